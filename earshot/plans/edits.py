"""Queries of edited queues, playlists and sections, with their SQL. Arrays come out as text or as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import edits as e
from earshot.operators import recommend as r
from earshot.plans.models import _FP
from earshot.plans.sql import TRACK_STATS
from earshot.sources.tables import fingerprints, read, stats, tracks

LEAST = 0.06


def _queues(s, d):
    """Orders as queues: items in order of line, some repeated, a current one, and two places."""
    li = read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 40).alias("x")).alias("e"))
    q = li.groupBy("id").agg(F.sort_array(F.collect_list("e"))["x"].alias("items"))
    k = F.col("id")
    return q.withColumns({"index": (k % 9 - 1).cast("int"), "at": (k % 5).cast("int"), "to": (k % 3).cast("int"), "more": F.array(k % 40, k % 7, k % 40)}).withColumn("index", F.least("index", F.size("items") - 1))


def _text(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def _sections(s, d):
    k = F.col("id")
    part = lambda n, a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), ((k + n) % 3).cast("int").alias("tier"), F.lit(f"S{n}").alias("label"), ((k * (n + 3)) % 10 / 10.0).alias("energy"))
    parts = F.array(part(0, 0.0, 0.2), part(1, 0.2, 0.5), part(2, 0.5, 0.8), part(3, 0.8, 1.0))
    return fingerprints(s, d).select("id", F.col("bpm").cast("double").alias("bpm"), parts.alias("parts"), (k % 97 / 97.0).alias("at"), (k % 4).cast("int").alias("i"), (100.0 + k % 300).alias("length"), (k % 7 * 0.1).alias("first"))


def _rows(df):
    return df.select("id", F.posexplode("x").alias("k", "y")).select("id", "k", "y.start", "y.end", "y.tier", "y.label")


def _entries(s, d):
    q = _queues(s, d).select("id", F.posexplode("items").alias("pos", "x"))
    return q.select("id", "pos", (F.col("x") + 1).alias("seq")).join(r.with_stats(tracks(s, d), stats(s, d)).select("seq", "plays", "mtime"), "seq")


QUERIES: dict = {
    "queue_moved": lambda s, d: _queues(s, d).select("id", _text(e.moved("items", "at", "to")).alias("items"), e.index_after_move("items", "index", "at", "to").alias("index")),
    "queue_removed": lambda s, d: _queues(s, d).select("id", _text(e.removed("items", "at")).alias("items"), e.index_after_removal("items", "index", "at").alias("index")),
    "queue_added": lambda s, d: _queues(s, d).select("id", _text(e.added("items", "more")).alias("last"), _text(e.played_next("items", "index", "more")).alias("next"), _text(e.without_upcoming("items", "index")).alias("heard")),
    "queue_deduplicated": lambda s, d: _queues(s, d).select("id", _text(e.deduplicated("items")).alias("items"), e.index_after_dedup("items", "index").alias("index")),
    "queue_shuffled": lambda s, d: _queues(s, d).select("id", _text(e.shuffled_upcoming("items", "index", 5)).alias("items")),
    "playlist_appended": lambda s, d: _queues(s, d).select("id", _text(e.appended_unseen("items", "more")).alias("items")),
    **{f"playlist_{m}": (lambda s, d, m=m: e.play_order(_entries(s, d), m).select("id", "pos", "place")) for m in ("reverse", "plays", "newest")},
    "sections_split": lambda s, d: _rows(_sections(s, d).select("id", e.split_sections("parts", "at", LEAST).alias("x"))),
    "sections_merged": lambda s, d: _rows(_sections(s, d).select("id", e.merged_sections("parts", "i").alias("x"))),
    "sections_moved": lambda s, d: _rows(_sections(s, d).select("id", e.moved_boundary("parts", "i", "at", LEAST).alias("x"))),
    "section_targets": lambda s, d: _sections(s, d).select("id", e.intro_target("parts", F.lit(1.0)).alias("intro"), e.next_drop("parts", "at").alias("next_drop"), e.snapped("at", "length", "bpm", "first").alias("bar"), e.snapped("at", "length", "bpm", "first", F.col("id") % 2 == 0).alias("beat"), e.bar_at("at", "length", "bpm", "first")["start"].alias("bar_start"), e.bar_at("at", "length", "bpm", "first")["end"].alias("bar_end")),
    "middle_items": lambda s, d: _queues(s, d).select("id", _text(e.middle("items", 3)).alias("items")),
    "sections_own": lambda s, d: e.replaced(_sections(s, d).select("id", "bpm"), fingerprints(s, d).where("id % 3 = 0").select("id", F.lit(99.0).alias("bpm")), "id", "bpm"),
}

_Q = """q0 as (select l_orderkey as id, list(l_partkey % 40 order by l_linenumber, l_partkey % 40) as items from lineitem group by 1),
  q as (select id, items, len(items)::int as n, least(id % 9 - 1, len(items) - 1)::int as i, (id % 5)::int as a, (id % 3)::int as b, [id % 40, id % 7, id % 40] as more from q0)"""
_T = lambda x: f"array_to_string(list_transform({x}, lambda z: z::varchar), ',')"
_S = """sn as (select vec_id as id, (60.0 + (vec_id * 7) % 140)::double as bpm, vec_id % 97 / 97.0::double as pt, (vec_id % 4)::int as i, 100.0::double + vec_id % 300 as length, vec_id % 7 * 0.1::double as first from embeddings),
  p as (select sn.*, n as k, [0.0::double, 0.2::double, 0.5::double, 0.8::double][n + 1] as s, [0.2::double, 0.5::double, 0.8::double, 1.0::double][n + 1] as e, ((id + n) % 3)::int as tier, 'S' || n as label, (id * (n + 3)) % 10 / 10.0::double as energy from sn, (select unnest(range(0, 4)) as n))"""
_NEXT = "case when i < 0 then more else items[1:i + 1] || more || items[i + 2:] end"
_PLACE = lambda by: f"with {TRACK_STATS}, {_Q}, en as (select id, unnest(items) + 1 as seq, unnest(range(0, n)) as pos from q) select id, pos::int as pos, (row_number() over (partition by id order by {by}) - 1)::int as place from en join ts using (seq)"

ORACLE: dict[str, str] = {
    "queue_moved": f"""with {_Q}, r as (select *, items[1:a] || items[a + 2:] as rest, a < n and b < n and a <> b as ok from q)
      select id, {_T('case when ok then rest[1:b] || [items[a + 1]] || rest[b + 1:] else items end')} as items, (case when not ok then i when i = a then b when a < i and b >= i then i - 1 when a > i and b <= i then i + 1 else i end)::int as index from r""",
    "queue_removed": f"with {_Q} select id, {_T('case when a < n then items[1:a] || items[a + 2:] else items end')} as items, (case when a >= n then i when n = 1 then -1 when a < i then i - 1 when a = i then least(i, n - 2) else i end)::int as index from q",
    "queue_added": f"with {_Q} select id, {_T('items || more')} as last, {_T(_NEXT)} as next, {_T('case when i < 0 or i >= n - 1 then items else items[1:i + 1] end')} as heard from q",
    "queue_deduplicated": f"with {_Q}, u as (select *, list_filter(items, lambda x, k: list_position(items, x) = k) as once from q) select id, {_T('once')} as items, (case when i >= 0 then list_position(once, items[i + 1]) - 1 else i end)::int as index from u",
    "queue_shuffled": f"""with {_Q}, t as (select *, case when n < 3 then items else items[1:greatest(i + 1, 0)] end as head, case when n < 3 then [] else items[greatest(i + 1, 0) + 1:] end as tail from q),
      x as (select id, unnest(tail) as v, unnest(range(0, len(tail))) as k from t), o as (select id, list(v order by md5('5:' || k || ':' || v), k) as sh from x group by id) select id, {_T('head || coalesce(sh, [])')} as items from t left join o using (id)""",
    "playlist_appended": f"with {_Q} select id, {_T('items || list_filter(more, lambda x: not list_contains(items, x))')} as items from q",
    "playlist_reverse": _PLACE("pos desc"), "playlist_plays": _PLACE("plays desc, pos"), "playlist_newest": _PLACE("mtime desc, pos"),
    "sections_split": f"""with {_S}, f as (select *, pt >= s and pt < e and pt - s >= {LEAST}::double and e - pt >= {LEAST}::double as cut from p),
      r as (select id, k * 2 as o, s, case when cut then pt else e end as e, tier, label from f union all select id, k * 2 + 1, pt, e, tier, label || ' ²' from f where cut) select id, (row_number() over (partition by id order by o) - 1)::int as k, s as start, e as end, tier, label from r""",
    "sections_merged": f"""with {_S}, j as (select *, case when i = 0 then 1 else i - 1 end as j, max(case when k = i then s end) over (partition by id) as gs, max(case when k = i then e end) over (partition by id) as ge from p)
      select id, (row_number() over (partition by id order by k) - 1)::int as k, case when k = j then least(s, gs) else s end as start, case when k = j then greatest(e, ge) else e end as end, tier, label from j where k <> i""",
    "sections_moved": f"""with {_S}, b as (select *, greatest(max(case when k = i then s end) over (partition by id) + {LEAST}::double, least(max(case when k = i + 1 then e end) over (partition by id) - {LEAST}::double, pt)) as b from p)
      select id, k::int as k, case when i < 3 and k = i + 1 then b else s end as start, case when i < 3 and k = i then b else e end as end, tier, label from b""",
    "section_targets": f"""with {_S}, g as (select id, any_value(pt) as pt, any_value(bpm) as bpm, any_value(length) as length, any_value(first) as first, min(s) filter (energy >= 0.4::double and s > 0.01::double and s < 0.34::double) as intro, coalesce(min(s) filter (tier = 2 and s > pt + 0.01::double), min(s) filter (tier = 2)) as next_drop from p group by id),
      h as (select *, 240.0::double / bpm as bar_s, case when id % 2 = 0 then 60.0::double / bpm else 240.0::double / bpm end as fine, greatest(0, first + floor((pt * length - first) / (240.0::double / bpm)) * (240.0::double / bpm)) as bs from g)
      select id, intro, next_drop, greatest(0, least(1, (first + floor((pt * length - first) / bar_s + 0.5::double) * bar_s) / length)) as bar, greatest(0, least(1, (first + floor((pt * length - first) / fine + 0.5::double) * fine) / length)) as beat, bs as bar_start, least(length, bs + bar_s) as bar_end from h""",
    "middle_items": f"with {_Q} select id, {_T('case when n > 3 then items[(n - 3) // 2 + 1:(n - 3) // 2 + 3] else items end')} as items from q",
    "sections_own": f"with {_FP} select id, case when id % 3 = 0 then 99.0 else bpm end::double as bpm from fp",
}
