"""Queries of the taste model, the planners and the streams, with SQL where SQL can express them. Others are tested by brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.functions.text import camelot_distance
from earshot.operators import taste as m
from earshot.operators import vectors as v
from earshot.plans.session import scratch
from earshot.plans.sql import EVENTS, TRACKS
from earshot.sources import stores
from earshot.sources.tables import as_listens, as_tracks, fingerprints, listens, read, tracks
from earshot.streaming import listening as st


def _lists(s, d):
    """Each order is a set of distinct tracks (list, id)."""
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_partkey").alias("id")).distinct()


def _tempo_and_key(k):
    return (60 + k * 7 % 140).cast("double"), F.concat((1 + k % 12).cast("string"), F.when(k % 2 == 0, "A").otherwise("B"))


def _set_tracks(s, d):
    """The lists' tracks with bpm, camelot, energy and a vector."""
    k = F.col("id")
    bpm, camelot = _tempo_and_key(k)
    t = _lists(s, d).withColumns({"bpm": bpm, "camelot": camelot, "energy": (k % 50) / 49.0})
    return t.join(fingerprints(s, d).select(F.col("id").alias("vec"), "v"), F.col("vec") == F.col("id") % 500).drop("vec")


def _hand_overs(s, d):
    """Tracks with the one before in their list. Only ids are sorted; what is known of a track, and its vector, comes after."""
    vectors = fingerprints(s, d).where("id < 500")  # a track takes the vector of its id modulo 500, so others meet none
    known = _lists(s, d).join(vectors.select(F.col("id").alias("vec")), F.col("vec") == F.col("id") % 500, "left_semi")
    t = known.withColumn("id_a", F.lag("id").over(Window.partitionBy("list").orderBy("id"))).where("id_a is not null")
    for own in ("id", "id_a"):
        end = own[2:]
        t = t.withColumns({f"bpm{end}": _tempo_and_key(F.col(own))[0], f"camelot{end}": _tempo_and_key(F.col(own))[1]})
        t = t.join(vectors.select(F.col("id").alias("vec"), F.col("v").alias(f"v{end}")), F.col("vec") == F.col(own) % 500).drop("vec")
    return t.select("list", "id", camelot_distance("camelot_a", "camelot").alias("keys"), m.transition_score("bpm_a", "camelot_a", "bpm", "camelot").alias("score"), m.transition_cost("v_a", "bpm_a", "v", "bpm").alias("cost"))


def _centroids(s, d):
    return m._means(fingerprints(s, d).select(F.col("label").alias("cluster"), "v"))


def _features(s, d):
    unit = lambda i: F.least(F.lit(1.0), F.abs(F.col("v")[i].cast("double")) * 3)
    return fingerprints(s, d).select("id", F.when(F.col("id") % 50 == 0, 0.0).otherwise(F.col("bpm").cast("double")).alias("bpm"), *[unit(i).alias(t) for i, t in enumerate(m.TARGETS)])


def _stream(s, d, name, of, mode):
    return st.drain(of(as_listens(st.events_stream(s, f"{d}/events.parque[t]"))), scratch(s, name), mode)


def _latest(df, *keys):
    """Of what an update stream gave out, the rows of each key's last batch."""
    last = df.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return df.join(last, [*keys, "batch"]).drop("batch")


QUERIES: dict = {
    "hand_overs": _hand_overs,
    "musical_keys": lambda s, d: m.musical_keys(fingerprints(s, d).select("id", F.slice("v", 1, 12).alias("chroma"))),
    "track_genres": lambda s, d: m.genres(_features(s, d)).drop("confidence", "bpm"),
    "genre_confidence": lambda s, d: m.genres(_features(s, d)).select("id", "confidence", "bpm"),
    "taste_scores": lambda s, d: m.taste_scores(fingerprints(s, d), _centroids(s, d).select(F.when(F.col("cluster") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("c").alias("v"), (F.col("cluster") + 1.0).alias("mass"))),
    "nearest_centroid": lambda s, d: m.nearest(fingerprints(s, d), _centroids(s, d)).drop("v"),
    "cluster_silhouette": lambda s, d: m.silhouette(fingerprints(s, d), _centroids(s, d)),
    "kmeans_clusters": lambda s, d: m.nearest(fingerprints(s, d), m.spherical_kmeans(fingerprints(s, d), 8)).drop("v"),
    "online_model": lambda s, d: m.online_model(listens(s, d), fingerprints(s, d)).select("user_id", "side", "centroid", F.posexplode("v").alias("dim", "x"), "mass"),
    "flow_order": lambda s, d: m.flow_order(_set_tracks(s, d)),
    "endless_set": lambda s, d: m.endless_set(_set_tracks(s, d)),
    "energy_set": lambda s, d: m.energy_set(_set_tracks(s, d), "peak", True, 12.0),
    "stream_counters": lambda s, d: _latest(_stream(s, d, "counters", st.counters, "update"), "track"),
    "stream_sessions": lambda s, d: _stream(s, d, "sessions", st.finished_sessions, "append").drop("batch"),
    "stream_clock": lambda s, d: _latest(_stream(s, d, "clock", st.hourly_clock, "update"), "user_id", "hour"),
    "event_log": lambda s, d: st.event_log(listens(s, d), 20).select("user_id", "seq", "back"),
    "last_played": lambda s, d: st.last_played(listens(s, d)),
    "stream_last_played": lambda s, d: _latest(_stream(s, d, "last", st.last_played, "update"), "user_id", "track"),
    "stream_scan": lambda s, d: st.drain(stores.scanned(as_tracks(st.events_stream(s, f"{d}/part.parque[t]")).select("path", "mtime"), tracks(s, d).where("year < 1980").select("path", (F.col("mtime") + (F.col("seq") % 4 == 0).cast("int")).alias("mtime"))), scratch(s, "scan")).drop("batch"),
    "json_round_trip": lambda s, d: stores.from_json(stores.as_json(fingerprints(s, d).select("id", "bpm", "v"), "id"), "bpm double, v array<float>").select("id", "bpm", F.posexplode("v").alias("dim", "x")),
    "sections_exported": lambda s, d: stores.section_files(tracks(s, d).select("title", "artist", "path", F.col("duration").alias("length"), F.lit(120.0).alias("bpm"), F.lit(0.5).alias("first_beat"), F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.5).alias("end"), F.lit(1).alias("tier"), F.lit("A").alias("label"))).alias("sections"))).select("name", F.get_json_object("text", "$.path").alias("path"), F.get_json_object("text", "$.sections[0].endSec").cast("double").alias("end_sec")),
    "media_rows": lambda s, d: stores.below(stores.media_rows(tracks(s, d).select("path", F.when(F.col("seq") % 3 == 0, "<unknown>").when(F.col("seq") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "artist")).alias("artist")), "artist"), "/lib/PROMO").withColumn("album", stores.folder_album("path")),
    "settings_backup": lambda s, d: stores.backup(read(s, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "our-").otherwise("x-"), "n_name").alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey").cast("string")).alias("value")), "our-"),
    "stream_model": lambda s, d: _latest(_stream(s, d, "model", lambda e: st.taste_model(e, fingerprints(s, d)), "update"), "user_id").select("user_id", "side", "centroid", "mass"),
    "bucket_counts": lambda s, d: st.bucket_means(listens(s, d), "6 hours"),
}

_FP = "fp as (select vec_id as id, embedding::double[] as v, (60.0 + (vec_id * 7) % 140)::double as bpm, label from embeddings)"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
_COS = lambda a, b: f"({_DOT.format(a=a, b=b)} / sqrt({_DOT.format(a=a, b=a)} * {_DOT.format(a=b, b=b)}))"
_CEN = f"""{_FP}, l as (select label, unnest(v) as x, unnest(range(0, len(v))) as dim from fp), cm as (select label, dim, avg(x) as x from l group by 1, 2),
  cn as (select label, list(x order by dim) as c0, sqrt(sum(x * x)) as n from cm group by 1), ce as (select label as cluster, list_transform(c0, lambda x: x / n) as c from cn)"""
_PAIR = f"{_CEN}, pr as (select id, cluster, {_COS('v', 'c')} as sim from fp, ce)"
_num = lambda x: "null::double" if x is None else f"{x}::double"
_PROTO = ", ".join("(" + ", ".join([f"'{p[0]}'", f"'{p[1]}'", *map(_num, p[2:])]) + ")" for p in m.PROTOTYPES)
_BELL = lambda k: f"exp(-0.5::double * pow((f.bpm * {k} - p.pb) / p.tol, 2))"
_TONES = ", ".join(f"('{m.NOTES[r]} {name}', '{wheel[r]}{ring}', {2 * r + k}, {[p[(i - r) % 12] for i in range(12)]}::double[])" for k, (name, ring, p, wheel) in enumerate((("major", "B", m.MAJOR, m.WHEEL_MAJOR), ("minor", "A", m.MINOR, m.WHEEL_MINOR))) for r in range(12))
_CENTRED = lambda c: f"list_transform({c}, lambda x: x - list_avg({c}))"
_FOLD = lambda b: f"case when {b} < 70 then {b} * 2 when {b} >= 180 then {b} / 2 else {b} end"

ORACLE: dict[str, str] = {
    "hand_overs": f"""with {_FP}, ls as (select distinct l_orderkey as list, l_partkey as k from lineitem), st as (select list, k, (60 + k * 7 % 140)::double as bpm, 1 + k % 12 as num, k % 2 as ring, v from ls join fp on fp.id = k % 500),
      h as (select *, lag(k) over w as ka, lag(bpm) over w as ba, lag(num) over w as na, lag(ring) over w as ra, lag(v) over w as va from st window w as (partition by list order by k)),
      q as (select *, least((na - num + 12) % 12, 12 - (na - num + 12) % 12) as wh, ba / bpm as ratio from h where ka is not null),
      r as (select *, (case when wh = 0 then case when ra = ring then 0 else 1 end else wh + case when ra = ring then 0 else 2 end end)::int as keys from q)
      select list, k as id, keys, least(1, greatest(0, 0.45::double * greatest(0, least(1, 1 - abs(ratio - 1) / 0.12::double)) + 0.35::double * greatest(0, 1 - keys / 4.0::double) + 0.20::double)) as score,
        1 - {_COS('va', 'v')} + least(abs({_FOLD('ba')} - {_FOLD('bpm')}) / 8, 1.5::double) as cost from r""",
    "musical_keys": f"""with {_FP}, pf(key, camelot, rank, p) as (values {_TONES}), x as (select id, {_CENTRED('v[1:12]')} as x from fp), y as (select key, camelot, rank, {_CENTRED('p')} as y from pf),
      r as (select id, key, camelot, rank, {_DOT.format(a='x', b='y')} / sqrt({_DOT.format(a='x', b='x')} * {_DOT.format(a='y', b='y')}) as r from x, y),
      o as (select *, row_number() over (partition by id order by r desc, rank) as rn, lead(r) over (partition by id order by r desc, rank) as second from r)
      select id, key, camelot, greatest(0, least(1, (r - second) * 3)) as confidence from o where rn = 1""",
    "track_genres": f"""with {_FP}, p(sub, genre, pb, tol, t1, t2, t3, t4, t5, t6, t7, w) as (values {_PROTO}), f as (select id, case when id % 50 = 0 then 0.0 else bpm end::double as bpm, list_transform(v[1:7], lambda x: least(1.0::double, abs(x) * 3)) as f from fp),
      x as (select f.id, sub, genre, f.bpm, w, {_BELL('1.0')} as one, {_BELL('0.5')} as half, {_BELL('2.0')} as dbl,
        list_avg(list_filter([{', '.join(f'case when t{i} is not null then greatest(0, 1 - abs(f[{i}] - t{i})) end' for i in range(1, 8))}], lambda z: z is not null)) as feat from f, p),
      y as (select id, sub, genre, round((w * case when bpm <= 0 then 0.3::double else greatest(one, half, dbl) end + feat) / (w + 1), 9) as score, case when bpm <= 0 then 1.0 when dbl > one and dbl >= half then 2.0 when half > one and half >= dbl then 0.5 else 1.0 end::double as octave from x)
      select id, genre, sub as subgenre, score, octave from (select *, row_number() over (partition by id order by score desc, sub desc) as rn from y) where rn = 1""",
    "genre_confidence": f"""with {_FP}, p(sub, genre, pb, tol, t1, t2, t3, t4, t5, t6, t7, w) as (values {_PROTO}), f as (select id, case when id % 50 = 0 then 0.0 else bpm end::double as bpm, list_transform(v[1:7], lambda x: least(1.0::double, abs(x) * 3)) as f from fp),
      x as (select f.id, sub, genre, f.bpm, w, {_BELL('1.0')} as one, {_BELL('0.5')} as half, {_BELL('2.0')} as dbl,
        list_avg(list_filter([{', '.join(f'case when t{i} is not null then greatest(0, 1 - abs(f[{i}] - t{i})) end' for i in range(1, 8))}], lambda z: z is not null)) as feat from f, p),
      y as (select id, bpm, sub, round((w * case when bpm <= 0 then 0.3::double else greatest(one, half, dbl) end + feat) / (w + 1), 9) as score, bpm > 0 and dbl > one and dbl >= half as twice from x),
      z as (select *, row_number() over (partition by id order by score desc, sub desc) as rn, lead(score) over (partition by id order by score desc, sub desc) as second from y)
      select id, least(1, greatest(0, 0.35::double + 2 * case when second > 0 then greatest(0, score - second) else score end)) as confidence, case when twice and bpm * 2 <= 240 then bpm * 2 else bpm end as bpm from z where rn = 1""",
    "taste_scores": f"with {_PAIR}, s as (select id, cluster % 2 as odd, max(sim * (cluster + 1.0::double) / (cluster + 4.0::double)) as b from pr group by 1, 2) select id, coalesce(max(b) filter (odd = 0), 0) - 0.8::double * coalesce(max(b) filter (odd = 1), 0) as score from s group by id",
    "nearest_centroid": f"with {_PAIR} select id, arg_max(cluster, sim) as cluster, max(sim) as sim from pr group by id",
    "cluster_silhouette": f"with {_PAIR}, q as (select id, 1 - sim as d, row_number() over (partition by id order by 1 - sim) as rn from pr), w as (select id, min(d) filter (rn = 1) as own, min(d) filter (rn = 2) as other from q group by id) select avg(case when greatest(own, other) > 1e-9 then (other - own) / greatest(own, other) else 0 end) as silhouette from w",
    "stream_counters": f"with {EVENTS} select track, count(*) filter (kind not like 'Skip%') as plays, least(10, count(*) filter (kind like 'Skip%'))::bigint as skips, max(ts) as last_played from e where track is not null group by track",
    "stream_sessions": """with x as (select user_id, event_id as seq, floor(epoch(ts))::bigint as ts, json_extract_string(props, '$.k')::bigint as track from events),
      g as (select *, case when row_number() over w > 1 and lag(track) over w is not distinct from track then 0 else 1 end as turn from x window w as (partition by user_id order by seq)),
      r as (select *, sum(turn) over (partition by user_id order by seq) as n from g), t as (select *, max(n) over (partition by user_id) as top from r)
      select user_id, any_value(track) as track, min(ts) as start, max(ts) as finish, count(*) as events from t where n < top group by user_id, n""",
    "event_log": "select user_id, event_id as seq, (rn - 1)::int as back from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn <= 20",
    **{k: "select user_id, json_extract_string(props, '$.k')::bigint as track, max(floor(epoch(ts))::bigint) as ts from events where event_type not in ('purchase', 'signup') and json_extract_string(props, '$.k') is not null group by 1, 2" for k in ("last_played", "stream_last_played")},
    "stream_scan": f"with {TRACKS} select path, mtime, case when year < 1980 and seq % 4 <> 0 then 'unchanged' else 'changed' end as state from t",
    "json_round_trip": "select vec_id as id, (60.0 + (vec_id * 7) % 140)::double as bpm, unnest(range(0, len(embedding)))::int as dim, unnest(embedding) as x from embeddings",
    "sections_exported": f"with {TRACKS} select regexp_replace(title, '[^\\w.-]+', '_', 'g') || '.sections.json' as name, path, duration * 0.5::double as end_sec from t",
    "media_rows": f"with {TRACKS} select path, case when seq % 3 = 2 then artist end as artist, artist as album from t where starts_with(path, '/lib/PROMO/')",
    "settings_backup": "select 'our-' || n_name as key, n_nationkey::varchar as value from nation where n_nationkey % 2 = 0 and n_nationkey % 3 <> 0",
    "bucket_counts": "select (floor(epoch(ts))::bigint // 21600 * 21600)::bigint as start, user_id, avg(value) as mean, count(*) as n from events group by 1, 2",
}
