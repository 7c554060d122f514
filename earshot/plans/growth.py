"""Queries of what grows and is kept up: scans that build a library, browse lists, fingerprints, clusters, ordered mixes, live sections, batches, and searches joined laterally."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from earshot.functions import lateral
from earshot.operators import clock as ck
from earshot.operators import clusters as cl
from earshot.operators import mixes as mx
from earshot.operators import moments as mo
from earshot.operators import tours as tr
from earshot.operators import upkeep as up
from earshot.operators.taste import nearest
from earshot.plans.mixes import _assigned, _scores
from earshot.plans.mixes import ORACLE as _MIXES
from earshot.plans.details import ORACLE as _DETAILS
from earshot.plans.models import _CEN, _COS, _centroids
from earshot.plans.session import scratch
from earshot.plans.sql import TRACKS
from earshot.plans.upkeep import ORACLE as _UPKEEP
from earshot.sources.tables import as_listens, fingerprints, listens, read, stats, tracks
from earshot.streaming import browse as br
from earshot.streaming import listening as st
from earshot.streaming import scans as sc
from earshot.streaming import stateful as sf

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_lists(spark, run):
    """Run something whose streams need the RocksDB state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def scan_folder(spark, sf_dir: str):
    """Three scans of a library that changes, as files of a stream, two files a scan and one row at its end: some tracks are new, some gone, some touched, and titles tell the scan."""
    t = tracks(spark, sf_dir).select("path", "title", "mtime", "year", "seq")
    at = scratch(spark, "scans")
    there = {1: "year < 1990", 2: "year > 1955", 3: "year > 1960 and seq % 7 <> 0"}
    for g, where in there.items():
        touched = F.when(F.col("seq") % 5 == g, F.col("mtime") + g).otherwise(F.col("mtime"))
        rows = t.where(where).select(F.lit(g).cast("long").alias("generation"), "path", touched.alias("mtime"), F.concat("title", F.lit(f" {g}")).alias("title"), "seq")
        for k in range(2):
            rows.where(f"seq % 2 = {k}").drop("seq").coalesce(1).write.mode("append").parquet(at)
        spark.createDataFrame([(g, None, None, None)], "generation long, path string, mtime double, title string").coalesce(1).write.mode("append").parquet(at)
    return at


def scan_stream(spark, at: str):
    schema = "generation long, path string, mtime double, title string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def _scan_library(spark, sf_dir):
    return sc.keep_library(scan_stream(spark, scan_folder(spark, sf_dir)), scratch(spark, "scanned")).select("path", "mtime", "title", "generation")


def _scan_removed(spark, sf_dir):
    folder = scratch(spark, "scanned")
    sc.keep_library(scan_stream(spark, scan_folder(spark, sf_dir)), folder)
    return sc.removed(spark, f"{folder}/library").select("path", "generation")


def _clusters(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    return nearest(fp, cl.auto_clusters(fp)).drop("v")


def _recipe_flow(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    chosen = up.recipe(fp, spark.createDataFrame([(3,), (7,), (11,)], "id long"), fp.select("id", ((F.col("label") - 4.5) / 10).alias("score")), 60)
    return tr.ordered_mix(fp, chosen, "flow", 3)


def _supermix(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    return tr.supermix(fp, mx.representatives(_assigned(spark, sf_dir), _centroids(spark, sf_dir), 1).select("cluster", "id"))


def _discover_flow(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    return tr.ordered_mix(fp, mx.discover(fp, _scores(spark, sf_dir), listens(spark, sf_dir).where("track % 3 <> 0"), 40))


def browse_parts(spark, sf_dir: str):
    """Statistics of tracks, playlists, and which tenth of the changes each row comes in."""
    rated = stats(spark, sf_dir).join(tracks(spark, sf_dir).select("seq"), "seq")
    lists = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("seq")).distinct()
    return rated.select("seq", "last_played", "rating"), lists


def browse_batches(spark, sf_dir: str, folder: str):
    """Browse lists begun with what changed before, then kept up over five batches, in which tracks are played again and rated anew, and playlists lose and gain places."""
    rated, lists = browse_parts(spark, sf_dir)
    old = rated.select("seq", (F.col("last_played") - F.when(F.col("seq") % 3 == 0, 50_000_000).otherwise(0)).alias("last_played"), F.when(F.col("seq") % 4 == 1, 5).otherwise(F.col("rating")).alias("rating"))
    before = lists.where("id % 5 <> 0").select("id", "pos", F.when(F.col("pos") % 4 == 0, F.lit(1)).otherwise(F.col("seq")).cast("long").alias("seq"))
    extra = lists.where("id % 7 = 1").select("id", (F.col("pos") + 900_000_000).alias("pos"), "seq")
    kept = br.BrowseLists(spark, folder, lambda: br.entries_of_stats(rated).unionByName(br.entries_of_playlists(lists)))
    kept.whole, whole = (lambda: br.entries_of_stats(old).unionByName(br.entries_of_playlists(before.unionByName(extra)))), kept.whole
    kept.begin()
    kept.whole = whole
    none = spark.createDataFrame([], "seq long")
    for k in range(5):
        s = rated.where((F.col("seq") % 5 == k) & ((F.col("seq") % 3 == 0) | (F.col("seq") % 4 == 1))).withColumn("version", F.lit(k))
        p = lists.where((F.pmod(F.xxhash64("id"), F.lit(5)) == k) & ((F.col("id") % 5 == 0) | (F.col("pos") % 4 == 0)))
        out = extra.where(F.pmod(F.xxhash64("id"), F.lit(5)) == k).select("id", "pos", F.lit(None).cast("long").alias("seq"))
        kept.merge(k, s, p.unionByName(out).withColumn("version", F.lit(k)), none)
    return kept


def _fingerprints_grown(spark, sf_dir):
    """Three batches: half of the vectors, a little more, then the rest; the last batch makes all fingerprints due."""
    raw = fingerprints(spark, sf_dir).select("id", "v", "bpm")
    state, prints = None, raw.select("id", F.col("v").cast("array<double>").alias("v"), "bpm", F.lit(0).cast("long").alias("made_by")).where("false")
    had = raw.where("false")
    for where in ("id % 2 = 0", "id % 20 = 1", "id % 2 = 1 and id % 20 <> 1"):
        new = raw.where(where)
        state = tr.stored(mo.state_of(new) if state is None else mo.merged(state, mo.state_of(new)), "state")
        had = had.unionByName(new)
        prints = tr.stored(mo.refreshed(prints, had, state).drop("anew"), "prints")
    return prints.select("id", F.posexplode("v").alias("dim", "x"))


def _samples(events):
    """Energy samples of a stream of events: each listener is a track, played from its first second on, a sample a bucket and more."""
    return events.select(F.col("user_id").alias("id"), F.timestamp_seconds(F.col("seq") * 2).alias("at"), (F.col("seq") * 2.0).alias("position"), (F.least(F.lit(300.0), F.col("value")) / 300).alias("energy"))


def _live_sections(spark, sf_dir):
    def run():
        e = as_listens(st.events_stream(spark, f"{sf_dir}/events.parque[t]"))
        return st.drain(sf.live_sections(sf.bucket_energy(_samples(e))), scratch(spark, "sections")).drop("batch")

    return with_state_lists(spark, run)


def _batches(spark, sf_dir):
    def run():
        e = as_listens(st.events_stream(spark, f"{sf_dir}/events.parque[t]"))
        rows = e.select(F.col("kind").alias("source"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("path"), F.lit(True).alias("done"))
        return st.drain(sf.batches(rows, 70, 10**9, 10**9), scratch(spark, "batches"), once=True).select("source", "number", "why", F.size("paths").cast("long").alias("n"), F.element_at("paths", 1).alias("first"), F.element_at("paths", -1).alias("last"))

    return with_state_lists(spark, run)


def _log(spark, sf_dir):
    def run():
        return st.drain(sf.bounded_log(as_listens(st.events_stream(spark, f"{sf_dir}/events.parque[t]")), 50), scratch(spark, "log"), "update").drop("batch")

    return with_state_lists(spark, run)


def _long_words(text: str):
    """A result for every word of 14 letters and more; shorter ones from 13 letters on have no address."""
    for word in re.findall("[a-z]+", text):
        if len(word) >= 13:
            yield {"url": f"word:{word}" if len(word) >= 14 else "", "title": word, "duration": len(word)}


def _strict(text: str):
    """The first word; a text with a digit is an error."""
    if re.search("[0-9]", text):
        raise ValueError("a digit")
    word = re.search("[a-z]+", text)
    if word:
        yield {"url": f"first:{word[0]}", "artist": "reader"}


def _lateral(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = lateral.searched(docs, "text", {"long": lateral.search_function("long", _long_words), "strict": lateral.search_function("strict", _strict)})
    return found.groupBy("doc_id", "function").agg(F.count("url").alias("n"), F.min("url").alias("first"), F.max("artist").alias("artist"), F.sum("duration").alias("duration"), F.max("error").alias("error"))


QUERIES: dict = {
    "scan_library": _scan_library,
    "scan_removed": _scan_removed,
    "best_clusters": _clusters,
    "recipe_flow": _recipe_flow,
    "supermix": _supermix,
    "discover_flow": _discover_flow,
    "browse_kept": lambda s, d: browse_batches(s, d, scratch(s, "browse")).shown(),
    "fingerprints_grown": _fingerprints_grown,
    "vector_state": lambda s, d: mo.merged(*[mo.state_of(fingerprints(s, d).where(f"id % 3 = {k}")) for k in range(3)]),
    "live_sections": _live_sections,
    "stream_batches": _batches,
    "stream_log": _log,
    "clock_by_segments": lambda s, d: ck.clock(listens(s, d).where("user_id % 3 = 0").withColumn("user_id", F.lit(0).cast("long"))),
    "clock_segments": lambda s, d: ck.segments(listens(s, d), 512).select("user_id", "hour", "segment", F.size("kinds").cast("long").alias("n"), F.explode("counts").alias("c")).select("user_id", "hour", "segment", "n", "c.kind", F.col("c.n").alias("of_kind")),
    "lateral_search": _lateral,
}

_SCANS = f"""{TRACKS}, g as (select 1 as g union all select 2 union all select 3),
f as (select path, g, mtime + case when seq % 5 = g then g else 0 end as mtime, title || ' ' || g as title from t, g where (g = 1 and year < 1990) or (g = 2 and year > 1955) or (g = 3 and year > 1960 and seq % 7 <> 0)),
c as (select *, lag(mtime) over (partition by path order by g) as was, lag(g) over (partition by path order by g) as was_g from f),
h as (select *, max(case when was is null or was <> mtime or was_g <> g - 1 then g end) over (partition by path order by g) as since from c)"""
_FLOW = """st as (select id from {chosen} order by {first} limit 1),
w as (select fp.id, v, case when bpm <= 0 then 0 when bpm < 70 then bpm * 2 when bpm >= 180 then bpm / 2 else bpm end::double as b from fp where id in (select id from {chosen})),
costs as (select x.id as a, y.id as b, 1 - {cos} + case when x.b > 0 and y.b > 0 then least(abs(x.b - y.b) / 8, 1.5) else 0 end as cost from w x join w y on x.id <> y.id),
tour as (select 0 as pos, id, [id] as used from st union all
  select pos + 1, b, list_append(used, b) from (select tour.pos, tour.used, costs.b, row_number() over (order by costs.cost, costs.b) as rn from tour join costs on costs.a = tour.id where not list_contains(tour.used, costs.b)) where rn = 1)
select pos, id from tour"""


def _flow_sql(before: str, chosen: str, first: str) -> str:
    body = before.strip()
    return f"with recursive {body}, " + _FLOW.format(chosen=chosen, first=first, cos=_COS("x.v", "y.v"))


def _inner(sql: str, name: str) -> str:
    """A query's parts, with its last select as a part called name."""
    head, _, last = sql.strip().removeprefix("with ").rpartition(") select ")
    return f"{head}), {name} as (select {last})"


_MIX = f"""{_CEN}, reps as (select cluster, id, v, row_number() over (partition by cluster order by {_COS('v', 'c')} desc, id) as rn from fp join ce on cluster = label),
s as (select cluster, id as seed, v as q from reps where rn = 1 order by cluster limit 8), x as (select id, max({_COS('v', 'q')}) as near from fp, s group by id),
chosen as (select id, 0.75::double * near + case when id in (select seed from s) then 1 else 0 end as score from x order by score desc, id limit 80)"""

ORACLE: dict[str, str] = {
    "recipe_flow": _flow_sql(_inner(_UPKEEP["recipe"], "chosen"), "chosen", "id = 3 desc, score desc, id"),
    "supermix": _flow_sql(_MIX, "chosen", "id = (select arg_min(seed, cluster) from s) desc"),
    "discover_flow": _flow_sql(_inner(_MIXES["discover_pool"], "chosen"), "chosen", "score desc, id"),
    "scan_library": f"with {_SCANS} select h.path, h.mtime, f.title, 3 as generation from h join f on f.path = h.path and f.g = h.since where h.g = 3",
    "scan_removed": f"with {_SCANS} select path, g + 1 as generation from f where g < 3 and not exists (select 1 from f n where n.path = f.path and n.g = f.g + 1)",
    "browse_kept": _DETAILS["browse_lists"].replace("from lineitem join", "from (select distinct l_orderkey, l_partkey, l_linenumber from lineitem) join"),
    "fingerprints_grown": _MIXES["zscore_fingerprints"],
    "vector_state": "with l as (select unnest(embedding)::double as x, unnest(range(0, len(embedding)))::int as dim from embeddings) select dim, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as m2 from l group by dim",
    "stream_batches": """with e as (select case event_type when 'purchase' then 'Like' when 'signup' then 'AddedManually' when 'view' then 'FullPlay' when 'click' then 'SkipMid' when 'error' then 'SkipEarly' end as source, lpad(event_id::varchar, 12, '0') as path from events),
r as (select *, (row_number() over (partition by source order by path) - 1) // 70 as number from e)
select source, number, case when count(*) = 70 then 'count' else 'done' end as why, count(*) as n, min(path) as first, max(path) as last from r group by source, number""",
    "stream_log": "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as back, count(*) over (partition by user_id) as events from events) select user_id, events, count(*) as held, min(event_id) as first_seq, max(event_id) as last_seq from r where back <= 50 group by user_id, events",
    "clock_segments": """with e as (select user_id, (floor(epoch(ts))::bigint // 3600 % 24)::bigint as hour, event_id // 512 as segment, case event_type when 'purchase' then 'Like' when 'signup' then 'AddedManually' when 'view' then 'FullPlay' when 'click' then 'SkipMid' when 'error' then 'SkipEarly' end as kind from events),
c as (select user_id, hour, segment, kind, count(*) as of_kind from e where kind is not null group by all) select user_id, hour, segment, (sum(of_kind) over (partition by user_id, hour, segment))::bigint as n, kind, of_kind from c""",
    "lateral_search": """with w as (select doc_id, unnest(regexp_extract_all(text, '[a-z]+')) as w from documents),
l as (select doc_id, 'long' as function, count(*) as n, 'word:' || min(w) as first, 'long' as artist, sum(len(w))::double as duration, null as error from w where len(w) >= 14 group by doc_id),
s as (select doc_id, 'strict' as function, case when bad then 0 else 1 end as n, case when not bad then 'first:' || w end as first, case when not bad then 'reader' end as artist, case when not bad then 0.0 end::double as duration, case when bad then 'a digit' end as error
  from (select doc_id, regexp_matches(text, '[0-9]') as bad, nullif(regexp_extract(text, '[a-z]+'), '') as w from documents where text is not null) where bad or w is not null)
select * from l union all select * from s""",
}
