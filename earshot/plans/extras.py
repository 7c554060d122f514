"""Queries of settings, presets, pools, named searches, fused lanes, caches and resets, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import lookups as lk
from earshot.operators import mixes as mx
from earshot.operators import settings as st
from earshot.operators import upkeep as up
from earshot.operators.clusters import auto_clusters
from earshot.plans.mixes import THEN, _liked
from earshot.plans.models import _CEN, _COS, _FP
from earshot.plans.session import scratch
from earshot.plans.sql import EVENTS, TRACKS
from earshot.sources import formats, stores
from earshot.sources.tables import fingerprints, listens, read, stats, tracks


def _knob_changes(s, d):
    """Events as changes of settings: purchases and signups choose a preset, views and clicks turn a knob."""
    e = read(s, d, "events")
    chosen = F.col("event_type").isin("purchase", "signup")
    return e.select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.when(chosen, F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string"))).alias("preset"),
        F.when(~chosen & (F.col("event_type") != "error"), F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("knob"), F.col("value"))


def _presets(s, d):
    """Presets of five names with three knobs each, from the smallest nations."""
    n = read(s, d, "nation").where("n_nationkey < 15")
    return n.select(F.concat(F.lit("p"), (F.col("n_nationkey") % 5).cast("string")).alias("preset"), F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 5).cast("string")).alias("knob"), (F.col("n_nationkey") * 10.0).alias("value"))


def _scene_texts(s, d):
    """Parts as scene files: wrapped, bare, without a name, without layers, and no JSON at all."""
    p = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"))
    layers = F.array(F.struct(F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"), F.lit("wave").alias("type"), (F.col("size") / 50).alias("opacity"), F.col("size").alias("x")), F.struct(F.lit("m").alias("id"), F.lit("text").alias("type"), F.lit(None).cast("double").alias("opacity"), F.lit(None).cast("double").alias("x")))
    wrapped = F.to_json(F.struct(F.lit("scene").alias("kind"), F.struct("name", layers.alias("layers")).alias("scene")))
    bare = F.to_json(F.struct("name", layers.alias("layers")))
    text = F.when(F.col("id") % 5 == 0, wrapped).when(F.col("id") % 5 == 1, bare).when(F.col("id") % 5 == 2, F.to_json(F.struct(layers.alias("layers")))).when(F.col("id") % 5 == 3, F.to_json(F.struct("name", F.lit("none").alias("layers")))).otherwise(F.concat(F.lit("{"), "name"))
    return p.select("id", text.alias("text"))


def _scenes(s, d):
    t = st.parsed_scenes(_scene_texts(s, d))
    one = F.explode_outer("layers").alias("l")
    return t.select("id", "name", "error", one).select("id", "name", "error", F.col("l.id").alias("layer"), "l.type", "l.visible", "l.opacity", "l.blend", "l.x", "l.scale", "l.props")


def _round_trip(s, d):
    t = st.parsed_scenes(_scene_texts(s, d)).where("error is null").select("id", "name", "layers")
    again = st.parsed_scenes(st.scene_files(t))
    return again.join(t.select("id", F.col("layers").alias("was")), "id").groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("layers") == F.col("was")).alias("same"), F.count("error").alias("errors"))


def _shown(s, d):
    p = read(s, d, "part").select(F.element_at(F.array(*[F.lit(x) for x in ("built", "user", "assigned", "device")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("source"), F.col("p_name").alias("name"), F.col("p_brand").alias("sub"), (F.col("p_size") % 2 == 0).alias("graphic"))
    kinds = [(c, q) for c in ("all", "graphic", "parametric", "user", "assigned", "device") for q in ("", " BRAND#1", "wi")]
    out = None
    for c, q in kinds:
        one = st.presets_shown(p, c, q).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("category"), F.lit(q).alias("search"), "n")
        out = one if out is None else out.union(one)
    return out


def _pool(s, d):
    t = tracks(s, d).select("seq", "genre", F.col("artist").alias("subgenre"))
    named = lambda df, n: df.select(F.lit(n).alias("pool"), "seq")
    return named(st.set_pool(t, "pRoMo"), 1).union(named(st.set_pool(t, subgenre="bRAND#13"), 2)).union(named(st.set_pool(t, "SMALL", "Brand#5"), 3)).union(named(st.set_pool(t), 4))


def _lanes(s, d):
    rated = stats(s, d).select(F.col("seq").alias("id"), "plays", "rating")
    return mx.fused_lanes(fingerprints(s, d), rated)


def _cache(s, d):
    """Tracks saved as a cache of JSON lines and read again, with one line of it broken."""
    at = scratch(s, "cache")
    stores.save_cache(tracks(s, d).select("path", "title", "year", "duration"), at, "disk")
    s.createDataFrame([("{broken",)], "line string").write.mode("append").text(f"{at}/rows")
    return formats.read_cache(s, f"{at}/rows", "path string, title string, year long, duration double").where("path is not null")


def _kinds(s, d):
    k = F.col("p_partkey")
    url = F.concat(F.when(k % 7 == 0, "ftp").when(k % 2 == 0, "http").otherwise("HTTPS"), F.lit("://host/"), k.cast("string"), F.when(k % 5 == 0, ".pls").when(k % 5 == 1, ".M3U8?x=1").when(k % 5 == 2, ".m3u").otherwise(".mp3"))
    return read(s, d, "part").select(k.alias("id"), formats.input_kind(url).alias("kind"))


def _reset(s, d):
    """What is left of each state after a reset: counts of rows."""
    at = scratch(s, "taste")
    states = {"model": _liked(s, d), "events": listens(s, d), "fingerprints": fingerprints(s, d), "recipes": read(s, d, "region")}
    stores.save_states(states, at)
    st.reset_taste(s, at)
    out = None
    for name in states:
        one = stores.read_table(s, f"{at}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("state"), "n")
        out = one if out is None else out.union(one)
    return out


def _recluster(s, d):
    """Whether clusters were made: at first, again for the same number of vectors, and for another number."""
    at, fp = scratch(s, "clusters"), fingerprints(s, d)
    rows = []
    for k, v in enumerate((fp, fp, fp.where("id % 10 <> 0"), fp.where("id % 10 <> 1"))):
        found, made = st.reclustered(v, at, auto_clusters)
        rows.append((k, v.count(), made, found.count() > 0))
    return s.createDataFrame(rows, "run int, vectors long, made boolean, some boolean")


def _presets_upserted(s, d):
    n = read(s, d, "nation")
    base = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("value"), F.lit(0).cast("long").alias("seen"))
    new = n.join(read(s, d, "region"), F.lit(True)).where("n_nationkey % 3 = 0 and r_regionkey < 3").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10 + F.col("r_regionkey")).cast("long").alias("value"), (F.col("r_regionkey") + 1).cast("long").alias("seen"))
    return lk.upserted(base, new, "name", "seen").orderBy("name")


_NAMED = {"mfcc4_mean": 1.0, "mfcc6_mean": -0.5, "mfcc12_mean": 2.0, "nobody": 9.0}
QUERIES: dict = {
    "knobs_now": lambda s, d: st.knobs_now(_knob_changes(s, d), _presets(s, d)),
    "scenes_parsed": _scenes,
    "scenes_round_trip": _round_trip,
    "presets_listed": _shown,
    "set_pools": _pool,
    "headphone_names": lambda s, d: tracks(s, d).select("seq", st.headphone_name(F.concat(F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("title")), F.when(F.col("seq") % 3 == 0, " ParametricEQ.txt").when(F.col("seq") % 3 == 1, " parametric eq.TXT").otherwise("  GraphicEQ.txt"))).alias("name")),
    "fused_by_taste": _lanes,
    "similar_unheard": lambda s, d: mx.similar_unheard(fingerprints(s, d), 7, listens(s, d), THEN, 25),
    "described_named": lambda s, d: mx.described_by_name(fingerprints(s, d), _NAMED, 25, 80, 180),
    "cache_read": _cache,
    "input_kinds": _kinds,
    "mass_decayed": lambda s, d: up.decayed(_liked(s, d), 1_000_000, 1_000_000 + 86_400 * 200, 0.8).select("side", "centroid", "mass"),
    "taste_reset": _reset,
    "clusters_kept": _recluster,
    "presets_upserted": _presets_upserted,
    "played_lately": lambda s, d: st.recent_list(stats(s, d), 30).withColumn("order", F.lit("newest")).union(st.recent_list(stats(s, d), 30, False).withColumn("order", F.lit("oldest"))),
    "long_enough": lambda s, d: st.lasting(tracks(s, d), 300.0).agg(F.count(F.lit(1)).alias("n")),
    "heard_by_both": lambda s, d: listens(s, d).where("kind = 'Like'").select("track").intersect(listens(s, d).where("kind = 'FullPlay'").select("track")).where("track is not null"),
}

_EQ = "case when seq % 4 = 0 then '' else title end"
ORACLE: dict[str, str] = {
    "knobs_now": """with c as (select user_id as owner, event_id as seq, case when event_type in ('purchase', 'signup') then 'p' || event_id % 5 end as preset, case when event_type in ('view', 'click') then 'k' || event_id % 4 end as knob, value from events),
p as (select 'p' || n_nationkey % 5 as preset, 'k' || n_nationkey // 5 as knob, n_nationkey * 10.0::double as value from nation where n_nationkey < 15),
l as (select owner, max(seq) as at, arg_max(preset, seq) as preset from c where preset is not null group by owner),
t as (select c.owner, c.knob, arg_max(c.value, c.seq) as v from c left join l using (owner) where c.knob is not null and (l.at is null or c.seq > l.at) group by 1, 2),
o as (select distinct owner from c),
b as (select o.owner, case when l.preset is null or exists (select 1 from t where t.owner = o.owner) then 'custom' else l.preset end as label from o left join l using (owner)),
v as (select owner, knob, coalesce(t.v, s.value) as value from (select l.owner, p.knob, p.value from l join p using (preset)) s full join t using (owner, knob))
select owner, label, knob, value from b join v using (owner)""",
    "scenes_parsed": """with p as (select p_partkey as id, p_name as name, p_size::double as size from part)
select id, name, null as error, 'l' || id as layer, 'wave' as type, true as visible, size / 50 as opacity, 'source-over' as blend, size as x, 1.0::double as scale, '{}' as props from p where id % 5 < 2
union all select id, name, null, 'm', 'text', true, 1.0, 'source-over', 0.0, 1.0, '{}' from p where id % 5 < 2
union all select id, null, case when id % 5 = 4 then 'not valid JSON' else 'not a scene' end, null, null, null, null, null, null, null, null from p where id % 5 > 1""",
    "scenes_round_trip": "select count(*) as n, count(*) as same, 0::bigint as errors from part where p_partkey % 5 < 2",
    "presets_listed": """with p as (select ['built', 'user', 'assigned', 'device'][p_partkey % 4 + 1] as source, lower(p_name) as name, lower(p_brand) as sub, p_size % 2 = 0 as graphic from part),
c as (select unnest(['all', 'graphic', 'parametric', 'user', 'assigned', 'device']) as category), q as (select unnest(['', ' BRAND#1', 'wi']) as search)
select category, search, count(*) filter (where (category = 'all' or (category = 'graphic' and source in ('built', 'user') and graphic) or (category = 'parametric' and source in ('built', 'user') and not graphic) or category = source)
  and (contains(name, lower(trim(search))) or contains(sub, lower(trim(search))))) as n from c, q, p group by 1, 2""",
    "set_pools": f"with {TRACKS} select 1 as pool, seq from t where lower(genre) = 'promo' union all select 2, seq from t where lower(artist) = 'brand#13' union all select 3, seq from t where lower(genre) = 'small' and lower(artist) = 'brand#5' union all select 4, seq from t",
    "headphone_names": f"with {TRACKS} select seq, coalesce(nullif(trim({_EQ}), ''), 'AutoEq') as name from t",
    "fused_by_taste": f"""with {_FP}, r as (select l_partkey as id, count(*) + 1 + l_partkey % 5 as b from lineitem group by l_partkey), s as (select id as seed, v as q from fp join r using (id) order by b desc, id limit 3),
o as (select seed, id, row_number() over (partition by seed order by {_COS('v', 'q')} desc, id) as rn from fp, s where id <> seed) select seed, (rn - 1)::int as pos, id from o where rn <= 30""",
    "similar_unheard": f"with {_FP}, {EVENTS}, h as (select track from e where kind not in ('Like', 'Dislike', 'AddedManually') and track is not null and {THEN} - ts < 28800 and track <> 7), q as (select v as q from fp where id = 7) select id, {_COS('v', 'q')} as sim from fp, q where id <> 7 and id not in (select track from h) order by sim desc, id limit 25",
    "described_named": "with x as (select vec_id as id, 60.0 + (vec_id * 7) % 140 as bpm, (embedding[4]::double - 0.5 * embedding[6]::double + 2 * embedding[12]::double) / (sqrt(list_sum(list_transform(embedding, lambda a: a::double * a::double))) * sqrt(5.25::double)) as sim from embeddings) select id, sim from x where sim > 0 and bpm >= 80 and bpm <= 180 order by sim desc, id limit 25",
    "cache_read": f"with {TRACKS} select path, title, year::bigint as year, duration from t",
    "input_kinds": "select p_partkey as id, case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then 'pls' when p_partkey % 5 in (1, 2) then 'm3u' else 'direct' end as kind from part",
    "mass_decayed": f"with {_CEN} select case when cluster % 2 = 0 then 1 else -1 end as side, cluster as centroid, (cluster + 1.0::double) * pow(0.5::double, 200.0::double / 90) as mass from ce where (cluster + 1.0::double) * pow(0.5::double, 200.0::double / 90) >= 0.8",
    "taste_reset": "select 'model' as state, 0::bigint as n union all select 'events', 0 union all select 'fingerprints', count(*) from embeddings union all select 'recipes', count(*) from region",
    "clusters_kept": "with n as (select count(*) as a, count(*) filter (vec_id % 10 <> 0) as b, count(*) filter (vec_id % 10 <> 1) as c from embeddings) select 0 as run, a as vectors, true as made, true as some from n union all select 1, a, false, true from n union all select 2, b, true, true from n union all select 3, c, c <> b, true from n",
    "presets_upserted": """with b as (select n_name as name, n_regionkey::bigint as value, 0::bigint as seen, n_nationkey as k from nation), u as (select name, k * 10 + r as value, r + 1 as seen from b, (select max(r_regionkey) as r from region where r_regionkey < 3) where k % 3 = 0)
select name, value::bigint as value, seen::bigint as seen from u union all select name, value, seen from b where k % 2 = 0 and k % 3 <> 0""",
    "played_lately": """with s as (select l_partkey as seq, max(epoch(l_shipdate))::bigint as last_played from lineitem group by 1), l as (select * from s where last_played > 0 order by last_played desc, seq limit 30)
select row_number() over (order by last_played desc, seq) - 1 as pos, seq, 'newest' as "order" from l union all select row_number() over (order by last_played, seq desc) - 1, seq, 'oldest' from l""",
    "long_enough": f"with {TRACKS} select count(*) as n from t where duration >= 300",
    "heard_by_both": f"with {EVENTS} select track from e where kind = 'Like' and track is not null intersect select track from e where kind = 'FullPlay'",
}
