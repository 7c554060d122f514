"""Queries of fingerprints, explained scores, clusters and mixes, with SQL where SQL can express them. Others are tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import mixes as x
from earshot.operators import recommend as r
from earshot.operators import taste as m
from earshot.operators.vectors import fold_bpm
from earshot.plans.models import _CEN, _COS, _FOLD, _FP, _PAIR, _centroids, _hand_overs
from earshot.plans.models import ORACLE as _MODELS
from earshot.plans.sql import EVENTS, NOW, TRACK_STATS, TRACKS, WHO
from earshot.sources.tables import fingerprints, listens, stats, tracks

#: A time at which some tracks were heard just now.
THEN = NOW - 86_400 * 3
DAY = 20_240_130


def _liked(s, d):
    """The labels' centroids as a listener's: even ones liked, odd ones not."""
    bpm = fingerprints(s, d).groupBy(F.col("label").alias("cluster")).agg(F.avg("bpm").alias("bpm"))
    return _centroids(s, d).join(bpm, "cluster").select(F.when(F.col("cluster") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("cluster").alias("centroid"), F.col("c").alias("v"), (F.col("cluster") + 1.0).alias("mass"), "bpm")


def _scores(s, d):
    return m.taste_scores(fingerprints(s, d), _liked(s, d))


def _assigned(s, d):
    return fingerprints(s, d).withColumnRenamed("label", "cluster")


def _tokens(s, d):
    return fingerprints(s, d).select("id", F.array(F.when(F.col("label") < 4, F.concat(F.lit("crate "), F.col("label").cast("string"))).otherwise(F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))), F.lit("")).alias("tokens"))


def _prefs(s, d):
    return tracks(s, d).select("genre").distinct().withColumn("pref", F.length("genre") % 5 / 4.0)


def _pairs(s, d):
    a = fingerprints(s, d).select("id", F.col("bpm").cast("double").alias("bpm_a"), (F.col("id") % 7 * 0.1).alias("first_a"), (120.0 + F.col("id") % 200).alias("length_a"))
    b = fingerprints(s, d).select((F.col("id") - 1).alias("id"), F.col("bpm").cast("double").alias("bpm_b"), (F.col("id") % 7 * 0.1).alias("first_b"))
    k, length = F.col("id"), F.col("length_a")
    part = lambda share, label, energy: F.struct((length * share).alias("start"), label.alias("label"), energy.alias("energy"))
    found = [part(0.0, F.lit("Intro"), F.lit(0.1)), part(0.65, F.when(k % 3 == 0, "Breakdown").otherwise("Drop"), k % 10 / 10.0), part(0.85, F.when(k % 4 == 0, "Outro").otherwise("Drop"), k % 7 / 7.0)]
    return a.join(b, "id").withColumn("sections_a", F.array(*found))


def _phrases(s, d):
    return s.createDataFrame([("dark", 1, -1.0), ("dark", 4, 0.5), ("busy", 7, 2.0), ("nothing", 99, 1.0), ("void", 3, 0.0)], "phrase string, dim int, weight double")


def _next(seed, last=None, explore=False):
    return lambda s, d: x.next_for_queue(fingerprints(s, d), _scores(s, d), listens(s, d), THEN, seed, last, explore)


QUERIES: dict = {
    "zscore_fingerprints": lambda s, d: x.fingerprints(fingerprints(s, d)).select("id", F.posexplode("v").alias("dim", "x")),
    "taste_shown": lambda s, d: x.shown_scores(_scores(s, d), listens(s, d)),
    "taste_hidden": lambda s, d: x.shown_scores(_scores(s, d), listens(s, d).limit(29)),
    "taste_explained": lambda s, d: x.explained(fingerprints(s, d), _liked(s, d)).withColumn("descriptors", F.array_join("descriptors", ", ")),
    "taste_stations": lambda s, d: x.stations(_liked(s, d)),
    "station_tracks": lambda s, d: x.station_tracks(fingerprints(s, d), _liked(s, d), listens(s, d), THEN, 20),
    "cluster_names": lambda s, d: x.cluster_names(_assigned(s, d), _centroids(s, d), _tokens(s, d)),
    "cluster_reps": lambda s, d: x.representatives(_assigned(s, d), _centroids(s, d)),
    "cluster_ids": lambda s, d: x.kept_ids(_centroids(s, d), m._means(_assigned(s, d).where("id % 3 <> 0").select((F.col("cluster") + 100).alias("cluster"), "v")).where("cluster % 4 <> 0"), 500),
    "genre_mixes": lambda s, d: x.genre_mixes(fingerprints(s, d), _centroids(s, d), _scores(s, d), listens(s, d), THEN, 15),
    "daily_blend_of": lambda s, d: x.daily_blend_of(fingerprints(s, d), _liked(s, d), listens(s, d), THEN, 24),
    "discover_pool": lambda s, d: x.discover(fingerprints(s, d), _scores(s, d), listens(s, d).where("track % 3 <> 0"), 40),
    "next_track": _next(7),
    "next_explored": _next(7, 3, True),
    "weighted_sample": lambda s, d: x.weighted_sample(tracks(s, d), _prefs(s, d), 40, 77).select("seq", "turn"),
    "daily_mixes": lambda s, d: x.daily_mixes(tracks(s, d), DAY),
    "naming_tokens": lambda s, d: x.naming_tokens(tracks(s, d)).select("id", F.array_join("tokens", "|").alias("tokens")),
    "transition_plans": lambda s, d: x.transition_plan(_pairs(s, d)).drop("sections_a"),
    "set_flow": lambda s, d: _hand_overs(s, d).groupBy("list").agg(F.avg("score").alias("flow")),
    "vibe_probes": lambda s, d: x.probed(_phrases(s, d), fingerprints(s, d)),
    "supermix_pool": lambda s, d: m.nearest(fingerprints(s, d), x.representatives(_assigned(s, d), _centroids(s, d), 1).where("cluster < 8").join(fingerprints(s, d).select("id", F.col("v").alias("c")), "id").select("cluster", "c")).select("id", F.col("sim").alias("score")).orderBy(F.desc("score"), "id").limit(80),
    "fused_lanes": lambda s, d: x.ranked_by(fingerprints(s, d).where("id not in (3, 7, 11)"), fingerprints(s, d).where("id in (3, 7, 11)").select(F.col("id").alias("seed"), F.col("v").alias("c")), "seed", 30).select("seed", "pos", "id"),
    "cluster_tempos": lambda s, d: _assigned(s, d).groupBy("cluster").agg(F.avg(fold_bpm("bpm")).alias("bpm")),
    "plays_top": lambda s, d: r.plays_by(tracks(s, d), stats(s, d), "artist", "album").orderBy(F.desc("plays"), "artist", "album").limit(6),
}

_WORDS = ", ".join(f"({i}, '{hi}', '{lo}')" for i, n in enumerate(x.FEATURES) if (w := x.PHRASES.get(n) or (x.TIMBRE if n.startswith("mfcc") else None)) for hi, lo in [w])
_NAMED = f"""{_CEN}, bb as (select label as cluster, avg(bpm) as bpm from fp group by label), f(dim, hi, lo) as (values {_WORDS}), d as (select cluster, unnest(c) as x, unnest(range(0, len(c))) as dim from ce),
  dw as (select cluster, case when x > 0 then hi else lo end as word, row_number() over (partition by cluster order by abs(x) desc, dim) as rn from d join f using (dim)), du as (select cluster, word, min(rn) as rn from dw group by 1, 2),
  dr as (select *, row_number() over (partition by cluster order by rn) as k from du), wd as (select cluster, string_agg(word, ', ' order by k) filter (k <= 5) as words, string_agg(word, ' & ' order by k) filter (k <= 2) as two from dr group by cluster),
  nm as (select cluster, bpm, words, two, case when bpm > 1 then case when bpm >= 140 then 'fast' when bpm >= 100 then 'mid-tempo' else 'slow' end || ' (~' || floor(bpm + 0.5::double)::bigint || ' BPM), ' else '' end || words as text from bb join wd using (cluster))"""
_PAIRED = f"pr as (select id, cluster, {_COS('v', 'c')} as sim from fp, ce)"
_SCORED = "ss as (select id, cluster, cluster % 2 as odd, sim * (cluster + 1.0::double) / (cluster + 4.0::double) as sc from pr), sp as (select id, max(sc) filter (odd = 0) as ps, arg_max(cluster, sc) filter (odd = 0) as pi, max(sc) filter (odd = 1) as ns, arg_max(cluster, sc) filter (odd = 1) as ni from ss group by id), sr as (select id, coalesce(ps, 0) - 0.8::double * coalesce(ns, 0) as score, * exclude (id) from sp)"
_PLAYED = "kind not in ('Like', 'Dislike', 'AddedManually') and track is not null"
_HEARD = f"hd as (select distinct track as id from e where {_PLAYED} and {THEN} - ts < 28800)"
_TITLE = lambda c: f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_U = lambda key: f"((('0x' || substr(md5({key}), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)"
_MEAN = "select id, dim, case when s > 1e-9 then (x - m) / s else 0 end as z from l join mm using (dim)"

ORACLE: dict[str, str] = {
    "zscore_fingerprints": f"with {_FP}, l as (select id, unnest(v) as x, unnest(range(0, len(v))) as dim from fp), mm as (select dim, avg(x) as m, stddev_samp(x) as s from l group by dim), z as ({_MEAN}), n as (select id, sqrt(sum(z * z)) as n from z group by id) select id, dim::int as dim, z / n as x from z join n using (id)",
    "taste_shown": _MODELS["taste_scores"],
    "taste_hidden": "select vec_id as id, null::double as score from embeddings",
    "taste_explained": f"""with {_NAMED}, {_PAIRED}, {_SCORED}, w as (select id, score, case when ps is not null and ps >= coalesce(ns, 0) then 'positive' when ni is not null then 'negative' else 'neutral' end as side, pi, ni from sr),
      q as (select id, score, side, case side when 'positive' then pi else ni end as centroid from w) select id, score, side, centroid, words as descriptors, text from q join nm on cluster = centroid""",
    "taste_stations": f"with {_NAMED} select cluster as station, text as name, bpm from nm where cluster % 2 = 0",
    "station_tracks": f"with {EVENTS}, {_HEARD}, {_PAIR} select cluster as station, (rn - 1)::int as pos, id from (select *, row_number() over (partition by cluster order by sim desc, id) as rn from pr where cluster % 2 = 0 and id not in (select id from hd)) where rn <= 20",
    "cluster_names": f"""with {_NAMED}, sz as (select label as cluster, count(*) as size, avg({_FOLD('bpm')}) as fb from fp group by label),
      tk as (select label as cluster, case when label < 4 then 'crate ' || label else 't' || id % 3 end as token, count(*) as n from fp group by 1, 2), tt as (select cluster, token, n from (select *, row_number() over (partition by cluster order by n desc, token) as rn from tk) where rn = 1)
      select cluster, size, fb as bpm, case when n >= 0.6::double * size then {_TITLE('token')} else {_TITLE('two')} || ' ~' || floor(fb + 0.5::double)::bigint end as name from sz join tt using (cluster) join nm using (cluster)""",
    "cluster_reps": f"with {_CEN}, q as (select cluster, id, row_number() over (partition by cluster order by {_COS('v', 'c')} desc, id) as rn from fp join ce on cluster = label) select cluster, (rn - 1)::int as pos, id from q where rn <= 9",
    "genre_mixes": f"""with {EVENTS}, {_HEARD}, {_PAIR}, {_SCORED}, nr as (select id, arg_max(cluster, sim) as cluster from pr where id not in (select id from hd) group by id),
      q as (select cluster, id, row_number() over (partition by cluster order by score desc, id) as rn from nr join sr using (id)) select cluster, (rn - 1)::int as pos, id from q where rn <= 15""",
    "discover_pool": f"with {EVENTS}, {_PAIR}, {_SCORED} select id, score from sr where id not in (select track from e where {_PLAYED} and track % 3 <> 0) order by score desc, id limit 40",
    "next_track": f"with {EVENTS}, {_HEARD}, {_PAIR}, {_SCORED} select id from sr where id not in (select id from hd) order by score / 0.3::double - ln(-ln({_U(chr(39) + '7:' + chr(39) + ' || id')})) desc, id limit 1",
    "next_explored": f"""with {EVENTS}, {_HEARD}, {_FP}, sd as (select v as q from fp where id = 3), q as (select id, {_COS('v', 'q')} as sim from fp, sd where id not in (select id from hd)), t as (select quantile_cont(sim, 1.0::double / 3) as third from q)
      select id from q, t where sim <= third order by {_U(chr(39) + '7:' + chr(39) + ' || id')} desc, id limit 1""",
    "weighted_sample": f"""with {TRACKS}, k as (select *, lower(coalesce(nullif({WHO}, ''), '?')) as w, {_U(chr(39) + '77:' + chr(39) + ' || path')} + 1.2::double * (length(genre) % 5 / 4.0::double) as key from t),
      pt as (select *, row_number() over (partition by w order by key desc, seq) as turn from k), pg as (select *, max(key) over (partition by w) as gk from pt where turn <= 7) select seq, turn from pg order by turn, gk desc, seq limit 40""",
    "daily_mixes": f"""with {TRACKS}, g as (select genre, count(*) as n from t where genre <> '' group by genre having count(*) >= 8 order by n desc, genre limit 4), gm as (select genre, row_number() over (order by n desc, genre) - 1 as mix from g),
      k as (select *, lower(coalesce(nullif({WHO}, ''), '?')) as w, md5(({DAY} + mix * 101) || ':' || path) as key from t join gm using (genre)), pt as (select *, row_number() over (partition by mix, w order by key, seq) as turn from k), pg as (select *, min(key) over (partition by mix, w) as gk from pt where turn <= 4),
      pp as (select *, row_number() over (partition by mix order by turn, gk) - 1 as pos from pg), pc as (select *, count(*) over (partition by mix) as c from pp where pos < 24) select mix::int as mix, genre, pos::int as pos, seq from pc where c >= 6""",
    "naming_tokens": f"with {TRACKS} select seq as id, lower(artist) || '|' || lower(genre) as tokens from t",
    "transition_plans": f"""with {_FP}, a as (select id, bpm as bpm_a, id % 7 * 0.1::double as first_a, 120.0::double + id % 200 as length_a from fp), b as (select id - 1 as id, bpm as bpm_b, id % 7 * 0.1::double as first_b from fp), p as (select * from a join b using (id)),
      o as (select *, 960.0::double / bpm_a as overlap, greatest(0, length_a - 960.0::double / bpm_a) as latest, 240.0::double / bpm_a as bar from p),
      f as (select *, case when id % 4 = 0 or id % 7 / 7.0::double < 0.5::double then length_a * 0.85::double when id % 3 = 0 or id % 10 / 10.0::double < 0.5::double then length_a * 0.65::double else latest end as found from o),
      g as (select *, greatest(length_a * 0.5::double, least(found, greatest(latest, length_a * 0.5::double))) as early from f)
      select id, bpm_a, first_a, length_a, bpm_b, first_b, greatest(0, least(first_a + floor((early - first_a) / bar + 0.5::double) * bar, latest)) as out_at, first_b as in_at, overlap, bpm_a / bpm_b as tempo_ratio, abs(bpm_a / bpm_b - 1) <= 0.06::double as beatmatch from g""",
    "set_flow": f"with h as ({_MODELS['hand_overs']}) select list, avg(score) as flow from h group by list",
    "vibe_probes": "with w(phrase, dim, weight) as (values ('dark', 1, -1.0), ('dark', 4, 0.5), ('busy', 7, 2.0)), q as (select phrase, vec_id, sum(embedding[dim + 1]::double * weight::double) as s from embeddings, w group by 1, 2) select phrase, count(*) as hits from q where s > 0 group by phrase having count(*) >= 5",
    "supermix_pool": f"with {_CEN}, q as (select cluster, id, v, row_number() over (partition by cluster order by {_COS('v', 'c')} desc, id) as rn from fp join ce on cluster = label), s as (select v as q from q where rn = 1 and cluster < 8) select id, max({_COS('v', 'q')}) as score from fp, s group by id order by score desc, id limit 80",
    "fused_lanes": f"with {_FP}, s as (select id as seed, v as q from fp where id in (3, 7, 11)), o as (select seed, id, row_number() over (partition by seed order by {_COS('v', 'q')} desc, id) as rn from fp, s where id not in (3, 7, 11)) select seed, (rn - 1)::int as pos, id from o where rn <= 30",
    "cluster_tempos": f"with {_FP} select label as cluster, avg({_FOLD('bpm')}) as bpm from fp group by label",
    "plays_top": f"with {TRACK_STATS} select artist, album, sum(plays)::bigint as plays from ts where plays > 0 group by 1, 2 order by plays desc, artist, album limit 6",
}
