"""From feature vectors to mixes: fingerprints, explained scores, stations, named clusters, generated mixes, and the next track.

Centroids and clusters are a listener's few dozen by contract; they are one row, whose size the number of centroids bounds. What is
ordered by hand (a blend of at most K lists, a flow) is cut to its length first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import is_missing
from earshot.operators.recommend import artist_of, beside_total
from earshot.operators.vectors import EPSILON, cosine, described, dot, fold_bpm, one_row, similar

# Names of the dimensions, words for what is high or low in them, events of a cold start, seconds that count as just
# played, the share of a token that names a cluster, likeness of two clusters taken for one, and the draw of a next track.
FEATURES = [*[f"mfcc{i}_mean" for i in range(1, 14)], *[f"mfcc{i}_std" for i in range(1, 14)], "centroid_mean", "centroid_std", "rolloff_mean", "rolloff_std", "flux_mean", "flux_std", "flatness_mean", "flatness_std", "rms_mean", "rms_std", "zcr_mean", "zcr_std", "tempo_z", "onset_density", "low_end", "mid_hoover", "crest", "chroma_entropy", "tempo_folded"]
PHRASES = {
    "centroid_mean": ("bright", "dark"), "rolloff_mean": ("airy highs", "rolled-off highs"), "flux_mean": ("aggressive", "smooth"), "flatness_mean": ("noisy", "tonal"), "rms_mean": ("loud", "quiet"), "rms_std": ("punchy", "compressed"),
    "zcr_mean": ("distorted/hats", "clean"), "onset_density": ("dense percussion", "sparse percussion"), "low_end": ("bass-heavy", "light low-end"), "mid_hoover": ("synth-forward mids", "scooped mids"), "crest": ("dynamic", "low dynamics"), "chroma_entropy": ("atonal", "harmonic"),
}
TIMBRE = ("rich timbre", "plain timbre")
COLD, RECENT, MAJORITY, SAME = 30, 28_800, 0.6, 0.6
HEAT, EXPLORED = 0.3, 0.12


def l2_normalised(v) -> Column:
    """A vector at length 1; one without length stays. The vector and its length are bound once, by a list of one: inside the inner function they would be computed for every number."""
    v = F.transform(F.array(v), lambda x: F.struct(F.transform(x, lambda y: y.cast("double")).alias("v")))
    v = F.transform(v, lambda x: F.struct(x["v"].alias("v"), F.sqrt(dot(x["v"], x["v"])).alias("n")))
    return F.get(F.transform(v, lambda x: F.when(x["n"] > EPSILON, F.transform(x["v"], lambda y: y / x["n"])).otherwise(x["v"])), F.lit(0))


def _first(t: DataFrame, name: str, by, n: int) -> DataFrame:
    """The first n rows of each group with their places from 0. The filter is on row_number itself, so that every task cuts its own rows before they meet."""
    return t.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= n).withColumn(name, F.col("_rn") - 1).drop("_rn")


def fingerprints(raw: DataFrame) -> DataFrame:
    """Raw vectors (id, v, ...) as fingerprints: every dimension by its distance from the library's mean in deviations (0 where there is none), at length 1.

    They depend on the whole library, so they are computed anew for all of it; operators/moments.py keeps them up as it grows.
    """
    long = raw.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.when(F.count("x") > 1, F.stddev_samp("x")).otherwise(1.0).alias("s"))
    one = long.agg(F.sort_array(F.collect_list(F.struct("dim", "m", "s"))).alias("ms"))  # a row of as many numbers as there are dimensions
    z = F.zip_with("v", "ms", lambda x, m: F.when(m["s"] > 1e-9, (x.cast("double") - m["m"]) / m["s"]).otherwise(0.0))
    t = raw.join(F.broadcast(one), F.lit(True)).withColumn("v", z).drop("ms")
    return t.withColumn("v", l2_normalised("v"))


def phrase(name, value) -> Column:
    """A word for a dimension that stands out, by its name and the sign of its value; null where there is none."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    words = lambda k: F.create_map(*[F.lit(x) for n, p in PHRASES.items() for x in (n, p[k])])
    pick = lambda k: F.coalesce(F.element_at(words(k), c(name)), F.when(F.startswith(c(name), F.lit("mfcc")), F.lit(TIMBRE[k])))
    return F.when(c(value) > 0, pick(0)).otherwise(pick(1))


def descriptors(v, most: int, names: list[str] = FEATURES) -> Column:
    """The words of the dimensions that stand out most, each once."""
    named = F.zip_with(v, F.array(*[F.lit(n) for n in names]), lambda x, n: F.struct((-F.abs(x.cast("double"))).alias("by"), n.alias("n"), x.cast("double").alias("x")))
    ranked = F.array_sort(F.transform(named, lambda e, i: F.struct(F.coalesce(e["by"], F.lit(0.0)).alias("by"), i.alias("i"), F.when(e["x"].isNotNull(), phrase(e["n"], e["x"])).alias("word"))))
    return F.slice(F.array_distinct(F.filter(F.transform(ranked, lambda e: e["word"]), lambda w: w.isNotNull())), 1, most)


def described_as(words, bpm) -> Column:
    """A sentence of a tempo and words."""
    b = F.col(bpm) if isinstance(bpm, str) else bpm
    speed = F.when(b >= 140, "fast").when(b >= 100, "mid-tempo").otherwise("slow")
    parts = F.concat(F.when(b > 1, F.array(F.concat(speed, F.lit(" (~"), F.floor(b + 0.5).cast("string"), F.lit(" BPM)")))).otherwise(F.array().cast("array<string>")), words)
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("no strong character yet")


def shown_scores(scores: DataFrame, events: DataFrame) -> DataFrame:
    """Scores (id, score), null as long as fewer than COLD events were heard."""
    n = events.agg(F.count(F.lit(1)).alias("heard"))
    return scores.join(F.broadcast(n), F.lit(True)).select("id", F.when(F.col("heard") >= COLD, F.col("score")).alias("score"))


def explained(vectors: DataFrame, centroids: DataFrame, saturate: float = 3.0, dislike: float = 0.8) -> DataFrame:
    """id, score, side, centroid, descriptors and text of vectors (id, v, bpm) against centroids (side 1 or -1, centroid, v, mass, bpm): the side whose best centroid is nearer explains the score."""
    one = one_row(centroids.select("side", "centroid", F.col("v").alias("c"), "mass", F.col("bpm").alias("b")), "side", "centroid", "c", "mass", "b")
    t = vectors.select("id", "v", "bpm").join(F.broadcast(one), F.lit(True))
    best = lambda side: F.array_max(F.transform(F.filter("cs", lambda x: x["side"] == side), lambda x: F.struct((cosine(F.col("v"), x["c"]) * x["mass"] / (x["mass"] + saturate)).alias("s"), (-x["centroid"]).alias("o"), x["c"].alias("c"), x["b"].alias("b"))))
    t = t.withColumns({"p": best(1), "n": best(-1)}).drop("cs")
    zero = lambda c: F.coalesce(F.col(f"{c}.s"), F.lit(0.0))
    side = F.when(F.col("p").isNotNull() & (F.col("p.s") >= zero("n")), "positive").when(F.col("n").isNotNull(), "negative").otherwise("neutral")
    t = t.withColumns({"score": zero("p") - dislike * zero("n"), "side": side}).withColumn("won", F.when(F.col("side") == "positive", F.col("p")).when(F.col("side") == "negative", F.col("n")))
    words = F.coalesce(descriptors("won.c", 5), F.array().cast("array<string>"))
    return t.select("id", "score", "side", (-F.col("won.o")).alias("centroid"), words.alias("descriptors"), described_as(words, F.coalesce("won.b", "bpm")).alias("text"))


def stations(centroids: DataFrame) -> DataFrame:
    """station, name, bpm: one for each liked centroid, named by its sound."""
    return centroids.where("side = 1").select(F.col("centroid").alias("station"), described_as(descriptors("v", 5), "bpm").alias("name"), "bpm")


def _heard(events: DataFrame, now: int) -> DataFrame:
    """Tracks (id) played, not only liked or added, in the last hours."""
    played = ~F.col("kind").isin("Like", "Dislike", "AddedManually") & F.col("track").isNotNull()
    return events.where(played & (F.lit(now) - F.col("ts") < RECENT)).select(F.col("track").alias("id")).distinct()


def ranked_by(vectors: DataFrame, centroids: DataFrame, name: str, n: int) -> DataFrame:
    """For each centroid (name, c) the n vectors most like it: name, pos from 0, id, sim. Each task cuts its own best first."""
    one = one_row(centroids.select(F.col(name).alias("k"), "c"), "k", "c")
    t = vectors.select("id", "v").join(F.broadcast(one), F.lit(True)).select("id", "v", F.explode("cs").alias("x")).select(F.col("x.k").alias(name), "id", cosine("v", "x.c").alias("sim"))
    by = Window.partitionBy(name).orderBy(F.desc("sim"), "id")
    return _first(t, "pos", by, n)


def fused_lanes(vectors: DataFrame, rated: DataFrame, seeds: int = 3, n: int = 30, least: int = 4) -> DataFrame:
    """seed, pos, id: what sounds like each of the most loved tracks (rated: id, plays, rating), which are those played or rated high, by plays and rating. A lane of fewer than least tracks is none."""
    loved = rated.where((F.col("plays") > 0) | (F.col("rating") >= 4)).withColumn("by", F.col("plays") + F.col("rating")).join(vectors.select("id", F.col("v").alias("c")), "id")
    top = loved.orderBy(F.desc("by"), "id").limit(seeds).select(F.col("id").alias("seed"), "c")
    lanes = ranked_by(vectors, top, "seed", n + 1).where("id <> seed").select("seed", "id", "sim")
    lanes = _first(lanes, "pos", Window.partitionBy("seed").orderBy(F.desc("sim"), "id"), n)
    return lanes.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("seed"))).where(F.col("size") >= least).select("seed", "pos", "id")


def similar_unheard(vectors: DataFrame, to: int, events: DataFrame, now: int, n: int) -> DataFrame:
    """id, sim: the n vectors most like one of them, but for those heard just now."""
    return similar(vectors.join(_heard(events, now).where(F.col("id") != to), "id", "left_anti"), to, n)


def described_by_name(vectors: DataFrame, weights: dict[str, float], n: int, bpm_min: float = 0, bpm_max: float = 0) -> DataFrame:
    """id, sim: the n vectors that point most the way of named features; names that nobody knows count for nothing."""
    return described(vectors, {FEATURES.index(k): w for k, w in weights.items() if k in FEATURES}, n, bpm_min, bpm_max)


def station_tracks(vectors: DataFrame, centroids: DataFrame, events: DataFrame, now: int, n: int) -> DataFrame:
    """station, pos, id: for each liked centroid the n tracks nearest to it that were not heard just now."""
    fresh = vectors.join(_heard(events, now), "id", "left_anti")
    return ranked_by(fresh, centroids.where("side = 1").select(F.col("centroid").alias("station"), F.col("v").alias("c")), "station", n).select("station", "pos", "id")


def cluster_names(assigned: DataFrame, centroids: DataFrame, tokens: DataFrame) -> DataFrame:
    """cluster, size, bpm (mean of folded tempos above 0) and name of clusters: assigned (id, cluster, bpm), centroids (cluster, c), tokens (id, tokens).

    A token of six tenths of the members names a cluster (of equal ones the first by name), else its two strongest features and tempo.
    """
    folded = fold_bpm("bpm")
    size = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.avg(F.when(folded > 0, folded)), F.lit(0.0)).alias("bpm"))
    told = assigned.join(tokens, "id").select("cluster", F.explode(F.array_distinct("tokens")).alias("token")).where("token <> ''").groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("n"))
    top = told.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("t"))
    t = size.join(top, "cluster", "left").join(centroids, "cluster")
    words = descriptors("c", 2)
    base = F.when(F.size(words) > 0, F.initcap(F.array_join(words, " & "))).otherwise("Mixed")
    sound = F.when(F.col("bpm") > 1, F.concat(base, F.lit(" ~"), F.floor(F.col("bpm") + 0.5).cast("string"))).otherwise(base)
    return t.select("cluster", "size", "bpm", F.when(-F.col("t.n") >= MAJORITY * F.col("size"), F.initcap("t.token")).otherwise(sound).alias("name"))


def representatives(assigned: DataFrame, centroids: DataFrame, n: int = 9) -> DataFrame:
    """cluster, pos, id: the members (id, cluster, v) most like their own centroid (cluster, c), which are few."""
    own = F.broadcast(one_row(centroids, "cluster", "c")).select(F.explode("cs").alias("x")).select("x.cluster", "x.c")
    t = assigned.join(own, "cluster").select("cluster", "id", cosine("v", "c").alias("sim"))
    return _first(t, "pos", Window.partitionBy("cluster").orderBy(F.desc("sim"), "id"), n).select("cluster", "pos", "id")


def kept_ids(new: DataFrame, old: DataFrame, next_id: int) -> DataFrame:
    """cluster, id: new clusters (cluster, c) in turn take the id of the most similar old one (cluster, c) that none took before, above SAME; others get ids from next_id on. There are a few dozen of each."""
    pairs = new.select(F.col("cluster").alias("n"), F.col("c").alias("a")).join(F.broadcast(old.select(F.col("cluster").alias("o"), F.col("c").alias("b"))), F.lit(True), "left")
    near = pairs.select("n", F.struct(F.coalesce(cosine("a", "b"), F.lit(-1.0)).alias("s"), (-F.col("o")).alias("o")).alias("x")).groupBy("n").agg(F.collect_list("x").alias("xs"))
    all_new = near.agg(F.sort_array(F.collect_list(F.struct("n", "xs"))).alias("all"))
    nothing = F.array().cast("array<struct<n:bigint,o:bigint>>")

    def step(done, x):
        free = F.filter(x["xs"], lambda y: (y["s"] > SAME) & ~F.exists(done, lambda d: d["o"].eqNullSafe(-y["o"])))
        return F.concat(done, F.array(F.struct(x["n"].cast("long").alias("n"), (-F.array_max(free)["o"]).cast("long").alias("o"))))

    told = all_new.select(F.posexplode(F.aggregate("all", nothing, step)).alias("at", "x")).select("at", F.col("x.n").alias("cluster"), F.col("x.o").alias("o"))
    return told.select("cluster", F.coalesce("o", next_id + F.sum(F.col("o").isNull().cast("long")).over(Window.orderBy("at")) - 1).alias("id"))


def genre_mixes(vectors: DataFrame, centroids: DataFrame, scores: DataFrame, events: DataFrame, now: int, per: int) -> DataFrame:
    """cluster, pos, id: each track not heard just now falls to its nearest cluster (cluster, c); of a cluster's tracks the per best by score (id, score), or by nearness in a cold start."""
    one = one_row(centroids, "cluster", "c")
    near = F.array_max(F.transform("cs", lambda x: F.struct(cosine(F.col("v"), x["c"]).alias("sim"), (-x["cluster"]).alias("o"))))
    t = vectors.join(_heard(events, now), "id", "left_anti").join(F.broadcast(one), F.lit(True)).select("id", near.alias("b")).select("id", (-F.col("b.o")).alias("cluster"), F.col("b.sim").alias("sim"))
    t = t.join(scores, "id", "left").join(F.broadcast(events.agg(F.count(F.lit(1)).alias("heard"))), F.lit(True))
    by = Window.partitionBy("cluster").orderBy(F.desc(F.when(F.col("heard") < COLD, F.col("sim")).otherwise(F.coalesce("score", F.lit(0.0)))), "id")
    return _first(t, "pos", by, per).select("cluster", "pos", "id")


def round_robin(lists: DataFrame, n: int) -> DataFrame:
    """pos, id: n entries of lists (list, pos, id) by turns, each list giving its next one that no list gave before.

    Every entry is given by the list that reaches it first, so it is a fold over at most lists times n rows: a listener's few lists, cut to n.
    """
    rows = lists.where(F.col("pos") < n).groupBy("list").agg(F.sort_array(F.collect_list(F.struct("pos", "id")))["id"].alias("ids"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("list", "ids")))["ids"].alias("ls"))
    kind = lists.schema["id"].dataType.simpleString()
    state = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.col("ls").alias("ls"))

    def turn(s, i):
        own = F.filter(F.get(s["ls"], i), lambda x: ~F.array_contains(s["out"], x))
        more = F.when(F.size(s["out"]) < n, F.concat(s["out"], F.slice(own, 1, 1))).otherwise(s["out"])
        return F.struct(more.alias("out"), s["ls"].alias("ls"))

    turns = F.flatten(F.array_repeat(F.sequence(F.lit(0), F.size("ls") - 1), n))
    return whole.where(F.size("ls") > 0).select(F.posexplode(F.aggregate(turns, state, turn)["out"]).alias("pos", "id"))


def daily_blend_of(vectors: DataFrame, centroids: DataFrame, events: DataFrame, now: int, per: int) -> DataFrame:
    """pos, id: by turns the tracks nearest to each liked centroid, each once; none in a cold start."""
    lists = station_tracks(vectors, centroids, events, now, per).select(F.col("station").alias("list"), "pos", "id")
    heard = events.agg(F.count(F.lit(1)).alias("heard")).where(F.col("heard") >= COLD)
    return round_robin(lists, per).join(F.broadcast(heard), F.lit(True)).drop("heard")


def discover(vectors: DataFrame, scores: DataFrame, events: DataFrame, per: int) -> DataFrame:
    """id, score: the best of what was never played; its order within a mix is flow_order()'s."""
    played = events.where(~F.col("kind").isin("Like", "Dislike", "AddedManually")).select(F.col("track").alias("id")).distinct()
    t = vectors.join(played, "id", "left_anti").join(scores, "id", "left").join(F.broadcast(events.agg(F.count(F.lit(1)).alias("heard"))), F.lit(True))
    return t.select("id", F.when(F.col("heard") >= COLD, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score")).orderBy(F.desc("score"), "id").limit(per)


def uniform(seed, *key) -> Column:
    """A number in (0, 1) by the md5 of seed and key: the same at every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4_294_967_296.0


def next_for_queue(vectors: DataFrame, scores: DataFrame, events: DataFrame, now: int, seed: int, last: int | None = None, explore: bool | None = None) -> DataFrame:
    """One track (id) to play next, of those not heard just now: drawn by softmax of score over HEAT; at times, EXPLORED of the draws, any of the third least like the last track; in a cold start any.

    A draw by softmax is the largest of score / HEAT plus Gumbel noise, so it is one aggregate and not a pass over cumulated weights.
    """
    free = vectors.join(_heard(events, now), "id", "left_anti").join(scores, "id", "left")
    u = uniform(seed, "id")
    explore = (hash_share(seed) < EXPLORED) if explore is None else explore
    if explore and last is not None:
        q = vectors.where(F.col("id") == last).select(F.col("v").alias("q")).limit(1)
        t = beside_total(free.join(F.broadcast(q), F.lit(True)).select("id", cosine("v", "q").alias("sim")), F.count(F.lit(1)).alias("n"), F.percentile("sim", F.lit(1 / 3)).alias("third"))
        return t.where("sim <= third").select("id", uniform(seed, "id").alias("key")).orderBy(F.desc("key"), "id").limit(1).select("id")
    t = free.join(F.broadcast(events.agg(F.count(F.lit(1)).alias("heard"))), F.lit(True))
    key = F.when(F.col("heard") < COLD, u).otherwise(F.coalesce("score", F.lit(0.0)) / HEAT - F.log(-F.log(u)))
    return t.select("id", key.alias("key")).orderBy(F.desc("key"), "id").limit(1).select("id")


def hash_share(seed: int) -> float:
    """A number in [0, 1) by the md5 of a seed."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16) / 4_294_967_296


def weighted_sample(tracks: DataFrame, prefs: DataFrame, n: int, seed: int, lean: float = 1.2) -> DataFrame:
    """n tracks by a seeded draw plus lean times the preference (genre, pref) for their genre, artists in turn, none more than a sixth of n (2 at least): adds turn and key, by which it reads."""
    who = F.lower(F.coalesce(F.nullif(artist_of(), F.lit("")), F.lit("?")))
    t = tracks.withColumn("_g", F.lower(F.trim(F.coalesce("genre", F.lit(""))))).join(prefs.select(F.lower(F.trim("genre")).alias("_g"), "pref"), "_g", "left")
    t = t.withColumns({"_who": who, "_key": uniform(seed, "path") + lean * F.coalesce("pref", F.lit(0.0))})
    t = t.withColumn("turn", F.row_number().over(Window.partitionBy("_who").orderBy(F.desc("_key"), "seq"))).where(F.col("turn") <= max(2, -(-n // 6)))
    t = t.withColumn("key", F.max("_key").over(Window.partitionBy("_who")))
    return t.drop("_g", "_who", "_key", "pref").orderBy("turn", F.desc("key"), "seq").limit(n)


def daily_mixes(tracks: DataFrame, day: int, mixes: int = 4, size: int = 24, least: int = 6) -> DataFrame:
    """mix, genre, pos, seq: of each of the largest genres (8 tracks or more) a draw of the day, artists in turn. Mixes of fewer than least tracks go."""
    large = tracks.where("genre <> ''").groupBy("genre").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").orderBy(F.desc("n"), "genre").limit(mixes)
    large = large.withColumn("mix", F.row_number().over(Window.orderBy(F.desc("n"), "genre")) - 1).select("genre", "mix")
    who = F.lower(F.coalesce(F.nullif(artist_of(), F.lit("")), F.lit("?")))
    t = tracks.join(F.broadcast(large), "genre").withColumns({"who": who, "k": F.md5(F.concat((F.lit(day) + F.col("mix") * 101).cast("string"), F.lit(":"), "path"))})
    t = t.withColumn("turn", F.row_number().over(Window.partitionBy("mix", "who").orderBy("k", "seq"))).where(F.col("turn") <= max(2, -(-size // 6))).withColumn("key", F.min("k").over(Window.partitionBy("mix", "who")))
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("mix").orderBy("turn", "key")) - 1).where(F.col("pos") < size).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mix")))
    return t.where(F.col("n") >= least).select("mix", "genre", "pos", "seq")


def naming_tokens(tracks: DataFrame) -> DataFrame:
    """id, tokens: the folder a track lies in and its genre, in lower case."""
    parts = F.filter(F.split("path", r"[\\/]"), lambda p: p != "")
    parent = F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -2)))
    return tracks.select(F.col("seq").alias("id"), F.array_compact(F.array(parent, F.when(~is_missing("genre"), F.lower("genre")))).alias("tokens"))


def transition_plan(pairs: DataFrame, overlap_beats: float = 16.0) -> DataFrame:
    """Adds to pairs of tracks how the first hands over to the second: out_at, in_at, overlap, tempo_ratio, beatmatch.

    Pairs have bpm_a, bpm_b, first_a, first_b (first beats), length_a in seconds, and sections_a: structs of start, label, energy. The way out is the
    last section of the track's back part that is quiet or ends it, at the nearest bar; else as late as the overlap allows.
    """
    a, b, length = F.greatest(F.lit(1.0), F.col("bpm_a")), F.greatest(F.lit(1.0), F.col("bpm_b")), F.col("length_a")
    overlap = max(1.0, overlap_beats) * 60.0 / a
    latest = F.greatest(F.lit(0.0), length - overlap)
    quiet = F.filter("sections_a", lambda s: (s["start"] >= length * 0.6) & (s["label"].isin("Outro", "Breakdown") | (s["energy"] < 0.5)))
    found = F.coalesce(F.get(F.transform(F.reverse(quiet), lambda s: s["start"]), F.lit(0)), latest)
    early = F.greatest(length * 0.5, F.least(found, F.greatest(latest, length * 0.5)))
    bar = 240.0 / a
    snapped = F.col("first_a") + F.floor((early - F.col("first_a")) / bar + 0.5) * bar
    return pairs.withColumns({
        "out_at": F.greatest(F.lit(0.0), F.least(snapped, latest)), "in_at": F.greatest(F.lit(0.0), F.col("first_b")), "overlap": overlap, "tempo_ratio": a / b, "beatmatch": F.abs(a / b - 1) <= 0.06})


def probed(phrases: DataFrame, vectors: DataFrame, least: int = 5) -> DataFrame:
    """Of candidate phrases (phrase, dim, weight) those that at least so many vectors answer to: phrase, hits. Weights and vectors meet on their dimension."""
    norm = phrases.groupBy("phrase").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("len")).where("len > 0")
    long = vectors.select("id", F.posexplode("v").alias("dim", "x"))
    sums = long.join(phrases, "dim").groupBy("phrase", "id").agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("dot")).where("dot > 0")
    return sums.join(norm, "phrase").groupBy("phrase").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
