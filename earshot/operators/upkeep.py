"""Keeping a library: patches, appends, removals, priorities, restored queues and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import is_missing
from earshot.operators.described import bounded
from earshot.operators.vectors import cosine

#: Seeds of a mix, which go to every task.
MOST_SEEDS = 10_000


def patched(tracks: DataFrame, patches: DataFrame, key: str = "path", only_missing: bool = False) -> DataFrame:
    """Tracks with the values of patches (key and some columns): null keeps, '' clears. only_missing fills what is null, blank or a stand-in, and clears nothing."""
    fields = [c for c in patches.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    out = tracks.join(p, key, "left")
    for c in fields:
        new = F.nullif(f"_{c}", F.lit(""))
        out = out.withColumn(c, F.when(is_missing(c) & new.isNotNull(), new).otherwise(F.col(c)) if only_missing else F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(new))
    return out.select(*tracks.columns)


def append_unseen(known: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """known, and of new the rows whose key known lacks, one a key."""
    return known.unionByName(new.join(known.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def without_folder(tracks: DataFrame, folder: str) -> DataFrame:
    return tracks.where(~F.startswith("path", F.lit(folder.rstrip("/") + "/")))


def not_heard_since(tracks: DataFrame, events: DataFrame, now: int, seconds: int = 28_800) -> DataFrame:
    """Tracks (id) without an event in the last seconds."""
    recent = events.where((F.col("ts") > now - seconds) & F.col("track").isNotNull()).select(F.col("track").alias("id"))
    return tracks.join(recent, "id", "left_anti")


def analysis_order(rated: DataFrame, done: DataFrame) -> DataFrame:
    """Tracks still to analyse (key seq), with priority: loved first, then by plays, then newest."""
    todo = rated.join(done.select("seq"), "seq", "left_anti")
    rank = F.when(F.col("rating") >= 4, 1e6).otherwise(0.0) + F.col("plays") * 1000.0 + F.when(F.col("last_played") > 0, 100.0).otherwise(0.0)
    return todo.withColumn("priority", rank).orderBy(F.desc("priority"), F.desc(F.coalesce("mtime", F.lit(0.0))), "seq")


def restored_queue(queue: DataFrame, tracks: DataFrame) -> DataFrame:
    """Saved queues (id, pos, seq, current) as id, place, seq, current: entries the library still has, numbered anew from 0."""
    kept = queue.join(tracks.select("seq"), "seq")
    return kept.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1).alias("place"), "seq", "current")


def by_similarity(entries: DataFrame, ranks: DataFrame) -> DataFrame:
    """Entries (id, pos, seq) in order of ranks (seq, rank), those without a rank last: adds place."""
    r = entries.join(ranks, "seq", "left")
    by = Window.partitionBy("id").orderBy(F.coalesce("rank", F.lit(10**9)), "pos")
    return r.select("id", "seq", (F.row_number().over(by) - 1).alias("place"))


def similar_to_each(vectors: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """seed, id, sim: for each of a few seeds (id) the n vectors most like it. More than MOST_SEEDS seeds are an error, as they go to every task."""
    one = bounded(vectors.join(seeds, "id").agg(F.collect_list(F.struct(F.col("id").alias("seed"), F.col("v").alias("q"))).alias("qs")), "qs", MOST_SEEDS)
    t = vectors.join(F.broadcast(one), F.lit(True)).select("id", "v", F.explode("qs").alias("x")).where("id <> x.seed").select("x.seed", "id", cosine("v", "x.q").alias("sim"))
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("sim"), "id"))).where(F.col("rn") <= n).drop("rn")


def recipe(vectors: DataFrame, seeds: DataFrame, taste: DataFrame, size: int) -> DataFrame:
    """id, score: the tracks of a mix from its seeds (id): three parts the likeness to the nearest seed, one part taste (id, score); seeds come first."""
    s = F.broadcast(bounded(vectors.join(seeds, "id").groupBy().agg(F.collect_list("v").alias("qs"), F.collect_list("id").alias("ids")), "qs", MOST_SEEDS))
    near = F.coalesce(F.array_max(F.transform("qs", lambda q: cosine(F.col("v"), q))), F.lit(0.0))
    t = vectors.join(s, F.lit(True)).join(taste.select("id", F.col("score").alias("taste")), "id", "left")
    score = 0.75 * near + 0.25 * F.coalesce("taste", F.lit(0.0)) + F.when(F.array_contains("ids", F.col("id")), 1.0).otherwise(0.0)
    return t.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(size)


def decayed(centroids: DataFrame, last: int, now: int, least: float = 0.2) -> DataFrame:
    """Centroids whose mass halves every 90 days, once a week has gone by; those that fall below least go."""
    days = max(0, now - last) / 86_400
    if not last or days < 7:
        return centroids
    return centroids.withColumn("mass", F.col("mass") * 0.5 ** (days / 90)).where(F.col("mass") >= least)
