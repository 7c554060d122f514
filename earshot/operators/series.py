"""Curves over time: buckets, smoothing, tiers with hysteresis, sections, peaks and listening sessions.

Input rows are points id, i (their order within id) and v. Every step is a window over one id or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A half width of smoothing, in whole numbers.
SCALE = 1_000_000_000
# A tier is entered at the first level and left below the second.
ENTER = {1: (0.44, 0.34), 2: (0.72, 0.62)}


def numbered(points: DataFrame, *order: str) -> DataFrame:
    """Points with i from 0 in the given order and n, the number of points of their id."""
    return points.withColumns({"i": F.row_number().over(Window.partitionBy("id").orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("id"))})


def bucket_means(points: DataFrame, at: str, width: float, least: float = 0.001) -> DataFrame:
    """id, bucket, mean, n of what lies in each stretch of that width; values up to least are silence and left out."""
    return points.where(F.col("v") > least).groupBy("id", F.floor(F.col(at) / width).alias("bucket")).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def carried_forward(points: DataFrame) -> DataFrame:
    """v with gaps (null) filled by the last value before them."""
    return points.withColumn("v", F.last("v", ignorenulls=True).over(Window.partitionBy("id").orderBy("i")))


def smoothed(points: DataFrame, before: int, after: int) -> DataFrame:
    """Adds mean, over so many points before and after."""
    return points.withColumn("mean", F.avg("v").over(Window.partitionBy("id").orderBy("i").rowsBetween(-before, after)))


def enhanced(points: DataFrame, trail: int) -> DataFrame:
    """Adds onset: what rises above the trailing mean, over its deviation within the id."""
    rise = smoothed(points, trail - 1, 0).withColumn("rise", F.greatest(F.lit(0.0), F.col("v") - F.col("mean")))
    dev = F.stddev_pop("rise").over(Window.partitionBy("id"))
    return rise.withColumn("onset", F.when(dev > 1e-9, F.col("rise") / dev).otherwise(F.col("rise"))).drop("rise", "mean")


def peaks(points: DataFrame) -> DataFrame:
    """Local maxima above mean and one deviation of their id: id, i, v, gap (points since the peak before)."""
    by, whole = Window.partitionBy("id").orderBy("i"), Window.partitionBy("id")
    t = points.withColumns({"was": F.lag("v").over(by), "next": F.lead("v").over(by), "level": F.avg("v").over(whole) + F.stddev_pop("v").over(whole)})
    t = t.where("v > was and v >= next and v > level")
    return t.select("id", "i", "v", (F.col("i") - F.lag("i").over(by)).alias("gap"))


def _hysteresis(level: Column, enter: float, leave: float, begins: bool) -> Column:
    """On from enter, off below leave, and between them as before."""
    by = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(level >= enter, True).when(level < leave, False), ignorenulls=True).over(by), F.lit(begins))


def tiers(points: DataFrame) -> DataFrame:
    """Adds level (the smoothed curve from its lower to its upper tenth as 0 to 1) and tier 0, 1 or 2. Needs n."""
    w = F.greatest(F.lit(2), F.floor(F.col("n") * 0.02))
    # The half width differs by id, and a window's frame can't. Points are as far apart as one over their id's half width, so that a frame of fixed range holds it.
    along = Window.partitionBy("id").orderBy("_x").rangeBetween(-SCALE - 100, SCALE + 100)
    sm = points.withColumn("_x", F.floor(F.col("i").cast("double") * SCALE / w)).withColumn("sm", F.avg("v").over(along)).drop("_x")
    ranked = sm.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("sm")) - 1)
    pick = lambda q: F.max(F.when(F.col("rank") == F.floor(F.col("n") * q), F.col("sm"))).over(Window.partitionBy("id"))
    ranged = ranked.withColumns({"low": pick(0.1), "high": pick(0.9)}).withColumn("high", F.when(F.col("high") == 0, 1.0).otherwise(F.col("high")))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sm") - F.col("low")) / F.greatest(F.lit(1e-4), F.col("high") - F.col("low"))))
    out = ranged.withColumn("level", F.round(level, 9)).drop("rank", "low", "high")
    return out.withColumn("tier", _hysteresis(F.col("level"), *ENTER[1], True).cast("int") + _hysteresis(F.col("level"), *ENTER[2], False).cast("int"))


def sections(points: DataFrame) -> DataFrame:
    """id, section, first, last, tier, label: runs of one tier, short ones taken into the run before them."""
    by = Window.partitionBy("id").orderBy("i")
    t = tiers(points).withColumn("turn", F.coalesce((F.col("tier") != F.lag("tier").over(by)).cast("int"), F.lit(0)))
    runs = t.withColumn("run", F.sum("turn").over(by)).groupBy("id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.first("tier").alias("tier"), F.first("n").alias("n"))
    short = F.col("last") - F.col("first") + 1 < F.greatest(F.lit(2), F.floor(F.col("n") * 0.035))
    along = Window.partitionBy("id").orderBy("run")
    kept = runs.withColumn("section", F.sum(F.when((F.col("run") == 0) | ~short, 1).otherwise(0)).over(along) - 1)
    out = kept.groupBy("id", "section").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("tier", "run").alias("tier"))
    end = F.max("section").over(Window.partitionBy("id"))
    label = F.when(F.col("section") == 0, "Intro").when(F.col("section") == end, "Outro").when(F.col("tier") == 2, "Drop").when(F.col("tier") == 0, "Break").otherwise("Verse")
    return out.withColumn("label", label)


def waveform(points: DataFrame, buckets: int) -> DataFrame:
    """id, bucket, peak: the largest swing in each of the buckets over the largest of all; points past the last whole bucket are dropped. Needs n."""
    per = F.greatest(F.lit(1), F.floor(F.col("n") / buckets))
    b = points.withColumn("bucket", F.floor(F.col("i") / per)).where(F.col("bucket") < buckets).groupBy("id", "bucket").agg(F.max(F.abs("v")).alias("peak"))
    top = F.max("peak").over(Window.partitionBy("id"))
    return b.withColumn("peak", F.when(top > 0, F.col("peak") / top).otherwise(0.0))


def listening_sessions(plays: DataFrame) -> DataFrame:
    """Rows id, seq, ts, track to one row a stretch of one track: id, session, track, start, finish, events, ordered by arrival."""
    by = Window.partitionBy("id").orderBy("seq")
    t = plays.withColumn("turn", F.when(F.lag("track").over(by).eqNullSafe(F.col("track")) & (F.row_number().over(by) > 1), 0).otherwise(1))
    t = t.withColumn("session", F.sum("turn").over(by) - 1)
    return t.groupBy("id", "session").agg(F.first("track").alias("track"), F.min("ts").alias("start"), F.max("ts").alias("finish"), F.count(F.lit(1)).alias("events"))


def containing(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Each point (id, at) with the span (id, first, last, label) it lies in; spans of an id don't overlap. By one sort an id."""
    a = spans.select("id", F.col("first").alias("k"), F.struct("last", "label").alias("x"), F.lit(0).alias("side"))
    b = points.select("id", F.col("at").alias("k"), F.lit(None).cast(a.schema["x"].dataType).alias("x"), F.lit(1).alias("side"))
    found = a.union(b).withColumn("x", F.last("x", ignorenulls=True).over(Window.partitionBy("id").orderBy("k", "side"))).where("side = 1")
    return found.select("id", F.col("k").alias("at"), F.when(F.col("k") <= F.col("x.last"), F.col("x.label")).alias("label"))
