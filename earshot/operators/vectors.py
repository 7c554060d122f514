"""Feature vectors: normalising, cosine search, described-sound search and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07
#: Centroids that a table may hold: they go to every task as one row.
MOST_CENTROIDS = 10_000


def one_row(centroids: DataFrame, *fields: str) -> DataFrame:
    """The centroids as one row, cs, in order of their fields; more than MOST_CENTROIDS are an error, as that row goes to every task."""
    row = centroids.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cs"))
    return row.withColumn("cs", F.when(F.size("cs") <= MOST_CENTROIDS, F.col("cs")).otherwise(F.raise_error(F.lit("too many centroids"))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 where either has no length to speak of."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na <= EPSILON) | (nb <= EPSILON), 0.0).otherwise(dot(a, b) / F.sqrt(na * nb))


def moments(vectors: DataFrame) -> DataFrame:
    """dim, mean, std (of a sample; 1 for fewer than two vectors) of every dimension."""
    long = vectors.select(F.posexplode("v").alias("dim", "x"))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(F.count("x") > 1, F.stddev_samp("x")).otherwise(1.0).alias("std"))


def similar(vectors: DataFrame, to: int, n: int) -> DataFrame:
    """The n vectors most like one of them: id, sim."""
    seed = vectors.where(F.col("id") == to).select(F.col("v").alias("q")).limit(1)
    return vectors.where(F.col("id") != to).join(F.broadcast(seed), F.lit(True)).select("id", cosine("v", "q").alias("sim")).orderBy(F.desc("sim"), "id").limit(n)


def described(vectors: DataFrame, weights: dict[int, float], n: int, bpm_min: float = 0, bpm_max: float = 0) -> DataFrame:
    """The n vectors that point most the way of named dimensions, above 0, within a tempo range (0: open). No weights: none."""
    size = max(weights, default=-1) + 1
    q = F.array(*[F.lit(float(weights.get(k, 0.0))) for k in range(size)])
    fit = vectors.where((F.lit(bpm_min <= 0) | (F.col("bpm") >= bpm_min)) & (F.lit(bpm_max <= 0) | (F.col("bpm") <= bpm_max)))
    norm = sum(x * x for x in weights.values()) ** 0.5
    if norm == 0:
        return fit.where(F.lit(False)).select("id", F.lit(0.0).alias("sim"))
    sim = dot(F.slice("v", 1, size), q) / (F.sqrt(dot("v", "v")) * norm)
    return fit.select("id", sim.alias("sim")).where("sim > 0").orderBy(F.desc("sim"), "id").limit(n)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Per group: dim and mean of its members, scaled to length 1 over the group."""
    means = vectors.select(by, F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("mean"))
    length = means.groupBy(by).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("len"))
    return means.join(length, by).select(by, "dim", F.when(F.col("len") > 0, F.col("mean") / F.col("len")).otherwise(F.col("mean")).alias("x"))


def fold_bpm(b) -> Column:
    """Doubled or halved into [70, 180); 0 or less is 0."""
    c = F.col(b) if isinstance(b, str) else b
    up, down = F.pow(F.lit(2.0), F.ceil(F.log2(70.0 / c))), F.pow(F.lit(2.0), F.floor(F.log2(c / 180.0)) + 1)
    return F.when(c <= 0, 0.0).when(c < 70, c * up).when(c >= 180, c / down).otherwise(c)
