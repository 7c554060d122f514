"""Means and deviations that grow with a library, and fingerprints that follow them.

The state is a row a dimension: count, mean and sum of squared distances, which merge pairwise, so that a batch of new vectors is read
once and the rest never again. Each fingerprint is kept with the count of the state that made it; those made by a state more than a tenth smaller are due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.vectors import EPSILON, dot

#: Growth of the library after which a fingerprint is made anew.
GROWTH = 1.1


def state_of(raw: DataFrame) -> DataFrame:
    """dim, n, mean, m2 of raw vectors (id, v)."""
    return raw.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_pop("x") * F.count("x"), F.lit(0.0)).alias("m2"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several, as if all their vectors had been read at once."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)

    def add(a, b):
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    one = every.groupBy("dim").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))), nothing, add).alias("s"))
    return one.select("dim", "s.n", "s.mean", "s.m2")


def moments(state: DataFrame) -> DataFrame:
    """dim, mean, std (of a sample; 1 for a single vector)."""
    return state.select("dim", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(1.0).alias("std"))


def fingerprints_by(raw: DataFrame, state: DataFrame) -> DataFrame:
    """Raw vectors (id, v, bpm) as fingerprints by a state: id, v, bpm and made_by, the state's count. The state is one row of as many numbers as there are dimensions."""
    one = moments(state).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))), lambda e: e).alias("ms"))
    one = one.join(state.agg(F.max("n").alias("made_by")), F.lit(True))
    z = F.zip_with("v", "ms", lambda x, m: F.when(m["std"] > 1e-9, (x.cast("double") - m["mean"]) / m["std"]).otherwise(0.0))
    t = raw.join(F.broadcast(one), F.lit(True)).select("id", "bpm", "made_by", z.alias("z"))
    # The length is bound once a row by a list of one; inside the inner function it would be computed for every number.
    bound = F.transform(F.array(F.struct(F.col("z").alias("z"), F.sqrt(dot("z", "z")).alias("n"))), lambda e: F.when(e["n"] > EPSILON, F.transform(e["z"], lambda x: x / e["n"])).otherwise(e["z"]))
    return t.select("id", F.get(bound, F.lit(0)).alias("v"), "bpm", "made_by")


def due(prints: DataFrame, state: DataFrame, growth: float = GROWTH) -> DataFrame:
    """The fingerprints that a state grown by more than a tenth since makes anew."""
    n = state.agg(F.max("n").alias("now"))
    return prints.join(F.broadcast(n), F.lit(True)).where(F.col("now") > growth * F.col("made_by")).drop("now")


def refreshed(prints: DataFrame, raw: DataFrame, state: DataFrame, growth: float = GROWTH) -> DataFrame:
    """id, v, bpm, made_by, anew: fingerprints of all raw vectors (id, v, bpm); those not due stay as they are, the due ones and those that had none are made by the state."""
    kept = prints.join(due(prints, state, growth).select("id"), "id", "left_anti").join(raw.select("id"), "id", "left_semi")
    anew = fingerprints_by(raw.join(kept.select("id"), "id", "left_anti"), state)
    return kept.select("id", "v", "bpm", "made_by", F.lit(False).alias("anew")).unionByName(anew.withColumn("anew", F.lit(True)))
