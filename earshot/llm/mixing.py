"""Mixing sources to target weights.

Every document gets a hash-random key; within its source, documents are ranged by that key, distributed prefix sums of
their sizes say where each one lies, and the mix is cut at the source's exact budget, after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Weights dealt to the sources in the order of their names, over and over.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets per source: share * all sizes dealt by weight, none above most * its own size, the excess dealt anew by weight.

    The fixpoint of that dealing has a closed form. Order sources by cap / weight; the first k are full where giving
    every other source level = (total - their caps) / (rest of the weights) leaves none of the first k below its cap.
    The windows here run over one row a source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.sum("weight").over(down))
        .withColumn("is_full", F.col("ratio") <= F.col("level"))
    )
    # Full sources form a prefix of the order, so the level of the rest is that of the first that is not full.
    level = F.min(F.when(~F.col("is_full"), F.struct("ratio", F.col("level").alias("at")))).over(everything)["at"]
    return s.select("source", "source_size", F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, buckets: int = 256) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken, and sample_key.

    - Null text counts as size 0 and takes 0. A null source is a source of its own, last in the order of names.
    - A null doc_id is a document like others. Rows equal in doc_id, source and size are interchangeable: which of them
      gets the cut is open, the multiset of results is not. Ties of the key break by doc_id, then size.
    - An empty table gives an empty result. Columns other than doc_id, text and source are ignored.

    buckets: key ranges a source, each one group of a window; a hot source is spread over that many tasks. The ranges are
    cut at fixed hash values, so recomputed tasks land on the same ranges.
    """
    rows = docs.select(
        F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("sample_key"),
    ).withColumn("bucket", F.floor(F.conv(F.substring("sample_key", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("int"))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
        .alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
        .select("p.source", "p.bucket", "p.part_before", "t.source_size", "t.target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("sample_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("o.target") + F.lit(1e-6))
    epochs = F.when(F.col("o.source_size") > 0, F.floor(budget / F.col("o.source_size"))).otherwise(F.lit(0))
    out = placed.alias("r").join(offsets.alias("o"), F.expr("r.source <=> o.source and r.bucket = o.bucket")).select(
        "r.doc_id", "r.source", "r.size", "o.source_size", "o.target", "r.sample_key", epochs.cast("long").alias("epochs"),
        (budget - epochs * F.col("o.source_size") - F.col("o.part_before") - F.col("r.in_part")).cast("long").alias("left"),
    )
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "sample_key")
