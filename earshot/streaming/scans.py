"""A stream of scans that builds a library.

A scan walks the folders once and is a generation: its stream has a row a file found (generation, path, mtime and what else is known of it), and
a row without a path when it has come to its end. Each micro-batch is written once as a delta, under its number, without reading the library;
the library is the last base with the deltas since. The batch in which a generation ends makes the next base: who was not found in that
generation is removed. A batch that runs again finds itself declared finished, or replaces what it left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.sources.stores import commit, committed, forget

_DELTA, _BASE = "delta-", "base-"


def _row(columns: list[str]):
    return F.struct(*[F.col(c) for c in columns]).alias("row")


def _found(batch: DataFrame, number: int) -> DataFrame:
    """path, generation, batch, row: a path that a batch has twice counts once a generation, with its latest mtime."""
    columns = [c for c in batch.columns if c != "generation"]
    files = batch.where("path is not null").select("path", "generation", _row(columns))
    return files.groupBy("path", "generation").agg(F.max_by("row", F.coalesce("row.mtime", F.lit(float("-inf")))).alias("row")).select("path", "generation", F.lit(number).cast("long").alias("batch"), "row")


def _merged(parts: DataFrame) -> DataFrame:
    """path, generation, batch, row of each path from all that was written of it: the row holds from the last time that its mtime was another one or unknown."""
    steps = F.array_sort(F.collect_list(F.struct("generation", "batch", "row")))
    same = lambda a, b: F.coalesce(a["row"]["mtime"] == b["row"]["mtime"], F.lit(False))
    held = F.aggregate(F.slice("steps", 2, F.size("steps")), F.get("steps", F.lit(0)), lambda s, x: F.when(same(s, x), s).otherwise(x))
    last = F.element_at("steps", -1)
    return parts.groupBy("path").agg(steps.alias("steps")).select("path", last["generation"].alias("generation"), last["batch"].alias("batch"), held["row"].alias("row"))


def _parts(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame | None:
    done = committed(spark, folder)
    number = lambda name: int(name.rpartition("-")[2])
    bases = [n for n in done if n.startswith(_BASE) and (upto is None or number(n) < upto)]
    since = number(bases[-1]) if bases else -1
    names = bases[-1:] + [n for n in done if n.startswith(_DELTA) and number(n) > since and (upto is None or number(n) < upto)]
    return spark.read.parquet(*[f"{folder}/{n}" for n in names]) if names else None


def library(spark: SparkSession, folder: str) -> DataFrame | None:
    """The library as it is now: the columns of the scan, and the generation in which a file was last found. None before the first batch."""
    parts = _parts(spark, folder)
    return None if parts is None else _merged(parts).select("row.*", "generation")


def merge_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Take one batch of a scan stream into the library in folder."""
    spark = batch.sparkSession
    delta, base = f"{_DELTA}{number:012d}", f"{_BASE}{number:012d}"
    done = committed(spark, folder)
    if any(int(n.rpartition("-")[2]) >= number for n in done):  # batches come in order
        return
    found = _found(batch, number)
    ended = batch.where("path is null").agg(F.max("generation")).first()[0]
    if ended is None:
        found.write.mode("overwrite").parquet(f"{folder}/{delta}")
        commit(spark, folder, delta)
        return
    before = _parts(spark, folder, number)
    now = _merged(found if before is None else before.unionByName(found))
    here = F.col("generation") >= ended
    now.where(here).write.mode("overwrite").parquet(f"{folder}/{base}")
    now.where(~here).select("path", F.lit(ended).alias("generation")).write.mode("overwrite").parquet(f"{folder}/removed/batch={number}")
    commit(spark, folder, base)
    bases = [n for n in done if n.startswith(_BASE)]
    if bases:  # what the base before this one was made from can go
        forget(spark, folder, [n for n in done if n.rpartition("-")[2] <= bases[-1].rpartition("-")[2] and n != bases[-1]])


def removed(spark: SparkSession, folder: str) -> DataFrame:
    """path, generation, batch: what each finished generation no longer found."""
    return spark.read.schema("path string, generation long, batch int").parquet(f"{folder}/removed")


def keep_library(scans: DataFrame, folder: str) -> DataFrame:
    """Run a scan stream over all that is there and read the library; to go on later, call it again with the same folder."""
    stream = scans.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda batch, number: merge_batch(batch, number, f"{folder}/library"))
    stream.trigger(availableNow=True).start().awaitTermination()
    return library(scans.sparkSession, f"{folder}/library")
