"""Helpers that the training-text operators share."""

from __future__ import annotations

import contextlib
import re
from contextvars import ContextVar
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir. Where that is unset a local master gets a folder of this machine, any other an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


#: Paths of the tables written inside the innermost tables_of() of this thread; what is written outside of any is the caller's to discard.
_scope: ContextVar[list[str] | None] = ContextVar("tables written", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (written := _scope.get()) is not None:
        written.append(path)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is executed inside deletes its own shuffle files at its end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once all that was made from them is written too."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of the file system that Spark takes it to be in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


@contextlib.contextmanager
def tables_of(spark: SparkSession):
    """Tables written inside, by this thread, are deleted at the end, whether it comes to a good one or not, but for those that the caller puts on the list it gets."""
    written: list[str] = []
    kept: list[DataFrame] = []
    token, names = _scope.set(written), set()
    try:
        yield kept
        names = {f.split("/")[-2] for df in kept for f in df.inputFiles()}
    finally:
        _scope.reset(token)
        for path in written:
            if path.rpartition("/")[2] not in names:
                _delete(spark, path)
        if (outer := _scope.get()) is not None:
            outer += [p for p in written if p.rpartition("/")[2] in names]


def packed(docs: DataFrame, **keys) -> DataFrame:
    """docs as one column, row, beside the keys: no column of the caller's can clash with one of ours. select("row.*") brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(col):
    """Lower-case A to Z only, as the word contracts ask; other letters stay."""
    return F.translate(col, UPPER, LOWER)
