"""A local session with the settings that tests and the benchmark use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("earshot")
        .config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor see, below spark.checkpoint.dir. Where that is unset a local master gets a folder of this machine, any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
