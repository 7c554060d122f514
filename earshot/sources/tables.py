"""Logical tables of a listening library, as views over whatever tables hold them. These read the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRACK rows from part."""
    return as_tracks(read(spark, sf_dir, "part"))


def as_tracks(p: DataFrame) -> DataFrame:
    return p.select(
        F.concat(F.lit("/lib/"), "p_type", F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.concat("p_brand", F.lit(" "), "p_type").alias("album"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("VA "), F.col("p_brand"))).alias("album_artist"), F.col("p_type").alias("genre"),
        (F.lit(1950) + F.col("p_size")).alias("year"), (F.lit(60.0) + F.col("p_size") * 10).alias("duration"),
        (F.lit(1_706_572_800) - F.col("p_partkey") * 3600).cast("double").alias("mtime"), F.col("p_partkey").alias("seq"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAT rows from lineitem: one a track that was played."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("seq")).agg(
        F.count(F.lit(1)).alias("plays"), F.max(F.unix_timestamp(F.col("l_shipdate"))).alias("last_played"),
        F.least(F.lit(10), F.count_if(F.col("l_returnflag") == "R")).cast("long").alias("skips")).withColumn("rating", (1 + F.pmod("seq", F.lit(5))).cast("long"))


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENT rows from events."""
    return as_listens(read(spark, sf_dir, "events"))


def as_listens(e: DataFrame) -> DataFrame:
    kinds = {"purchase": "Like", "signup": "AddedManually", "view": "FullPlay", "click": "SkipMid", "error": "SkipEarly"}
    return e.select(
        F.get_json_object("props", "$.k").cast("long").alias("track"), F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")).alias("kind"),
        F.unix_timestamp(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), "user_id", "value")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP rows from embeddings."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.lit(60.0) + F.pmod(F.col("vec_id") * 7, F.lit(140))).alias("bpm"), "label")
