"""Stores of a library: replaced tables, JSON caches and backups, sound files and the stream of a scan."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A name that a reader gives what it can't read.
UNKNOWN = "<unknown>"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *names]))


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the versions of a table that were finished, oldest first. There is one empty file a version, made once and never changed."""
    fs, at = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at("_done"))) if fs.exists(at("_done")) else []


def commit(spark: SparkSession, folder: str, name: str) -> None:
    """Declare a version finished."""
    fs, at = _fs(spark, folder)
    fs.create(at("_done", name), False).close()


def forget(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Delete versions, their declarations first."""
    fs, at = _fs(spark, folder)
    for name in names:
        fs.delete(at("_done", name), False)
        fs.delete(at(name), True)


def replace_table(rows: DataFrame, folder: str, keep: int = 2) -> None:
    """Replace the table in a folder as a whole: a new numbered version is written, then one empty file is made that declares it finished.

    Readers take the greatest finished version, so at no time do they find none or half of one, wherever a writer fails. Of two writers at
    once the one with the greater name holds. The last keep versions stay, so that who reads the one before isn't cut off.
    """
    spark = rows.sparkSession
    before = committed(spark, folder)
    version = f"v{int(before[-1][1:].split('-')[0]) + 1 if before else 0:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{version}")
    commit(spark, folder, version)
    forget(spark, folder, before[: max(0, len(before) + 1 - keep)])


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{committed(spark, folder)[-1]}")


def clear_table(spark: SparkSession, folder: str) -> None:
    """Leave a table without rows, with its columns."""
    replace_table(read_table(spark, folder).where(F.lit(False)), folder)


def save_states(states: dict[str, DataFrame], folder: str) -> None:
    """Each part of a model in a table of its own, so that one can be replaced without the others."""
    for name, rows in states.items():
        replace_table(rows, f"{folder}/{name}")


def save_cache(rows: DataFrame, folder: str, source: str) -> None:
    """Rows as JSON lines, and beside them one line that tells their source and number."""
    rows.write.mode("overwrite").json(f"{folder}/rows")
    rows.sparkSession.read.text(f"{folder}/rows").agg(F.count(F.lit(1)).alias("total")).select(F.lit(source).alias("source"), "total").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def page_of(rows: DataFrame, by: str, skip: int, n: int) -> DataFrame:
    """A page of rows in a fixed order; what is negative counts as 0."""
    return rows.orderBy(by).offset(max(0, skip)).limit(max(0, n))


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, and the other columns as one JSON text."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    """What as_json wrote; a text that is broken gives nulls."""
    keys = [c for c in rows.columns if c != "json"]
    return rows.select(*keys, F.from_json("json", schema).alias("x")).select(*keys, "x.*")


def section_files(tracks: DataFrame) -> DataFrame:
    """name, text: a JSON file for each track's sections. Tracks have title, artist, path, length, bpm, first_beat and sections (start and end as shares, tier, label)."""
    seconds = F.transform("sections", lambda s: F.struct(s["label"].alias("label"), s["tier"].alias("tier"), (s["start"] * F.col("length")).alias("startSec"), (s["end"] * F.col("length")).alias("endSec")))
    doc = F.struct(F.lit("earshot.sections").alias("format"), F.lit(1).alias("version"), "title", "artist", "path", F.col("length").alias("durationSec"), "bpm", F.col("first_beat").alias("firstBeatSec"), seconds.alias("sections"))
    name = F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), F.lit("track")), r"[^\w.-]+", "_")
    return tracks.select(F.concat(name, F.lit(".sections.json")).alias("name"), F.to_json(doc).alias("text"))


def backup(settings: DataFrame, prefix: str) -> DataFrame:
    """The settings (key, value) that are ours, by their prefix; without a value they are left out. Restoring is upserting them."""
    return settings.where(F.startswith("key", F.lit(prefix)) & F.col("value").isNotNull()).select("key", "value")


def media_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a media index with blanks and names of nothing as null."""
    clean = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN))
    return rows.withColumns({c: clean(c) for c in columns})


def below(rows: DataFrame, folder: str) -> DataFrame:
    """Rows whose path lies in a folder, at whatever depth."""
    return rows.where(F.startswith("path", F.lit(folder.rstrip("/") + "/")))


def samples_of(rows: DataFrame) -> DataFrame:
    """id, samples: little-endian 32-bit floats in base64 (id, data)."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "samples": [np.frombuffer(x, dtype="<f4").tolist() for x in f["raw"]]})

    return rows.select("id", F.unbase64("data").alias("raw")).mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, samples array<float>")


def wave_header(head: bytes) -> tuple[int, int, int, int] | None:
    """Rate, channels, where the samples begin and their bytes, from the first bytes of a 16-bit WAV file; nothing for another file."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate, channels = 12, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(head):
            channels, rate = int.from_bytes(head[at + 10 : at + 12], "little"), int.from_bytes(head[at + 12 : at + 16], "little")
            if int.from_bytes(head[at + 22 : at + 24], "little") != 16 or not channels or not rate:
                return None
        elif name == b"data":
            return (rate, channels, at + 8, size) if rate else None
        at += 8 + size + size % 2
    return None


def own_seconds(files: DataFrame) -> DataFrame:
    """id, sec, rate, samples: whole 16-bit WAV files (path, content) as mono seconds at their own rate. The last second is as long as it is. What is no such file has no rows."""
    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                content = b"" if content is None else bytes(content)
                found = wave_header(content[:65_536])
                if not found:
                    continue
                rate, channels, at, size = found
                whole = min(size, len(content) - at) // (2 * channels)
                for sec in range(-(-whole // rate)):
                    n = min(rate, whole - sec * rate)
                    x = np.frombuffer(content, dtype="<i2", count=n * channels, offset=at + sec * rate * channels * 2)
                    yield pd.DataFrame({"id": [path], "sec": np.array([sec], dtype=np.int32), "rate": np.array([rate], dtype=np.int32), "samples": [(x.reshape(-1, channels).mean(axis=1) / 32_768).astype(np.float32)]})

    return files.select("path", "content").mapInPandas(run, "id string, sec int, rate int, samples array<float>")


def low_pass(own: int, rate: int, lobes: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Where each of a second's rate samples lies among own ones, and the weights of those around it: a windowed sinc that lets through what lies below nine tenths of half the lower rate."""
    cutoff = 0.9 * min(rate, own) / own  # as a share of half the own rate
    half = int(np.ceil(lobes / cutoff))
    at = np.arange(rate) * (own / rate)
    near = np.floor(at).astype(int)[:, None] + np.arange(-half, half + 1)
    apart = near - at[:, None]
    weights = cutoff * np.sinc(cutoff * apart) * (0.5 + 0.5 * np.cos(np.pi * np.clip(apart / (half + 1), -1, 1)))
    return near, weights / weights.sum(axis=1, keepdims=True)


def thinned(seconds: DataFrame, rate: int = 4000, longest: int | None = None) -> DataFrame:
    """id, sec, samples: seconds (id, sec, rate, samples) thinned to a lower rate, without what that rate can't hold.

    A second is filtered together with the tail of the one before and the head of the one after, which come by a join on the second, so that it
    doesn't matter where blocks are cut, and no recording is one group. Before the first and after the last second there is silence.
    longest: seconds taken, all by default.
    """
    s = seconds if longest is None else seconds.where(F.col("sec") < longest)
    edge = 8_192  # more than any filter's half at rates up to 192 kHz
    tail = s.select("id", (F.col("sec") + 1).alias("sec"), F.slice("samples", F.greatest(F.lit(1), F.size("samples") - edge + 1), F.lit(edge)).alias("before"))
    head = s.select("id", (F.col("sec") - 1).alias("sec"), F.slice("samples", 1, edge).alias("after"))
    joined = s.join(tail, ["id", "sec"], "left").join(head, ["id", "sec"], "left").select("id", "sec", "rate", "before", "samples", "after")

    def run(frames):
        filters: dict = {}
        for f in frames:
            out = []
            for own, before, x, after in zip(f["rate"], f["before"], f["samples"], f["after"], strict=True):
                near, weights = filters.setdefault(int(own), low_pass(int(own), rate))
                half = weights.shape[1] // 2
                part = lambda v: np.zeros(0) if v is None else np.asarray(v, dtype=float)
                x, before, after = part(x), part(before)[-half:], part(after)[: half + 1]
                line = np.zeros(half + int(own) + half + 1)
                line[half - len(before) : half] = before
                line[half : half + len(x)] = x
                line[half + len(x) : half + len(x) + len(after)] = after
                n = min(rate, int(np.ceil(len(x) * rate / own)))
                out.append((line[near[:n] + half] * weights[:n]).sum(axis=1).astype(np.float32))
            yield pd.DataFrame({"id": f["id"], "sec": f["sec"], "samples": out})

    return joined.mapInPandas(run, "id string, sec int, samples array<float>")


def wave_seconds(files: DataFrame, rate: int = 4000, longest: int | None = None) -> DataFrame:
    """id, sec, samples: the mono sound of whole 16-bit WAV files (path, content), a second at a time, filtered and thinned to rate."""
    return thinned(own_seconds(files), rate, longest)


def scanned(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files found (path, mtime; a stream or a table) with state: unchanged if known (path, mtime) has them as they are, else changed. What is removed shows only at the end of a scan: see scan_diff."""
    return found.join(known.select("path", F.col("mtime").alias("_was")), "path", "left").withColumn("state", F.when(F.col("_was") == F.col("mtime"), "unchanged").otherwise("changed")).drop("_was")


def folder_album(path) -> Column:
    """The folder that a file lies in, as the name of its album."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("Folder")
