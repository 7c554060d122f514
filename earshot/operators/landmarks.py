"""Recordings found in mixes by an index of landmarks.

A second's peak says which bands rose most and which fell most since the second before. Two peaks at most REACH seconds apart make a landmark,
whose hash is the key of an inverted index. Where a mix and a recording share landmarks, the differences of their places vote for an offset;
only offsets with enough votes are correlated, second by second. No mix meets a recording with which it shares nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.sound import LEAST_FRAMES, LEAST_MIX, LEAST_SCORE
from earshot.operators.tours import stored

#: Seconds between the peaks of a landmark; votes that an offset needs, and the share of the best offset's; recordings' places of a landmark that one task joins; seconds of a curve's stretch.
REACH, LEAST_VOTES, VOTE_SHARE, BLOCK, SPAN = 3, 4, 0.5, 20_000, 256


def _peaks(frames: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of curves (arrays of a second's bands) the peak of every step from a second to the next, and which curve it is of.

    A peak names the bands that rose most and second most, and that fell most; -1 where none rose or none fell, or bands are missing. Of
    equal ones the lower band rises and the higher one falls.
    """
    seconds = frames.flatten()
    bands = seconds.flatten()
    size = pc.fill_null(pc.list_value_length(seconds), -1).to_numpy().astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
    v = pc.fill_null(bands, 0).to_numpy().astype(np.int64)
    lacks = np.concatenate(([0], np.cumsum(pc.is_null(bands).to_numpy(zero_copy_only=False))))[begin]
    curve = np.repeat(np.arange(len(frames)), pc.fill_null(pc.list_value_length(frames), 0).to_numpy())
    step = np.flatnonzero(curve[1:] == curve[:-1])
    whole = (size[step] == size[step + 1]) & (size[step] > 1) & (lacks[step] == lacks[np.minimum(step + 2, len(lacks) - 1)])
    peak = np.full(len(step), -1, dtype=np.int64)
    for n in np.unique(size[step][whole]).tolist():
        at = np.flatnonzero(whole & (size[step] == n))
        place = np.arange(n)
        change = (v[begin[step[at] + 1][:, None] + place] - v[begin[step[at]][:, None] + place]) * 100 + (99 - place)
        change.sort(axis=1)
        rose, second, fell = change[:, -1], change[:, -2], change[:, 0]
        band = lambda e: 99 - e % 100
        peak[at] = np.where((rose >= 100) & (fell < 0), (band(rose) * 100 + band(second)) * 100 + band(fell), -1)
    return peak, curve[step]


def landmarks(curves: DataFrame, reach: int = REACH, span: int = SPAN) -> DataFrame:
    """id, at, key: the landmarks of curves (id, frames: an array of a second's bands each). A second without change has no peak, so silence has no landmarks.

    Curves are cut into stretches of span seconds, each with as many of the next as its landmarks reach.
    """
    cuts = F.when(F.size("frames") > 1, F.sequence(F.lit(0), F.size("frames") - 2, F.lit(span)))
    pieces = curves.select("id", F.explode(F.transform(cuts, lambda a: F.struct(a.alias("a"), F.slice("frames", a + 1, span + reach + 1).alias("frames")))).alias("x")).select("id", "x.a", "x.frames")

    def run(batches):
        for b in batches:
            peak, curve = _peaks(b.column(2))
            first = np.searchsorted(curve, np.arange(len(b)))
            at = np.arange(len(peak)) - first[curve]
            for d in range(1, reach + 1):
                i = np.flatnonzero((curve[d:] == curve[: len(curve) - min(d, len(curve))]) & (peak[d:] >= 0) & (peak[: len(peak) - min(d, len(peak))] >= 0) & (at[: len(at) - min(d, len(at))] < span))
                own = curve[i]
                start = b.column(1).to_numpy()[own] + at[i]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(start.astype(np.int32)), pa.array((peak[i] * 1_000_000 + peak[i + d]) * 10 + d)], names=["id", "at", "key"])

    return pieces.mapInArrow(run, f"id {curves.schema['id'].dataType.simpleString()}, at int, key long")


def votes(mixes: DataFrame, recordings: DataFrame, block: int = BLOCK) -> DataFrame:
    """mix, id, off, votes: how many landmarks of a recording lie off seconds later in a mix. Both are id, at, key.

    A landmark that many recordings have is dealt out by the places it has there: so many of the recordings' rows go to one task, and the
    mixes' rows of that key to each of these tasks. There are at most a block-th as many such landmarks as rows, so they go to every task.
    """
    recordings = stored(recordings, "landmarks")
    hot = recordings.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces")).where("pieces > 1")
    pieces = F.coalesce("pieces", F.lit(1))
    left = mixes.join(F.broadcast(hot), "key", "left").select("key", F.col("id").alias("mix"), F.col("at").alias("mix_at"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    right = recordings.join(F.broadcast(hot), "key", "left").select("key", "id", "at", F.pmod(F.xxhash64("id", "at"), pieces).cast("int").alias("piece"))
    met = left.join(right, ["key", "piece"]).where("mix <> id")
    return met.groupBy("mix", "id", (F.col("mix_at") - F.col("at")).alias("off")).agg(F.count(F.lit(1)).alias("votes")).where("off >= 0")


def hits(mixes: DataFrame, recordings: DataFrame, least_votes: int = LEAST_VOTES, share: float = VOTE_SHARE) -> DataFrame:
    """mix, id, start, finish, score: for every recording that has votes in a longer mix the offset of the greatest mean cosine over what overlaps. Both are id, length, frames."""
    long = stored(mixes.where((F.col("length") >= LEAST_MIX) & (F.size("frames") >= LEAST_FRAMES)).select("id", "length", "frames"), "mixes")
    short = stored(recordings.where(F.size("frames") >= LEAST_FRAMES).select("id", "length", "frames"), "recordings")
    found = votes(landmarks(long), landmarks(short)).where(F.col("votes") >= least_votes)
    best = F.max("votes").over(Window.partitionBy("mix", "id"))
    tried = found.withColumn("best", best).where(F.col("votes") >= share * F.col("best")).select("mix", "id", "off")
    sized = lambda df, *names: df.select(F.col("id").alias(names[0]), F.col("length").alias(names[1]), F.size("frames").alias(names[2]))
    tried = tried.join(sized(long, "mix", "mix_length", "mix_n"), "mix").join(sized(short, "id", "length", "n"), "id").where("length < mix_length")
    tried = tried.withColumn("overlap", F.least("n", F.col("mix_n") - F.col("off"))).where(F.col("overlap") >= LEAST_FRAMES).select("mix", "id", "off", "overlap")
    seconds = lambda df, key, sec, frame: df.select(F.col("id").alias(key), F.posexplode("frames").alias(sec, frame))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    pairs = tried.join(seconds(short, "id", "sec", "theirs"), "id").withColumn("mix_sec", F.col("off") + F.col("sec")).join(seconds(long, "mix", "mix_sec", "ours"), ["mix", "mix_sec"])
    size = F.sqrt(dot("ours", "ours") * dot("theirs", "theirs"))
    scores = pairs.select("mix", "id", "off", "overlap", (dot("ours", "theirs") / F.when(size > 0, size).otherwise(1.0)).alias("cos")).groupBy("mix", "id", "off", "overlap").agg((F.sum("cos") / F.col("overlap")).alias("score"))
    top = scores.groupBy("mix", "id").agg(F.max(F.struct(F.col("score"), (-F.col("off")).alias("o"), F.col("overlap"))).alias("b"))
    at = -F.col("b.o")
    return top.where(F.col("b.score") >= LEAST_SCORE).select("mix", "id", at.alias("start"), (at + F.col("b.overlap")).alias("finish"), F.col("b.score").alias("score"))


def without_overlaps(hits: DataFrame) -> DataFrame:
    """The hits that no better hit of their mix that stays overlaps; ties go to the lesser id."""
    def kept(x: pd.DataFrame) -> pd.DataFrame:
        rows, taken = [], []
        for r in x.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            if all(r.start >= b or r.finish <= a for a, b in taken):
                taken.append((r.start, r.finish))
                rows.append(r)
        return pd.DataFrame(rows, columns=x.columns)

    return hits.groupBy("mix").applyInPandas(kept, hits.schema)
