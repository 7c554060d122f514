"""Measures of sampled sound and of what a mix contains: envelopes, onsets, tempo votes, features of a genre, curves of an equalizer, and recordings found in a mix.

Curves are rows id, i, v, and each measure is an aggregate or a window over one id. Only the correlation of two recordings'
frames is array code; Spark deals its pairs out in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A house curve and how far a correction goes towards it; scales of a genre's features; frames that a match needs and its least
# likeness; the shortest mix in seconds.
HOUSE = [4.0, 3.0, 1.5, 0.0, -0.5, -0.5, -1.5, -1.0, 1.0, 0.5]
TOWARDS, MOST_GAIN = 0.5, 6.0
NYQUIST, ONSETS, CREST, ENTROPY, CROSSINGS = 11_025.0, 6.0, (6.0, 20.0), 2.484907, 0.2
LEAST_FRAMES, LEAST_SCORE, LEAST_MIX = 25, 0.84, 480.0
#: Frames of a piece of mixes, and of recordings, that one task correlates.
PIECE = 20_000


def crest(points: DataFrame) -> DataFrame:
    """id, crest: how many decibels the peak lies above the mean power; 0 for silence."""
    t = points.groupBy("id").agg(F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return t.select("id", F.when(F.col("rms") > 1e-9, 20 * F.log10(F.col("peak") / F.col("rms"))).otherwise(0.0).alias("crest"))


def chroma_entropy(c) -> Column:
    """How evenly twelve tones share the sound, 0 to 1."""
    c = F.col(c) if isinstance(c, str) else c
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(c, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
    return F.when(total > 0, h / F.log(F.lit(12.0))).otherwise(0.0)


def envelope(points: DataFrame, buckets: int) -> DataFrame:
    """id, bucket, low, high, rms of each of so many equal stretches. Needs n, the points of an id."""
    at = F.floor(F.col("i") * buckets / F.col("n"))
    return points.groupBy("id", at.alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def onset_density(points: DataFrame, per_second: float) -> DataFrame:
    """id, density: local maxima above mean and deviation, by the second."""
    by, whole = Window.partitionBy("id").orderBy("i"), Window.partitionBy("id")
    t = points.withColumns({"was": F.lag("v").over(by), "next": F.lead("v").over(by), "level": F.avg("v").over(whole) + F.stddev_pop("v").over(whole)})
    hit = F.coalesce((F.col("v") > F.col("level")) & (F.col("v") >= F.col("was")) & (F.col("v") > F.col("next")), F.lit(False))
    return t.groupBy("id").agg((F.count_if(hit) * F.lit(float(per_second)) / F.count(F.lit(1))).alias("density"))


def transients(points: DataFrame, window: int, gap: int) -> DataFrame:
    """id, i of local maxima well above what was just before and above all, none closer than gap to the last one taken."""
    by, whole = Window.partitionBy("id").orderBy("i"), Window.partitionBy("id")
    t = points.withColumns({"was": F.lag("v").over(by), "next": F.lead("v").over(by), "local": F.avg("v").over(by.rowsBetween(-window, -1)), "mean": F.avg("v").over(whole)})
    t = t.where((F.col("v") > F.greatest(F.col("local") * 1.6, F.col("mean") * 0.6)) & (F.col("v") >= F.col("was")) & (F.col("v") > F.col("next")))
    taken = F.aggregate("at", F.array().cast("array<int>"), lambda s, x: F.when(F.coalesce(x - F.element_at(F.concat(F.array(F.lit(-gap)), s), -1) >= gap, F.lit(True)), F.concat(s, F.array(x))).otherwise(s))
    return t.groupBy("id").agg(F.sort_array(F.collect_list(F.col("i").cast("int"))).alias("at")).select("id", F.explode(taken).alias("i"))


def voted_tempo(hits: DataFrame) -> DataFrame:
    """id, bpm: the tempo that gaps between hits (id, t, bpm: a first guess) vote for, each gap taken for 1 to 4 beats; the guess stays where votes are few or far from it."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("id").orderBy("t"))
    t = hits.withColumns({"gap": gap, "period": 60.0 / F.col("bpm")}).withColumn("beats", F.floor(F.col("gap") / F.col("period") + 0.5))
    vote = F.when(F.col("beats").between(1, 4) & (F.abs(F.col("gap") / F.col("period") - F.col("beats")) < 0.15), 60.0 * F.col("beats") / F.col("gap"))
    t = t.withColumn("vote", vote).withColumn("bin", F.floor((F.col("vote") - (F.col("bpm") - 8.0)) / 0.1 + 0.5))
    n = t.groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.count("vote").alias("votes"), F.first("bpm").alias("bpm"))
    peak = t.where("bin >= 0 and bin < 160").groupBy("id", "bin").agg(F.count(F.lit(1)).alias("c")).groupBy("id").agg(F.max(F.struct("c", "bin"))["bin"].alias("top"))
    near = t.join(peak, "id").where(F.abs(F.col("vote") - (F.col("bpm") - 8.0 + F.col("top") * 0.1)) <= 0.3).groupBy("id").agg(F.avg("vote").alias("mean"), F.count(F.lit(1)).alias("near"))
    ok = (F.col("hits") >= 16) & (F.col("votes") >= 12) & (F.col("near") >= 8) & (F.abs(F.col("mean") - F.col("bpm")) <= 0.06 * F.col("bpm"))
    return n.join(near, "id", "left").select("id", F.when(F.coalesce(ok, F.lit(False)), F.col("mean")).otherwise(F.col("bpm")).alias("bpm"))


def genre_features(raw: DataFrame, v: str = "v") -> DataFrame:
    """id, bpm and features of 0 to 1 from raw vectors (id, v of the named dimensions, bpm, tempo_conf)."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    at = lambda k: F.get(F.col(v), F.lit(k)).cast("double")
    t = raw.select("id", "bpm", unit(at(40)).alias("low"), unit(at(41)).alias("mid"), unit(at(39) / ONSETS).alias("onset"), unit(at(26) / (NYQUIST * 0.45)).alias("bright"), unit(at(28) / (NYQUIST * 0.85)).alias("air"), unit(at(32)).alias("flat"),
                   unit(at(36) / CROSSINGS).alias("zcr"), unit((at(42) - CREST[0]) / (CREST[1] - CREST[0])).alias("dynamics"), unit(at(43) / ENTROPY).alias("atonal"), unit(F.col("tempo_conf")).alias("steady"))
    return t.withColumn("energy", unit(0.45 * F.col("onset") + 0.30 * F.col("low") + 0.25 * (1 - F.col("dynamics"))))


def sound_tags(half_time: Column) -> Column:
    """Words for a row of genre_features."""
    c = F.col
    four = (c("steady") > 0.6) & (c("onset") > 0.45) & c("bpm").between(118, 138)
    return F.array_compact(F.array(
        F.when(four, "four-on-floor"), F.when(half_time, "half-time"), F.when(c("low") > 0.55, "bass-heavy"), F.when(c("bright") > 0.55, "bright").when(c("bright") < 0.3, "dark").otherwise("balanced"),
        F.when(c("atonal") > 0.6, "atonal").otherwise("melodic"), F.when(c("flat") > 0.55, "noisy"), F.when(c("dynamics") > 0.6, "dynamic"), F.when(c("energy") > 0.6, "high-energy").when(c("energy") < 0.3, "chilled")))


def corrective_curve(levels) -> Column:
    """Struct gains and preamp: half of what brings ten measured levels to the house curve, in steps of half a decibel."""
    levels = F.col(levels) if isinstance(levels, str) else levels
    house = F.array(*[F.lit(x - sum(HOUSE) / len(HOUSE)) for x in HOUSE])
    mean = F.aggregate(levels, F.lit(0.0), lambda s, x: s + x) / len(HOUSE)
    step = lambda x: F.floor(x * 2 + 0.5) / 2
    gains = F.zip_with(levels, house, lambda x, t: F.greatest(F.lit(-MOST_GAIN), F.least(F.lit(MOST_GAIN), step((t - (x - mean)) * TOWARDS))))
    return F.struct(gains.alias("gains"), F.greatest(F.lit(-12.0), -step(F.greatest(F.lit(0.0), F.array_max(gains)))).alias("preamp"))


def curve_response(log_f, bands, freqs, qs, preamp) -> Column:
    """Decibels that an equalizer's bands add at a frequency (its log10): bells in log frequency, narrower for a higher q."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    bell = lambda z: F.when(z["g"] == 0, 0.0).otherwise(z["g"] * F.exp(-0.5 * F.pow((c(log_f) - F.log10(z["f"])) * (F.greatest(F.lit(0.25), z["q"]) + 0.4) / 0.34, F.lit(2.0))))
    zipped = F.arrays_zip(c(bands).alias("g"), c(freqs).alias("f"), c(qs).alias("q"))
    return F.aggregate(zipped, c(preamp).cast("double"), lambda s, z: s + bell(z))


def merged_centroids(centroids: DataFrame, by: str) -> DataFrame:
    """by, v, bpm, mass of groups of centroids (by, v, bpm, mass): means by mass, at length 1."""
    long = centroids.select(by, "mass", F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg((F.sum(F.col("x") * F.col("mass")) / F.sum("mass")).alias("x"))
    v = long.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("v"))
    rest = centroids.groupBy(by).agg((F.sum(F.col("bpm") * F.col("mass")) / F.sum("mass")).alias("bpm"), F.sum("mass").alias("mass"))
    bound = F.array(F.struct("v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return v.select(by, F.get(F.transform(bound, lambda e: F.transform(e["v"], lambda x: x / e["n"])), F.lit(0)).alias("v")).join(rest, by)


def band_frames(seconds: DataFrame, bands: int = 12, rate: int = 4000) -> DataFrame:
    """id, sec, bands: for each second of mono sound (id, sec, samples at rate) the log energies of log-spaced bands at length 127."""
    edges = np.clip(np.round(40 * 45 ** (np.arange(bands + 1) / bands) / rate * 4096), 1, 2048).astype(int)

    def run(frames):
        for f in frames:
            x = np.stack([np.pad(np.asarray(s[:rate], dtype=float), (0, max(0, rate - len(s)))) for s in f["samples"]]) if len(f) else np.zeros((0, rate))
            power = np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(rate) / rate)), 4096, axis=1))
            e = np.log1p(np.stack([power[:, a:b].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1))
            e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": f["id"], "sec": f["sec"], "bands": list(np.clip(np.round(e * 127), -127, 127).astype(np.int8).tolist())})

    return seconds.select("id", "sec", "samples").mapInPandas(run, f"id {seconds.schema['id'].dataType.simpleString()}, sec int, bands array<tinyint>")


def _best_offset(mix: np.ndarray, part: np.ndarray) -> tuple[int, float]:
    """Where a recording's frames fit a mix's best: the offset of the greatest mean cosine over what overlaps."""
    m, n = len(mix), len(part)
    sums = np.zeros(m)
    for k in range(n):
        sums[: m - k] += mix[k:] @ part[k] if k < m else 0
    mean = sums / np.minimum(n, m - np.arange(m))
    mean = mean[: m - LEAST_FRAMES + 1]
    return int(mean.argmax()), float(mean.max())


def found_in_mixes(mixes: DataFrame, recordings: DataFrame) -> DataFrame:
    """mix, id, start, finish, score: recordings found in mixes, the better one where two overlap. Both are id, length, frames (an array of a second's bands each).

    Mixes of LEAST_MIX seconds and more and shorter recordings are dealt out in pieces of PIECE frames; each pair of pieces is one group.
    """
    long = mixes.where((F.col("length") >= LEAST_MIX) & (F.size("frames") >= LEAST_FRAMES))
    short = recordings.where(F.size("frames") >= LEAST_FRAMES)
    a, b = ((int(df.agg(F.sum(F.size("frames"))).first()[0] or 0) // PIECE + 1) for df in (long, short))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = long.select("id", "length", "frames", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int").alias("p")).withColumn("q", spread(b))
    right = short.select(*[F.col(c).alias(c) for c in ("id", "length", "frames")], F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("q")).withColumn("p", spread(a))
    kind = mixes.schema["id"].dataType.simpleString()

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        unit = lambda f: (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))(np.stack([np.asarray(r, dtype=float) for r in f]))
        out, parts = [], [(r.id, r.length, unit(r.frames)) for r in y.itertuples()]
        for r in x.itertuples():
            mix = unit(r.frames)
            for i, length, part in parts:
                if i != r.id and length < r.length:
                    at, score = _best_offset(mix, part)
                    if score >= LEAST_SCORE:
                        out.append((r.id, i, at, at + min(len(part), len(mix) - at), score))
        return pd.DataFrame(out, columns=["mix", "id", "start", "finish", "score"])

    hits = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(run, f"mix {kind}, id {kind}, start int, finish int, score double")

    def kept(x: pd.DataFrame) -> pd.DataFrame:
        free, rows = np.ones(int(x["finish"].max()), dtype=bool), []
        for r in x.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            if free[r.start : r.finish].all():
                free[r.start : r.finish] = False
                rows.append(r)
        return pd.DataFrame(rows, columns=x.columns)

    return hits.groupBy("mix").applyInPandas(kept, hits.schema)
