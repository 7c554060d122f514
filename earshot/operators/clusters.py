"""Clusters of the best number, all numbers at once.

Starts come by oversampling: a few passes, each drawing vectors with chances by how unlike they are to those drawn before; a pass more weighs what
was drawn by the vectors nearest to it. Every number of clusters chooses its starts among them. Then each round is one pass for all
numbers together, which sums members and silhouettes in tasks; the driver holds the drawn vectors and the centroids, whose number does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes of drawing, vectors drawn a pass for each cluster of the greatest number, and rounds at most.
DRAWS, OVERSAMPLE, ROUNDS = 5, 2, 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _noise(id_, salt: int):
    """A number in (0, 1) for each id, the same in every run."""
    return (F.pmod(F.xxhash64(id_, F.lit(salt)), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)


def drawn(vectors: DataFrame, most: int, draws: int = DRAWS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors drawn by their unlikeness to those drawn before, at length 1, and how many vectors each is nearest to. One pass a draw and one for the weights.

    A draw takes the most vectors of least -log(noise) / unlikeness, which is drawing without replacement; a vector that equals one drawn has no chance.
    """
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(1).select("v").collect()
    pool = unit(np.array([r.v for r in first], dtype=float).reshape(len(first), -1))
    for k in range(draws if len(pool) else 0):
        def far(batches, pool=pool):
            for b in batches:
                x = unit(_matrix(b.column(1)))
                away = 1 - (x @ pool.T).max(axis=1) if len(x) else np.zeros(0)
                yes = away > 1e-9
                score = -np.log(b.column(2).to_numpy()[yes]) / away[yes]
                best = np.argsort(score, kind="stable")[:most]  # no more can be among the least of all
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(yes)).take(pa.array(best)), b.column(1).filter(pa.array(yes)).take(pa.array(best)), pa.array(score[best])], names=["id", "v", "score"])

        schema = f"id {vectors.schema['id'].dataType.simpleString()}, v {vectors.schema['v'].dataType.simpleString()}, score double"
        found = vectors.select("id", "v", _noise("id", k).alias("u")).mapInArrow(far, schema).orderBy("score", "id").limit(most).select("v").collect()
        if not found:
            break
        pool = np.concatenate([pool, unit(np.array([r.v for r in found], dtype=float))])

    def nearest(batches):
        n = np.zeros(len(pool), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount((unit(_matrix(b.column(0))) @ pool.T).argmax(axis=1), minlength=len(pool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pool))), pa.array(n)], names=["i", "n"])

    weight = np.zeros(len(pool))
    for r in vectors.select("v").mapInArrow(nearest, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        weight[r.i] = r.n
    return pool, weight


def chosen(pool: np.ndarray, weight: np.ndarray, k: int, passes: int = 8) -> np.ndarray:
    """k starts from what was drawn: the heaviest, then each time the one of most weight times unlikeness, then a few rounds among the drawn by their weights."""
    if not len(pool):
        return pool
    at = [int(weight.argmax())]
    near = pool @ pool[at[0]]
    while len(at) < min(k, len(pool)) and (gain := np.maximum(weight, 1) * (1 - near)).max() > 1e-9:
        at.append(int(gain.argmax()))
        near = np.maximum(near, pool @ pool[at[-1]])
    centres = pool[at]
    for _ in range(passes):
        own = (pool @ centres.T).argmax(axis=1)
        sums = np.stack([(pool[own == c] * weight[own == c, None]).sum(axis=0) for c in range(len(centres))])
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-12, unit(sums), centres)
    return centres


def _round(vectors: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, float]]:
    """One pass for all numbers of clusters: sums and counts of every cluster's members, and the mean silhouette of every number."""
    ks = list(centres)
    flat, at = np.concatenate([centres[k] for k in ks]), np.cumsum([0] + [len(centres[k]) for k in ks])

    def run(batches):
        sums, counts, apart = np.zeros(flat.shape), np.zeros(len(flat), dtype=np.int64), np.zeros(len(ks))
        for b in batches:
            x = _matrix(b.column(0))
            for a in range(0, len(x), 4096):
                part, likes = x[a : a + 4096], unit(x[a : a + 4096]) @ flat.T
                for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    own = likes[:, lo:hi].argmax(axis=1)
                    member = np.zeros((len(part), hi - lo))
                    member[np.arange(len(part)), own] = 1
                    sums[lo:hi] += member.T @ part
                    counts[lo:hi] += member.sum(axis=0).astype(np.int64)
                    if hi - lo > 1:
                        two = 1 - np.partition(likes[:, lo:hi], hi - lo - 2, axis=1)[:, -2:]
                        top = np.maximum(two[:, 0], two[:, 1])
                        apart[i] += np.where(top > 1e-9, (two[:, 0] - two[:, 1]) / np.maximum(top, 1e-12), 0.0).sum()
        spread = np.repeat(np.arange(len(ks)), np.diff(at))
        first = np.concatenate(([True], spread[1:] != spread[:-1]))
        lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), sums.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), lists, pa.array(counts), pa.array(np.where(first, apart[spread], 0.0))], names=["i", "v", "n", "apart"])

    both = lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda a, b: a + b))
    made = vectors.select("v").mapInArrow(run, "i long, v array<double>, n long, apart double")
    rows = made.groupBy("i").agg(F.aggregate(F.collect_list("v"), F.array().cast("array<double>"), both).alias("v"), F.sum("n").alias("n"), F.sum("apart").alias("apart")).collect()
    total, count, apart = np.zeros(flat.shape), np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat))
    for r in rows:
        total[r.i], count[r.i], apart[r.i] = r.v, r.n, r.apart
    of = lambda x: {k: x[lo:hi] for k, lo, hi in zip(ks, at[:-1], at[1:], strict=True)}
    n = {k: max(1, int(c.sum())) for k, c in of(count).items()}
    return of(total), of(count), {k: float(x.sum()) / n[k] for k, x in of(apart).items()}


def clusterings(vectors: DataFrame, ks: Iterable[int], rounds: int = ROUNDS) -> dict[int, tuple[np.ndarray, float]]:
    """For each number its centroids and their silhouette. Vectors are id, v; one of length 0 belongs nowhere. Passes: the draws, the weights, and at most rounds + 1, whatever the numbers."""
    ks = sorted(set(ks))
    vectors = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pool, weight = drawn(vectors, OVERSAMPLE * max(ks))
        centres = {k: chosen(pool, weight, k) for k in ks}
        if not len(pool):
            return {k: (c, 0.0) for k, c in centres.items()}
        done: dict[int, tuple[np.ndarray, float]] = {}
        for left in range(rounds, -1, -1):
            sums, counts, apart = _round(vectors, {k: c for k, c in centres.items() if k not in done})
            for k in sums:
                here = counts[k] > 0  # an emptied cluster goes
                new = unit(sums[k][here])
                if left == 0 or (here.all() and np.allclose(new, centres[k], rtol=0, atol=1e-9)):
                    done[k] = (centres[k], apart[k])
                else:
                    centres[k] = new
            if len(done) == len(ks):
                break
        return done
    finally:
        vectors.unpersist()


def auto_clusters(vectors: DataFrame, least: int = 6, most: int = 16) -> DataFrame:
    """Centroids (cluster, c) of the number of clusters, least to most, whose silhouette is best; of equal ones the fewer. None for fewer than two vectors."""
    n = vectors.limit(most + 1).count()
    table = lambda cs: vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cs)], "cluster int, c array<double>")
    if n < 2:
        return table([])
    found = clusterings(vectors, range(min(least, n - 1), min(most, n - 1) + 1))
    return table(max(sorted(found.items()), key=lambda x: x[1][1])[1][0])
