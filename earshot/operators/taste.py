"""The taste model and the planners: keys, genres, transitions, scores against centroids, clusters, the online model and ordered sets.

Small tables (profiles, prototypes, at most K centroids a side) are broadcast; their size is fixed. Ordered sets and the online model
depend on order within one list or listener, so they run per group in pandas; lists are bounded by `longest`, and longer ones raise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import camelot_distance
from earshot.operators.clusters import auto_clusters as auto_clusters
from earshot.operators.recommend import EVENT_WEIGHTS
from earshot.operators.vectors import cosine, dot, fold_bpm, one_row

# Tonal profiles of major and minor keys from C, the wheel's numbers of their roots, and note names.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
WHEEL_MAJOR = [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1]
WHEEL_MINOR = [5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10]
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

# Confidence without a margin and what a margin adds, and the fastest tempo that doubling gives.
SURE, SURER, MOST_BPM = 0.35, 2.0, 240.0

# Genre prototypes as subgenre, genre, bpm, tolerance, targets (low, onset, bright, atonal, flat, zcr, steady; None is any), weight of the tempo.
PROTOTYPES = [
    ("Deep House", "Electronic", 122.0, 7.0, 0.55, 0.45, 0.40, 0.30, None, None, 0.75, 1.0),
    ("House", "Electronic", 124.0, 6.0, 0.45, 0.55, 0.55, 0.35, None, None, 0.80, 1.0),
    ("Tech House", "Electronic", 126.0, 5.0, 0.50, 0.70, 0.50, 0.45, 0.45, None, 0.85, 1.1),
    ("Techno", "Electronic", 132.0, 6.0, 0.50, 0.75, 0.30, 0.55, 0.50, None, 0.85, 1.1),
    ("Hard Techno", "Electronic", 150.0, 9.0, 0.55, 0.82, 0.28, 0.62, 0.58, None, 0.85, 1.3),
    ("Hardcore", "Electronic", 185.0, 15.0, 0.70, 0.88, 0.30, 0.66, 0.66, None, 0.78, 1.4),
    ("Uptempo", "Electronic", 210.0, 18.0, 0.70, 0.92, 0.30, 0.72, 0.72, None, 0.78, 1.4),
    ("Trance", "Electronic", 138.0, 6.0, 0.45, 0.55, 0.75, 0.25, None, None, 0.80, 1.1),
    ("Dubstep", "Electronic", 70.0, 6.0, 0.80, 0.45, 0.50, 0.55, 0.70, None, 0.55, 1.0),
    ("Drum & Bass", "Electronic", 174.0, 6.0, 0.70, 0.85, 0.55, 0.45, None, None, 0.55, 1.2),
    ("Future Bass", "Electronic", 150.0, 8.0, 0.60, 0.55, 0.75, 0.25, None, None, 0.65, 0.9),
    ("Trap", "Hip-Hop", 72.0, 6.0, 0.80, 0.45, 0.45, 0.45, None, 0.70, 0.55, 1.0),
    ("Hip-Hop", "Hip-Hop", 90.0, 8.0, 0.65, 0.45, 0.40, 0.40, None, None, 0.55, 0.8),
    ("R&B / Soul", "R&B", 95.0, 12.0, 0.45, 0.35, 0.40, 0.30, None, None, 0.55, 0.6),
    ("Pop", "Pop", 116.0, 10.0, 0.40, 0.45, 0.60, 0.30, None, None, 0.65, 0.6),
    ("Rock", "Rock", 120.0, 16.0, 0.35, 0.50, 0.55, 0.45, 0.55, 0.60, 0.55, 0.5),
    ("Acoustic / Folk", "Acoustic", 96.0, 20.0, 0.25, 0.25, 0.40, 0.20, 0.20, None, 0.45, 0.3),
    ("Ambient", "Ambient", 80.0, 30.0, 0.30, 0.15, 0.45, 0.50, None, None, 0.30, 0.3),
]
TARGETS = ["low", "onset", "bright", "atonal", "flat", "zcr", "steady"]

# Fixed values of the online model.
K, ETA, SPAWN_BELOW, SATURATE, DISLIKE, MIN_MASS = 6, 0.08, 0.55, 3.0, 0.8, 0.2


def musical_keys(chroma: DataFrame) -> DataFrame:
    """id, chroma (12 numbers from C) to id, key, camelot, confidence: the profile that correlates best."""
    spark = chroma.sparkSession
    rows = [(f"{NOTES[r]} {name}", f"{wheel[r]}{ring}", 2 * r + k, [p[(i - r) % 12] for i in range(12)]) for k, (name, ring, p, wheel) in enumerate((("major", "B", MAJOR, WHEEL_MAJOR), ("minor", "A", MINOR, WHEEL_MINOR))) for r in range(12)]
    profiles = spark.createDataFrame(rows, "key string, camelot string, rank int, profile array<double>")
    centred = lambda c: F.transform(c, lambda x: x.cast("double") - F.aggregate(c, F.lit(0.0), lambda s, y: s + y) / 12)
    t = chroma.select("id", centred(F.col("chroma")).alias("x")).join(F.broadcast(profiles.select("key", "camelot", "rank", centred(F.col("profile")).alias("y"))), F.lit(True))
    den = F.sqrt(dot("x", "x") * dot("y", "y"))
    t = t.withColumn("r", F.when(den > 1e-9, dot("x", "y") / den).otherwise(0.0))
    best = t.groupBy("id").agg(F.max(F.struct("r", (-F.col("rank")).alias("o"), "key", "camelot")).alias("b"), F.sort_array(F.collect_list("r"), False).alias("rs"))
    return best.select("id", "b.key", "b.camelot", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rs")[0] - F.col("rs")[1]) * 3)).alias("confidence"))


def genres(features: DataFrame) -> DataFrame:
    """id, bpm and the seven features in 0 to 1, to id, genre, subgenre, score, octave (the multiple of bpm that fits), confidence (by the margin to the second best) and bpm, doubled where the genre is one of twice that tempo."""
    spark = features.sparkSession
    schema = "subgenre string, genre string, p_bpm double, tol double, " + ", ".join(f"p_{t} double" for t in TARGETS) + ", w double"
    t = features.join(F.broadcast(spark.createDataFrame(PROTOTYPES, schema)), F.lit(True))
    bell = lambda m: F.exp(-0.5 * F.pow((F.col("bpm") * m - F.col("p_bpm")) / F.col("tol"), F.lit(2.0)))
    t = t.withColumns({"one": bell(1.0), "half": bell(0.5), "double": bell(2.0)})
    tempo = F.when(F.col("bpm") <= 0, 0.3).otherwise(F.greatest("one", "half", "double"))
    octave = F.when(F.col("bpm") <= 0, 1.0).when((F.col("double") > F.col("one")) & (F.col("double") >= F.col("half")), 2.0).when((F.col("half") > F.col("one")) & (F.col("half") >= F.col("double")), 0.5).otherwise(1.0)
    fits = F.array_compact(F.array(*[F.when(F.col(f"p_{k}").isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(F.col(k) - F.col(f"p_{k}")))) for k in TARGETS]))
    score = (F.col("w") * tempo + F.aggregate(fits, F.lit(0.0), lambda s, x: s + x) / F.size(fits)) / (F.col("w") + 1)
    top = t.select("id", "bpm", F.struct(F.round(score, 9).alias("score"), "subgenre", "genre", octave.alias("octave")).alias("x")).groupBy("id", "bpm").agg(F.max("x").alias("x"), F.sort_array(F.collect_list("x.score"), asc=False).alias("scores"))
    second = F.get("scores", F.lit(1))
    margin = F.when(second > 0, F.greatest(F.lit(0.0), F.col("x.score") - second)).otherwise(F.col("x.score"))
    twice = (F.col("x.octave") == 2.0) & (F.col("bpm") > 0) & (F.col("bpm") * 2 <= MOST_BPM)
    return top.select("id", "x.genre", "x.subgenre", "x.score", "x.octave", F.greatest(F.lit(0.0), F.least(F.lit(1.0), SURE + SURER * margin)).alias("confidence"), F.when(twice, F.col("bpm") * 2).otherwise(F.col("bpm")).alias("bpm"))


def transition_cost(va, bpm_a, vb, bpm_b) -> Column:
    """How far apart two tracks sound, and how far their folded tempos are, the latter up to 1.5."""
    a, b = fold_bpm(bpm_a), fold_bpm(bpm_b)
    return 1 - cosine(va, vb) + F.when((a > 0) & (b > 0), F.least(F.abs(a - b) / 8, F.lit(1.5))).otherwise(0.0)


def transition_score(bpm_a, key_a, bpm_b, key_b) -> Column:
    """0 to 1: tempos within 12 percent, keys that mix, and a constant share."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    ratio = F.greatest(F.lit(1.0), c(bpm_a)) / F.greatest(F.lit(1.0), c(bpm_b))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return unit(0.45 * unit(1 - F.abs(ratio - 1) / 0.12) + 0.35 * unit(1 - camelot_distance(key_a, key_b) / 4.0) + 0.20)


def taste_scores(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, score of vectors (id, v) against the listener's centroids (side 1 or -1, v, mass), of which there are 2 K at most."""
    c = one_row(centroids.select("side", F.col("v").alias("c"), "mass"), "side", "c", "mass")
    t = vectors.join(F.broadcast(c), F.lit(True))
    best = lambda side: F.coalesce(F.array_max(F.transform(F.filter("cs", lambda x: x["side"] == side), lambda x: cosine(F.col("v"), x["c"]) * x["mass"] / (x["mass"] + SATURATE))), F.lit(0.0))
    return t.select("id", (best(1) - DISLIKE * best(-1)).alias("score"))


def nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, v, cluster, sim: the most similar of at most a few dozen centroids (cluster, c)."""
    c = one_row(centroids, "cluster", "c")
    scored = F.transform("cs", lambda x: F.struct(cosine(F.col("v"), x["c"]).alias("sim"), (-x["cluster"]).alias("o")))
    return vectors.join(F.broadcast(c), F.lit(True)).withColumn("b", F.array_max(scored)).select("id", "v", (-F.col("b.o")).alias("cluster"), F.col("b.sim").alias("sim"))


def silhouette(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: mean over vectors of how much nearer their own centroid is than the next one."""
    c = one_row(centroids, "c")
    d = F.sort_array(F.transform("cs", lambda x: 1 - cosine(F.col("v"), x["c"])))
    t = vectors.join(F.broadcast(c), F.lit(True)).select(d.alias("d"))
    own, other = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    top = F.greatest(own, other)
    return t.agg(F.avg(F.when(F.size("d") > 1, F.when(top > 1e-9, (other - own) / top).otherwise(0.0)).otherwise(0.0)).alias("silhouette"))


def _means(assigned: DataFrame) -> DataFrame:
    """cluster, c: the mean direction of each cluster's members. Sums are per dimension, so a hot cluster is pre-aggregated."""
    m = assigned.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
    c = m.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("c"))
    return c.withColumn("n", F.sqrt(dot("c", "c"))).select("cluster", F.get(F.transform(F.array(F.struct("c", "n")), lambda e: F.when(e["n"] > 0, F.transform(e["c"], lambda x: x / e["n"])).otherwise(e["c"])), F.lit(0)).alias("c"))


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 12, sample: int = 50) -> DataFrame:
    """Centroids (cluster, c) of at most k clusters.

    Starts come from sample * k vectors at most, those of least hash: each next start is the one of them least like those before. Then every
    round is one pass over all vectors, kept in memory or on disk; the driver holds the sample and the k centroids. An emptied cluster goes.
    """
    spark, schema = vectors.sparkSession, "cluster int, c array<double>"
    table = lambda cs: spark.createDataFrame(list(enumerate(cs)), schema)
    vectors = vectors.select("id", "v").persist(StorageLevel.MEMORY_AND_DISK)
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample * k).select("v").collect()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    pool = unit(np.array([r.v for r in some], dtype=float)) if some else np.zeros((0, 1))
    starts, near = ([0], pool @ pool[0]) if len(pool) else ([], None)
    while len(starts) < min(k, len(pool)) and near.min() < 1 - 1e-9:
        starts.append(int(near.argmin()))
        near = np.maximum(near, pool @ pool[starts[-1]])
    centres = pool[starts].tolist()
    for _ in range(rounds if centres else 0):
        means = _means(nearest(vectors, table(centres))).orderBy("cluster").select("c").collect()  # k rows
        was, centres = centres, [[float(x) for x in r.c] for r in means]
        if len(was) == len(centres) and np.allclose(was, centres, rtol=0, atol=1e-9):
            break
    vectors.unpersist()
    return table(centres)


class Model:
    """The centroids of one listener, in the order of events: a small fold with two lists of at most K vectors."""

    def __init__(self, state: list | None = None):
        self.sides: dict = {1: [], -1: []}
        for side, v, mass in state or []:
            self.sides[side].append([np.asarray(v, dtype=float), mass])

    def rows(self) -> list:
        return [(s, c[0].tolist(), float(c[1])) for s, side in self.sides.items() for c in side]

    @staticmethod
    def _alike(vs, v):
        n = np.linalg.norm(vs, axis=1) * np.linalg.norm(v)
        return np.divide(vs @ v, n, out=np.zeros(len(vs)), where=n > 3.5e-4)

    def add(self, v, weight: float):
        if not weight:
            return
        side, strength = self.sides[1 if weight > 0 else -1], abs(weight)
        if side:
            sims = self._alike(np.stack([c[0] for c in side]), v)
            near = side[int(sims.argmax())]
            if sims.max() >= SPAWN_BELOW:
                moved = near[0] + ETA * strength * (v - near[0])
                near[0], near[1] = moved / (np.linalg.norm(moved) or 1.0), near[1] + strength
                return
        if len(side) >= K:
            vs = np.stack([c[0] for c in side])
            sims = np.stack([self._alike(vs, x) for x in vs])
            sims[np.tril_indices(len(vs))] = -2
            i, j = np.unravel_index(int(sims.argmax()), sims.shape)
            (a, m), (b, n) = side[i], side.pop(j)
            both = (a * m + b * n) / (m + n)
            side[i] = [both / (np.linalg.norm(both) or 1.0), m + n]
        side.append([np.array(v, dtype=float), strength])


#: Parts into which listeners are dealt, each folded as one, and listeners' sides from which on their events are taken together.
PARTS, FEW = 256, 4


class Models:
    """Models of many listeners: their sides' n-th events are taken in together, so that a listener costs no calls of its own. Sides 2i and 2i + 1 are what listener i likes and dislikes."""

    def __init__(self, listeners: int, dims: int):
        self.centre, self.mass, self.size = np.zeros((2 * listeners, K, dims)), np.zeros((2 * listeners, K)), np.zeros(2 * listeners, dtype=np.int64)

    def learn(self, listener: np.ndarray, vectors: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        """Events in order: the listener, which of the vectors, and the weight, which is not 0."""
        side = listener * 2 + (weight < 0)
        order = np.argsort(side, kind="stable")
        side, at, strength = side[order], at[order], np.abs(weight[order])
        first = np.flatnonzero(np.diff(side, prepend=-1))
        counts = np.diff(np.append(first, len(side)))
        for turn in range(int(counts.max(initial=0))):
            on = counts > turn
            if np.count_nonzero(on) < FEW:
                for a, n in zip(first[on].tolist(), counts[on].tolist(), strict=True):
                    self._alone(int(side[a]), vectors[at[a + turn : a + n]], strength[a + turn : a + n])
                return
            now = first[on] + turn
            self._take(side[now], vectors[at[now]], strength[now])

    def _alone(self, g: int, vectors: np.ndarray, strength: np.ndarray) -> None:
        model = Model([(1, self.centre[g, k], self.mass[g, k]) for k in range(self.size[g])])
        for v, w in zip(vectors, strength.tolist(), strict=True):
            model.add(v, w)
        rows = model.rows()
        self.size[g] = len(rows)
        for k, (_, v, mass) in enumerate(rows):
            self.centre[g, k], self.mass[g, k] = v, mass

    def _take(self, g: np.ndarray, v: np.ndarray, strength: np.ndarray) -> None:
        c, length, own = self.centre[g], np.linalg.norm(self.centre[g], axis=2), self.size[g]
        share = lambda dot, n: np.divide(dot, n, out=np.zeros(dot.shape), where=n > 3.5e-4)
        sims = np.where(np.arange(K) < own[:, None], share(np.einsum("nkd,nd->nk", c, v), length * np.linalg.norm(v, axis=1)[:, None]), -np.inf)
        near = sims.argmax(axis=1)
        hit = sims.max(axis=1) >= SPAWN_BELOW
        unit = lambda x: x / (lambda n: np.where(n == 0, 1.0, n))(np.linalg.norm(x, axis=1, keepdims=True))
        k = near[hit]
        was = c[hit, k]
        self.centre[g[hit], k] = unit(was + ETA * strength[hit][:, None] * (v[hit] - was))
        self.mass[g[hit], k] += strength[hit]
        full = ~hit & (own >= K)
        if full.any():
            gf, cf, m, n = g[full], c[full], self.mass[g[full]], length[full]
            pairs = share(np.matmul(cf, cf.transpose(0, 2, 1)), n[:, :, None] * n[:, None, :])
            pairs[:, np.tri(K, dtype=bool)] = -2
            i, j = np.unravel_index(pairs.reshape(len(gf), -1).argmax(axis=1), (K, K))
            rows = np.arange(len(gf))
            both = m[rows, i] + m[rows, j]
            cf[rows, i] = unit((cf[rows, i] * m[rows, i][:, None] + cf[rows, j] * m[rows, j][:, None]) / both[:, None])
            m[rows, i] = both
            rest = np.arange(K - 1) + (np.arange(K - 1) >= j[:, None])
            self.centre[gf, : K - 1], self.mass[gf, : K - 1] = cf[rows[:, None], rest], m[rows[:, None], rest]
            self.size[gf] = K - 1
        new = g[~hit]
        self.centre[new, self.size[new]], self.mass[new, self.size[new]] = v[~hit], strength[~hit]
        self.size[new] += 1

    def frame(self, users: list) -> pd.DataFrame:
        """user_id, side, centroid, mass, v; centroids are numbered over both sides."""
        side, k = np.nonzero(np.arange(K) < self.size[:, None])
        start = np.where(side % 2 == 1, self.size[side - side % 2], 0)
        return pd.DataFrame({"user_id": pd.array([users[i] for i in (side // 2).tolist()], dtype="Int64"), "side": np.where(side % 2 == 0, 1, -1).astype(np.int32), "centroid": (k + start).astype(np.int32), "mass": self.mass[side, k], "v": list(self.centre[side, k])})


def numbered_users(user: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, list]:
    """The number of each row's listener, and the listeners by number; one without an id is one of its own."""
    both = np.stack((user.astype(np.int64), none.astype(np.int64)), axis=1)
    names, own = np.unique(both, axis=0, return_inverse=True)
    return own.ravel(), [None if n else u for u, n in names.tolist()]


def online_model(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Events (user_id, seq, kind, track) and vectors (id, v) to user_id, side, centroid, mass, v: the model after all events in order of seq.

    The order of a listener's events decides, so a listener is in one part with others. A part holds its events as numbers, and each of its tracks' vectors once.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_WEIGHTS.items() for x in kv]), F.col("kind"))
    user = [F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.col("user_id").isNull().alias("none")]
    e = events.withColumn("w", weight).where("w <> 0 and track is not null").select(F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int").alias("part"), *user, "seq", "w", "track")
    v = e.select("part", "track").distinct().join(vectors.select(F.col("id").alias("track"), F.col("v").cast("array<double>").alias("v")), "track").select(F.col("part").alias("part"), F.col("track").alias("track"), "v")

    def fold(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(e):
            return Models(0, 0).frame([])
        at = pd.Series(np.arange(len(v)), index=v["track"]).reindex(e["track"]).to_numpy(dtype=float)
        known = np.flatnonzero(~np.isnan(at))
        known = known[np.argsort(e["seq"].to_numpy()[known], kind="stable")]
        own, users = numbered_users(e["user"].to_numpy()[known], e["none"].to_numpy()[known])
        rows = np.stack(v["v"].to_numpy())
        m = Models(len(users), rows.shape[1])
        m.learn(own, rows, at[known].astype(np.int64), e["w"].to_numpy(dtype=float)[known])
        return m.frame(users)

    return e.groupBy("part").cogroup(v.groupBy("part")).applyInPandas(fold, "user_id long, side int, centroid int, mass double, v array<double>")


def _greedy(n: int, start: int, cost) -> list[int]:
    """Positions from start on, each next the cheapest that is left; cost(at, step) gives the costs of all."""
    order, left = [start], np.ones(n, dtype=bool)
    left[start] = False
    for step in range(1, n):
        order.append(int(np.where(left, cost(order[-1], step), np.inf).argmin()))
        left[order[-1]] = False
    return order


def _greedies(start: np.ndarray, n: int, cost) -> np.ndarray:
    """_greedy() of many lists of n tracks at once, a row each; cost(at, step) gives a row of costs for each list's place."""
    rows, order, left = np.arange(len(start)), np.empty((len(start), n), dtype=np.int64), np.ones((len(start), n), dtype=bool)
    order[:, 0] = start
    left[rows, start] = False
    for step in range(1, n):
        order[:, step] = np.where(left, cost(order[:, step - 1], step), np.inf).argmin(axis=1)
        left[rows, order[:, step]] = False
    return order


def _whole_lists(frames, longest: int):
    """Frames of rows sorted by list, cut anew so that no list is in two of them."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat((rest, f), ignore_index=True)
        same = lambda k, f=f: (f["list"] == k) if pd.notna(k) else f["list"].isna()
        if len(f):
            last = int(np.count_nonzero(same(f["list"].iloc[-1])))
            if last > longest:
                raise ValueError(f"a list of more than {longest} tracks; sets are planned for {longest} at most")
            rest = f.iloc[len(f) - last :].reset_index(drop=True)
            if last < len(f):
                yield f.iloc[: len(f) - last]
    if rest is not None:
        yield rest


def _ordered(lists: DataFrame, columns: tuple[str, ...], cost_of, start_of, longest: int) -> DataFrame:
    """Lists in greedy order. cost_of() and start_of() take a dictionary of columns, each an array of lists by tracks, of lists of one length: a call for each list would cost more than its work."""
    fields = f"list {lists.schema['list'].dataType.simpleString()}, id {lists.schema['id'].dataType.simpleString()}, place int"

    def run(frames):
        for f in _whole_lists(frames, longest):
            own = f["list"]
            first = np.flatnonzero(((own != own.shift()) & ~(own.isna() & own.shift().isna())).to_numpy() | (np.arange(len(f)) == 0))
            sizes = np.diff(np.append(first, len(f)))
            if sizes.max() > longest:
                raise ValueError(f"a list of {sizes.max()} tracks; sets are planned for {longest} at most")
            dims = f["v"].str.len().to_numpy()[first] if "v" in columns else np.zeros(len(first))
            at = []
            for n, dim in sorted(set(zip(sizes.tolist(), dims.tolist(), strict=True))):
                begin = first[(sizes == n) & (dims == dim)]
                rows = begin[:, None] + np.arange(n)
                part = {c: (np.stack(f["v"].to_numpy()[rows.ravel()]).astype(float) if c == "v" else f[c].to_numpy()[rows.ravel()]) for c in columns}
                part = {c: x.reshape(len(begin), n, *x.shape[1:]) for c, x in part.items()}
                at.append((begin[:, None] + _greedies(start_of(part), n, cost_of(part)), np.broadcast_to(np.arange(n, dtype=np.int32), rows.shape)))
            order, place = (np.concatenate([x[k].ravel() for x in at]) for k in (0, 1))
            yield pd.DataFrame({"list": own.to_numpy()[order], "id": f["id"].to_numpy()[order], "place": place})

    rows = lists.select("list", "id", *columns).repartition("list").sortWithinPartitions("list", F.asc_nulls_last("id"))
    return rows.mapInPandas(run, fields)


def _parsed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (nan where it is none) and ring of keys, each key read once."""
    own, names = pd.factorize(pd.Series(codes, dtype="object").fillna("").astype(str))
    parsed = pd.Series(names, dtype="object").astype(str).str.strip().str.extract(r"^(\d+)([ABab])$")
    num, ring = pd.to_numeric(parsed[0]).to_numpy(dtype=float), parsed[1].str.upper().fillna("").to_numpy(dtype=str)
    return np.where((num >= 1) & (num <= 12), num, np.nan)[own], ring[own]


def _apart(num, ring, own_num, own_ring) -> np.ndarray:
    """Distances of keys, as camelot_distance() has them."""
    d, same = (num - own_num) % 12, ring == own_ring
    d = np.minimum(d, 12 - d)
    return np.where(np.isnan(d), 12, np.where(d == 0, np.where(same, 0, 1), d + np.where(same, 0, 2)))


def _wheel(codes) -> np.ndarray:
    """Pairwise distances of keys."""
    num, ring = _parsed(codes)
    return _apart(num[:, None], ring[:, None], num[None, :], ring[None, :])


def _keys_from(codes: np.ndarray):
    """The function from a place in each list to the distances of all its keys from the one there."""
    num, ring = (x.reshape(codes.shape) for x in _parsed(codes.ravel()))
    rows = np.arange(len(codes))
    return lambda at: _apart(num, ring, num[rows, at][:, None], ring[rows, at][:, None])


def _fold(b):
    return np.where(b <= 0, 0.0, b * 2.0 ** np.where(b < 70, np.ceil(np.log2(70 / np.maximum(b, 1e-9))), np.where(b >= 180, -np.floor(np.log2(np.maximum(b, 1e-9) / 180)) - 1, 0)))


def flow_order(lists: DataFrame, longest: int = 500) -> DataFrame:
    """Lists (list, id, v, bpm) in an order where each next track is the one most like the last; begins with the least id. list, id, place."""
    def costs(x):
        v, bpm, rows = x["v"], _fold(x["bpm"].astype(float)), np.arange(len(x["bpm"]))
        unit = v / np.maximum(np.linalg.norm(v, axis=2, keepdims=True), 1e-12)

        def cost(at, step):
            own = bpm[rows, at][:, None]
            return 1 - np.einsum("bnd,bd->bn", unit, unit[rows, at]) + np.where((bpm > 0) & (own > 0), np.minimum(np.abs(bpm - own) / 8, 1.5), 0)

        return cost

    return _ordered(lists, ("v", "bpm"), costs, lambda x: np.zeros(len(x["bpm"]), dtype=np.int64), longest)


def endless_set(lists: DataFrame, longest: int = 500) -> DataFrame:
    """Lists (list, id, bpm, camelot) in an order where each hand-over scores best; begins with the least id. list, id, place."""
    def costs(x):
        bpm, away, rows = np.maximum(x["bpm"].astype(float), 1), _keys_from(x["camelot"]), np.arange(len(x["bpm"]))
        return lambda at, step: -(0.45 * np.clip(1 - np.abs(bpm[rows, at][:, None] / bpm - 1) / 0.12, 0, 1) + 0.35 * np.clip(1 - away(at) / 4, 0, 1))

    return _ordered(lists, ("bpm", "camelot"), costs, lambda x: np.zeros(len(x["bpm"]), dtype=np.int64), longest)


def energy_target(curve: str, p: float) -> float:
    """The energy a set should have at p of its length."""
    if curve == "rise":
        return 0.25 + 0.75 * p
    if curve == "descend":
        return 1 - 0.75 * p
    if curve == "peak":
        return 1 - abs(2 * p - 1)
    if curve == "plateau":
        return 0.5 + 2 * p if p < 0.25 else 1 - (p - 0.85) / 0.15 * 0.35 if p > 0.85 else 1.0
    return 0.5 + 0.4 * math.sin(3 * math.pi * p)


def energy_set(lists: DataFrame, curve: str = "rise", harmonic: bool = True, max_jump: float = 0.0, longest: int = 500) -> DataFrame:
    """Lists (list, id, bpm, camelot, energy) in an order that follows a curve of energy with small steps of key and tempo. list, id, place."""
    wk, wb, we = (0.45, 0.30, 0.25) if harmonic else (0.15, 0.30, 0.55)

    def costs(x):
        bpm, energy, away, rows = x["bpm"].astype(float), x["energy"].astype(float), _keys_from(x["camelot"]), np.arange(len(x["bpm"]))

        def cost(at, step):
            jump = np.abs(bpm - bpm[rows, at][:, None])
            over = np.maximum(0, jump - max_jump) / max_jump * 0.5 if max_jump > 0 else 0
            return wk * away(at) / 12 + wb * (np.minimum(jump / 16, 1) + over) + we * np.abs(energy - energy_target(curve, step / max(1, bpm.shape[1] - 1)))

        return cost

    return _ordered(lists, ("bpm", "camelot", "energy"), costs, lambda x: np.abs(x["energy"].astype(float) - energy_target(curve, 0)).argmin(axis=1), longest)
