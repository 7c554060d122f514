"""Orders of lists of any length: each next track the one most like the last, as far as a bound lets one task look.

A list that is longer than the bound is cut into cells of like tracks: along tempo or the random direction along which they lie widest apart, at
about the middle, again and again until no cell is above the bound. The cells' mean tracks are put in order as a list of their own, by the same rule; inside the cells, all at once, the
order begins at the track nearest to the cell before, and is shortened by turning stretches round. A list within the bound is one cell, and
its order the plain greedy one.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.taste import _fold, _greedy
from earshot.operators.vectors import fold_bpm
from earshot.plans.session import scratch

#: Tracks that one task puts in order.
LONGEST = 500


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: what made it is not run again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _directions(depth: int, dims: int, n: int = 3):
    """Where each track lies along the tempo, in eights of a beat as a hand-over's cost has them, and along a few random directions of its vector at length 1."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    r = np.random.default_rng(7_919 + depth).normal(size=(n, dims))
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    along = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.when(size > 0, size).otherwise(1.0) for w in r]
    return [fold_bpm("bpm") / 8, *along]


def cells(lists: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lists (list, id, v, bpm) with cell: '' for a list within the bound, else the turns at each cut. No cell holds more than longest tracks; tracks that lie alike part by their hash."""
    t = lists.select("list", "id", F.col("v").cast("array<double>").alias("v"), F.col("bpm").cast("double").alias("bpm"), F.lit("").alias("cell"))
    dims = None
    for depth in count():
        over = t.groupBy("list", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > longest)
        if over.limit(1).count() == 0:
            return t
        dims = dims or len(t.select("v").first()["v"])
        ways = _directions(depth, dims)
        placed = t.select("*", F.array(*ways).alias("xs"))
        spread = placed.join(over.select("list", "cell"), ["list", "cell"]).groupBy("list", "cell").agg(*[
            F.struct(F.coalesce(F.var_pop(F.col("xs")[k]), F.lit(0.0)).alias("s"), F.lit(k).alias("k"), F.percentile_approx(F.col("xs")[k], F.lit(0.5), F.lit(1000)).alias("m")).alias(f"w{k}") for k in range(len(ways))])
        middle = spread.select("list", "cell", F.greatest(*[F.col(f"w{k}") for k in range(len(ways))]).alias("w")).select("list", "cell", F.col("w.k").alias("k"), F.col("w.m").alias("m"))
        placed = placed.join(middle, ["list", "cell"], "left").withColumn("x", F.get("xs", F.col("k")))
        turn = F.when((F.col("x") < F.col("m")) | ((F.col("x") == F.col("m")) & (F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(2)) == 0)), "0").otherwise("1")
        t = stored(placed.select("list", "id", "v", "bpm", F.when(F.col("m").isNull(), F.col("cell")).otherwise(F.concat("cell", turn)).alias("cell")), "cells")
    raise AssertionError


def _unit(v) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _costs(v: np.ndarray, bpm: np.ndarray, own_v: np.ndarray, own_bpm: float) -> np.ndarray:
    return 1 - v @ own_v + np.where((bpm > 0) & (own_bpm > 0), np.minimum(np.abs(bpm - own_bpm) / 8, 1.5), 0)


def _shortened(order: list[int], cost: np.ndarray, most: int = 300) -> list[int]:
    """An order with stretches turned round as long as that makes it cheaper; its first track stays. cost is symmetric."""
    order, n = np.array(order), len(order)
    if n < 4:
        return order.tolist()
    i, j = np.triu_indices(n - 1, 1)  # turn i + 1 .. j round; j may be the last
    i, j = np.concatenate((i, np.arange(n - 2))), np.concatenate((j, np.full(n - 2, n - 1)))
    inner = j < n - 1
    for _ in range(most):
        a, b, c, d = order[i], order[i + 1], order[j], order[np.minimum(j + 1, n - 1)]
        gain = cost[a, c] - cost[a, b] + np.where(inner, cost[b, d] - cost[c, d], 0.0)
        k = int(gain.argmin())
        if gain[k] > -1e-9:
            break
        order[i[k] + 1 : j[k] + 1] = order[i[k] + 1 : j[k] + 1][::-1].copy()
    return order.tolist()


def flow_tour(lists: DataFrame, starts: DataFrame | None = None, longest: int = LONGEST) -> DataFrame:
    """Lists (list, id, v, bpm) as list, id, place: each next track is the one most like the last. Begins with the list's start (list, id), or its least id where it has none."""
    t = cells(lists, longest)
    least = t.groupBy("list").agg(F.min("id").alias("least"))
    if starts is not None:
        given = t.join(starts.select("list", F.col("id").alias("wanted")), "list").where("id = wanted").groupBy("list").agg(F.min("id").alias("wanted"))
        least = least.join(given, "list", "left").select("list", F.coalesce("wanted", "least").alias("least"))
    first = t.join(least, "list").where("id = least").select("list", F.col("id").alias("start"), "cell")
    means = t.select("list", "cell", F.posexplode("v").alias("dim", "x")).groupBy("list", "cell", "dim").agg(F.avg("x").alias("x"))
    means = means.groupBy("list", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("v"))
    sizes = t.groupBy("list", "cell").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("bpm") > 0, fold_bpm("bpm"))), F.lit(0.0)).alias("bpm"))
    nodes = stored(sizes.join(means, ["list", "cell"], "left"), "cell-means")
    if nodes.where("cell <> ''").limit(1).count():
        order = flow_tour(nodes.select("list", F.col("cell").alias("id"), F.coalesce("v", F.array().cast("array<double>")).alias("v"), "bpm"), first.select("list", F.col("cell").alias("id")), longest)
        nodes = nodes.join(order.select("list", F.col("id").alias("cell"), F.col("place").alias("at")), ["list", "cell"])
    else:
        nodes = nodes.withColumn("at", F.lit(0))
    by = Window.partitionBy("list").orderBy("at")
    nodes = nodes.select("list", "cell", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("v").over(by).alias("last_v"), F.lag("bpm").over(by).alias("last_bpm"))
    nodes = nodes.join(first, ["list", "cell"], "left")
    kind = lambda c: lists.schema[c].dataType.simpleString()

    def inside(x: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        x, node = x.sort_values("id").reset_index(drop=True), at.iloc[0]
        v, bpm = _unit(x["v"]), _fold(x["bpm"].to_numpy(dtype=float))
        mine = np.flatnonzero((x["id"] == node["start"]).to_numpy()) if pd.notna(node["start"]) else []
        if len(mine):
            start = int(mine[0])
        elif node["last_v"] is not None:
            q = np.asarray(node["last_v"], dtype=float)
            start = int(_costs(v, bpm, q / max(np.linalg.norm(q), 1e-12), float(node["last_bpm"])).argmin())
        else:
            start = 0
        order = _greedy(len(x), start, lambda k, step: _costs(v, bpm, v[k], bpm[k]))
        if node["cell"]:
            order = _shortened(order, np.stack([_costs(v, bpm, v[k], bpm[k]) for k in range(len(x))]))
        return pd.DataFrame({"list": x["list"], "id": x["id"].to_numpy()[order], "place": int(node["before"]) + np.arange(len(x), dtype=np.int64)})

    return t.groupBy("list", "cell").cogroup(nodes.groupBy("list", "cell")).applyInPandas(inside, f"list {kind('list')}, id {kind('id')}, place long")


def tour_cost(lists: DataFrame, order: DataFrame) -> DataFrame:
    """list, cost: the sum of the costs of an order's hand-overs."""
    from earshot.operators.taste import transition_cost

    by = Window.partitionBy("list").orderBy("place")
    t = lists.join(order, ["list", "id"]).select("list", "v", "bpm", F.lag("v").over(by).alias("was_v"), F.lag("bpm").over(by).alias("was_bpm"))
    return t.groupBy("list").agg(F.coalesce(F.sum(transition_cost("was_v", "was_bpm", "v", "bpm")), F.lit(0.0)).alias("cost"))


def ordered_mix(vectors: DataFrame, chosen: DataFrame, order: str = "flow", start: int | None = None, longest: int = LONGEST) -> DataFrame:
    """pos, id of the chosen tracks (id, score): by 'score', by 'shuffle' (md5 of the id), or by 'flow' from start, else from the best."""
    if order != "flow":
        keys = (F.desc("score"), "id") if order == "score" else (F.md5(F.col("id").cast("string")), "id")
        rank = F.row_number().over(Window.partitionBy("list").orderBy(*keys)) - 1
        return chosen.withColumn("list", F.lit(0)).select(rank.alias("pos"), "id")
    lists = vectors.join(chosen.select("id"), "id").select(F.lit(0).alias("list"), "id", "v", "bpm")
    wanted = [] if start is None else [F.desc(F.col("id") == start)]
    first = chosen.orderBy(*wanted, F.desc("score"), "id").limit(1)
    return flow_tour(lists, first.select(F.lit(0).alias("list"), "id"), longest).select(F.col("place").alias("pos"), "id")


def supermix(vectors: DataFrame, representatives: DataFrame, size: int = 80, most: int = 8, longest: int = LONGEST) -> DataFrame:
    """pos, id: one long flow through all clusters. Its seeds are one representative (cluster, id) of each of the first clusters; the tracks most like a seed follow, from the first seed on."""
    from earshot.operators.upkeep import recipe

    seeds = representatives.orderBy("cluster", "id").limit(most)
    none = vectors.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    chosen = recipe(vectors, seeds.select("id"), none, size)
    first = seeds.limit(1).select(F.col("id").alias("seed"))
    lists = vectors.join(chosen.select("id"), "id").select(F.lit(0).alias("list"), "id", "v", "bpm")
    return flow_tour(lists, first.select(F.lit(0).alias("list"), F.col("seed").alias("id")), longest).select(F.col("place").alias("pos"), "id")
