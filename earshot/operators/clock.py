"""The hourly clock of many events: segments are folded in parallel and merged in order.

What a segment does to a listener's weights of an hour is a function of them: where no weight comes to the cap it adds the segment's counts, which
is one step whatever its length; only a segment in which the cap is met is walked, event by event. A segment is a stretch of seq, so that no
listener's events are sorted or held as one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a segment in seq, and the weight at which all weights of an hour are halved.
SEGMENT, CAP = 4_096, 240


def segments(events: DataFrame, length: int = SEGMENT) -> DataFrame:
    """user_id, hour, segment, counts (kind -> events) and kinds (in order of seq) of events (user_id, ts, kind, seq)."""
    e = events.where("kind is not null").select("user_id", F.hour(F.timestamp_seconds("ts")).cast("long").alias("hour"), F.floor(F.col("seq") / length).cast("long").alias("segment"), "kind", "seq")
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"])
    s = e.groupBy("user_id", "hour", "segment").agg(kinds.alias("kinds"))
    counts = F.transform(F.array_distinct("kinds"), lambda k: F.struct(k.alias("kind"), F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias("n")))
    return s.select("user_id", "hour", "segment", counts.alias("counts"), "kinds")


def after(weights: dict[str, float], counts: list[tuple[str, int]], kinds: list[str], cap: int = CAP) -> tuple[dict[str, float], int]:
    """A segment's effect: the weights after it, and how many halvings it met."""
    if all(weights.get(k, 0.0) + n < cap for k, n in counts):
        return weights | {k: weights.get(k, 0.0) + n for k, n in counts}, 0
    weights, halved = dict(weights), 0
    for k in kinds:
        weights[k] = weights.get(k, 0.0) + 1
        if weights[k] >= cap:
            weights, halved = {x: w / 2 for x, w in weights.items()}, halved + 1
    return weights, halved


def merged(segments: DataFrame, cap: int = CAP) -> DataFrame:
    """user_id, hour, kind, weight and halvings after all segments, in their order. Tasks pass over sorted rows and hold one hour's weights."""
    rows = segments.select("user_id", "hour", "segment", "counts", "kinds").repartition("user_id", "hour").sortWithinPartitions("user_id", "hour", "segment")
    columns = ["user_id", "hour", "kind", "weight", "halvings"]

    def run(frames):
        key, weights, halved = None, {}, 0
        out = lambda: pd.DataFrame([(*key, k, w, halved) for k, w in weights.items()], columns=columns)
        for f in frames:
            for r in f.itertuples(index=False):
                if (r.user_id, r.hour) != key:
                    if key is not None:
                        yield out()
                    key, weights, halved = (r.user_id, r.hour), {}, 0
                counts = [(c["kind"], int(c["n"])) for c in r.counts]
                weights, more = after(weights, counts, list(np.asarray(r.kinds, dtype=object)), cap)
                halved += more
        if key is not None:
            yield out()

    return rows.mapInPandas(run, "user_id long, hour long, kind string, weight double, halvings long")


def clock(events: DataFrame, length: int = SEGMENT, cap: int = CAP) -> DataFrame:
    return merged(segments(events, length), cap)
