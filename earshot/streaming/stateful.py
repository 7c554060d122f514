"""Streams with state of their own: batches by count or by time, stalled sources, live sections, and a log that forgets.

Each is a stateful processor per key. State is kept as values and lists that live no longer than they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a batch, milliseconds after which what there is goes out, and after which a source that is not done counts as stalled.
BATCH, FLUSH_MS, STALL_MS, DAY_MS = 200, 2_000, 30_000, 86_400_000
#: Seconds of a bucket of live sections; shares of the loudest smoothed bucket from which a bucket is a drop or a verse.
WIDTH, DROP, VERSE = 2, 0.72, 0.4
#: Batches that go out in one frame.
OUT = 1_000


def _by_path(parts: list[pa.Array]) -> pa.Array:
    """All parts' paths in one array, sorted."""
    paths = pa.concat_arrays([p.cast(pa.large_string()) for p in parts] or [pa.array([], pa.large_string())])
    return paths.take(pc.sort_indices(paths))


class _Batches(StatefulProcessor):
    """Holds a source's rows until there are enough of them or the oldest has waited long enough; a source that goes quiet before it is done is reported once."""

    def __init__(self, size: int, flush_ms: int, stall_ms: int, kept_ms: int):
        self.size, self.flush_ms, self.stall_ms, self.kept_ms = size, flush_ms, stall_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "path string", ttlDurationMs=self.kept_ms)
        # Number of the next batch, whether the source is done, when the oldest row came, when the source was last heard of.
        self.told = handle.getValueState("told", "number long, done boolean, since long, heard long", ttlDurationMs=self.kept_ms)

    def _out(self, key, number: int, why: str, paths: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "number": [number], "why": [why], "paths": [paths]})

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        number, done, since, _ = self.told.get() if self.told.exists() else (0, False, now, now)
        held = [r[0] for r in self.rows.get()] if self.rows.exists() else []
        since = since if held else now
        new = []
        for frame in rows:  # a key's rows come in several frames, and the order is that of all of them
            done = done or bool(frame["done"].any())
            new.append(pa.array(frame["path"], pa.string(), from_pandas=True).drop_null())
        new = pa.concat_arrays([pa.array(held, pa.large_string()), _by_path(new)])
        full = len(new) // self.size
        for a in range(0, full, OUT):
            many = min(OUT, full - a)
            paths = pa.ListArray.from_arrays(np.arange(many + 1, dtype=np.int32) * self.size, new.slice(a * self.size, many * self.size))
            yield pd.DataFrame({"source": [key[0]] * many, "number": np.arange(number + a, number + a + many), "why": "count", "paths": paths.to_pylist()})
        if full:
            number, since = number + full, now
        held = new.slice(full * self.size).to_pylist()
        if done and held:
            yield self._out(key, number, "done", held)
            held, number = [], number + 1
        if held:
            self.rows.put([(p,) for p in held])
        else:
            self.rows.clear()
        self.told.update((number, done, since, now))
        if held:
            self._timer(since + self.flush_ms)
        elif not done:
            self._timer(now + self.stall_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        number, done, since, heard = self.told.get() if self.told.exists() else (0, True, now, now)
        held = [r[0] for r in self.rows.get()] if self.rows.exists() else []
        if held:
            yield self._out(key, number, "time", held)
            self.rows.clear()
            number += 1
            self.told.update((number, done, now, heard))
            if not done:
                self.handle.registerTimer(max(now + 1, heard + self.stall_ms))
        elif not done:
            yield self._out(key, number, "stalled", [])
            self.told.update((number, True, since, heard))

    def close(self) -> None:
        pass


def batches(rows: DataFrame, size: int = BATCH, flush_ms: int = FLUSH_MS, stall_ms: int = STALL_MS, kept_ms: int = DAY_MS) -> DataFrame:
    """source, number, why, paths: rows (source, path, done) in batches of size; those that come in one micro-batch go by path. What has waited flush_ms goes out as it is ("time"), the rest of a source that is done at
    once ("done"), and a source without a row for stall_ms that is not done is said to be "stalled", with no paths. Needs the RocksDB state store."""
    step = _Batches(size, flush_ms, stall_ms, kept_ms)
    return rows.select("source", "path", "done").groupBy("source").transformWithStateInPandas(step, "source string, number long, why string, paths array<string>", "append", "processingTime")


class _Log(StatefulProcessor):
    """The last events of a listener: a list that drops its oldest, and the number of events so far."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "seq long, track long, kind string, ts long")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        old = list(self.rows.get()) if self.rows.exists() else []
        clean = lambda v: None if pd.isna(v) else int(v)
        held = old + [(int(r.seq), clean(r.track), r.kind, clean(r.ts)) for r in new.tail(self.most).itertuples()]
        n = (self.seen.get()[0] if self.seen.exists() else 0) + len(new)
        held = held[-self.most :]
        self.rows.put(held)
        self.seen.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "held": [len(held)], "first_seq": [held[0][0]], "last_seq": [held[-1][0]]})

    def close(self) -> None:
        pass


def bounded_log(events: DataFrame, most: int = 20_000) -> DataFrame:
    """user_id, events, held, first_seq, last_seq after each batch: a listener's log holds the last most events. Events of a batch apply in order of seq, batches in order of arrival. Sink in update mode."""
    rows = events.select("user_id", "seq", "track", "kind", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(_Log(most), "user_id long, events long, held long, first_seq long, last_seq long", "update", "none")


def bucket_energy(samples: DataFrame, late: str = "10 seconds") -> DataFrame:
    """id, bucket, energy, at: mean energy of WIDTH seconds of each track, final once the watermark has passed; samples are id, at (event time), position, energy. Silence does not count."""
    loud = samples.where("energy > 0.001 and position >= 0").withWatermark("at", late)
    out = loud.groupBy(F.window("at", f"{WIDTH} seconds"), "id").agg(F.avg("energy").alias("energy"), F.max("position").alias("position"))
    return out.select("id", F.floor(F.col("position") / WIDTH).alias("bucket"), "energy", F.window_time("window").alias("at"))


class _Sections(StatefulProcessor):
    """Smooths a track's buckets over three and gives out a run of one tier when the next begins. A bucket is smoothed once the one after it has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The last two buckets, the loudest smoothed one so far, and the run at hand.
        self.state = handle.getValueState("state", "first long, last long, before double, now double, top double, tier int, start long, sections long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.state.get() if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("bucket").itertuples():
            s, done = fold_bucket(s, int(r.bucket), float(r.energy))
            out += [(key[0], *d) for d in done]
        if s is not None:
            self.state.update(s)
        yield pd.DataFrame(out, columns=["id", "number", "start", "finish", "tier"]).astype({"number": "int64", "start": "int64", "finish": "int64", "tier": "int32"})

    def close(self) -> None:
        pass


def fold_bucket(state, bucket: int, energy: float):
    """The state after one more bucket and the sections that it ends: number, start and finish (buckets) and tier. Buckets between two that came carry the value before; a bucket before the last one is too late and changes nothing.

    Once a carried bucket leaves everything as it was, so do all others before the new one, and they are passed over at once: a gap takes a few steps, whatever its length.
    """
    if state is None:
        return (bucket, bucket, energy, energy, 0.0, -1, bucket, 0), []
    first, last, before, now, top, tier, start, number = state
    done = []
    while last < bucket:
        b = last + 1
        after = energy if b == bucket else now
        was, smooth = (before, now, top, tier), (before + now + after) / 3
        top = max(top, smooth, 0.0001)
        new = 2 if smooth >= DROP * top else 1 if smooth >= VERSE * top else 0
        if tier == -1:
            tier, start = new, last
        elif new != tier:
            done.append((number, start, last, tier))
            number, tier, start = number + 1, new, last
        before, now, last = now, after, b
        if (before, now, top, tier) == was and b < bucket - 1:
            last = bucket - 1
    return (first, last, before, now, top, tier, start, number), done


def live_sections(buckets: DataFrame) -> DataFrame:
    """id, number, start, finish, tier: stretches of buckets (finish not in it) of one loudness, beside the loudest so far, given out once they end. Takes what bucket_energy() gives, in the same query."""
    return buckets.groupBy("id").transformWithStateInPandas(_Sections(), "id long, number long, start long, finish long, tier int", "append", "none")
