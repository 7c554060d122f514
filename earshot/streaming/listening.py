"""Listening events as streams: counters, buckets, sessions, the hourly clock and the taste model.

Each function takes a streaming (or static, where it says so) DataFrame and gives one; the caller picks sink, trigger and checkpoint.
Events of one key are applied in order of seq within a micro-batch, and in order of arrival across batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from earshot.operators.recommend import EVENT_WEIGHTS
from earshot.operators.taste import PARTS, Models, numbered_users


def counters(events: DataFrame, most_skips: int = 10) -> DataFrame:
    """Running counters a track: plays, skips (capped), last_played. Also for static tables. Sink in complete or update mode."""
    skip = F.startswith("kind", F.lit("Skip"))
    return events.where("track is not null").groupBy("track").agg(F.count_if(~skip).alias("plays"), F.least(F.lit(most_skips), F.count_if(skip)).cast("long").alias("skips"), F.max("ts").alias("last_played"))


def bucket_means(events: DataFrame, width: str = "2 seconds", late: str = "1 hour") -> DataFrame:
    """start, user_id, mean, n of what lies in each stretch of time. A bucket is final once the watermark passes it; events later than that are dropped, which is this library's rule."""
    t = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    out = t.groupBy(F.window("at", width), "user_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_timestamp("window.start").alias("start"), "user_id", "mean", "n")


def finished_sessions(events: DataFrame) -> DataFrame:
    """user_id, track, start, finish, events: a stretch of one track, given out when another track begins."""
    out = "user_id long, track long, start long, finish long, events long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        done, rows = [], pd.concat(batches)
        for r in rows.sort_values("seq").itertuples():
            track = None if pd.isna(r.track) else int(r.track)
            if now and now[0] == track:
                now = [track, min(now[1], r.ts), max(now[2], r.ts), now[3] + 1]
            else:
                done += [(key[0], *now)] if now else []
                now = [track, r.ts, r.ts, 1]
        state.update(tuple(now))
        yield pd.DataFrame(done, columns=["user_id", "track", "start", "finish", "events"]).astype({"track": "Int64"})

    return events.groupBy("user_id").applyInPandasWithState(step, out, "track long, start long, finish long, events long", "append", GroupStateTimeout.NoTimeout)


def hourly_clock(events: DataFrame, cap: int = 240) -> DataFrame:
    """user_id, hour, kind, weight: counts of the kinds that a listener heard in an hour of the day, all halved whenever one of them comes to the cap. Sink in update mode.

    Listeners are dealt into PARTS parts, which are the keys of the state, as a key costs far more than its few numbers. A part holds the events of a batch as numbers, for their
    order is that of all of them; what is kept is a listener's hours with one number a kind.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, clocks = [], {}
        if state.exists:
            kinds, keys, weights = list(state.get[0]), np.frombuffer(state.get[1], dtype=np.int64).reshape(-1, 2), np.frombuffer(state.get[2]).reshape(-1, len(state.get[0]))
            clocks = {(u, h): w for (u, h), w in zip(keys.tolist(), weights.tolist(), strict=True)}
        parts = []
        for batch in batches:
            codes, names = pd.factorize(batch["kind"])
            kinds += [k for k in names if k not in kinds]
            parts.append(np.stack((batch["seq"], batch["user"], batch["hour"], np.array([kinds.index(k) for k in names], dtype=np.int64)[codes]), axis=1))
        now = np.concatenate(parts)
        for _, user, hour, kind in now[np.argsort(now[:, 0], kind="stable")].tolist():
            clock = clocks.get((user, hour))
            if clock is None:
                clock = clocks[user, hour] = [0.0] * len(kinds)
            elif len(clock) < len(kinds):
                clock += [0.0] * (len(kinds) - len(clock))
            clock[kind] += 1
            if clock[kind] >= cap:
                clock[:] = [w / 2 for w in clock]
        whole = np.array([w + [0.0] * (len(kinds) - len(w)) for w in clocks.values()])
        state.update((kinds, np.array(list(clocks), dtype=np.int64).tobytes(), whole.tobytes()))
        told = list({(u, h): None for u, h in now[:, 1:3].tolist()})
        weights, keys = np.array([clocks[k] for k in told]), np.array(told, dtype=np.int64)
        row, kind = np.nonzero(weights)  # a kind that came has more than nothing for ever
        user, hour = keys[row, 0], keys[row, 1]
        yield pd.DataFrame({
            "user_id": pd.Series(user, dtype="Int64").mask(hour >= 25), "hour": pd.Series(hour % 25, dtype="Int64").mask(hour % 25 == 24), "kind": np.array(kinds, dtype=object)[kind], "weight": weights[row, kind]})

    # Hour 24 is that of an event without a time, and 25 and on are those of no listener.
    hour = F.coalesce(F.hour(F.timestamp_seconds("ts")), F.lit(24)) + F.when(F.col("user_id").isNull(), 25).otherwise(0)
    t = events.where("kind is not null").select(F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int").alias("part"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), hour.cast("long").alias("hour"), "kind", F.col("seq").cast("long").alias("seq"))
    return t.groupBy("part").applyInPandasWithState(step, "user_id long, hour long, kind string, weight double", "kinds array<string>, keys binary, weights binary", "update", GroupStateTimeout.NoTimeout)


def event_log(events: DataFrame, most: int = 20_000) -> DataFrame:
    """The last events of each listener, most of them at most, and for each the place from the end (0 is the last). For tables."""
    by = Window.partitionBy("user_id").orderBy(F.desc("seq"))
    return events.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= most).withColumn("back", F.col("_rn") - 1).drop("_rn")


def last_played(events: DataFrame) -> DataFrame:
    """user_id, track, ts of the last event that played a track: one that only liked, disliked or added it does not count. Also for streams, in complete or update mode."""
    played = ~F.col("kind").isin("Like", "Dislike", "AddedManually") & F.col("track").isNotNull()
    return events.where(played).groupBy("user_id", "track").agg(F.max("ts").alias("ts"))


def taste_model(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, side, centroid, mass, v after each batch of events; vectors (id, v) is a static table. Sink in update mode: the last rows of a user hold. Listeners are dealt into parts, which are the keys of the state."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_WEIGHTS.items() for x in kv]), F.col("kind"))
    user = [F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int").alias("part"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.col("user_id").isNull().alias("none")]
    e = events.withColumn("w", weight).where("w <> 0").join(vectors.select(F.col("id").alias("track"), F.col("v").cast("array<double>").alias("v")), "track").select(*user, "seq", "w", "v")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = []
        for b in batches:
            told.append((b[["user", "none", "seq", "w"]], np.stack(b["v"].to_numpy()).astype(float)))
        now, rows = pd.concat([f for f, _ in told], ignore_index=True), np.concatenate([v for _, v in told])
        order = np.argsort(now["seq"].to_numpy(), kind="stable")
        was = (np.frombuffer(x, dtype=kind) for x, kind in zip(state.get, (np.int64, np.int64, float, float), strict=True)) if state.exists else (np.zeros(0, dtype=k) for k in (np.int64, np.int64, float, float))
        held, size, mass, flat = was
        held = held.reshape(-1, 2)
        own, users = numbered_users(np.concatenate((held[:, 0], now["user"].to_numpy())), np.concatenate((held[:, 1], now["none"].to_numpy())))
        m, mine = Models(len(users), rows.shape[1]), own[: len(held)]
        sides = (mine[:, None] * 2 + np.arange(2)).ravel()
        m.size[sides] = size
        side, k = np.nonzero(np.arange(m.mass.shape[1]) < size[:, None])
        m.mass[sides[side], k], m.centre[sides[side], k] = mass, flat.reshape(-1, rows.shape[1])
        m.learn(own[len(held) :][order], rows, order, now["w"].to_numpy(dtype=float)[order])
        side, k = np.nonzero(np.arange(m.mass.shape[1]) < m.size[:, None])
        keys = np.array([(0, 1) if u is None else (u, 0) for u in users], dtype=np.int64)
        state.update((keys.tobytes(), m.size.tobytes(), m.mass[side, k].tobytes(), m.centre[side, k].tobytes()))
        heard = set(own[len(held) :].tolist())
        out = m.frame(users)
        yield out[np.isin(side // 2, list(heard))]

    return e.groupBy("part").applyInPandasWithState(step, "user_id long, side int, centroid int, mass double, v array<double>", "users binary, sizes binary, masses binary, flat binary", "update", GroupStateTimeout.NoTimeout)


def events_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of events from Parquet files as they come, at most so many files a batch. Path is a folder or a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def drain(stream: DataFrame, folder: str, mode: str = "append", once: bool = False) -> DataFrame:
    """Run a stream over all that is there now and read what it gave out; once: in a single batch, as streams with timers by the clock would go on for ever. Every batch is one folder, written as a whole, so a batch run again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(**({"once": True} if once else {"availableNow": True})).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/out")
