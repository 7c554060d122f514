"""Streams with state, the clock in segments, tags of files, searches joined laterally, and sound that is filtered before it is thinned."""

import itertools
import json
import os
import random
import struct
import time
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.functions import lateral
from earshot.operators import clock, sound
from earshot.plans.growth import with_state_lists
from earshot.sources import stores, tags
from earshot.streaming import listening as st
from earshot.streaming import stateful as sf


def files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_live_sections_over_batches(spark, tmp_path):
    r = random.Random(6)
    level = [0.1] * 6 + [0.5] * 8 + [0.95] * 9 + [0.2] * 7 + [0.9] * 5
    samples = []
    for b, x in enumerate(level):
        if b in (10, 11):
            continue  # not heard
        for k in range(2):
            at = b * 2 + k
            samples += [(i, pd.Timestamp(at, unit="s").to_pydatetime(), float(at), max(0.0, x + r.uniform(-0.02, 0.02))) for i in (1, 2) if i == 1 or b < 12]
    samples.append((1, pd.Timestamp(30, unit="s").to_pydatetime(), 30.0, 0.0))  # silence
    late = (1, pd.Timestamp(1, unit="s").to_pydatetime(), 1.0, 0.99)  # comes after its bucket is final
    end = [(9, pd.Timestamp(t, unit="s").to_pydatetime(), 0.0, 0.5) for t in (500, 1000)]
    schema = "id long, at timestamp, position double, energy double"
    cut = [samples[:40], samples[40:90], samples[90:] + [late], end[:1], end[1:]]  # a batch is late by the watermark of the batch before
    stream = files(spark, f"{tmp_path}/in", cut, schema)
    got = with_state_lists(spark, lambda: st.drain(sf.live_sections(sf.bucket_energy(stream)), f"{tmp_path}/run").collect())
    want = []
    means = pd.DataFrame([s for s in samples if s[3] > 0.001], columns=["id", "at", "position", "energy"]).assign(bucket=lambda d: (d.position // 2).astype(int)).groupby(["id", "bucket"])["energy"].mean()
    for i in (1, 2):
        state = None
        for b, e in means[i].items():
            state, done = sf.fold_bucket(state, int(b), float(e))
            want += [(i, *d) for d in done]
    assert sorted((g.id, g.number, g.start, g.finish, g.tier) for g in got if g.id != 9) == sorted(want)
    assert {w[4] for w in want} == {0, 1, 2}


def test_sections_of_a_fold_by_hand():
    state, out = None, []
    for b, e in enumerate([0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.1, 0.9]):
        state, done = sf.fold_bucket(state, b, e)
        out += done
    assert out == [(0, 0, 2, 2), (1, 2, 4, 1), (2, 4, 6, 0)]
    assert sf.fold_bucket(state, 3, 0.5) == (state, [])  # too late


def test_batches_by_count_time_and_stall(spark, tmp_path):
    schema = "source string, path string, done boolean"
    rows = [("many", f"p{k:02d}", False) for k in range(23)] + [("few", "x", False), ("whole", "w", True)]
    stream = files(spark, f"{tmp_path}/in", [rows], schema)

    def run():
        out = []
        q = sf.batches(stream, 10, 1_500, 4_000).writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("append")
        q = q.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).trigger(processingTime="500 milliseconds").start()
        began = time.time()
        while time.time() - began < 60 and sum(r[2] == "stalled" for r in out) < 2:
            time.sleep(0.3)
        q.stop()
        q.awaitTermination(30)
        return out

    got = with_state_lists(spark, run)
    paths = [f"p{k:02d}" for k in range(23)]
    assert sorted(r for r in got if r[2] == "count") == [("many", 0, "count", paths[:10]), ("many", 1, "count", paths[10:20])]
    assert sorted(r for r in got if r[2] == "time") == [("few", 0, "time", ["x"]), ("many", 2, "time", paths[20:])]
    assert [r for r in got if r[2] == "done"] == [("whole", 0, "done", ["w"])]
    assert sorted((r[0], r[3]) for r in got if r[2] == "stalled") == [("few", []), ("many", [])]


def test_batches_of_many_frames_go_by_path(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 50)  # a source's rows come in frames of 50
    try:
        order = random.Random(1).sample(range(1_003), 1_003)
        stream = files(spark, f"{tmp_path}/in", [[("a", f"p{k:05d}", True) for k in order]], "source string, path string, done boolean")
        got = with_state_lists(spark, lambda: st.drain(sf.batches(stream, 10, 10**9, 10**9), f"{tmp_path}/run", once=True).orderBy("number").collect())
    finally:
        spark.conf.set(key, before)
    assert [p for r in got for p in r.paths] == [f"p{k:05d}" for k in range(1_003)]
    assert [(r.number, r.why, len(r.paths)) for r in got] == [(n, "count", 10) for n in range(100)] + [(100, "done", 3)]


def test_a_log_that_forgets(spark, tmp_path):
    schema = "user_id long, seq long, track long, kind string, ts long"
    r = random.Random(2)
    events = [(r.randrange(2), k, None if k % 9 == 0 else k % 5, "Like", k) for k in range(60)]
    cuts = [events[:7], events[7:40], events[40:]]
    out = with_state_lists(spark, lambda: st.drain(sf.bounded_log(files(spark, f"{tmp_path}/in", cuts, schema), 8), f"{tmp_path}/run", "update").collect())
    had: list = []
    for n, cut in enumerate(cuts):
        had += cut
        for u in (0, 1):
            mine = [e[1] for e in had if e[0] == u]
            if any(e[0] == u for e in cut):
                assert [(x.events, x.held, x.first_seq, x.last_seq) for x in out if x.user_id == u and x.batch == n] == [(len(mine), len(mine[-8:]), mine[-8:][0], mine[-1])]


def test_the_clock_in_any_segments_is_the_walk(spark):
    r = random.Random(8)
    events = [(u, k, r.choice(["Like", "Like", "FullPlay", "SkipMid", None]), r.randrange(3) * 3600) for k in range(900) for u in (1,) if r.random() < 0.9] + [(2, k, "Like", 0) for k in range(5)]
    table = spark.createDataFrame(events, "user_id long, seq long, kind string, ts long")
    walked = {}
    for u, _, kind, ts in sorted(events, key=lambda e: e[1]):
        if kind:
            w = walked.setdefault((u, ts // 3600), {})
            w[kind] = w.get(kind, 0.0) + 1
            if w[kind] >= 40:
                for k in w:
                    w[k] /= 2
    want = {(*key, k): x for key, w in walked.items() for k, x in w.items()}
    for length in (1, 7, 64, 333, 10_000):
        got = {(g.user_id, g.hour, g.kind): g.weight for g in clock.clock(table, length, 40).collect()}
        assert got == pytest.approx(want)
    assert clock.clock(table.where("false")).collect() == []


def test_effects_of_segments_compose():
    r = random.Random(1)
    kinds = [r.choice("abc") for _ in range(200)]
    count = lambda part: sorted({k: part.count(k) for k in part}.items())
    start = {"a": 11.5, "d": 3.0}
    whole = clock.after(start, count(kinds), kinds, 30)
    for cut in (0, 1, 50, 120, 200):
        w, h = clock.after(start, count(kinds[:cut]), kinds[:cut], 30)
        x, g = clock.after(w, count(kinds[cut:]), kinds[cut:], 30)
        assert (x, h + g) == (pytest.approx(whole[0]), whole[1])


def id3(frames, major=3, pad=0):
    size = (lambda n: struct.pack(">I", n)) if major == 3 else (lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]))
    body = b"".join(k.encode() + size(len(v)) + b"\0\0" + v for k, v in frames) + b"\0" * pad
    n = len(body)
    return b"ID3" + bytes([major, 0, 0, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def comment_block(pairs):
    texts = [f"{k}={v}".encode() for k, v in pairs]
    return struct.pack("<I", 3) + b"lib" + struct.pack("<I", len(texts)) + b"".join(struct.pack("<I", len(t)) + t for t in texts)


def ogg(packets):
    out = b""
    for p in packets:
        parts = [p[a : a + 255 * 200] for a in range(0, len(p), 255 * 200)]
        for i, x in enumerate(parts):
            full, rest = divmod(len(x), 255)
            lacing = [255] * full + ([rest] if i == len(parts) - 1 else [])
            out += b"OggS" + bytes(22) + bytes([len(lacing), *lacing]) + x
    return out


def test_tags_of_files(spark, tmp_path):
    audio = os.urandom(200_000)
    info = bytes(10) + (44_100 << 44 | 44_100 * 90).to_bytes(8, "big") + bytes(16)
    flac = lambda pairs, picture=0: b"fLaC" + bytes([0, *len(info).to_bytes(3, "big")]) + info + (bytes([6, *picture.to_bytes(3, "big")]) + bytes(picture) if picture else b"") + (lambda c: bytes([0x84, *len(c).to_bytes(3, "big")]) + c)(comment_block(pairs))
    made = {
        "one.mp3": id3([("TIT2", b"\x03Song"), ("TPE1", b"\x00Ex\xe9"), ("TALB", b"\x01" + "Älbum".encode("utf-16")), ("TPE2", b"\x03  "), ("TYER", b"\x001999"), ("TRCK", b"\x003/12"), ("APIC", bytes(9000)), ("TCON", b"\x03Rock")]),
        "four.mp3": id3([("TIT2", b"\x02" + "Hé".encode("utf-16-be")), ("TDRC", b"\x032004-05-06")], 4, 30),
        "Some One - A Title.mp3": id3([("TPE1", b"\x03Tagged")]),
        "two.flac": flac([("title", "Fläc"), ("ARTIST", "A"), ("Date", "2011-01"), ("DISCNUMBER", "2"), ("GENRE", "")]),
        "far.flac": flac([("TITLE", "Behind a picture")], 60_000),
        "three.ogg": ogg([b"\x01vorbis" + bytes(23), b"\x03vorbis" + comment_block([("TITLE", "Ogg"), ("ARTIST", "B"), ("X", "y" * 70_000), ("ALBUM", "last")])]),
        "five.opus": ogg([b"OpusHead" + bytes(11), b"OpusTags" + comment_block([("TITLE", "Opus")])]),
        "Cut Off - Name.mp3": id3([("TIT2", b"\x03Song")])[:14],
        "Broken - Flac.flac": b"fLaC\x04",
        "empty.mp3": b"",
    }
    for name, head in made.items():
        (tmp_path / name).write_bytes(head + (audio if head and not name.startswith(("Cut", "Broken")) else b""))
    paths = [str(tmp_path / n) for n in made] + [str(tmp_path / "Not - There.mp3")]
    rows = {os.path.basename(r.path): r for r in tags.tags_of_list(spark, paths + paths[:2]).collect()}
    assert len(rows) == len(paths)
    pick = lambda n, *c: tuple(rows[n][x] for x in c)
    assert pick("one.mp3", "title", "artist", "album", "album_artist", "year", "track_no", "genre", "format") == ("Song", "Exé", "Älbum", None, 1999, 3, "Rock", "id3")
    assert pick("four.mp3", "title", "year", "artist") == ("Hé", 2004, None)
    assert pick("Some One - A Title.mp3", "artist", "title") == ("Tagged", "A Title")
    assert pick("two.flac", "title", "artist", "year", "disc_no", "genre", "duration") == ("Fläc", "A", 2011, 2, None, 90.0)
    assert pick("far.flac", "title") == ("Behind a picture",)
    assert pick("three.ogg", "title", "artist", "album") == ("Ogg", "B", "last") and pick("five.opus", "title") == ("Opus",)
    assert pick("Cut Off - Name.mp3", "artist", "title") == ("Cut Off", "Name") and pick("Broken - Flac.flac", "artist", "title") == ("Broken", "Flac")
    assert pick("Not - There.mp3", "artist", "title", "bytes_read") == ("Not", "There", 0) and pick("empty.mp3", "title") == ("empty",)
    assert pick("two.flac", "bytes_read") == (4096,) and rows["far.flac"].bytes_read < 70_000 and rows["one.mp3"].bytes_read < 12_000  # heads alone
    table = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    assert sorted(map(str, tags.tags_of(table).collect())) == sorted(map(str, rows.values()))
    one = spark.read.format("tags").option("paths", json.dumps(paths)).option("files", "3").load()
    assert one.rdd.getNumPartitions() == 4


def test_searches_joined_laterally(spark):
    def slow(q):
        yield {"url": f"u:{q}", "title": "first"}
        time.sleep(30 if q == "slow" else 0)
        yield {"url": "", "title": "no address"}
        yield {"url": f"v:{q}", "artist": "who", "duration": 3}

    def wrong(q):
        if q != "b":
            raise KeyError("gone")
        yield None
        yield {"url": "w"}

    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "slow"), (4, None)], "id long, q string")
    began = time.time()
    got = lateral.searched(queries, "q", {"slow": lateral.search_function("slow", slow, 1.5), "wrong": lateral.search_function("wrong", wrong)})
    rows = sorted((r.id, r.function, r.url, r.artist, r.album, r.duration, r.error) for r in got.collect() if r.url)
    assert rows == [(1, "slow", "u:a", "slow", "slow", 0.0, None), (1, "slow", "v:a", "who", "slow", 3.0, None), (2, "slow", "u:b", "slow", "slow", 0.0, None), (2, "slow", "v:b", "who", "slow", 3.0, None), (2, "wrong", "w", "wrong", "wrong", 0.0, None), (3, "slow", "u:slow", "slow", "slow", 0.0, None)]
    errors = sorted((r.id, r.function, r.error) for r in got.collect() if r.error)
    assert errors == [(1, "wrong", "'gone'"), (3, "slow", "timed out"), (3, "wrong", "'gone'")]
    assert time.time() - began < 25


def wav(path, x, rate, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat((np.asarray(x) * 32_000).astype("<i2"), channels).tobytes())


def seconds_of(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "content")


def test_what_a_low_rate_cannot_hold_is_filtered(spark, tmp_path):
    for rate in (44_100, 48_000, 8_000):
        t = np.arange(rate * 3) / rate
        for hz in (500, 1500, 3000):
            wav(tmp_path / f"{rate}-{hz}.wav", 0.8 * np.sin(2 * np.pi * hz * t), rate, 2)
    (tmp_path / "no.wav").write_bytes(b"RIFFxxxxWAVE")
    got = {}
    for r in stores.wave_seconds(seconds_of(spark, tmp_path)).collect():
        got.setdefault(os.path.basename(r.id)[:-4], {})[r.sec] = np.array(r.samples)
    assert len(got) == 9
    for name, secs in got.items():
        x = secs[1]
        assert len(x) == 4000 and sorted(secs) == [0, 1, 2]
        power = np.sqrt(np.mean(x**2))
        assert power < 0.003 if name.endswith("3000") else power == pytest.approx(0.8 / np.sqrt(2), rel=0.03), name
        if not name.endswith("3000"):
            assert abs(np.abs(np.fft.rfft(x)).argmax() - int(name.split("-")[1])) <= 1
    frames = {(os.path.basename(r.id), r.sec): np.array(r.bands) for r in sound.band_frames(stores.wave_seconds(seconds_of(spark, tmp_path))).collect()}
    assert frames["44100-500.wav", 1].max() > 100


def test_where_blocks_are_cut_changes_nothing(spark, tmp_path):
    rate = 11_025
    x = np.random.default_rng(3).uniform(-0.9, 0.9, rate * 5 + 777)
    wav(tmp_path / "a.wav", x, rate)
    got = {r.sec: np.array(r.samples) for r in stores.wave_seconds(seconds_of(spark, tmp_path)).collect()}
    whole = np.concatenate([got[k] for k in sorted(got)])
    own = (x * 32_000).astype("<i2") / 32_768
    at = np.arange(len(whole)) * (rate / 4000)
    near, weights = stores.low_pass(rate, 4000)
    half = weights.shape[1] // 2
    line = np.concatenate((np.zeros(half), own, np.zeros(2 * rate)))
    want = [(line[int(np.floor(p)) + np.arange(2 * half + 1)] * weights[k % 4000]).sum() for k, p in enumerate(at)]
    assert np.allclose(whole, want, atol=1e-5)
    assert len(got) == 6 and len(got[5]) == int(np.ceil(777 * 4000 / rate))


def test_long_mixes_are_whole(spark, tmp_path):
    wav(tmp_path / "m.wav", np.zeros(4000 * 500), 4000)
    seconds = stores.wave_seconds(seconds_of(spark, tmp_path))
    assert seconds.count() == 500 and stores.wave_seconds(seconds_of(spark, tmp_path), longest=240).count() == 240


def test_a_gap_of_any_length_takes_a_few_steps():
    def walked(state, bucket, energy):
        first, last, before, now, top, tier, start, number = state
        done = []
        for b in range(last + 1, bucket + 1):
            after = energy if b == bucket else now
            smooth = (before + now + after) / 3
            top = max(top, smooth, 0.0001)
            new = 2 if smooth >= sf.DROP * top else 1 if smooth >= sf.VERSE * top else 0
            if tier == -1:
                tier, start = new, last
            elif new != tier:
                done.append((number, start, last, tier))
                number, tier, start = number + 1, new, last
            before, now, last = now, after, b
        return (first, last, before, now, top, tier, start, number), done

    r = random.Random(4)
    for _ in range(200):
        state = sf.fold_bucket(None, r.randrange(3), r.random())[0]
        for _ in range(8):
            step = state[1] + r.choice((1, 2, 3, 4, 9, 40)), r.choice((0.0, 0.1, 0.5, r.random()))
            assert sf.fold_bucket(state, *step) == walked(state, *step)
            state = walked(state, *step)[0]
    began = time.time()
    sf.fold_bucket(state, 10**12, 0.3)
    assert time.time() - began < 1
