"""Mixes, matches in mixes, stores and sound files beside brute force, on small tables."""

import base64
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import text
from earshot.operators import lookups, mixes, sound, taste
from earshot.sources import stores


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_new_clusters_keep_the_ids_of_similar_old_ones(spark):
    r = np.random.default_rng(1)
    old = r.normal(size=(9, 6))
    new = np.concatenate([old[[3, 3, 5, 8]] + r.normal(size=(4, 6)) * 0.2, r.normal(size=(3, 6))])
    want, used, fresh = {}, set(), 100
    for n, v in enumerate(new):
        near = max((o for o in range(9) if o not in used and cosine(v, old[o]) > 0.6), key=lambda o: cosine(v, old[o]), default=None)
        if near is None:
            want[n], fresh = fresh, fresh + 1
        else:
            used.add(near)
            want[n] = near
    table = lambda vs: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "cluster long, c array<double>")
    assert {r.cluster: r.id for r in mixes.kept_ids(table(new), table(old), 100).collect()} == want
    assert {r.cluster: r.id for r in mixes.kept_ids(table(new), table(old).where("false"), 0).collect()} == {i: i for i in range(7)}


def test_round_robin_gives_each_entry_once(spark):
    r = random.Random(4)
    lists = {k: r.sample(range(12), r.randrange(3, 9)) for k in range(4)}
    for n in (1, 5, 50):
        queues, out, more = {k: list(v[:n]) for k, v in lists.items()}, [], True
        while more and len(out) < n:
            more = False
            for q in queues.values():
                while q and len(out) < n:
                    x = q.pop(0)
                    if x not in out:
                        out.append(x)
                        more = True
                        break
        got = mixes.round_robin(spark.createDataFrame([(k, i, x) for k, v in lists.items() for i, x in enumerate(v)], "list int, pos int, id long"), n)
        assert [g.id for g in got.orderBy("pos").collect()] == out
    assert mixes.round_robin(spark.createDataFrame([], "list int, pos int, id long"), 5).collect() == []


def test_next_track_follows_the_scores(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "id long, v array<double>")
    scores = spark.createDataFrame([(i, 0.9 if i < 3 else -0.9) for i in range(30)], "id long, score double")
    heard = spark.createDataFrame([(0, "FullPlay", 990)] + [(99, "Like", 1)] * 40, "track long, kind string, ts long")
    got = [mixes.next_for_queue(vectors, scores, heard, 1000, seed, explore=False).first().id for seed in range(12)]
    assert 0 not in got and sum(g in (1, 2) for g in got) >= 10 and len(set(got)) > 1
    cold = [mixes.next_for_queue(vectors, scores, heard.limit(5), 1000, seed, explore=False).first().id for seed in range(8)]
    assert len(set(cold)) > 3
    assert mixes.next_for_queue(vectors, scores, heard, 1000, 1, last=29, explore=True).first().id <= 10


def test_clusters_of_the_best_number(spark):
    r = np.random.default_rng(3)
    centres = np.eye(8)[:7]
    rows = [(i, (centres[i % 7] + r.normal(size=8) * 0.05).tolist()) for i in range(140)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    best = taste.auto_clusters(vectors, 6, 8)
    assert best.count() == 7
    own = {r.id: r.cluster for r in taste.nearest(vectors, best).collect()}
    assert all((own[i] == own[j]) == (i % 7 == j % 7) for i in range(20) for j in range(20))
    assert taste.auto_clusters(vectors.limit(1)).count() == 0


def test_transients_keep_their_distance(spark):
    r = random.Random(7)
    v = [r.random() ** 4 for _ in range(200)]
    want, last = [], -5
    for f in range(1, 199):
        local = sum(v[max(0, f - 6) : f]) / len(v[max(0, f - 6) : f])
        if v[f] > max(local * 1.6, sum(v) / 200 * 0.6) and v[f] >= v[f - 1] and v[f] > v[f + 1] and f - last >= 5:
            want.append(f)
            last = f
    got = sound.transients(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "id int, i int, v double"), 6, 5)
    assert sorted(g.i for g in got.collect()) == want and len(want) > 5


def _tone(freqs, seconds, rate=4000):
    t = np.arange(rate) / rate
    return np.concatenate([sum(np.sin(2 * np.pi * f * t) for f in fs) * 0.2 for fs in freqs[:seconds]])


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    """Frames of four recordings of ever other chords and of a mix of two of them, through WAV files."""
    folder, r = tmp_path_factory.mktemp("sound"), random.Random(5)
    chords = {k: [[r.uniform(50, 1700) for _ in range(3)] for _ in range(90)] for k in ("a", "b", "c", "d")}
    sounds = {k: _tone(c, 90) for k, c in chords.items()}
    sounds["mix"] = np.concatenate([sounds["c"], _tone([[100.0]] * 40, 40), sounds["a"], _tone([[1500.0]] * 300, 300)])
    for k, x in sounds.items():
        with wave.open(f"{folder}/{k}.wav", "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(4000)
            w.writeframes((np.repeat(x, 2) * 32_000).astype("<i2").tobytes())
    (folder / "broken.wav").write_bytes(b"RIFFnothing")
    files = spark.read.format("binaryFile").load(f"{folder}/*.wav")
    seconds = stores.wave_seconds(files, longest=900).withColumn("id", text.stem("id"))
    rows = sound.band_frames(seconds).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sec", "bands")))["bands"].alias("frames"))
    return rows.withColumn("length", F.size("frames").cast("double")).cache()


def test_recordings_are_found_in_a_mix(frames):
    got = sound.found_in_mixes(frames, frames).orderBy("start").collect()
    assert [(g.mix, g.id, g.start, g.finish) for g in got] == [("mix", "c", 0, 90), ("mix", "a", 130, 220)]
    assert all(g.score > 0.99 for g in got)
    assert sound.found_in_mixes(frames.where("id <> 'mix'"), frames).collect() == []


def test_pieces_change_nothing(frames, monkeypatch):
    monkeypatch.setattr(sound, "PIECE", 100)
    assert {g.id for g in sound.found_in_mixes(frames, frames).collect()} == {"a", "c"}


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    rows = spark.range(5)
    stores.replace_table(rows, f"{tmp_path}/t")
    stores.replace_table(rows.where("id > 2"), f"{tmp_path}/t")
    assert stores.read_table(spark, f"{tmp_path}/t").count() == 2
    with pytest.raises(Exception):
        stores.replace_table(rows.select(F.raise_error(F.lit("no")).alias("x")), f"{tmp_path}/t")
    assert stores.read_table(spark, f"{tmp_path}/t").count() == 2
    stores.clear_table(spark, f"{tmp_path}/t")
    assert stores.read_table(spark, f"{tmp_path}/t").columns == ["id"] and stores.read_table(spark, f"{tmp_path}/t").count() == 0
    stores.save_states({"a": rows, "b": rows.limit(1)}, f"{tmp_path}/s")
    assert stores.read_table(spark, f"{tmp_path}/s/b").count() == 1


def test_caches_and_samples(spark, tmp_path):
    stores.save_cache(spark.range(7), f"{tmp_path}/c", "/music")
    assert spark.read.json(f"{tmp_path}/c/meta").first().asDict() == {"source": "/music", "total": 7}
    assert [r.id for r in stores.page_of(spark.range(9), "id", 3, 2).collect()] == [3, 4] and stores.page_of(spark.range(9), "id", -1, -4).count() == 0
    data = base64.b64encode(np.array([0.5, -2, 3], dtype="<f4").tobytes()).decode()
    assert stores.samples_of(spark.createDataFrame([(1, data), (2, "")], "id int, data string")).orderBy("id").collect()[0].samples == [0.5, -2, 3]


def test_headers_and_trees(spark):
    d = spark.createDataFrame([("HTTP/1.1 200\r\nLocation:  http://x/y \r\nST: z", "a&amp;&lt;b&#39;")], "h string, x string")
    got = d.select(text.header_value("h", "location").alias("a"), text.header_value("h", "none").alias("b"), text.unescaped_xml("x").alias("c"), F.concat_ws("|", text.path_parts(F.lit("C:\\a/b//c"))).alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == ("http://x/y", None, "a&<b'", "C:|a|b|c")
    same = lookups.same_album({"album": F.lit(" Folder"), "album_artist": F.lit(None), "artist": F.lit("x")}, {"album": F.lit("folder"), "album_artist": F.lit(None), "artist": F.lit("x")})
    assert spark.range(1).select(same.alias("s")).first().s is False
