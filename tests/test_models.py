"""What SQL can't say, beside brute force: ordered sets, clusters, the online model and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import text as x
from earshot.operators import described as ds
from earshot.operators import taste as m
from earshot.streaming import listening as st

KEYS = ["8A", "8B", "9A", "3A", "12B", "1B", "", None, "13A"]


def camelot(a, b):
    def read(c):
        c = (c or "").strip()
        return (int(c[:-1]), c[-1]) if c[:-1].isdigit() and c[-1:] in "AB" and 1 <= int(c[:-1]) <= 12 else None

    p, q = read(a), read(b)
    if not p or not q:
        return 12
    d = min((p[0] - q[0]) % 12, (q[0] - p[0]) % 12)
    same = p[1] == q[1]
    return (0 if same else 1) if d == 0 else d + (0 if same else 2)


def test_keys_on_the_wheel(spark):
    pairs = [(a, b) for a in KEYS for b in KEYS]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", x.camelot_distance("a", "b").alias("d")).collect()
    assert [r.d for r in got] == [camelot(r.a, r.b) for r in got]
    assert m._wheel(KEYS).tolist() == [[camelot(a, b) for b in KEYS] for a in KEYS]


def test_energy_set_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, i, float(rnd.randint(80, 170)), rnd.choice(KEYS), rnd.random()) for k in (1, 2) for i in range(9)]
    got = {}
    for r in m.energy_set(spark.createDataFrame(rows, "list int, id int, bpm double, camelot string, energy double"), "peak", True, 10.0).orderBy("list", "place").collect():
        got.setdefault(r.list, []).append(r.id)
    for k in (1, 2):
        left = [r for r in rows if r[0] == k]
        at = min(left, key=lambda r: abs(r[4] - m.energy_target("peak", 0)))
        order = [at]
        left.remove(at)
        for step in range(1, 9):
            def cost(r, p=order[-1], e=m.energy_target("peak", step / 8)):
                jump = abs(r[2] - p[2])
                return 0.45 * camelot(p[3], r[3]) / 12 + 0.3 * (min(jump / 16, 1) + max(0, jump - 10) / 10 * 0.5) + 0.25 * abs(r[4] - e)

            order.append(min(left, key=cost))
            left.remove(order[-1])
        assert got[k] == [r[1] for r in order]


def test_flow_follows_the_nearest_and_long_lists_raise(spark):
    rows = [(0, i, [1.0 if d in (i, i + 1) else 0.0 for d in range(5)], 120.0) for i in range(4)]
    t = spark.createDataFrame(rows, "list int, id int, v array<double>, bpm double")
    assert [r.id for r in m.flow_order(t).orderBy("place").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="3 at most"):
        m.flow_order(t, 3).collect()


def test_endless_set_begins_near_and_ends_with_the_clash(spark):
    rows = [(0, 0, 128.0, "8A"), (0, 1, 174.0, "3B"), (0, 2, 130.0, "10A"), (0, 3, 129.0, "9A")]
    order = [r.id for r in m.endless_set(spark.createDataFrame(rows, "list int, id int, bpm double, camelot string")).orderBy("place").collect()]
    assert order == [0, 3, 2, 1]


def test_clusters_are_those_planted(spark):
    rnd = random.Random(5)
    rows = [(10 * i + c, [float(d == c) + rnd.gauss(0, 0.05) for d in range(6)]) for c in range(4) for i in range(15)]
    t = spark.createDataFrame(rows, "id int, v array<double>")
    found = m.nearest(t, m.spherical_kmeans(t, 4)).collect()
    assert len({(r.id % 10, r.cluster) for r in found}) == 4
    assert m.silhouette(t, m.spherical_kmeans(t, 4)).first().silhouette > 0.8
    assert m.spherical_kmeans(t.limit(0), 3).count() == 0
    assert m.spherical_kmeans(t.limit(1), 3).count() == 1


def _events(spark, n=400):
    rnd = random.Random(9)
    kinds = ["Like", "FullPlay", "SkipEarly", "SkipLate", "Dislike"]
    rows = [(i % 3, i, 3600 * (i % 30), rnd.choice(kinds), rnd.randrange(12), 1.0) for i in range(n)]
    vectors = [(k, [float(d == k % 4) + 0.2 * rnd.random() for d in range(6)]) for k in range(12)]
    return spark.createDataFrame(rows, "user_id long, seq long, ts long, kind string, track long, value double"), spark.createDataFrame(vectors, "id long, v array<double>")


def _stream(spark, events, folder, parts):
    """Events as a stream of several batches, in order."""
    for k in range(parts):
        events.where(F.floor(F.col("seq") * parts / 400) == k).coalesce(1).write.mode("append").parquet(str(folder))
    return st.events_stream(spark, str(folder), 1)


def test_streamed_model_is_that_of_the_batch(spark, tmp_path):
    events, vectors = _events(spark)
    out = st.drain(st.taste_model(_stream(spark, events, tmp_path / "in", 3), vectors), str(tmp_path / "run"), "update")
    assert out.select("batch").distinct().count() > 1
    last = out.join(out.groupBy("user_id").agg(F.max("batch").alias("batch")), ["user_id", "batch"])
    key = lambda df: sorted((r.user_id, r.centroid, r.side, round(r.mass, 6), [round(a, 6) for a in r.v]) for r in df.collect())
    assert key(last) == key(m.online_model(events, vectors))
    assert all(r.n <= m.K for r in last.groupBy("user_id", "side").agg(F.count("*").alias("n")).collect())


def test_streamed_sessions_and_clock(spark, tmp_path):
    events, _ = _events(spark)
    rows = events.orderBy("seq").collect()
    got = st.drain(st.finished_sessions(_stream(spark, events, tmp_path / "in", 4)), str(tmp_path / "run"))
    want, now = [], {}
    for r in rows:
        s = now.get(r.user_id)
        if s and s[1] == r.track:
            s[2], s[3], s[4] = min(s[2], r.ts), max(s[3], r.ts), s[4] + 1
        else:
            want += [tuple(s)] if s else []
            now[r.user_id] = [r.user_id, r.track, r.ts, r.ts, 1]
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(want)
    clock = st.drain(st.hourly_clock(st.events_stream(spark, str(tmp_path / "in"), 1), cap=5), str(tmp_path / "clock"), "update")
    hours: dict = {}
    for r in rows:
        h = hours.setdefault((r.user_id, r.ts // 3600 % 24), {})
        h[r.kind] = h.get(r.kind, 0.0) + 1
        if h[r.kind] >= 5:
            for k in h:
                h[k] /= 2
    last = clock.join(clock.groupBy("user_id", "hour").agg(F.max("batch").alias("batch")), ["user_id", "hour", "batch"]).collect()
    assert {((r.user_id, r.hour), r.kind): r.weight for r in last} == {(h, k): w for h, ks in hours.items() for k, w in ks.items()}


def test_streamed_counters(spark, tmp_path):
    events, _ = _events(spark)
    out = st.drain(st.counters(_stream(spark, events, tmp_path / "in", 2)), str(tmp_path / "run"), "update")
    last = out.join(out.groupBy("track").agg(F.max("batch").alias("batch")), ["track", "batch"]).drop("batch")
    assert sorted(map(tuple, last.select("track", "plays", "skips", "last_played").collect())) == sorted(map(tuple, st.counters(events).select("track", "plays", "skips", "last_played").collect()))


def test_words_expand_by_synonym_stem_and_edit(spark):
    triggers = spark.createDataFrame([(0, 0, "energetic"), (1, 0, "dark"), (2, 0, "chill")], "term int, place int, word string")
    synonyms = spark.createDataFrame([("nocturnal", "dark")], "word string, trigger string")
    texts = spark.createDataFrame([(1, "Nocturnal drive"), (2, "darkness"), (3, "chil"), (4, "the music"), (5, None)], "id int, text string")
    got = {r.id: r.said for r in ds.expanded(texts, triggers, synonyms).collect()}
    assert got == {1: "nocturnal drive dark", 2: "darkness dark", 3: "chil chill", 4: "the music", 5: ""}


def test_tempo_windows(spark):
    t = spark.createDataFrame([(1, "128-120 bpm"), (2, "around 128 bpm"), (3, "fast")], "id int, q string")
    assert [r.w and tuple(r.w) for r in t.select(ds.tempo_window(F.col("q")).alias("w"), "id").orderBy("id").collect()] == [(120, 128), (122, 134), None]


def test_suggestions_leave_out_clashes(spark):
    a = spark.createDataFrame([("Calm", "low"), ("Warm", None)], "word string, mood string")
    s = spark.createDataFrame([("rave", "high"), ("rain", "low"), ("road", None)], "scene string, mood string")
    assert {r.phrase for r in ds.suggestions(a, s).collect()} == {"Rave", "Rain", "Road", "Calm rain", "Calm road", "Warm rave", "Warm rain", "Warm road"}


def test_lists_of_all_lengths_in_order_at_once(spark):
    rnd = random.Random(12)
    rows = [(k, i, float(rnd.randint(0, 190)), rnd.choice(KEYS), rnd.random(), [rnd.gauss(0, 1) for _ in range(3 + k % 2)]) for k in range(300) for i in rnd.sample(range(99), rnd.choice((1, 2, 5, 17)))]
    t = spark.createDataFrame(rows, "list int, id int, bpm double, camelot string, energy double, v array<double>")
    lists: dict = {}
    for row in sorted(rows):
        lists.setdefault(row[0], []).append(row)
    fold = lambda b: float(m._fold(np.array([b]))[0])
    unit = lambda v: np.array(v) / np.linalg.norm(v)

    def flow(p, r, at):
        a, b = fold(p[2]), fold(r[2])
        return 1 - unit(p[5]) @ unit(r[5]) + (min(abs(a - b) / 8, 1.5) if a > 0 and b > 0 else 0)

    def endless(p, r, at):
        return -(0.45 * min(1, max(0, 1 - abs(max(p[2], 1) / max(r[2], 1) - 1) / 0.12)) + 0.35 * min(1, max(0, 1 - camelot(p[3], r[3]) / 4)))

    def energy(p, r, at):
        jump = abs(r[2] - p[2])
        return 0.45 * camelot(p[3], r[3]) / 12 + 0.3 * (min(jump / 16, 1) + max(0, jump - 12) / 12 * 0.5) + 0.25 * abs(r[4] - m.energy_target("peak", at))

    def best(p, r, cost, at, got):
        costs = [cost(p, x, at) for x in r]
        return got in [x[1] for x, c in zip(r, costs, strict=True) if c < min(costs) + 1e-9]

    for of, cost, first in ((m.flow_order, flow, lambda r: r[0][1]), (m.endless_set, endless, lambda r: r[0][1]), (lambda x: m.energy_set(x, "peak", True, 12.0), energy, lambda r: min(r, key=lambda x: x[4])[1])):
        got: dict = {}
        for row in of(t).orderBy("list", "place").collect():
            assert row.place == len(got.setdefault(row.list, []))
            got[row.list].append(row.id)
        assert got.keys() == lists.keys()
        for k, order in got.items():
            own = {r[1]: r for r in lists[k]}
            assert order[0] == first(lists[k]) and sorted(order) == sorted(own)
            for n in range(1, len(order)):
                assert best(own[order[n - 1]], [own[i] for i in order[n:]], cost, n / max(1, len(order) - 1), order[n])
    frame = t.toPandas().sort_values(["list", "id"])
    cut = [frame.iloc[a : a + 7] for a in range(0, len(frame), 7)]
    whole = list(m._whole_lists(iter(cut), 500))
    assert sum(map(len, whole)) == len(frame) and all(set(a["list"]).isdisjoint(b["list"]) for a, b in zip(whole, whole[1:]))


def test_models_together_are_those_of_each_alone():
    rnd = np.random.default_rng(5)
    vectors = np.concatenate((rnd.normal(size=(40, 5)), np.zeros((1, 5))))
    events = [(int(u), int(t), float(w)) for u, t, w in zip(rnd.integers(0, 30, 3_000) ** 2 // 30, rnd.integers(0, 41, 3_000), rnd.choice([1.5, 0.8, -0.5, -1.0], 3_000), strict=True)]
    want = {}
    for u, t, w in events:
        want.setdefault(u, m.Model()).add(vectors[t], w)
    for few in (0, m.FEW, 1_000):
        got = m.Models(30, 5)
        m.FEW, before = few, m.FEW
        try:
            for part in (events[:700], events[700:]):  # and what was learnt stays
                u, t, w = (np.array(x) for x in zip(*part, strict=True))
                got.learn(u, vectors, t, w)
        finally:
            m.FEW = before
        rows = got.frame(list(range(30)))
        for u, model in want.items():
            mine = rows[rows["user_id"] == u]
            assert [(s, round(mass, 9)) for s, _, mass in model.rows()] == [(s, round(mass, 9)) for s, mass in zip(mine["side"], mine["mass"], strict=True)]
            assert np.allclose(np.stack(mine["v"].to_numpy()), [v for _, v, _ in model.rows()]) and mine["centroid"].tolist() == list(range(len(mine)))
        assert len(rows) == sum(len(x.rows()) for x in want.values())


def test_a_clock_of_many_pieces_goes_by_seq(spark, tmp_path):
    r = random.Random(3)
    events = [(r.choice([1, 2, None]), k, r.choice([0, 3600, None]), r.choice(["Like", "FullPlay", "SkipMid"])) for k in range(900)]
    r.shuffle(events)
    schema = "user_id long, seq long, ts long, kind string"
    spark.createDataFrame(events, schema).repartition(6).write.parquet(str(tmp_path / "in"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 20)
    try:
        got = st.drain(st.hourly_clock(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cap=5), str(tmp_path / "clock"), "update").collect()
    finally:
        spark.conf.set(key, before)
    hours: dict = {}
    for user, _, ts, kind in sorted(events, key=lambda e: e[1]):
        h = hours.setdefault((user, None if ts is None else ts // 3600), {})
        h[kind] = h.get(kind, 0.0) + 1
        if h[kind] >= 5:
            for k in h:
                h[k] /= 2
    assert {(g.user_id, g.hour, g.kind): g.weight for g in got} == {(*k, kind): w for k, h in hours.items() for kind, w in h.items()}
