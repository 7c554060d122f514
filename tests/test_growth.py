"""What grows and is kept up: scans, replaced tables, browse lists, fingerprints, clusters and tours, beside what is made anew."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import clusters as cl
from earshot.operators import moments as mo
from earshot.operators import taste
from earshot.operators import tours as tr
from earshot.sources import stores
from earshot.streaming import browse as br
from earshot.streaming import scans as sc

SCAN = "generation long, path string, mtime double, title string"


def library_of(scans):
    """The library after generations {path: (mtime, title)}, and what each one no longer found."""
    held, gone = {}, []
    for g, files in enumerate(scans, 1):
        gone += [(p, g) for p in held if p not in files]
        held = {p: (held[p] if p in held and held[p][0] is not None and held[p][0] == f[0] else f) for p, f in files.items()}
    return held, gone


def test_scans_build_a_library(spark, tmp_path):
    r = np.random.default_rng(2)
    paths = [f"/m/{i}.mp3" for i in range(40)]
    scans = [{p: (None if r.random() < 0.1 else float(r.integers(3)), f"{p} {g}") for p in paths if r.random() < 0.7} for g in (1, 2, 3)]
    folder, number = f"{tmp_path}/library", 0
    for g, files in enumerate(scans, 1):
        rows = [(g, p, m, t) for p, (m, t) in files.items()]
        batches = [rows[:10], rows[10:20] + rows[5:8], rows[20:], [(g, None, None, None)]]
        if g == 2:  # the end comes with the last files
            batches = [rows[:15], rows[15:] + [(g, None, None, None)]]
        for b in batches:
            batch = spark.createDataFrame(b, SCAN)
            sc.merge_batch(batch, number, folder)
            sc.merge_batch(batch, number, folder)  # run again
            number += 1
        held, gone = library_of(scans[:g])
        assert {x.path: (x.mtime, x.title) for x in sc.library(spark, folder).collect()} == held
        assert sorted((x.path, x.generation) for x in sc.removed(spark, folder).collect()) == sorted(gone)
    sc.merge_batch(spark.createDataFrame([(1, "/old", 1.0, "x")], SCAN), 2, folder)  # a batch from long ago
    assert {x.path for x in sc.library(spark, folder).collect()} == set(library_of(scans)[0])
    assert not [f for f in os.listdir(folder) if f.startswith("delta-") and int(f[6:]) < 5]  # what bases were made from is gone


def test_a_batch_that_failed_half_way_leaves_the_library_as_it_was(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/library"
    batch = lambda rows: spark.createDataFrame(rows, SCAN)
    sc.merge_batch(batch([(1, "a", 1.0, "t"), (1, "b", 1.0, "t"), (1, None, None, None)]), 0, folder)
    before = sorted(map(tuple, sc.library(spark, folder).collect()))
    with monkeypatch.context() as m:
        m.setattr(sc, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        for k, rows in ((1, [(2, "a", 2.0, "new")]), (1, [(2, None, None, None)])):
            with pytest.raises(OSError):
                sc.merge_batch(batch(rows), k, folder)
    assert sorted(map(tuple, sc.library(spark, folder).collect())) == before
    sc.merge_batch(batch([(2, "a", 2.0, "new")]), 1, folder)
    sc.merge_batch(batch([(2, None, None, None)]), 2, folder)
    assert [tuple(x) for x in sc.library(spark, folder).collect()] == [("a", 2.0, "new", 2)]
    assert sc.library(spark, f"{tmp_path}/none") is None


def test_a_replaced_table_is_never_missing(spark, tmp_path, monkeypatch):
    folder, rows = f"{tmp_path}/t", spark.range(5)
    stores.replace_table(rows, folder)
    for step in ("write", "commit"):
        with monkeypatch.context() as m:
            if step == "commit":
                m.setattr(stores, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            bad = rows.select(F.raise_error(F.lit("no")).alias("id")) if step == "write" else spark.range(9)
            with pytest.raises(Exception):  # noqa: B017
                stores.replace_table(bad, folder)
        assert stores.read_table(spark, folder).count() == 5
    held = stores.read_table(spark, folder)
    stores.replace_table(spark.range(2), folder)
    assert held.count() == 5  # who reads the version before is not cut off
    stores.replace_table(spark.range(3), folder)
    assert stores.read_table(spark, folder).count() == 3
    assert len(stores.committed(spark, folder)) == 2


def lists_anew(stats, playlists, library):
    recent = sorted((-p, s) for s, (p, _) in stats.items() if p > 0 and s in library)
    out = {"recent": [s for _, s in recent][: br.BROWSE["recent"]], "loved": sorted(s for s, (_, r) in stats.items() if r >= 4 and s in library)[: br.BROWSE["loved"]]}
    for (i, pos), s in sorted(playlists.items()):
        if s in library:
            out.setdefault(f"pl:{i}", []).append(s)
    return {k: v[: br.BROWSE["playlist"]] if k.startswith("pl:") else v for k, v in out.items() if v}


def test_browse_lists_are_kept_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(br, "BROWSE", {"recent": 6, "loved": 5, "playlist": 4})
    monkeypatch.setattr(br, "RESERVE", 3)
    r = np.random.default_rng(5)
    library = set(range(60))
    stats = {s: (int(r.integers(0, 50)), int(r.integers(0, 6))) for s in library}
    playlists = {(i, p): int(r.integers(60)) for i in range(3) for p in range(int(r.integers(2, 15)))}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)

    def whole():
        e = br.entries_of_stats(table([(s, *stats[s]) for s in sorted(library)], "seq long, last_played long, rating long"))
        return e.unionByName(br.entries_of_playlists(table([(i, p, s) for (i, p), s in playlists.items() if s in library], "id long, pos long, seq long")))

    kept = br.BrowseLists(spark, f"{tmp_path}/b", whole)
    kept.begin()
    for batch in range(5):
        changed = [(int(s), int(r.integers(0, 60)), int(r.integers(0, 6)), 1) for s in r.choice(sorted(library), 6, replace=False)]
        moves = [(int(i), int(r.integers(0, 15)), None if r.random() < 0.5 else int(r.choice(sorted(library))), 1) for i in r.integers(0, 4, 5)]
        moves = list({m[:2]: m for m in moves}.values())
        lost = [int(x) for x in r.choice(sorted(library), 3 if batch % 2 else 9, replace=False)]
        library -= set(lost)
        stats |= {s: (p, q) for s, p, q, _ in changed}
        for i, p, s, _ in moves:
            playlists.pop((i, p), None)
            if s is not None and s in library:
                playlists[i, p] = s
        playlists = {k: s for k, s in playlists.items() if s in library}
        parts = (table(changed, "seq long, last_played long, rating long, version int"), table(moves, "id long, pos long, seq long, version int"), table([(s,) for s in lost], "seq long"))
        kept.merge(batch, *parts)
        if batch == 3:
            kept.merge(batch, *parts)
        got = {}
        for x in kept.shown().orderBy("list", "pos").collect():
            got.setdefault(x.list, []).append(x.seq)
        assert got == lists_anew(stats, playlists, library), batch
    assert kept.refilled  # some list had lost more than its reserve


def test_a_batch_reads_its_changes_alone(spark, tmp_path):
    def whole():
        if whole.used:
            raise AssertionError("the tables were read")
        whole.used = True
        return br.entries_of_stats(spark.range(500).selectExpr("id seq", "id last_played", "id % 6 rating"))

    whole.used = False
    kept = br.BrowseLists(spark, f"{tmp_path}/b", whole)
    kept.begin()
    for k in range(3):
        kept.merge(k, spark.createDataFrame([(k, 900 + k, 1, 0)], "seq long, last_played long, rating long, version int"), spark.createDataFrame([], "id long, pos long, seq long, version int"), spark.createDataFrame([(499 - k,)], "seq long"))
    assert [x.seq for x in kept.shown().where("list = 'recent'").orderBy("pos").limit(5).collect()] == [2, 1, 0, 496, 495]


def test_a_batch_meets_the_lists_by_one_join(spark, tmp_path):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    physical = lambda df: df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    kept = br.BrowseLists(spark, f"{tmp_path}/b", lambda: br.entries_of_playlists(spark.range(3000).selectExpr("id % 7 id", "id pos", "id seq")))
    kept.begin()
    assert kept.held().count() == 7  # one row a list
    assert "Exchange" not in physical(kept.shown()) and "Window" not in plan(kept.shown())
    batch = br.grouped(kept.held(), br.entries_of_playlists(spark.createDataFrame([(1, 1, None), (9, 4, 5)], "id long, pos long, seq long")), None)
    once = br.merged(kept.held(), br.stored(batch, "batch"))
    assert plan(once).count("Join") == 1 and "Aggregate" not in plan(once) and "Window" not in plan(once)
    assert {r.list: (len(r.held), r.more) for r in once.collect()} == {f"pl:{i}": (339 if i == 1 else 340, True) for i in range(7)} | {"pl:9": (1, False)}


def test_moments_merge_as_if_read_at_once(spark):
    r = np.random.default_rng(1)
    v = r.normal(3, 2, (90, 5))
    v[:, 4] = 7
    raw = spark.createDataFrame([(i, x.tolist(), 100.0) for i, x in enumerate(v)], "id long, v array<double>, bpm double")
    cuts = [raw.where("id < 1"), raw.where("id >= 1 and id < 37"), raw.where("id >= 37")]
    for order in ([0, 1, 2], [2, 0, 1]):
        state = {x.dim: x for x in mo.merged(*[mo.state_of(cuts[k]) for k in order]).collect()}
        assert all(state[d].n == 90 and state[d].mean == pytest.approx(v[:, d].mean()) and state[d].m2 == pytest.approx(((v[:, d] - v[:, d].mean()) ** 2).sum(), abs=1e-9) for d in range(5))
    z = (v - v.mean(axis=0)) / np.where(v.std(axis=0, ddof=1) > 1e-9, v.std(axis=0, ddof=1), np.inf)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    got = {x.id: x.v for x in mo.fingerprints_by(raw, mo.state_of(raw)).collect()}
    assert all(np.allclose(got[i], z[i]) for i in range(90))


def test_only_due_fingerprints_are_made_anew(spark):
    raw = spark.range(130).selectExpr("id", "array(double(id), double(id * id % 7)) v", "100.0D bpm")
    none = spark.createDataFrame([], "id long, v array<double>, bpm double, made_by long")
    state, prints, anew = None, none, []
    for n in (100, 105, 110, 111, 130):
        had = raw.where(F.col("id") < n)
        new = mo.state_of(had.where(F.col("id") >= (anew[-1][0] if anew else 0)))
        state = new if state is None else mo.merged(state, new)
        out = mo.refreshed(prints, had, state)
        anew.append((n, out.where("anew").count()))
        prints = spark.createDataFrame(out.drop("anew").collect(), none.schema)
        assert prints.count() == n
    # 100 made by 100; 105 and 110 only add; 111 is more than a tenth above 100: those made by 100 go anew; at 130 all made by up to 118.
    assert anew == [(100, 100), (105, 5), (110, 5), (111, 101), (130, 130)]


def test_clusters_of_all_numbers_in_few_passes(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = np.eye(10)[:9]
    x = np.array([centres[i % 9] + r.normal(size=10) * 0.08 for i in range(360)])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rounds = []
    real = cl._round
    monkeypatch.setattr(cl, "_round", lambda *a: rounds.append(1) or real(*a))
    found = cl.clusterings(vectors, range(6, 13))
    assert len(rounds) <= cl.ROUNDS + 1  # whatever the numbers of clusters
    best = max(sorted(found.items()), key=lambda k: k[1][1])
    assert best[0] == 9
    unit = cl.unit(x)
    for c, apart in found.values():
        d = np.sort(1 - unit @ c.T, axis=1)
        assert apart == pytest.approx(((d[:, 1] - d[:, 0]) / d[:, 1]).mean(), abs=1e-6)
        own = (unit @ c.T).argmax(axis=1)
        new = cl.unit(np.stack([x[own == k].sum(axis=0) for k in range(len(c))]))
        assert np.abs(new - c).max() < 0.2
    own = (unit @ best[1][0].T).argmax(axis=1)
    assert all((own[i] == own[j]) == (i % 9 == j % 9) for i in range(40) for j in range(40))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(best[1][0])], "cluster int, c array<double>")
    assert taste.silhouette(vectors, table).first().silhouette == pytest.approx(best[1][1], abs=1e-6)


def test_clusters_of_few_and_equal_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id long, v array<double>")
    assert cl.auto_clusters(same).count() == 1
    assert cl.auto_clusters(same.limit(1)).count() == 0 and cl.auto_clusters(same.where("false")).count() == 0
    assert cl.auto_clusters(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")).count() == 2


def tour_table(spark, n, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 6))
    rows = [(k, i, (centres[i % 12] + r.normal(size=6) * 0.3).tolist(), float(70 + i * 13 % 100)) for k in ("a", "b") for i in range(n if k == "a" else 30)]
    return spark.createDataFrame(rows, "list string, id long, v array<double>, bpm double")


def test_tours_within_the_bound_are_the_greedy_ones(spark):
    t = tour_table(spark, 80)
    assert sorted(map(tuple, tr.flow_tour(t).collect())) == sorted(map(tuple, taste.flow_order(t).collect()))
    start = spark.createDataFrame([("b", 17), ("a", 999)], "list string, id long")
    first = {x.list: x.id for x in tr.flow_tour(t, start).where("place = 0").collect()}
    assert first == {"a": 0, "b": 17}


def test_long_tours_in_cells(spark):
    t = tour_table(spark, 600)
    got = tr.flow_tour(t, longest=60)
    places = {k: sorted(x.place for x in got.collect() if x.list == k) for k in ("a", "b")}
    assert places == {"a": list(range(600)), "b": list(range(30))}
    assert got.select("list", "id").distinct().count() == 630 and got.where("place = 0 and list = 'a'").first().id == 0
    assert max(x.n for x in tr.cells(t, 60).groupBy("list", "cell").agg(F.count("id").alias("n")).collect()) <= 60
    cost = lambda o: {x.list: x.cost for x in tr.tour_cost(t, o).collect()}
    cells, greedy = cost(got), cost(taste.flow_order(t, 600))
    by_id = cost(t.selectExpr("list", "id", "id place"))
    assert cells["b"] == pytest.approx(greedy["b"])
    assert greedy["a"] < cells["a"] < 1.6 * greedy["a"] and cells["a"] < 0.5 * by_id["a"]


def test_cells_of_tracks_that_lie_alike(spark):
    t = spark.createDataFrame([(1, i, [1.0, 0.0], 0.0) for i in range(100)], "list long, id long, v array<double>, bpm double")
    assert max(x["count"] for x in tr.cells(t, 10).groupBy("list", "cell").count().collect()) <= 10
    assert sorted(x.place for x in tr.flow_tour(t, longest=10).collect()) == list(range(100))
    assert tr.flow_tour(t.where("false")).collect() == []


def test_ordered_mixes(spark):
    t = tour_table(spark, 40).where("list = 'a'").drop("list")
    chosen = t.select("id", (F.col("id") % 10).cast("double").alias("score")).where("id < 20")
    flow = [x.id for x in tr.ordered_mix(t, chosen, "flow", 5).orderBy("pos").collect()]
    assert flow[0] == 5 and sorted(flow) == list(range(20))
    assert [x.id for x in tr.ordered_mix(t, chosen, "flow").orderBy("pos").collect()][0] == 9  # the best
    assert [x.id for x in tr.ordered_mix(t, chosen, "score").orderBy("pos").collect()][:3] == [9, 19, 8]
    assert sorted(x.pos for x in tr.ordered_mix(t, chosen, "shuffle").collect()) == list(range(20))
    seeds = spark.createDataFrame([(0, 3), (1, 8)], "cluster int, id long")
    mix = [x.id for x in tr.supermix(t, seeds, 12).orderBy("pos").collect()]
    assert mix[0] == 3 and len(set(mix)) == 12 and 8 in mix


def test_first_rows_are_cut_before_they_meet(spark):
    from earshot.operators import mixes
    from earshot.streaming import listening

    t = tour_table(spark, 40).where("list = 'a'").drop("list")
    centres = spark.createDataFrame([(0, [1.0] * 6), (1, [-1.0] * 6)], "cluster int, c array<double>")
    events = spark.createDataFrame([(1, 1, "Like", 5)], "user_id long, seq long, kind string, track long").withColumn("ts", F.lit(0))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (mixes.ranked_by(t, centres, "cluster", 5), mixes.representatives(t.withColumn("cluster", (F.col("id") % 2).cast("int")), centres, 3), mixes.genre_mixes(t, centres, t.selectExpr("id", "0.5D score"), events, 10, 4), listening.event_log(events, 3), br.shown(spark.createDataFrame([("recent", 1, 1.0, 1)], "list string, entry long, k double, seq long"))):
        assert "WindowGroupLimit" in plan(df)


def test_seeds_beyond_the_bound_are_an_error(spark, monkeypatch):
    from earshot.operators import mixes, vectors

    monkeypatch.setattr(vectors, "MOST_CENTROIDS", 3)
    t = tour_table(spark, 10).where("list = 'a'").drop("list")
    many = t.selectExpr("id cluster", "v c")
    with pytest.raises(Exception, match="too many centroids"):
        mixes.ranked_by(t, many, "cluster", 2).collect()
