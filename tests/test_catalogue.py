from earshot.operators import catalogue as c
from earshot.operators import recommend as r
from earshot.operators import vectors as v

SCHEMA = "path string, title string, artist string, album string, album_artist string, genre string, year int, track_no int, disc_no int, duration double, mtime double, folder string, seq long"


def rows(spark, *items):
    return spark.createDataFrame([(p, t, a, al, a, "Rock", y, 1, 1, 180.0, 0.0, "/music", i) for i, (p, t, a, al, y) in enumerate(items)], SCHEMA)


def test_page_sorts_without_case_and_cuts(spark):
    t = rows(spark, ("/k/3.ogg", "quay", "Norn", "Ports", 1971), ("/k/1.ogg", "Pier", "Mull", "Shores", 1984), ("/k/2.ogg", "REEF", "Lewis", "Ports", None), ("/k/4.ogg", "pier", "Skye", "Shores", 1962))
    assert [x.path for x in c.page(t).collect()] == ["/k/1.ogg", "/k/4.ogg", "/k/3.ogg", "/k/2.ogg"]
    assert [x.title for x in c.page(t, offset=2, limit=1).collect()] == ["quay"]
    assert [x.year for x in c.page(t, sort="year").collect()] == [None, 1962, 1971, 1984]
    assert c.page(t, limit=-3).count() == 0 and c.page(t, offset=-5, limit=9).count() == 4


def test_filters(spark):
    t = rows(spark, ("/k/1.ogg", "Harbour lights", "Mull", "Ports", 1979), ("/k/2.ogg", "Lighthouse", "Mull", "Shores", 1980), ("/k/3.ogg", "Fog", "Norn", "Light", 1989))
    n = lambda **k: c.count(t, c.TrackFilter(**k)).first().n
    assert [n(search=" LIGHT "), n(search="l_ght"), n(search="  "), n(search="mull p")] == [3, 3, 3, 1]
    assert [n(decade=1970), n(decade=1980), n(artist="Mull"), n(artist="mull"), n(album="Ports"), n(album="ports"), n(genre="Rock"), n(genre="rock"), n(folder="/music")] == [1, 2, 2, 0, 1, 0, 3, 0, 3]


def test_upsert_and_scan(spark):
    t = rows(spark, ("/k/1.ogg", "Quay", "Mull", "Ports", 1971), ("/k/2.ogg", "Pier", "Mull", "Ports", 1972))
    new = rows(spark, ("/k/2.ogg", "first", "Mull", "Ports", 1), ("/k/2.ogg", "last", "Mull", "Ports", 1), ("/k/9.ogg", "added", "Norn", "Fog", 1))
    assert sorted((x.path, x.title) for x in c.upsert(t, new).collect()) == [("/k/1.ogg", "Quay"), ("/k/2.ogg", "last"), ("/k/9.ogg", "added")]
    known = spark.createDataFrame([("/k/same", 4.5), ("/k/unread", None), ("/k/gone", 7.0)], "path string, mtime double")
    found = spark.createDataFrame([("/k/same", 4.5), ("/k/unread", 6.0), ("/k/fresh", 8.0), ("/k/fresh", 8.0)], "path string, mtime double")
    assert dict(map(tuple, c.scan_diff(known, found).collect())) == {"/k/same": "unchanged", "/k/unread": "changed", "/k/gone": "removed", "/k/fresh": "changed"}


def test_recent_rule(spark):
    t = rows(spark, ("/k/1.ogg", "Quay", "Mull", "Ports", 1971))
    assert [r.smart_playlist(t, [("recent", "within", d)], "all", 10 * r.DAY).count() for d in (0, 3, 11)] == [1, 0, 1]


def test_folders(spark):
    t = rows(spark, ("/m/x/a.mp3", "A", "A", "X", 1), ("/m/b.mp3", "B", "A", "X", 1))
    assert dict(map(tuple, c.folder_totals(t).collect())) == {"/m": 2, "/m/x": 1}


def test_rules_without_conditions_match_nothing(spark):
    t = rows(spark, ("/a.mp3", "A", "A", "X", 1))
    assert r.smart_playlist(t, [], "all", 0).count() == 0
    assert r.smart_playlist(t, [("title", "contains", " ")], "all", 0).count() == 1


def test_diverse_ranking(spark):
    t = spark.createDataFrame([(i, "ab"[i > 2], float(10 - i)) for i in range(6)], "seq long, artist string, score double")
    assert [x.seq for x in r.rank_diverse(t, 3, 2).collect()] == [0, 1, 3]


def test_cosine_and_tempo(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], 35.0), (2, [2.0, 0.0], 360.0), (3, [0.0, 0.0], 0.0)], "id long, v array<float>, bpm double")
    assert [tuple(x) for x in v.similar(t, 1, 5).collect()] == [(2, 1.0), (3, 0.0)]
    assert [x[0] for x in t.orderBy("id").select(v.fold_bpm("bpm")).collect()] == [70.0, 90.0, 0.0]
    assert v.described(t, {}, 5).count() == 0


def test_scroll_labels_of_times_before_1970_beside_sql(spark, tmp_path):
    from earshot.plans import registry
    from scripts.compare import TABLES, compare

    for t in TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        df = df.unionByName(df.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)) if t == "part" else df
        if t in ("part", "lineitem"):
            df.write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert compare(spark, str(tmp_path), "scroll_labels", registry.QUERIES["scroll_labels"], registry.ORACLE["scroll_labels"]) == ""
