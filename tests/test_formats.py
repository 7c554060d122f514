from pyspark.sql import functions as F

from earshot.functions import text as x
from earshot.sources import formats as fm


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_m3u(spark):
    t = files(spark, "#EXTM3U\r\n#EXTINF:12,Ann - One - Two\r\n# note\r\n/a/b.mp3\r\n\r\n/c.mp3\r\n#EXTINF:-1, Solo \n/d.mp3", "", None)
    assert [tuple(r)[2:] for r in fm.m3u_entries(t).orderBy("id", "pos").collect()] == [("/a/b.mp3", "One - Two", "Ann"), ("/c.mp3", None, None), ("/d.mp3", "Solo", None)]


def test_streams_and_pls(spark):
    t = files(spark, "#EXTINF:-1,Radio\nlocal.mp3\nhttp://x\nHTTPS://y")
    assert [tuple(r)[2:] for r in fm.m3u_streams(t).orderBy("pos").collect()] == [("http://x", "Radio"), ("HTTPS://y", None)]
    p = files(spark, "[playlist]\nFile1=http://a\ntitle1= A \nFile2=ftp://b\nFile3=http://c\nFile3=http://d")
    assert sorted(tuple(r)[1:] for r in fm.pls_entries(p).collect()) == [(1, "http://a", "A"), (3, "http://d", None)]


def test_lyrics_and_the_line_at_hand(spark):
    t = fm.lyric_lines(files(spark, "[00:01.50][01:00]hey\nplain\n[00:03:5] ho "))
    assert sorted((r.t, r.text) for r in t.collect()) == [(-1.0, "plain"), (1.5, "hey"), (3.5, "ho"), (60.0, "hey")]
    at = spark.createDataFrame([(0, 0.0), (0, 1.46), (0, 3.6), (1, 5.0)], "id int, at double")
    assert {(r.id, r.at): r.text for r in fm.active_lines(t, at).collect()} == {(0, 0.0): None, (0, 1.46): "hey", (0, 3.6): "ho", (1, 5.0): None}


def test_equalizer_and_names(spark):
    t = files(spark, "Preamp: -6.5 dB\nFilter 1: ON PK Fc 105 Hz Gain -2.5 dB Q 0.70\nFilter 2: OFF PK Fc 1 Hz Gain 1 dB Q 1\nFilter 3: ON lsc Fc 20 Hz Gain 3 dB Q 1.1")
    assert [tuple(r)[2:] for r in fm.equalizer_filters(t).orderBy("pos").collect()] == [(-6.5, "PK", 105.0, -2.5, 0.7), (-6.5, "LSC", 20.0, 3.0, 1.1)]
    n = spark.createDataFrame([("HD 600 ParametricEQ.txt",), ("ParametricEQ.txt",)], "n string")
    assert [r[0] for r in n.select(fm.headphone_name(F.col("n"))).collect()] == ["HD 600", "AutoEq"]


def test_folders_and_feeds(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name in ("Ann - One.mp3", "x.TXT", "Solo.FLAC"):
        (tmp_path / "m" / name).write_bytes(b"abc")
    got = fm.named_by_file(fm.library_files(spark, str(tmp_path / "m")).withColumn("path", F.url_decode("path")))
    assert sorted((r.title, r.artist, r.size) for r in got.collect()) == [("One", "Ann", 3), ("Solo", None, 3)]
    (tmp_path / "f.xml").write_text('<rss><channel><item><title>E1</title><enclosure url="http://a.mp3"/><itunes:duration>1:02:03</itunes:duration><description>&lt;b&gt;hi&lt;/b&gt;</description></item><item><title>no sound</title></item></channel></rss>')
    assert [tuple(r) for r in fm.feed_episodes(spark, str(tmp_path / "f.xml")).collect()] == [("E1", "http://a.mp3", 3723.0, "hi")]


def test_byte_ranges_and_labels(spark):
    cases = {("bytes=2-5", 10): (2, 5), ("bytes=5-", 10): (5, 9), ("bytes=-3", 10): (7, 9), ("bytes=8-100", 10): (8, 9), ("bytes=20-25", 10): None, ("bytes=5-2", 10): None, ("rows=1-2", 10): None, ("bytes=-", 10): None, ("bytes=0-1", 0): None}
    t = spark.createDataFrame(list(cases), "h string, n long")
    assert {(r.h, r.n): r.r and tuple(r.r) for r in t.select("h", "n", x.byte_range("h", "n").alias("r")).collect()} == cases
    v = spark.createDataFrame([("0.2.0", "0.1.9", 1), ("0.2.0-beta", "0.2", 0), ("1", "1.0.1", -1)], "a string, b string, c int")
    assert all(r[0] == r[1] for r in v.select(F.when(x.version_parts("a") > x.version_parts("b"), 1).when(x.version_parts("a") < x.version_parts("b"), -1).otherwise(0), "c").collect())
    s = spark.createDataFrame([("a10",), ("a9",), ("A2b3",)], "n string")
    assert [r.n for r in s.orderBy(x.natural_key("n")).collect()] == ["A2b3", "a9", "a10"]
    c = spark.createDataFrame([(3725.9, "1:02:05"), (59.0, "0:59"), (-4.0, "0:00"), (None, "0:00")], "s double, t string")
    assert all(r[0] == r[1] for r in c.select(x.clock("s"), "t").collect())


def test_playlists_are_read_without_sorting_their_lines(spark):
    text = "#EXTM3U\n#EXTINF:1,A - one\n\n# note\n  /a.mp3 \n/b.mp3\r\n#EXTINF:2,B - lost\n#EXTINF:3,C - - two\n#EXTVLC\n/c.mp3\n#EXTINF:4,end"
    t = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "#only\n"), (5, "\n".join(f"#EXTINF:1,t{k}\nhttp://h/{k}" for k in range(3_000)))], "id int, text string")
    got = fm.numbered_entries(t)
    assert [tuple(r) for r in got.where("id = 1").orderBy("pos").collect()] == [(1, 4, 1, "/a.mp3", "one", "A"), (1, 5, 2, "/b.mp3", None, None), (1, 9, 3, "/c.mp3", "- two", "C")]
    assert got.where("id in (2, 3, 4)").count() == 0
    assert [(r.n, r.title) for r in got.where("id = 5").orderBy("n").collect()] == [(k + 1, f"t{k}") for k in range(3_000)]
    streams = fm.m3u_streams(t)
    assert [(r.url, r.title) for r in streams.where("id = 5").orderBy("pos").collect()] == [(f"http://h/{k}", f"t{k}") for k in range(3_000)]
    for df in (fm.m3u_entries(t), streams):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan and "Exchange" not in plan


def test_hand_overs_sort_ids_alone(spark):
    from earshot.plans import models

    plan = models.QUERIES["hand_overs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "embedding" not in window[: window.index("Exchange")]
