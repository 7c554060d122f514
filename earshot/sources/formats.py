"""Playlists, lyrics, feeds, equalizer files and folders of media as tables, and playlists and caches back as text.

Parsers take a DataFrame with a key column id and a column text, one row a file, and give one row an entry. Files that hold nothing give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.text import is_audio, seconds_of, stem, strip_tags

URL = r"(?i)^https?://"
STAMP = r"\[(\d{1,2}):(\d{2})(?:[.:](\d{1,3}))?\]"


def lines(files: DataFrame) -> DataFrame:
    """id, pos (from 0), line: trimmed, blank ones left out."""
    out = files.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    return out.withColumn("line", F.btrim("line", F.lit(" \t"))).where("line <> ''")


def _carried(files: DataFrame, entry, info) -> DataFrame:
    """id, pos, n (from 1), line, info: entry lines, each with the last info that came since the entry before it. entry() and info() take a line; info is null where a line says nothing.

    A file is one row, so its lines stay in it: what lies between two entries is a slice, and all slices together are as long as the file.
    """
    bind = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))
    cut = F.transform(F.split("text", r"\r?\n"), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(" \t")).alias("line")))
    rows = files.select("id", F.filter(cut, lambda x: x["line"] != "").alias("rows"))

    def entries(rows):
        at = F.filter(F.transform(rows, lambda x, i: F.when(entry(x["line"]), i)), lambda i: i.isNotNull())
        return bind(at, lambda at: F.transform(at, lambda i, k: bind(F.when(k > 0, F.get(at, k - 1) + 1).otherwise(0), lambda begin: F.struct(
            F.get(rows, i)["pos"].alias("pos"), (k + 1).alias("n"), F.get(rows, i)["line"].alias("line"), said(rows, begin, i).alias("info")))))

    def said(rows, begin, i):
        all_ = F.filter(F.transform(F.slice(rows, begin + 1, i - begin + 1), lambda x: info(x["line"])), lambda x: x.isNotNull())
        return F.try_element_at(all_, F.lit(-1))

    return rows.select("id", F.inline(bind(F.col("rows"), entries)))


def m3u_entries(files: DataFrame) -> DataFrame:
    """id, pos, path, title, artist; names come from the note before a path and are null without one."""
    return numbered_entries(files).drop("n")


def numbered_entries(files: DataFrame) -> DataFrame:
    """m3u_entries() with each entry's number in its file, from 1."""
    noted = lambda line: F.when(line.rlike(r"^#EXTINF:-?\d+\s*,"), F.struct(F.regexp_extract(line, r"^#EXTINF:-?\d+\s*,\s*(.*)$", 1).alias("label")))
    out, dash = _carried(files, lambda line: ~F.startswith(line, F.lit("#")), noted), F.instr("info.label", " - ")
    return out.select("id", "pos", "n", F.col("line").alias("path"), F.when(dash > 1, F.trim(F.substr("info.label", dash + 3))).otherwise(F.trim("info.label")).alias("title"), F.when(dash > 1, F.trim(F.substr("info.label", F.lit(1), dash - 1))).alias("artist"))


def m3u_streams(files: DataFrame) -> DataFrame:
    """id, pos, url, title of the network addresses in playlists."""
    title = lambda line: F.nullif(F.trim(F.regexp_extract(line, r"#EXTINF:[^,]*,(.*)", 1)), F.lit(""))
    out = _carried(files, lambda line: line.rlike(URL), lambda line: F.when(F.startswith(line, F.lit("#EXTINF")), F.struct(title(line).alias("title"))))
    return out.select("id", "pos", F.col("line").alias("url"), F.col("info.title").alias("title"))


def pls_entries(files: DataFrame) -> DataFrame:
    """id, n, url, title: file and title lines of one number go together, the last of each holds."""
    part = lambda k: F.regexp_extract("line", r"(?i)^(File|Title)(\d+)=(.*)$", k)
    rows = lines(files).select("id", "pos", F.lower(part(1)).alias("what"), part(2).alias("n"), F.trim(part(3)).alias("value")).where("what <> ''")
    last = lambda what: F.max(F.when(F.col("what") == what, F.struct("pos", "value")))["value"]
    return rows.groupBy("id", "n").agg(last("file").alias("url"), last("title").alias("title")).where(F.col("url").rlike(URL)).select("id", F.col("n").cast("long").alias("n"), "url", "title")


def input_kind(url):
    """pls, m3u, direct, or null for what is no address."""
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    return F.when(u.rlike(URL), F.when(u.rlike(r"(?i)\.pls(\?|$)"), "pls").when(u.rlike(r"(?i)\.m3u8?(\?|$)"), "m3u").otherwise("direct"))


def lyric_lines(files: DataFrame) -> DataFrame:
    """id, pos, t, text: one row a time stamp, t in seconds; a line without stamps once, with t -1."""
    rows = lines(files).withColumns({"text": F.trim(F.regexp_replace("line", STAMP, "")), **{k: F.regexp_extract_all("line", F.lit(STAMP), F.lit(i)) for i, k in ((1, "m"), (2, "s"), (3, "f"))}})
    at = lambda i: F.get("m", i).cast("double") * 60 + F.get("s", i).cast("double") + F.coalesce(F.concat(F.lit("0."), F.get("f", i)).try_cast("double"), F.lit(0.0))
    times = F.transform(F.sequence(F.lit(0), F.size("m") - 1), at)
    stamped = rows.where("size(m) > 0").select("id", "pos", F.explode(times).alias("t"), "text")
    return stamped.union(rows.where("size(m) = 0").select("id", "pos", F.lit(-1.0).alias("t"), "text"))


def active_lines(lyrics: DataFrame, positions: DataFrame, slack: float = 0.05) -> DataFrame:
    """id, at, text: for each position (id, at) the line that is being sung, null before the first. An as-of join by one sort a song."""
    a = lyrics.where("t >= 0").select("id", F.col("t").alias("k"), F.lit(None).cast("double").alias("at"), F.struct("pos", "text").alias("x"), F.lit(0).alias("side"))
    b = positions.select("id", (F.col("at") + slack).alias("k"), F.col("at").cast("double").alias("at"), F.lit(None).cast(a.schema["x"].dataType).alias("x"), F.lit(1).alias("side"))
    order = Window.partitionBy("id").orderBy("k", "side", F.col("x.pos"))
    return a.union(b).withColumn("x", F.last("x", ignorenulls=True).over(order)).where("side = 1").select("id", "at", F.col("x.text").alias("text"))


def equalizer_filters(files: DataFrame) -> DataFrame:
    """id, pos, preamp, kind, fc, gain, q of the filters that are on; preamp is 0 where no line states it, and the last stated otherwise."""
    rule = r"(?i)^Filter\s+\d+:\s*ON\s+(\w+)\s+Fc\s+([\d.]+)\s*Hz\s+Gain\s+(-?[\d.]+)\s*dB\s+Q\s+([\d.]+)"
    pre = F.regexp_extract("line", r"(?i)^Preamp:\s*(-?\d+(?:\.\d+)?)\s*dB", 1).try_cast("double")
    rows = lines(files).withColumn("pre", pre)
    rows = rows.withColumn("preamp", F.coalesce(F.max(F.when(F.col("pre").isNotNull(), F.struct("pos", "pre"))).over(Window.partitionBy("id"))["pre"], F.lit(0.0)))
    number = lambda k: F.regexp_extract("line", rule, k).try_cast("double")
    return rows.where(F.col("line").rlike(rule)).select("id", "pos", "preamp", F.upper(F.regexp_extract("line", rule, 1)).alias("kind"), number(2).alias("fc"), number(3).alias("gain"), number(4).alias("q"))


def headphone_name(name):
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"(?i)\s*Parametric ?EQ\s*$", ""), r"(?i)\s*GraphicEQ\s*$", "")
    return F.coalesce(F.nullif(F.trim(n), F.lit("")), F.lit("AutoEq"))


def library_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime, size of the media files below a folder. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"))
    return f.where(is_audio("path"))


def named_by_file(files: DataFrame) -> DataFrame:
    """Adds title and artist from file names like Artist - Title; without the dash the artist is null."""
    s = stem("path")
    parts = F.split(s, " - ", 2)
    return files.withColumns({"title": F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(1)))).otherwise(s), "artist": F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(0))))})


def feed_episodes(spark: SparkSession, path: str) -> DataFrame:
    """title, url, seconds, about of the items of podcast feeds; items without sound are left out."""
    schema = "title string, `itunes:duration` string, description string, pubDate string, enclosure struct<_url: string, _type: string>"
    items = spark.read.format("xml").schema(schema).option("rowTag", "item").load(path)
    return items.where("enclosure._url <> ''").select("title", F.col("enclosure._url").alias("url"), seconds_of("`itunes:duration`").alias("seconds"), strip_tags("description").alias("about"))


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines cache; lines that are broken are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def to_m3u(entries: DataFrame) -> DataFrame:
    """id, text: an extended playlist of each id's entries (id, pos, path, title, artist, duration)."""
    item = F.concat_ws("\n", F.concat(F.lit("#EXTINF:"), F.when(F.col("duration") > 0, F.round("duration")).otherwise(-1).cast("long").cast("string"), F.lit(","), F.coalesce("artist", F.lit("")), F.lit(" - "), F.coalesce("title", F.lit(""))), F.col("path"))
    listed = entries.select("id", F.struct("pos", item.alias("item")).alias("x")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("id", F.concat(F.lit("#EXTM3U\n"), F.array_join("x.item", "\n"), F.lit("\n")).alias("text"))


def matched(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Playlist entries with the library's names, or names of their own where the library lacks the path."""
    t = tracks.select("path", F.col("title").alias("t"), F.col("artist").alias("a"), F.lit(True).alias("known"))
    out = entries.join(t, "path", "left")
    own = F.coalesce(F.nullif("title", F.lit("")), stem("path")), F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown artist"))
    return out.select("id", "pos", "path", F.when(F.col("known"), F.col("t")).otherwise(own[0]).alias("title"), F.when(F.col("known"), F.col("a")).otherwise(own[1]).alias("artist"), F.coalesce("known", F.lit(False)).alias("known"))
