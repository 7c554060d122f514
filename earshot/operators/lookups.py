"""Small joins and rules by which a library is shown, enriched and looked after: views, sentinels, presets, caches, registries and browse lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import is_missing

# Names of cover files by priority and their suffixes, and lengths of browse lists.
COVER_NAMES = ["cover", "folder", "front", "album", "albumart", "albumartsmall", "thumb", "artwork"]
COVER_SUFFIXES = ["jpg", "jpeg", "png", "webp"]
BROWSE = {"recent": 100, "loved": 200, "playlist": 300}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shown(tracks: DataFrame) -> DataFrame:
    """Tracks as they are shown: blank artists fall to the album's, and what is unknown has a stand-in."""
    own = lambda c: F.nullif(c, F.lit(""))
    name = F.regexp_replace(F.element_at(F.split("path", r"[\\/]"), -1), r"\.[^.]+$", "")
    return tracks.withColumns({
        "title": F.coalesce(own("title"), name), "artist": F.coalesce(own("artist"), own("album_artist"), F.lit("Unknown artist")), "album": F.coalesce(own("album"), F.lit("Unknown album"))})


def resolved(ranked: DataFrame, tracks: DataFrame, key: str = "seq") -> DataFrame:
    """Ranked keys (key, rank) with what the library knows of them, in their order; those it lacks are left out."""
    return ranked.join(tracks, key).orderBy("rank", key)


def same_album(a: dict, b: dict) -> Column:
    """Whether two tracks, each a dict of columns album, album_artist, artist, are of one album whose name means something."""
    fold = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    who = lambda t: fold(F.coalesce(F.nullif(t["album_artist"], F.lit("")), t["artist"]))
    album = fold(a["album"])
    return ~album.isin("", "folder", "unknown album") & (album == fold(b["album"])) & (who(a) == who(b))


def gapless(queue: DataFrame) -> DataFrame:
    """Entries of queues (id, pos, album, album_artist, artist) with joined: whether the one before is of the same album."""
    by = Window.partitionBy("id").orderBy("pos")
    before = {c: F.lag(c).over(by) for c in ("album", "album_artist", "artist")}
    return queue.withColumn("joined", F.coalesce(same_album({c: F.col(c) for c in before}, before), F.lit(False)))


def rating_events(ratings: DataFrame) -> DataFrame:
    """What changed ratings (track, seq, rating) say: Like for 4 and more, Dislike for 1 and 2, nothing for others or for no change. The first is a change from 0."""
    was = F.coalesce(F.lag("rating").over(Window.partitionBy("track").orderBy("seq")), F.lit(0))
    kind = F.when(F.col("rating") >= 4, "Like").when(F.col("rating").between(1, 2), "Dislike")
    return ratings.withColumns({"kind": kind, "_was": was}).where("rating <> _was and kind is not null").drop("_was")


def abandoned(played, length, ended) -> Column:
    """Whether a track was left early: not to its end, longer than half a minute, and before a fifth of it."""
    return ~_c(ended) & (_c(length) > 30) & (_c(played) / F.greatest(_c(length), F.lit(1e-9)) < 0.2)


def needs_enrichment(album, artist) -> Column:
    return (F.coalesce(_c(album), F.lit("")) == "Folder") | (F.coalesce(_c(artist), F.lit("")) == "Unknown artist")


def enriched(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """Tracks with what a reader found (path, title, artist, album_artist, album, genre, year as text, duration in seconds): blanks keep what is there, an artist falls to the album's, and the stand-in for an album is cleared."""
    clean = lambda c: F.nullif(F.trim(f"f.{c}"), F.lit(""))
    t, f = tracks.alias("t"), found.alias("f")
    year = F.regexp_extract(F.coalesce("f.year", F.lit("")), r"^\s*(-?\d+)", 1).try_cast("long")
    new = {
        "title": F.coalesce(clean("title"), "t.title"), "artist": F.coalesce(clean("artist"), clean("album_artist"), "t.artist"), "album_artist": F.coalesce(clean("album_artist"), "t.album_artist"),
        "album": F.coalesce(clean("album"), F.when((F.col("t.album") == "Folder") & F.col("f.path").isNotNull(), "Unknown album").otherwise(F.col("t.album"))), "genre": F.coalesce(clean("genre"), "t.genre"),
        "year": F.coalesce(F.when(year != 0, year), F.col("t.year").cast("long")), "duration": F.coalesce(F.when(F.col("f.duration") > 0, F.col("f.duration")), "t.duration")}
    return t.join(f, F.col("t.path") == F.col("f.path"), "left").select(*[new[c].alias(c) if c in new else F.col(f"t.{c}") for c in tracks.columns])


def cache_hits(asked: DataFrame, cache: DataFrame, least_version: int = 5) -> DataFrame:
    """asked (path, mtime) with hit: whether the cache (path, mtime, version) holds it as it is now, by a version that still counts."""
    c = cache.where(F.col("version") >= least_version).select("path", F.col("mtime").alias("_at"))
    return asked.join(c, "path", "left").withColumn("hit", F.coalesce(F.col("_at") == F.col("mtime"), F.lit(False))).drop("_at")


def cached_for(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: how many of the asked paths the cache holds, and how many are skipped."""
    t = asked.join(cache.select("path", F.lit(1).alias("_hit")).distinct(), "path", "left")
    return t.agg(F.count("_hit").alias("found"), F.count_if(F.col("_hit").isNull()).alias("skipped"))


def merged_cache(indexed: DataFrame, cached: DataFrame, key: str = "path") -> DataFrame:
    """Indexed rows, each as the cache has it where the cache has it enriched, which is with an artist."""
    c = cached.where(~is_missing("artist"))
    fields = [x for x in indexed.columns if x != key]
    t = indexed.alias("i").join(c.alias("c"), F.col(f"i.{key}") == F.col(f"c.{key}"), "left")
    return t.select(F.col(f"i.{key}").alias(key), *[F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"i.{x}")).alias(x) for x in fields])


def song_curves(tracks: DataFrame, pins: DataFrame, auto: DataFrame, base: str, on_play: bool = True) -> DataFrame:
    """seq, curve, source: the curve pinned to a track, else its automatic one where those are allowed, else the base."""
    t = tracks.select("seq").join(pins.select("seq", F.col("curve").alias("p")), "seq", "left").join(auto.select("seq", F.col("curve").alias("a")), "seq", "left")
    a = F.col("a") if on_play else F.lit(None).cast("string")
    return t.select("seq", F.coalesce("p", a, F.lit(base)).alias("curve"), F.when(F.col("p").isNotNull(), "pin").when(a.isNotNull(), "auto").otherwise("base").alias("source"))


def device_curves(mapping: DataFrame, devices: DataFrame, own: DataFrame, built_in: DataFrame) -> DataFrame:
    """address, device, preset, curve: what each device's preset (address, preset) means; the user's own presets come before those built in, and one that neither knows is left out."""
    t = mapping.where("preset <> ''").join(devices.select("address", "name"), "address", "left").join(own.select("preset", F.col("curve").alias("o")), "preset", "left").join(built_in.select("preset", F.col("curve").alias("b")), "preset", "left")
    return t.select("address", F.coalesce(F.nullif("name", F.lit("")), "address").alias("device"), "preset", F.coalesce("o", "b").alias("curve")).where("curve is not null")


def remembered_devices(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Devices (address, name) with those seen (address, name, seq), one an address: the last name that isn't blank, or the one known."""
    last = seen.groupBy("address").agg(F.max_by(F.nullif("name", F.lit("")), F.when(F.col("name") != "", F.col("seq"))).alias("new"))
    return known.join(last, "address", "full").select("address", F.coalesce("new", "name", F.lit("")).alias("name"))


def upserted(base: DataFrame, new: DataFrame, key: str = "name", by: str | None = None) -> DataFrame:
    """base with the rows of new by key, the last by a column of new where it repeats a key. Only new is grouped; base is passed over once."""
    if by:
        last = new.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in base.columns]), by).alias("r")).select("r.*")
    else:
        last = new.dropDuplicates([key]).select(*base.columns)
    return base.join(last.select(key), key, "left_anti").select(*base.columns).union(last)


def first_sidecar(tracks: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """path and content of the first file beside a track, of the same stem, whose content isn't blank; suffixes in order of priority. files: file, content."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./\\]+$", "")
    rank = F.array_position(F.array(*[F.lit(x) for x in suffixes]), F.lower(F.regexp_extract("file", r"\.([^./\\]+)$", 1)))
    f = files.withColumns({"stem": stem(F.col("file")), "rank": rank}).where("rank > 0 and trim(content) <> ''").groupBy("stem").agg(F.min_by("content", "rank").alias("content"))
    return tracks.select("path", stem(F.col("path")).alias("stem")).join(f, "stem", "left").select("path", "content")


def folder_covers(images: DataFrame) -> DataFrame:
    """folder, cover: of the images (file) in a folder the one with the best known name, else the first by name."""
    file = F.element_at(F.split("file", "/"), -1)
    stem, suffix = F.regexp_replace(file, r"\.[^.]+$", ""), F.regexp_extract(file, r"\.([^.]+)$", 1)
    names = F.array(*[F.lit(x) for x in COVER_NAMES])
    known = F.when((stem == F.lower(stem)) | (stem == F.upper(stem)), F.array_position(names, F.lower(stem))).otherwise(0)
    types = F.array_position(F.array(*[F.lit(x) for x in COVER_SUFFIXES]), F.lower(suffix))
    t = images.withColumns({"known": known, "type": types, "folder": F.regexp_replace("file", r"/[^/]*$", "")}).where("type > 0")
    rank = F.struct(F.when(F.col("known") > 0, F.col("known")).otherwise(99).alias("a"), F.when(F.col("known") > 0, F.col("type")).otherwise(0).alias("b"), F.col("file"))
    return t.groupBy("folder").agg(F.min(rank)["file"].alias("cover"))


def folder_list(tracks: DataFrame, *keys: str) -> DataFrame:
    """The folders that tracks lie in and how many each holds itself."""
    return tracks.groupBy(*keys, F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def covering(checked: DataFrame, totals: DataFrame) -> DataFrame:
    """Of checked folders (folder) those without a checked folder above them, with their totals (folder, n)."""
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    long = checked.select("folder", F.split("folder", "/").alias("parts")).where("size(parts) > 1").select("folder", F.explode(above).alias("a"))
    covered = long.join(checked.select(F.col("folder").alias("a")), "a").select("folder").distinct()
    return checked.join(covered, "folder", "left_anti").join(totals, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"))


def collapsed(folders: DataFrame) -> DataFrame:
    """folder, name, own, total of the folders a tree shows: one with a single folder in it and no tracks of its own is shown as one with that. folders: folder, n (tracks of its own).

    Every folder lies on the way to some track. A folder is merged down if all tracks below it are below one child; names join what was merged.
    """
    parts = F.split("folder", "/")
    long = folders.withColumn("parts", parts).select("n", "parts", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("depth", "at"))
    node = long.groupBy("at").agg(F.sum("n").alias("total"), F.sum(F.when(F.size("parts") == F.col("depth") + 1, F.col("n")).otherwise(0)).alias("own"), F.count_distinct(F.get("parts", F.col("depth") + 1)).alias("children"))
    kept = node.where("own > 0 or children <> 1").withColumn("parts", F.split("at", "/"))
    ways = kept.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("up"))
    parent = ways.join(kept.select(F.col("at").alias("up")), "up").groupBy("at").agg(F.max_by("up", F.length("up")).alias("up"))
    t = kept.join(parent, "at", "left")
    return t.select(F.col("at").alias("folder"), F.when(F.col("up").isNull(), F.col("at")).otherwise(F.substring(F.col("at"), F.length("up") + 2, F.length("at"))).alias("name"), "own", "total")


def translated(keys: DataFrame, catalog: DataFrame, lang: str, fallback: str = "en") -> DataFrame:
    """keys (key, vars: map of names to values) with text: the catalog's (lang, key, text) in a language, else in the fallback, else the key, with {name} filled in."""
    of = lambda l, n: catalog.where(F.col("lang") == l).select("key", F.col("text").alias(n))  # noqa: E731, E741
    t = keys.join(of(lang, "_a"), "key", "left").join(of(fallback, "_b"), "key", "left")
    text = F.coalesce("_a", "_b", "key")
    filled = F.aggregate(F.coalesce(F.map_entries("vars"), F.array().cast("array<struct<key:string,value:string>>")), text, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return t.withColumn("text", filled).drop("_a", "_b")


def browse_lists(rated: DataFrame, playlists: DataFrame) -> DataFrame:
    """list, pos, seq: what a browser shows: recently played, loved, and each playlist (id, pos, seq), none longer than BROWSE."""
    cut = lambda df, name, by, n: df.orderBy(*by).limit(n).select(F.lit(name).alias("list"), (F.row_number().over(Window.orderBy(*by)) - 1).alias("pos"), "seq")
    recent = cut(rated.where("last_played > 0"), "recent", (F.desc("last_played"), F.col("seq")), BROWSE["recent"])
    loved = cut(rated.where("rating >= 4"), "loved", (F.col("seq"),), BROWSE["loved"])
    own = playlists.join(rated.select("seq"), "seq").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("rn") <= BROWSE["playlist"]).withColumn("rn", F.col("rn") - 1)
    return recent.union(loved).union(own.select(F.concat(F.lit("pl:"), F.col("id").cast("string")), "rn", "seq"))


def year_review(rated: DataFrame) -> DataFrame:
    """kind, pos, name, plays: the most played songs (18) and artists (3); nothing if fewer than 8 tracks were played."""
    played = rated.where("plays > 0")
    enough = played.agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    who = F.coalesce(F.nullif("album_artist", F.lit("")), F.nullif("artist", F.lit("")))
    songs = played.orderBy(F.desc("plays"), "seq").limit(18).select(F.lit("song").alias("kind"), (F.row_number().over(Window.orderBy(F.desc("plays"), "seq")) - 1).alias("pos"), F.col("title").alias("name"), "plays")
    artists = played.where(who.isNotNull()).groupBy(who.alias("name")).agg(F.sum("plays").alias("plays")).orderBy(F.desc("plays"), "name").limit(3)
    artists = artists.select(F.lit("artist").alias("kind"), (F.row_number().over(Window.orderBy(F.desc("plays"), "name")) - 1).alias("pos"), "name", "plays")
    return songs.union(artists).join(F.broadcast(enough), F.lit(True)).drop("n")


def recent_history(rated: DataFrame, n: int = 8) -> DataFrame:
    return rated.where("plays > 0 and last_played > 0").orderBy(F.desc("last_played"), "seq").limit(n).select("seq", "last_played")


def scroll_label(sort: str) -> Column:
    """What a fast scroll shows of a track under a sort: its letter, year, minutes, stars, plays or month; a dash where there is no year, no stars or no time after 1970."""
    letter = lambda c: F.when(F.upper(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 1)).rlike("^[A-Z]$"), F.upper(F.substring(F.trim(c), 1, 1))).otherwise("#")
    plays, at = F.coalesce("plays", F.lit(0)), F.coalesce("mtime", F.lit(0.0))
    rules = {
        "artist": lambda: letter(F.col("artist")), "album": lambda: letter(F.col("album")), "year": lambda: F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise("—"),
        "duration": lambda: F.concat(F.floor(F.coalesce("duration", F.lit(0.0)) / 60).cast("string"), F.lit("m")), "rating": lambda: F.when(F.coalesce("rating", F.lit(0)) > 0, F.repeat(F.lit("★"), F.col("rating").cast("int"))).otherwise("—"),
        "plays": lambda: F.when(plays >= 100, "100+").when(plays >= 10, "10+").otherwise(plays.cast("string")), "recent": lambda: F.when(at > 0, F.date_format(F.timestamp_seconds(F.when(at > 1e12, at / 1000).otherwise(at)), "MMM yy")).otherwise("—")}
    return rules.get(sort, lambda: letter(F.col("title")))()
