"""The feed: blended scores, lanes sampled by a seed, and shelves grouped from the library. Input rows are tracks with their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import fnv1a, hour_distance
from earshot.operators.recommend import DAY, affinity, artist_of, beside_total, engagement, rank_diverse

# How much each signal weighs in a blend, and what each mood's genres contain.
WEIGHTS = {"artist": 0.45, "genre": 0.30, "engagement": 0.15, "discovery": 0.20, "skips": 0.30, "repeat": 0.50, "context": 0.08, "jitter": 0.06}
EXPLORE = {"familiar": 0.35, "balanced": 1.0, "discover": 2.0}
MOODS = {
    "chill": ["ambient", "chill", "lo-fi", "lofi", "downtempo", "acoustic", "jazz", "soul", "r&b", "rnb", "blues", "folk", "soundtrack", "piano", "classical", "instrumental"],
    "energy": ["edm", "dance", "house", "techno", "trance", "dubstep", "drum", "electro", "metal", "punk", "rock", "hardcore", "rave", "big room", "hard"],
    "focus": ["instrumental", "ambient", "classical", "piano", "study", "post-rock", "soundtrack", "score", "lo-fi", "lofi"],
    "party": ["pop", "dance", "hip hop", "hip-hop", "rap", "house", "funk", "disco", "reggaeton", "afrobeat", "latin"],
}


def jitter(c: str) -> Column:
    """In [0, 1), the same at every run."""
    return F.pmod(fnv1a(c), F.lit(1000)) / 1000.0


def blend_scores(rated: DataFrame, now: int, explore: float = 1.0) -> DataFrame:
    """Adds who, base, a and g (affinities, 0 if none) and score. Affinities are one row an artist or genre; the join strategy is left to their size."""
    w = WEIGHTS
    t = beside_total(rated.withColumns({"who": artist_of(), "base": engagement()}), F.greatest(F.lit(0.0), F.max("base")).alias("top"))
    t = t.join(affinity(rated, "artist", now).select(F.col("artist").alias("who"), F.col("affinity").alias("a")), "who", "left")
    t = t.join(affinity(rated, "genre", now).select("genre", F.col("affinity").alias("g")), "genre", "left").fillna(0.0, ["a", "g"])
    own = F.when(F.col("top") > 0, F.greatest(F.lit(0.0), F.col("base")) / F.col("top")).otherwise(0.0)
    heard = F.col("last_played") > 0
    apart = hour_distance(F.hour(F.timestamp_seconds("last_played")), F.lit(now // 3600 % 24))
    return t.withColumn("score", (
        w["artist"] * F.col("a") + w["genre"] * F.col("g") + w["engagement"] * own
        + F.when((F.col("plays") == 0) & (F.col("a") > 0.15), w["discovery"] * explore).otherwise(0.0)
        - F.when((F.col("skips") >= 2) & (F.col("rating") < 4), w["skips"]).otherwise(0.0)
        - F.when(heard & (now - F.col("last_played") < 2 * DAY), w["repeat"] * max(1.0, explore)).otherwise(0.0)
        + F.when(heard & (apart <= 3), w["context"] * (1 - apart / 3.0)).otherwise(0.0)
        + w["jitter"] * jitter("path"))).drop("top")


def smart_blend(rated: DataFrame, now: int, n: int = 50, explore: str = "balanced") -> DataFrame:
    """The n best blends, no more than 3 of an artist; none before anything was listened to."""
    scored = blend_scores(rated, now, EXPLORE[explore])
    known = affinity(rated, "artist", now).agg(F.count(F.lit(1)).alias("known"))
    return rank_diverse(scored.where("score > 0.08").join(F.broadcast(known), F.lit(True)).where("known > 0"), n, 3, "who")


def hidden_gems(rated: DataFrame, now: int, n: int = 40) -> DataFrame:
    """Hardly played, never skipped, and rated high or of a loved artist; in library order."""
    loved = affinity(rated, "artist", now).where("affinity > 0.4").select(F.col("artist").alias("who"), F.lit(True).alias("loved"))
    t = rated.where("plays <= 1 and skips = 0").withColumn("who", artist_of()).join(loved, "who", "left")
    return t.where("rating >= 4 or loved").orderBy("seq").limit(n)


def because_played(rated: DataFrame, now: int, n: int = 30) -> DataFrame:
    """Tracks of the strongest artist and of that artist's main genre, blended, with the seed; none if they are fewer than 4."""
    seed = affinity(rated, "artist", now).orderBy(F.desc("affinity"), "artist").limit(1).select(F.col("artist").alias("seed"))
    lane = rated.withColumn("who", artist_of()).join(F.broadcast(seed), F.col("who") == F.col("seed")).where("genre <> ''")
    genre = lane.groupBy("genre").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at")).orderBy(F.desc("n"), "at").limit(1).select(F.col("genre").alias("seed_genre"))
    t = blend_scores(rated, now).join(F.broadcast(seed), F.lit(True)).join(F.broadcast(genre), F.lit(True), "left")
    t = t.where("who = seed or genre = seed_genre").withColumn("score", F.col("score") + F.when(F.col("who") == F.col("seed"), 0.15).otherwise(0.0))
    return at_least(rank_diverse(t, n, 6, "who"), 4)


def at_least(df: DataFrame, n: int) -> DataFrame:
    """df, or nothing if it has fewer than n rows."""
    return beside_total(df, F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= n).drop("_rows")


def sample(tracks: DataFrame, n: int, seed: int) -> DataFrame:
    """n tracks in an order that the seed shuffles, artists in turn, none more than a sixth of n (2 at least). Adds turn and key, by which it reads."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), "path"))
    who = F.lower(F.coalesce(F.nullif(artist_of(), F.lit("")), F.lit("?")))
    t = tracks.withColumns({"_who": who, "_key": key}).withColumn("turn", F.row_number().over(Window.partitionBy("_who").orderBy("_key", "seq"))).where(F.col("turn") <= max(2, -(-n // 6)))
    t = t.withColumn("key", F.min("_key").over(Window.partitionBy("_who")))
    return t.drop("_who", "_key").orderBy("turn", "key").limit(n)


def discover_weekly(rated: DataFrame, week: int) -> DataFrame:
    """Owned, unplayed and not rated low; a new set each week."""
    return sample(at_least(rated.where("plays = 0 and rating not in (1, 2)"), 6), 30, week)


def release_radar(rated: DataFrame, now: int) -> DataFrame:
    """Added within 45 days by artists that were played, or by any if those are fewer than 4."""
    who = F.lower(F.trim(artist_of()))
    played = rated.where("plays > 0").select(who.alias("who")).where("who <> ''").distinct().withColumn("yours", F.lit(1))
    recent = rated.where((F.col("mtime") > 0) & (now - F.col("mtime") <= 45 * DAY)).withColumn("who", who).join(played, "who", "left")
    pool = beside_total(recent, F.count("yours").alias("n")).where("yours = 1 or n < 4").drop("who", "yours", "n")
    return sample(at_least(pool, 4), 18, 555)


def throwback(rated: DataFrame, now: int) -> DataFrame:
    """Added about a year ago."""
    return sample(at_least(rated.where((F.col("mtime") > 0) & (now - F.col("mtime")).between(330 * DAY, 400 * DAY)), 4), 18, 9001)


def rediscover(rated: DataFrame, now: int) -> DataFrame:
    """Loved, and not heard for 120 days."""
    return sample(at_least(rated.where((F.col("rating") >= 4) & ((F.col("last_played") == 0) | (now - F.col("last_played") > 120 * DAY))), 4), 18, 4242)


def mood_lane(rated: DataFrame, mood: str) -> DataFrame:
    """Tracks whose genre contains a word of the mood."""
    hit = F.lit(False)
    for k in MOODS[mood]:
        hit = hit | F.contains(F.lower("genre"), F.lit(k))
    return at_least(sample(rated.where(hit), 18, len(mood) * 97 + 13), 4)


def genre_groups(tracks: DataFrame, least: int = 5, most: int = 12) -> DataFrame:
    """The largest genres: genre, n."""
    g = tracks.where(F.trim("genre") != "").groupBy(F.trim("genre").alias("genre")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).orderBy(F.desc("n"), "genre").limit(most)


def decade_groups(tracks: DataFrame, least: int = 8) -> DataFrame:
    g = tracks.where("year <> 0").groupBy((F.floor(F.col("year") / 10) * 10).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).orderBy(F.desc("decade"))


def artist_groups(rated: DataFrame, most: int = 12) -> DataFrame:
    """The most played artists: artist, n, plays."""
    g = rated.groupBy(artist_of().alias("artist")).agg(F.count(F.lit(1)).alias("n"), F.sum("plays").alias("plays"))
    return g.where("plays > 0 and artist <> ''").orderBy(F.desc("plays"), "artist").limit(most)


def album_groups(rated: DataFrame, least: int = 4, most: int = 20) -> DataFrame:
    """Whole albums by plays, then by when their first track came: artist, album, n, plays, cover."""
    first = F.struct("seq", "mtime", "path")
    g = rated.where("album <> ''").groupBy(artist_of().alias("artist"), "album").agg(F.count(F.lit(1)).alias("n"), F.sum("plays").alias("plays"), F.min(first).alias("f"))
    top = g.where(F.col("n") >= least).orderBy(F.desc("plays"), F.desc(F.coalesce("f.mtime", F.lit(0.0))), "artist", "album").limit(most)
    return top.select("artist", "album", "n", "plays", F.col("f.path").alias("cover"))


def year_in_review(rated: DataFrame) -> DataFrame:
    """One row: minutes, played; none if fewer than 8 tracks were played."""
    return rated.where("plays > 0").agg(F.round(F.sum(F.coalesce("duration", F.lit(0.0)) * F.col("plays")) / 60).cast("long").alias("minutes"), F.count(F.lit(1)).alias("played")).where("played >= 8")


def deep_cuts(rated: DataFrame) -> DataFrame:
    """Unplayed tracks of played artists."""
    t = rated.withColumn("who", artist_of())
    return t.where("plays = 0").join(t.where("plays > 0 and who <> ''").select("who"), "who", "left_semi")


def _top(rated: DataFrame, name: str) -> DataFrame:
    """A named list with its positions from 0. Each is cut to its length before it is numbered."""
    rules = {"liked": ("rating >= 4", F.col("seq"), 60), "played": ("plays > 0", F.desc("plays"), 60), "added": ("true", F.desc(F.coalesce("mtime", F.lit(0.0))), 60), "recent": ("last_played > 0", F.desc("last_played"), 40)}
    where, by, n = rules[name]
    cut = rated.where(where).orderBy(by, "seq").limit(n)
    return cut.withColumn("pos", F.row_number().over(Window.orderBy(by, "seq")) - 1)


def quick_picks(rated: DataFrame, n: int = 27) -> DataFrame:
    """Liked, then most played, then newest, each once: seq and place in that chain."""
    chain = [_top(rated, k).select("seq", (F.lit(100 * i) + F.col("pos")).alias("place")) for i, k in enumerate(("liked", "played", "added"))]
    return chain[0].union(chain[1]).union(chain[2]).groupBy("seq").agg(F.min("place").alias("place")).orderBy("place").limit(n)


def fresh_familiar(rated: DataFrame, n: int = 40, rounds: int = 24) -> DataFrame:
    """New and loved tracks by turns, each once."""
    loved = _top(rated, "liked").select("seq", F.col("pos").alias("p")).union(_top(rated, "played").select("seq", (F.col("pos") + 100).alias("p")))
    loved = loved.withColumn("pos", F.row_number().over(Window.orderBy("p")) - 1)
    both = _top(rated, "added").where(F.col("pos") < rounds).select("seq", (2 * F.col("pos")).alias("place")).union(loved.where(F.col("pos") < rounds).select("seq", (2 * F.col("pos") + 1).alias("place")))
    return both.groupBy("seq").agg(F.min("place").alias("place")).orderBy("place").limit(n)
