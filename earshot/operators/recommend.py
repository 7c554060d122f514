"""Behavioural recommendation: listening statistics, affinity, blended scores, capped ranking and shelves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
# The weight of each kind of listening event.
EVENT_WEIGHTS = {"SkipEarly": -1.0, "SkipMid": -0.5, "SkipLate": 0.0, "FullPlay": 0.5, "Replay": 1.0, "AddedManually": 0.8, "Like": 1.5, "Dislike": -1.5, "SeekReplaySection": 0.6}


def with_stats(tracks: DataFrame, stats: DataFrame, key: str = "seq") -> DataFrame:
    """Tracks with their counters, 0 where nothing was counted."""
    return tracks.join(stats, key, "left").fillna(0, ["plays", "last_played", "skips", "rating"])


def recency(now: int, half_life_days: float = 30.0) -> Column:
    """Halves every half_life_days since last_played; 0 if never played."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_played")) / DAY)
    return F.when(F.col("last_played") > 0, F.pow(F.lit(0.5), age / half_life_days)).otherwise(0.0)


def listening_stats(tracks: DataFrame, stats: DataFrame) -> DataFrame:
    """Plays and favourites of all counters; seconds and played tracks of those in the library only."""
    total = stats.agg(F.coalesce(F.sum("plays"), F.lit(0)).alias("total_plays"), F.count_if(F.col("rating") >= 4).alias("favs"))
    inner = tracks.join(stats, "seq").agg(F.coalesce(F.sum(F.col("duration") * F.col("plays")), F.lit(0.0)).alias("listen_sec"), F.count_if(F.col("plays") > 0).alias("played"))
    return total.join(inner, F.lit(True))


def plays_by(tracks: DataFrame, stats: DataFrame, *keys: str) -> DataFrame:
    return tracks.join(stats, "seq").where("plays > 0").groupBy(*keys).agg(F.sum("plays").alias("plays"))


def artist_of() -> Column:
    """The artist a track counts for: that of the album, else its own, else ''. Blank is missing."""
    return F.coalesce(F.nullif("album_artist", F.lit("")), F.nullif("artist", F.lit("")), F.lit(""))


def engagement() -> Column:
    """Plays and rating of a track, less half a point a skip."""
    stars = F.when(F.col("rating") >= 4, 3.0).when(F.col("rating").between(1, 2), -2.0).otherwise(0.0)
    return F.col("plays") + stars - 0.5 * F.col("skips")


def beside_total(df: DataFrame, *totals: Column) -> DataFrame:
    """Every row with totals over all rows. They are one row, so it is broadcast; no window pulls the rows together."""
    return df.join(F.broadcast(df.agg(*totals)), F.lit(True))


def affinity(rated: DataFrame, by: str, now: int) -> DataFrame:
    """by (artist or genre), affinity in (0, 1]: what positive contributions of the group's tracks add up to, over the largest group's. Recent listening weighs more."""
    key = F.nullif(artist_of() if by == "artist" else F.col(by), F.lit(""))
    part = engagement() * (0.3 + 0.7 * recency(now))
    sums = rated.select(key.alias("k"), part.alias("c")).where("c > 0 and k is not null").groupBy("k").agg(F.sum("c").alias("s"))
    return beside_total(sums, F.max("s").alias("top")).select(F.col("k").alias(by), (F.col("s") / F.col("top")).alias("affinity"))


def rank_diverse(scored: DataFrame, n: int, per: int, group: str = "artist") -> DataFrame:
    """The n best, no more than per of a group; ties by seq."""
    own = Window.partitionBy(group).orderBy(F.desc("score"), "seq")
    return scored.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= per).drop("_rn").orderBy(F.desc("score"), "seq").limit(n)


def diversify(tracks: DataFrame, most: int, group: str = "artist") -> DataFrame:
    """Round robin over groups in order of their first track, no more than most of each: adds turn and group_rank, by which the result reads."""
    own = Window.partitionBy(group).orderBy("seq")
    return tracks.withColumn("turn", F.row_number().over(own)).withColumn("group_rank", F.min("seq").over(Window.partitionBy(group))).where(F.col("turn") <= most)


def event_scores(listens: DataFrame, now: int, half_life_days: float = 90.0) -> DataFrame:
    """Per track: events, and their weights decayed with age, added up."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_WEIGHTS.items() for x in kv]), F.col("kind"))
    decay = F.pow(F.lit(0.5), (F.lit(now) - F.col("ts")) / DAY / half_life_days)
    return listens.where("track is not null").groupBy("track").agg(F.count(F.lit(1)).alias("events"), F.sum(weight * decay).alias("score"))


def hourly_clock(listens: DataFrame) -> DataFrame:
    """hour (UTC), kind, n."""
    return listens.groupBy(F.hour(F.timestamp_seconds("ts")).cast("long").alias("hour"), "kind").agg(F.count(F.lit(1)).alias("n"))


def hour_preferences(clock: DataFrame, hour: int) -> DataFrame:
    """kind, pref: counts of the hour, half of those beside it, over the largest."""
    near = F.least(F.pmod(F.col("hour") - hour, F.lit(24)), F.pmod(F.lit(hour) - F.col("hour"), F.lit(24)))
    w = clock.where(near <= 1).groupBy("kind").agg(F.sum(F.when(near == 0, F.col("n")).otherwise(F.col("n") * 0.5)).alias("w"))
    return beside_total(w, F.max("w").alias("top")).select("kind", (F.col("w") / F.col("top")).alias("pref"))


def shelf(rated: DataFrame, name: str, now: int) -> DataFrame:
    """Tracks of a named shelf."""
    rules = {
        "liked": F.col("rating") >= 4, "forgotten": ((F.col("rating") >= 4) | (F.col("plays") >= 3)) & (F.col("last_played") < now - 14 * DAY) & (F.col("plays") > 0),
        "quick": F.col("duration") <= 150, "long": F.col("duration") >= 480, "new": F.col("mtime") > now - 7 * DAY, "gems": (F.col("plays") <= 1) & (F.col("skips") == 0) & (F.col("rating") >= 4)}
    return rated.where(rules[name])


def smart_playlist(rated: DataFrame, rules: list[tuple[str, str, object]], match: str, now: int) -> DataFrame:
    """Tracks by rules (field, op, value); ops contains, is, within (at least); match all or any. No rules: no tracks. A blank text matches all."""
    def one(field, op, value):
        if field == "recent":
            return F.lit(True) if float(value) <= 0 else F.col("mtime") >= now - float(value) * DAY
        if op == "within":
            return F.coalesce(F.col(field), F.lit(0)) >= float(value)
        needle, text = str(value).strip().lower(), F.lower(F.coalesce(F.col(field).cast("string"), F.lit("")))
        return F.lit(True) if not needle else text == needle if op == "is" else F.contains(text, F.lit(needle))

    conditions = [one(*r) for r in rules]
    if not conditions:
        return rated.where(F.lit(False))
    total = conditions[0]
    for c in conditions[1:]:
        total = total & c if match == "all" else total | c
    return rated.where(total)
