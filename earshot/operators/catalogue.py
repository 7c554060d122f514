"""The library catalogue: filtered and sorted pages, counts, rollups, upserts and scan diffs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c) -> Column:
    """Folds A to Z only."""
    return F.translate(c, UPPER, LOWER)


def search_key() -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "artist", "album")]))


def effective_artist() -> Column:
    return F.coalesce(F.nullif("album_artist", F.lit("")), F.col("artist"))


@dataclass(frozen=True)
class TrackFilter:
    """Conditions that all hold; None is no condition. A blank search is none either; % and _ in it are wildcards."""

    search: str | None = None
    genre: str | None = None
    decade: int | None = None
    folder: str | None = None
    artist: str | None = None
    album: str | None = None

    def condition(self) -> Column:
        c: list[Column] = [F.lit(True)]
        if self.search and self.search.strip():
            c.append(search_key().like("%" + self.search.strip().lower().replace("\\", "\\\\") + "%"))
        for name in ("genre", "folder", "album"):
            if (v := getattr(self, name)) is not None:
                c.append(F.col(name) == v)
        if self.decade is not None:
            c.append((F.col("year") >= self.decade) & (F.col("year") < self.decade + 10))
        if self.artist is not None:
            c.append((F.col("album_artist") == self.artist) | (F.col("artist") == self.artist))
        return reduce(Column.__and__, c)


def order(sort: str = "title", descending: bool = False) -> list[Column]:
    """Sort keys of a page, ties by title and path. The direction binds to the last key of the sort only; unknown sorts go by title."""
    keys = {"title": [nocase("title")], "artist": [nocase("artist")], "album": [nocase("album")], "year": [F.col("year")], "duration": [F.col("duration")], "added": [F.col("seq")], "track": [F.col("disc_no"), F.col("track_no")]}
    k = keys.get(sort, keys["title"])
    last = k[-1].desc_nulls_last() if descending else k[-1].asc_nulls_first()
    return [*[x.asc_nulls_first() for x in k[:-1]], last, nocase("title").asc_nulls_first(), F.col("path").asc()]


def page(tracks: DataFrame, where: TrackFilter = TrackFilter(), sort: str = "title", descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    return tracks.where(where.condition()).orderBy(*order(sort, descending)).offset(max(0, offset)).limit(max(0, limit))


def count(tracks: DataFrame, where: TrackFilter = TrackFilter()) -> DataFrame:
    return tracks.where(where.condition()).agg(F.count(F.lit(1)).alias("n"))


def albums(tracks: DataFrame, where: TrackFilter = TrackFilter()) -> DataFrame:
    """Tracks by effective artist and album, with a cover path. Grouping minds the case."""
    return tracks.where(where.condition()).groupBy(effective_artist().alias("artist"), "album").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("cover"))


def artists(tracks: DataFrame, where: TrackFilter = TrackFilter()) -> DataFrame:
    return tracks.where(where.condition()).groupBy(effective_artist().alias("artist")).agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str = "path", at: str = "seq") -> DataFrame:
    """old, which has a row a key, with the rows of new, the last by at of those with one key. Only new is grouped; old is passed over once."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in new.columns]), at).alias("r")).select("r.*")
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last, allowMissingColumns=True)


def scan_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, state: changed (new, or other or unknown mtime), unchanged, removed. Paths found twice count once."""
    k, f = known.select("path", F.col("mtime").alias("was")), found.groupBy("path").agg(F.max("mtime").alias("now"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return k.join(f, "path", "full").select("path", state.alias("state"))


def folder_totals(tracks: DataFrame) -> DataFrame:
    """Every folder with the number of tracks in it and below: each path counts once for each of its prefixes."""
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return tracks.select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
