"""Lists of a browser, kept up from changes instead of made anew.

Of every list the first entries are held, and a reserve beyond its cut. A batch of changes becomes entries that come and entries that go; those that
go are met from the reserve. As long as a list has as many entries as its cut, or has never been cut, it is right; one that has lost more
than its reserve is short, and only short lists are filled anew from the tables. What is held of a list is one row, an array in order, so that a
batch meets the lists by one join, and what a browser shows needs neither a shuffle nor a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.operators.lookups import BROWSE
from earshot.operators.tours import stored
from earshot.sources.stores import committed, read_table, replace_table

#: Entries held beyond a list's cut, and short lists whose names go to every task.
RESERVE, FEW = 40, 10_000


def _cut(name) -> F.col:
    return F.when(F.col(name) == "recent", BROWSE["recent"]).when(F.col(name) == "loved", BROWSE["loved"]).otherwise(BROWSE["playlist"])


def entries_of_stats(stats: DataFrame) -> DataFrame:
    """list, entry, k (the order), seq, there: what rows of tracks' statistics (seq, last_played, rating) say of the recent and the loved list."""
    seq = F.col("seq").cast("long")
    row = lambda name, k, there: F.struct(F.lit(name).alias("list"), seq.alias("entry"), k.cast("double").alias("k"), seq.alias("seq"), F.coalesce(there, F.lit(False)).alias("there"))
    return stats.select(F.explode(F.array(row("recent", -F.col("last_played"), F.col("last_played") > 0), row("loved", F.lit(0.0), F.col("rating") >= 4))).alias("e")).select("e.*")


def entries_of_playlists(playlists: DataFrame) -> DataFrame:
    """The same of rows of playlists (id, pos, seq); a null seq empties the place."""
    return playlists.select(F.concat(F.lit("pl:"), F.col("id").cast("string")).alias("list"), F.col("pos").cast("long").alias("entry"), F.col("pos").cast("double").alias("k"), F.col("seq").cast("long").alias("seq"), F.col("seq").isNotNull().alias("there"))


def _first(entries: DataFrame, more: int = 0) -> DataFrame:
    """The entries that are held and so many more of each list, as one array a list in order: list, first."""
    by = Window.partitionBy("list").orderBy("k", "seq", "entry")
    ranked = entries.select("list", "entry", "k", "seq", F.row_number().over(by).alias("rank"))
    ranked = ranked.where(F.col("rank") <= max(BROWSE.values()) + RESERVE + more).where(F.col("rank") <= _cut("list") + RESERVE + more)
    return ranked.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("k", "seq", "entry"))).alias("first"))


def begun(entries: DataFrame) -> DataFrame:
    """list, held, more of whole lists: the held entries in order, and whether the list was cut."""
    top = _cut("list") + RESERVE
    return _first(entries.where("there"), 1).select("list", F.slice("first", F.lit(1), top).alias("held"), (F.size("first") > top).alias("more"))


def grouped(held: DataFrame, changes: DataFrame, gone: DataFrame | None) -> DataFrame:
    """One batch by list: list, comes (entries in order), off (entries whose place in the list goes), lost (tracks that it holds and that left).

    No more entries come than a list holds, and one more that tells whether it was cut. Of a list that was cut, whose changes may be very
    many, only held entries go.
    """
    c = changes
    if gone is not None:
        gone = gone.select("seq").where("seq is not null").distinct()
        c = c.join(gone.withColumn("out", F.lit(True)), "seq", "left").select("list", "entry", "k", "seq", (F.col("there") & F.col("out").isNull()).alias("there"))
    none = lambda kind: F.lit(None).cast(kind)
    entries, longs = "array<struct<k: double, seq: bigint, entry: bigint>>", "array<bigint>"
    comes = _first(c.where("there"), 1).select("list", F.col("first").alias("comes"), none(longs).alias("off"), none(longs).alias("lost"))
    cut = held.where("more").select("list", F.col("held.entry").alias("places"))
    off = c.join(cut, "list", "left").where(F.col("places").isNull() | F.array_contains("places", F.col("entry"))).groupBy("list").agg(F.collect_list("entry").alias("off"))
    parts = comes.unionByName(off.select("list", none(entries).alias("comes"), "off", none(longs).alias("lost")))
    if gone is not None:
        lost = held.select("list", F.explode("held.seq").alias("seq")).join(gone, "seq", "left_semi").groupBy("list").agg(F.collect_set("seq").alias("lost"))
        parts = parts.unionByName(lost.select("list", none(entries).alias("comes"), none(longs).alias("off"), "lost"))
    return parts.groupBy("list").agg(*[F.first(n, True).alias(n) for n in ("comes", "off", "lost")])


def merged(held: DataFrame, batch: DataFrame, kept: bool = True) -> DataFrame:
    """list, held, more after one batch as grouped() makes it; without kept only of lists that are held now.

    An entry that comes behind the last one held of a list that was cut is not held: entries that nobody holds may lie before it.
    A list that was cut and lost all it held keeps its row, so that it is known to be short.
    """
    t = held.withColumn("had", F.lit(True)).join(batch.withColumn("met", F.lit(True)), "list", "full" if kept else "inner")
    top, more, last = _cut("list") + RESERVE, F.coalesce("more", F.lit(False)), F.element_at("held", F.lit(-1))
    within = lambda names, x: F.coalesce(F.array_contains(names, x), F.lit(False))
    stays = F.filter("held", lambda e: ~within(F.col("off"), e["entry"]) & ~within(F.col("lost"), e["seq"]))
    empty = F.array().cast("array<struct<k: double, seq: bigint, entry: bigint>>")
    comes = F.when(~more, F.col("comes")).when(F.size("held") > 0, F.filter("comes", lambda e: e <= last))
    now = F.sort_array(F.concat(F.coalesce(stays, empty), F.coalesce(comes, empty)))
    t = t.select("list", "met", "held", more.alias("more"), F.when(F.col("met"), now).alias("now"))
    t = t.select("list", F.when(F.col("met"), F.slice("now", F.lit(1), top)).otherwise(F.col("held")).alias("held"), (F.col("more") | F.coalesce(F.size("now") > top, F.lit(False))).alias("more"))
    return t.where((F.size("held") > 0) | F.col("more"))


def short(held: DataFrame) -> DataFrame:
    """Lists that were cut and hold fewer entries than they show."""
    return held.where(F.col("more") & (F.size("held") < _cut("list"))).select("list")


def shown(held: DataFrame) -> DataFrame:
    """list, pos, seq: the lists as a browser shows them."""
    by = Window.partitionBy("list").orderBy("k", "seq", "entry")
    ranked = held.where("entry is not null").withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= max(BROWSE.values())).where(F.col("rank") <= _cut("list")).select("list", (F.col("rank") - 1).alias("pos"), "seq")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "version").alias("r")).select("r.*")


class BrowseLists:
    """The lists of a browser in a folder. Batches hold changed rows: stats (seq, last_played, rating, version), playlists (id, pos, seq, version) and gone (seq); whole() reads the tables, and only where a list is short."""

    def __init__(self, spark: SparkSession, folder: str, whole):
        self.spark, self.folder, self.whole, self.refilled = spark, folder, whole, 0

    def held(self) -> DataFrame:
        """list, held (an array of k, seq, entry in order), more: one row a list."""
        return read_table(self.spark, self.folder)

    def begin(self) -> None:
        replace_table(begun(self.whole()), self.folder)

    def merge(self, number: int, stats: DataFrame, playlists: DataFrame, gone: DataFrame) -> None:
        """Take one batch in; a batch that was taken in before changes nothing, as its rows replace themselves."""
        changes = stored(entries_of_stats(_last(stats, "seq")).unionByName(entries_of_playlists(_last(playlists, "id", "pos"))), "changes")
        held = self.held()
        batch = stored(grouped(held, changes, None if gone.isEmpty() else gone), "batch")
        now = merged(held, batch)
        lists = stored(short(merged(held.where("more"), batch, False)), "short")  # only a list that was cut can be short
        n = lists.count()
        if n:
            self.refilled += n
            lists = F.broadcast(lists) if n <= FEW else lists
            now = now.join(lists, "list", "left_anti").unionByName(begun(self.whole().join(lists, "list", "left_semi")))
        replace_table(now, self.folder)

    def shown(self) -> DataFrame:
        return self.held().select("list", F.posexplode(F.slice("held", F.lit(1), _cut("list"))).alias("pos", "e")).select("list", "pos", "e.seq")

    def versions(self) -> list[str]:
        return committed(self.spark, self.folder)
