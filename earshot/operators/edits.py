"""Edits of ordered things: queues, playlists and sections, as column functions over arrays. Places count from 0; an edit that does not fit changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _inside(items, *places) -> Column:
    ok = F.lit(True)
    for p in places:
        ok = ok & (p >= 0) & (p < F.size(items))
    return ok


def moved(items, at, to) -> Column:
    """items with the one at a place moved to another."""
    items, at, to = _c(items), _c(at), _c(to)
    rest = F.concat(F.slice(items, F.lit(1), F.greatest(at, F.lit(0))), F.slice(items, F.greatest(at, F.lit(0)) + 2, F.size(items)))
    put = F.concat(F.slice(rest, F.lit(1), F.greatest(to, F.lit(0))), F.slice(items, F.greatest(at, F.lit(0)) + 1, F.lit(1)), F.slice(rest, F.greatest(to, F.lit(0)) + 1, F.size(items)))
    return F.when(_inside(items, at, to) & (at != to), put).otherwise(items)


def index_after_move(items, index, at, to) -> Column:
    """Where the current item of a queue is after moved()."""
    items, index, at, to = _c(items), _c(index), _c(at), _c(to)
    new = F.when(index == at, to).when((at < index) & (to >= index), index - 1).when((at > index) & (to <= index), index + 1).otherwise(index)
    return F.when(_inside(items, at, to) & (at != to), new).otherwise(index)


def removed(items, at) -> Column:
    items, at = _c(items), _c(at)
    return F.when(_inside(items, at), F.concat(F.slice(items, F.lit(1), F.greatest(at, F.lit(0))), F.slice(items, F.greatest(at, F.lit(0)) + 2, F.size(items)))).otherwise(items)


def index_after_removal(items, index, at) -> Column:
    """Where the current item is after removed(): the next one takes the place of a removed current one; -1 for an empty queue."""
    items, index, at = _c(items), _c(index), _c(at)
    new = F.when(at < index, index - 1).when(at == index, F.least(index, F.size(items) - 2)).otherwise(index)
    return F.when(_inside(items, at), F.when(F.size(items) > 1, new).otherwise(-1)).otherwise(index)


def added(items, more) -> Column:
    return F.concat(_c(items), _c(more))


def played_next(items, index, more) -> Column:
    """items with more put right after the current one; without a current one more is the queue."""
    items, index = _c(items), _c(index)
    return F.when(F.size(_c(more)) == 0, items).when(index < 0, _c(more)).otherwise(F.concat(F.slice(items, F.lit(1), F.greatest(index, F.lit(0)) + 1), _c(more), F.slice(items, F.greatest(index, F.lit(0)) + 2, F.size(items))))


def without_upcoming(items, index) -> Column:
    items, index = _c(items), _c(index)
    return F.when((index < 0) | (index >= F.size(items) - 1), items).otherwise(F.slice(items, F.lit(1), F.greatest(index, F.lit(0)) + 1))


def deduplicated(items) -> Column:
    """Each item where it first is."""
    return F.array_distinct(_c(items))


def index_after_dedup(items, index) -> Column:
    """Where the current item first is among those that are left."""
    items, index = _c(items), _c(index)
    current = F.get(items, F.greatest(index, F.lit(0)))
    return F.when(index >= 0, F.greatest(F.lit(0), F.array_position(F.array_distinct(items), current).cast("int") - 1)).otherwise(index)


def appended_unseen(items, more) -> Column:
    """items, and of more those not yet among them; what more repeats stays repeated."""
    items = _c(items)
    return F.concat(items, F.filter(_c(more), lambda x: ~F.array_contains(items, x)))


def shuffled_upcoming(items, index, seed: int) -> Column:
    """The items after the current one in an order that the seed gives; fewer than three items stay."""
    items, index = _c(items), _c(index)
    head, tail = F.slice(items, F.lit(1), F.greatest(index + 1, F.lit(0))), F.slice(items, F.greatest(index + 1, F.lit(0)) + 1, F.size(items))
    keyed = F.array_sort(F.transform(tail, lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), x.cast("string"))).alias("k"), i.alias("i"), x.alias("x"))))
    return F.when(F.size(items) < 3, items).otherwise(F.concat(head, F.transform(keyed, lambda e: e["x"])))


def play_order(entries: DataFrame, mode: str) -> DataFrame:
    """Entries of playlists (id, pos, seq, plays, mtime) with place: in reverse, by plays, or newest first; equal ones as they were."""
    by = {"reverse": [F.desc("pos")], "plays": [F.desc("plays"), "pos"], "newest": [F.desc(F.coalesce("mtime", F.lit(0.0))), "pos"]}[mode]
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*by)) - 1)


def snapped(at, length, bpm, first, fine=None) -> Column:
    """A place in a track, as a share of its length, at the nearest bar, or beat where fine; without a tempo as it is."""
    at, length, bpm, first = _c(at), _c(length), _c(bpm), F.coalesce(_c(first), F.lit(0.0))
    step = 240.0 / bpm if fine is None else F.when(_c(fine), 60.0 / bpm).otherwise(240.0 / bpm)
    grid = (first + F.floor((at * length - first) / step + 0.5) * step) / length
    return F.when(F.coalesce(bpm, F.lit(0.0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), grid))).otherwise(at)


def bar_at(at, length, bpm, first) -> Column:
    """start and end in seconds of the bar that a place, a share of the length, lies in; null without a tempo."""
    at, length, bpm, first = _c(at), _c(length), _c(bpm), F.coalesce(_c(first), F.lit(0.0))
    bar = 240.0 / bpm
    start = F.greatest(F.lit(0.0), first + F.floor((at * length - first) / bar) * bar)
    return F.when(F.coalesce(bpm, F.lit(0.0)) > 0, F.struct(start.alias("start"), F.least(length, start + bar).alias("end")))


def _span(s, **new) -> Column:
    return F.struct(*[new.get(k, s[k]).alias(k) for k in ("start", "end", "tier", "label")])


def split_sections(sections, at, least: float) -> Column:
    """Sections (start, end, tier, label) with the one that a place lies in cut there, if both parts have least; the second is marked."""
    at = _c(at)
    fits = lambda s: (at >= s["start"]) & (at < s["end"]) & (at - s["start"] >= least) & (s["end"] - at >= least)
    return F.flatten(F.transform(_c(sections), lambda s: F.when(fits(s), F.array(_span(s, end=at), _span(s, start=at, label=F.concat(s["label"], F.lit(" ²"))))).otherwise(F.array(_span(s)))))


def merged_sections(sections, i) -> Column:
    """Sections without the i-th, whose stretch the one before takes, or the next one for the first. A single section stays."""
    s, i = _c(sections), _c(i)
    j = F.when(i == 0, F.lit(1)).otherwise(i - 1)
    gone = F.get(s, i)
    wider = F.transform(s, lambda x, k: F.when(k == j, _span(x, start=F.least(x["start"], gone["start"]), end=F.greatest(x["end"], gone["end"]))).otherwise(_span(x)))
    return F.when((F.size(s) > 1) & _inside(s, i), F.filter(wider, lambda x, k: k != i)).otherwise(F.transform(s, lambda x: _span(x)))


def moved_boundary(sections, i, to, least: float) -> Column:
    """Sections with the end of the i-th, and so the start of the next, moved to a place that leaves both at least that long."""
    s, i = _c(sections), _c(i)
    at = F.greatest(F.get(s, i)["start"] + least, F.least(F.get(s, i + 1)["end"] - least, _c(to)))
    return F.when(_inside(s, i, i + 1), F.transform(s, lambda x, k: F.when(k == i, _span(x, end=at)).when(k == i + 1, _span(x, start=at)).otherwise(_span(x)))).otherwise(F.transform(s, lambda x: _span(x)))


def intro_target(sections, length) -> Column:
    """Where a long intro ends: the start of the first section of some energy (start, energy) that begins in the track's first third but not at its head; null if there is none."""
    length = _c(length)
    fit = F.filter(_c(sections), lambda s: (s["energy"] >= 0.4) & (s["start"] > length * 0.01) & (s["start"] < length * 0.34))
    return F.get(F.transform(fit, lambda s: s["start"]), F.lit(0))


def next_drop(sections, at) -> Column:
    """The start of the next section of the highest tier, from the front again after the last; null if there is none."""
    at = _c(at)
    drops = F.transform(F.filter(_c(sections), lambda s: s["tier"] == 2), lambda s: s["start"])
    return F.coalesce(F.get(F.filter(drops, lambda x: x > at + 0.01), F.lit(0)), F.get(drops, F.lit(0)))


def middle(items, n: int) -> Column:
    """The n items in the middle, or all of fewer."""
    items = _c(items)
    return F.when(F.size(items) > n, F.slice(items, F.floor((F.size(items) - n) / 2).cast("int") + 1, F.lit(n))).otherwise(items)


def replaced(base: DataFrame, edits: DataFrame, key: str, column: str) -> DataFrame:
    """base with the user's own value of a column where edits (key, column) has one."""
    return base.join(edits.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
