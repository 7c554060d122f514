"""Exact join of near-equal documents on word shingles, with skipping by set relations.

Two sets link if they differ in at most a ninth of their sizes together, which is a Jaccard similarity of 0.8. Sets that are
highly similar to a pivot keep only what they differ in from it. Their answers come from the pivot's: two members differ in
d1 + d2 less twice what their differences share, so where d1 + d2 is small they link without a comparison, and elsewhere a
join of the short differences decides. Between different pivots, each set enters the index lists of its first elements in one
global order (common ones last); lists are cut into blocks, and a pair of blocks is skipped if sizes and positions leave no
overlap large enough or both hold one pivot's sets only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, packed, parallelism
from .graph import components
from .shingles import BITS, folded, min_hashes, parity, set_key, shingle_sets

#: A pair links if its overlap is at least 4/9 of the sizes together, which is a Jaccard similarity of 0.8.
NUM, DEN = 4, 9
#: Elements found in this share of the documents go last in the order; their number is at most the mean set size over it.
COMMON = 0.002
#: Rows of a block, and of a part of a list that one task handles.
BLOCK, PART = 32, 2048
#: Rows of a side of a cell of a pivot's grid.
CELL = 512
#: A member differs from its pivot in at most this share of their sizes together.
PIVOT = 0.25
#: Elements before the one at hand that a row of a list brings along.
BEFORE = 4
WORDS = BITS // 64


def _local_counts(share: float):
    def run(batches):
        held, docs, size = [], 0, 0

        def out():
            values, n = np.unique(np.concatenate(held or [np.zeros(0, dtype=np.uint64)]), return_counts=True)
            often = n >= max(8, share * docs / 2)
            return pa.RecordBatch.from_arrays([pa.array([*values[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), docs], pa.int64())], names=["token", "n"])

        for b in batches:
            for s in shingle_sets(b.column(0)):
                held.append(s)
                docs, size = docs + 1, size + len(s)
                if size >= 4_000_000:
                    yield out()
                    held, docs, size = [], 0, 0
        yield out()

    return run


def common_elements(docs: DataFrame, share: float = COMMON) -> np.ndarray:
    """Sorted hashes of elements that at least that share of the documents hold, as far as each task's own counts show them. Any set here gives right joins."""
    counted = docs.select("text").mapInArrow(_local_counts(share), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "counted")
    total = counted.where("token is null").agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("token").isNotNull() & (F.col("n") >= share * total)).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(s):
        return s
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate((s[~last], s[last]))


def _lists(rows, kind=np.int64):
    """An Arrow array of lists of 64-bit numbers."""
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32), np.concatenate([*rows, np.zeros(0, dtype=kind)]).view(np.int64))


def _signed(common):
    def run(batches):
        for b in batches:
            n, key, wide, bits, keys, rare, often = [], [], [], [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                key.append(int(set_key(s).view(np.int64)) if len(s) else None)
                wide.append(parity(s))
                bits.append(folded(wide[-1]))
                keys.append(min_hashes(s))
                head = _ordered(s, common.value)[: len(s) - (NUM * len(s) + NUM) // (NUM + 1) + 1] if len(s) else s
                last = np.isin(head, common.value)
                rare.append(head[~last])
                often.append(head[last])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(key, pa.int64()), _lists(wide), _lists(bits), _lists(keys, np.uint64), _lists(rare, np.uint64), _lists(often, np.uint64)], names=["doc_id", "rid", "n", "cls", "wide", "bits", "keys", "rare", "often"])

    return run


def _sets(batches):
    for b in batches:
        s = list(shingle_sets(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(s, np.uint64)], names=["cls", "set"])


def _block_pairs(group, n, pos, pivot):
    """Pairs of blocks that may hold a link: (first row, rows) of one and of the other. Rows come by group and pivot."""
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(new, len(group)))
    per = -(-size // BLOCK)
    own = np.repeat(np.arange(len(new)), per)
    at = new[own] + BLOCK * (np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per))
    rows = np.minimum(BLOCK, new[own] + size[own] - at)
    low, high = (lambda x: np.minimum.reduceat(x, at)), (lambda x: np.maximum.reduceat(x, at))
    n0, n1, p0, p1, c0, c1 = low(n), high(n), low(pos), high(pos), low(pivot), high(pivot)
    live, d = np.arange(len(own)), 0
    while len(live):
        x, y = live, live + d
        most = np.minimum(n1[x] - np.maximum(0, p0[x] - p1[y]), n1[y] - np.maximum(0, p0[y] - p1[x]))
        ok = (DEN * most >= NUM * (n0[x] + n0[y])) & ((NUM + 1) * n1[x] >= NUM * n0[y]) & ((NUM + 1) * n1[y] >= NUM * n0[x])
        ok &= ~((c0[x] == c1[x]) & (c0[y] == c1[y]) & (c0[x] == c0[y]))
        yield at[x[ok]], rows[x[ok]], at[y[ok]], rows[y[ok]]
        d += 1
        live = live[live + d < len(own)]
        live = live[own[live + d] == own[live]]


def _row_pairs(a, na, b, nb, most: int = 1 << 20):
    """Rows of pairs of blocks, each with each, some at a time."""
    total = np.cumsum(na * nb)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        cnt = (na * nb)[i:j]
        own = np.repeat(np.arange(i, j), cnt)
        k = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        yield a[own] + k // nb[own], b[own] + k % nb[own]
        i = j


def _compared(batches):
    """Pairs of sets of different pivots that the lists leave over, from rows sorted by list, pivot and size."""
    names = ["token", "s", "t", "seg", "n", "pos", "cls", "pivot", *[f"b{k}" for k in range(WORDS)], *[f"p{k}" for k in range(BEFORE)]]

    def pairs(x):
        group = np.cumsum(np.concatenate(([0], (np.diff(x["token"]) != 0) | (np.diff(x["s"]) != 0) | (np.diff(x["t"]) != 0))))
        n, pos, pivot, cls, seg = x["n"], x["pos"], x["pivot"], x["cls"], x["seg"]
        cross = x["s"] != x["t"]
        found = [np.zeros((0, 2), dtype=np.int64)]
        for blocks in _block_pairs(group, n, pos, pivot):
            for i, j in _row_pairs(*blocks):
                need = -(-NUM * (n[i] + n[j]) // DEN)
                ok = (i < j) & (pivot[i] != pivot[j]) & (~cross[i] | (seg[i] != seg[j]))
                ok &= np.minimum(n[i] - np.maximum(0, pos[i] - pos[j]), n[j] - np.maximum(0, pos[j] - pos[i])) >= need
                i, j, need = i[ok], j[ok], need[ok]
                apart = np.zeros(len(i), dtype=np.int64)
                for k in range(WORDS):
                    w = x[f"b{k}"]
                    apart += np.bitwise_count(w[i] ^ w[j])
                ok = n[i] + n[j] - apart >= 2 * need
                i, j = i[ok], j[ok]
                # A pair with another common element just before meets in that list too: the first such list has it.
                early = np.zeros(len(i), dtype=bool)
                for k in range(BEFORE):
                    for m in range(BEFORE):
                        p = x[f"p{k}"][i]
                        early |= (p == x[f"p{m}"][j]) & (p != 0)
                i, j = i[~early], j[~early]
                found.append(np.stack((np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])), axis=1))
        got = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    for x in _whole_groups(batches, names, ("token", "s", "t"), 50_000):
        yield pairs({k: v.view(np.uint64) if k[0] == "b" else v for k, v in x.items()})


def _whole_groups(batches, names, keys, most: int, lists=()):
    """Columns of about most rows at a time, from rows sorted by keys, never with a part of a group. Columns in lists hold arrays."""
    held: dict = {}
    take = lambda b, k: np.array([*b.column(k).to_numpy(zero_copy_only=False), None], dtype=object)[:-1] if k in lists else b.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
    for b in batches:
        x = {k: take(b, k) for k in names}
        held = {k: np.concatenate((held[k], x[k])) for k in names} if held else x
        m = len(held[names[0]])
        if m < most:
            continue
        same = np.logical_and.reduce([held[k] == held[k][-1] for k in keys])
        cut = m - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on in the next batch
        if cut:
            yield {k: v[:cut] for k, v in held.items()}
            held = {k: v[cut:] for k, v in held.items()}
    if held and len(held[names[0]]):
        yield held


def _derived(batches):
    """Links between sets of one pivot, from what each differs in from it: rows (cls, other, docs).

    Rows of a cell of the pivot's grid have side 0 for those whose partners are sought and 1 for the partners. With other null, docs of
    cls's partners; else cls and other are joined by links.
    """
    names = ("pivot", "i", "j", "side", "cls", "n", "d", "docs", "safe", "diff")
    for x in _whole_groups(batches, names, names[:3], 4096, ("diff",)):
        cell = np.cumsum(np.concatenate(([0], np.logical_or.reduce([np.diff(x[k]) != 0 for k in names[:3]]))))
        for cells in _runs(cell, x["side"]):
            rows = slice(*np.searchsorted(cell, [cells[0], cells[1]]))
            yield _linked(cell[rows], {k: x[k][rows] for k in names})


def _runs(cell, side, most: int = 1 << 22):
    """First and last + 1 of runs of cells whose pairs of rows are not more than most together, or one cell."""
    left, right = np.bincount(cell, weights=side == 0), np.bincount(cell, weights=side == 1)
    total = np.cumsum(left * right)
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _linked(cell, x):
    cell = cell - cell[0]
    left, right = np.flatnonzero(x["side"] == 0), np.flatnonzero(x["side"] == 1)
    wide = np.bincount(cell[right], minlength=cell[-1] + 1)
    begin = np.cumsum(wide) - wide  # of a cell's partners among right
    per = wide[cell[left]]
    base = np.cumsum(per) - per  # a pair's place is base of the one + place of the other in its cell
    of_left = np.repeat(np.arange(len(left)), per)
    of_right = np.arange(per.sum()) - base[of_left] + begin[cell[left]][of_left]
    flat = lambda at: (np.repeat(at, [len(v) for v in x["diff"][at]]), np.concatenate([*x["diff"][at], np.zeros(0, dtype=np.int64)]).view(np.uint64) + cell[np.repeat(at, [len(v) for v in x["diff"][at]])].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    (l_row, l_el), (r_row, r_el) = flat(left), flat(right)
    order = np.argsort(r_el, kind="stable")
    lo, hi = np.searchsorted(r_el[order], l_el, "left"), np.searchsorted(r_el[order], l_el, "right")
    shared = np.zeros(len(of_left), dtype=np.int64)
    at, cuts = np.searchsorted(left, l_row), np.cumsum(hi - lo)
    k = 0
    while k < len(l_el):  # some millions of shared elements at a time
        m = max(k + 1, int(np.searchsorted(cuts, (cuts[k - 1] if k else 0) + (1 << 22), "right")))
        size = (hi - lo)[k:m]
        other = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[k:m], size)]
        own = np.repeat(at[k:m], size)
        shared += np.bincount(base[own] + np.searchsorted(right, r_row[other]) - begin[cell[left]][own], minlength=len(shared))
        k = m
    a, b = left[of_left], right[of_right]
    ok = (x["cls"][a] != x["cls"][b]) & ((NUM * 2 + 1) * (x["d"][a] + x["d"][b] - 2 * shared) <= x["n"][a] + x["n"][b])
    a, b = a[ok], b[ok]
    docs = np.bincount(a, weights=x["docs"][b], minlength=len(cell)) + np.where(x["safe"] == 1, np.bincount(b, weights=x["docs"][a], minlength=len(cell)), 0)
    got = np.flatnonzero(docs)
    node, back = np.unique(np.stack((cell, x["cls"]), axis=1), axis=0, return_inverse=True)
    back, label = back.ravel(), np.arange(len(node))
    while True:
        least = np.minimum(label[back[a]], label[back[b]])
        new = label.copy()
        np.minimum.at(new, back[a], least)
        np.minimum.at(new, back[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((x["cls"][got], node[far, 1]))), pa.array([*[None] * len(got), *node[label[far], 1].tolist()], pa.int64()), pa.array(np.concatenate((docs[got].astype(np.int64), np.zeros(len(far), dtype=np.int64))))], names=["cls", "other", "docs"])


def _able(classes: DataFrame, pairs: DataFrame, most) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most most(sizes together) bits, with apart, the least number of elements they differ in."""
    info = classes.select("cls", "n", "wide")
    both = pairs.join(info.alias("x"), F.col("a") == F.col("x.cls")).select("a", "b", F.col("x.n").alias("na"), F.col("x.wide").alias("wa"))
    both = both.join(info.alias("y"), F.col("b") == F.col("y.cls")).select("a", "b", "na", F.col("y.n").alias("nb"), "wa", F.col("y.wide").alias("wb"))
    both = both.where(F.abs(F.col("na") - F.col("nb")) <= most(F.col("na") + F.col("nb")))
    # The longer signature folds to the length of the other.
    half = lambda w: F.zip_with(F.slice(w, 1, (F.size(w) / 2).cast("int")), F.slice(w, (F.size(w) / 2).cast("int") + 1, F.size(w)), lambda p, q: p.bitwiseXOR(q))
    for w, v in (("wa", "wb"), ("wb", "wa")):
        both = both.withColumn(w, F.when(F.size(w) > F.size(v), half(F.col(w))).otherwise(F.col(w)))
    apart = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    both = both.select("a", "b", "na", "nb", apart.alias("apart"))
    return both.where(F.col("apart") <= most(F.col("na") + F.col("nb"))).select("a", "b", "apart")


def _with_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with their whole sets sa and sb, and the table of sets behind them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = ids.join(classes.select("cls", "rid"), "cls")
    sets = docs.select("rid", "text").join(wanted, "rid").select("cls", "text").mapInArrow(_sets, "cls long, set array<long>")
    # A row's key covers its text, so whichever of the rows with that key comes first has the class's own set.
    sets = materialize(sets.dropDuplicates(["cls"]), name)
    x, y = sets.alias("x"), sets.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.cls")).select("a", "b", F.col("x.set").alias("sa")).join(y, F.col("b") == F.col("y.cls")).select("a", "b", "sa", F.col("y.set").alias("sb")), sets


def _members(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Sets with a pivot: cls, pivot, d (elements they differ in), diff (those elements). A pivot has no pivot itself.

    Sets that share the least element of some order may be similar; the least class of those that do leads. Which pairs are tried
    here only changes the work: what gets no pivot meets the others in the index.
    """
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    lead = keyed.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("hi")).where("a <> hi").drop("hi")
    tried = _able(classes, keyed.join(lead, "key").where("a <> cls").select("a", F.col("cls").alias("b")).distinct(), lambda n: n * PIVOT)
    best = tried.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    best = materialize(best, "leaders")
    # One whose own leader has a leader stays without: pivots are roots.
    root = best.join(best.select(F.col("b").alias("a")), "a", "left_anti")
    whole, sets = _with_sets(docs, classes, root, "sets")
    diff = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    out = whole.select(F.col("b").alias("cls"), F.col("a").alias("pivot"), (F.size("sa") + F.size("sb")).alias("both"), diff.alias("diff"))
    out = materialize(out.where(F.size("diff") <= F.col("both") * PIVOT).select("cls", "pivot", F.size("diff").cast("long").alias("d"), "diff"), "members")
    discard(best, sets)
    return out


def _inside(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Links between sets of one pivot: rows (cls, other, docs) as _derived gives them."""
    spark = classes.sparkSession
    sizes = classes.select("cls", "n", "docs")
    none = F.array().cast("array<bigint>")
    own = members.join(sizes, "cls").select("pivot", "cls", "n", "docs", "d", "diff")
    tops = members.select(F.col("pivot").alias("cls")).distinct().join(sizes, "cls").select(F.col("cls").alias("pivot"), "cls", "n", "docs", F.lit(0).cast("long").alias("d"), none.alias("diff"))
    # Two safe members differ in at most a ninth of their sizes together, so all of them link.
    group = materialize(own.union(tops).withColumn("safe", ((NUM * 2 + 1) * F.col("d") <= F.col("n")).cast("long")), "groups")
    total = group.groupBy("pivot").agg(F.sum(F.col("safe") * F.col("docs")).alias("safe_docs"), F.sum(1 - F.col("safe")).alias("unsafe"), F.count(F.lit(1)).alias("all"))
    group = group.join(total, "pivot")
    sure = group.where("safe = 1 and safe_docs > docs").select("cls", F.lit(None).cast("long").alias("other"), (F.col("safe_docs") - F.col("docs")).alias("docs"))
    near = group.where("safe = 1 and cls <> pivot").select("cls", F.col("pivot").alias("other"), F.lit(0).cast("long").alias("docs"))
    parts = lambda c: F.ceil(F.col(c) / CELL).cast("long")
    cells = group.where("unsafe > 0").withColumns({"rows": parts("unsafe"), "columns": parts("all")})
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    columns = ["pivot", "i", "j", "side", "cls", "n", "d", "docs", "safe", "diff"]
    left = cells.where("safe = 0").withColumns({"side": F.lit(0).cast("long"), "i": F.pmod(F.xxhash64("cls"), F.col("rows"))}).withColumn("j", upto("columns"))
    right = cells.withColumns({"side": F.lit(1).cast("long"), "j": F.pmod(F.xxhash64("cls", F.lit(1)), F.col("columns"))}).withColumn("i", upto("rows"))
    dealt = left.select(*columns).union(right.select(*columns)).repartition(parallelism(spark), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "side")
    return sure.union(near).union(dealt.mapInArrow(_derived, "cls long, other long, docs long"))


def _across(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between sets of different pivots, by the index lists."""
    spark = docs.sparkSession
    told = classes.join(members.select("cls", "pivot"), "cls", "left").withColumn("pivot", F.coalesce("pivot", "cls"))
    # Lists of rare elements are shorter than a share of the documents. Those of common ones may be of any length: they are summed up before their rows are dealt.
    of_list = Window.partitionBy("token")
    rare = told.select("cls", "n", "pivot", F.posexplode("rare").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long")).withColumns({"lo": F.min("pivot").over(of_list), "hi": F.max("pivot").over(of_list), "len": F.count(F.lit(1)).over(of_list)}).where("lo <> hi")
    often = told.select("cls", "n", "pivot", F.size("rare").cast("long").alias("before"), F.posexplode("often").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long") + F.col("before"))
    lengths = often.groupBy("token").agg(F.min("pivot").alias("lo"), F.max("pivot").alias("hi"), F.count(F.lit(1)).alias("len")).where("lo <> hi")
    columns = ["token", "cls", "n", "pos", "pivot", "len"]
    live = materialize(rare.select(*columns).union(often.join(lengths, "token").select(*columns)), "postings")

    along = Window.partitionBy("cls").orderBy("pos")
    bits = classes.select("cls", *[F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(WORDS)])
    mixed = live.withColumns({f"p{k}": F.coalesce(F.lag("token", k + 1).over(along), F.lit(0)) for k in range(BEFORE)}).join(bits, "cls")
    parts = F.ceil(F.col("len") / PART).cast("long")
    mixed = mixed.withColumn("parts", parts).withColumn("seg", F.pmod(F.xxhash64("cls"), F.col("parts")))
    spread = mixed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "token", F.least("seg", "o").alias("s"), F.greatest("seg", "o").alias("t"), "seg", "n", "pos", "cls", "pivot", *[f"b{k}" for k in range(WORDS)], *[f"p{k}" for k in range(BEFORE)])
    spread = spread.repartition(parallelism(spark), "token", "s", "t").sortWithinPartitions("token", "s", "t", "pivot", "n", "pos")
    found = materialize(spread.mapInArrow(_compared, "a long, b long").distinct(), "pairs")
    rest = materialize(_able(classes, found, lambda n: n / (NUM * 2 + 1)).select("a", "b"), "pairs")
    whole, sets = _with_sets(docs, classes, rest, "sets")
    links = materialize(whole.where(DEN * F.size(F.array_intersect("sa", "sb")) >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")
    discard(live, found, rest, sets)
    return links


def near_components(docs: DataFrame, share: float = COMMON) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links lead to), n_links (other documents it links with), cls (key of its set), root (of its component) and rid (of the row).

    - Documents link where the Jaccard similarity of their sets is at least 0.8; equal sets are one class and always link.
    - Null or empty text, or text without words: no shingles, null cls, linked with nothing; component_id is its own doc_id.
    - A null doc_id counts as greater than any other; a component without any other has a null component_id.
    - Repeated rows each give a row and link with one another; so do different texts under one doc_id where they are similar.
    - Texts of any length are taken whole; the longest has to fit a task with its set. Sets and elements go by 64-bit hashes.
    - An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), row_key(docs).alias("rid"))
    common = spark.sparkContext.broadcast(common_elements(docs, share))
    many = "array<long>"
    signed = materialize(docs.mapInArrow(_signed(common), f"doc_id long, rid long, n long, cls long, wide {many}, bits {many}, keys {many}, rare {many}, often {many}"), "signed")
    rows = materialize(signed.select("doc_id", "rid", F.col("n").alias("n_shingles"), "cls"), "rows")
    first = [F.first(c).alias(c) for c in ("n", "wide", "bits", "keys", "rare", "often")]
    classes = materialize(signed.where("n > 0").groupBy("cls").agg(*first, F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("docs")), "classes")
    discard(signed)

    members = _members(docs, classes)
    inside = materialize(_inside(classes, members), "inside")
    across = _across(docs, classes, members)
    edges = inside.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")).union(across)
    roots = components(edges, "a", "b")
    sizes = classes.select("cls", "docs")
    both = across.select("a", "b").union(across.select("b", "a")).join(sizes, F.col("b") == F.col("cls")).select(F.col("a").alias("cls"), "docs")
    partners = inside.where("other is null").select("cls", "docs").union(both).groupBy("cls").agg(F.sum("docs").alias("partners"))

    member = classes.select("cls", "rep", "docs").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", "docs", F.coalesce("root", "cls").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("rep").alias("component_id")), "root").join(partners, "cls", "left").select("cls", "component_id", "root", (F.coalesce("partners", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    out = rows.join(materialize(named, "named"), "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "cls", "root", "rid")


def row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def one_of_each(docs: DataFrame, share: float = COMMON) -> DataFrame:
    """The documents without near copies: of each component that with the least doc_id (nulls last), once; those without words all stay.

    Columns are as they were, whatever their names. Null, empty, repeated and very long texts and empty tables are as near_components has them.
    """
    found = materialize(near_components(docs, share), "components")
    winners = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))["rid"].alias("rid")).select("rid")
    bare = found.where("n_shingles = 0").select("rid").distinct()
    keyed = packed(docs, rid=row_key(docs))
    once = keyed.join(winners, "rid", "left_semi").dropDuplicates(["rid"])
    return once.union(keyed.join(bare, "rid", "left_semi")).select("row.*")
