"""What filters do to each other in every order.

Each document is tested once: the filters that it fails are the bits of its mask. Documents count into cells by part and mask, 32 a part for
five filters, and everything else is made from cells. The orders of the filters are visited so that each differs from the one before by one
swap of neighbours; only the two steps that swapped see another set of earlier filters, so only they are made anew, and the removals of
all steps add up to the filters' Shapley sums along the walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The filters in the order of their bits.
FILTERS = "ABCDE"
_UPPERS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
#: Counts of a cell: documents, good ones, toxic ones.
_KINDS = ("n", "good", "toxic")


def failures(text: bytes, chars: int) -> int:
    """Bits of A to D for one text of so many code points: A under 200 words, B more than half of the words repeated, C more than a fiftieth of A-Z, D marks."""
    words = text.split()
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPERS))) > 2 * chars) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _tested(batches):
    for b in batches:
        masks, prints = [], []
        for t in b.column(b.num_columns - 1):
            text = t.as_py() or ""
            raw = text.encode()
            masks.append(failures(raw, len(text)))
            prints.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(masks, pa.int32()), pa.array(prints, pa.binary())], names=[*b.schema.names[:-1], "mask", "print"])


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, source and mask of every document. E, a text that a smaller doc_id has too, holds for all but the first of the equal texts: the
    firsts come from one aggregate over fingerprints (SHA-256), and documents meet them by doc_id and fingerprint, so that a text with very many copies is no hot key."""
    kind = lambda c: docs.schema[c].dataType.simpleString()
    tested = docs.select("doc_id", "source", "text").mapInArrow(_tested, f"doc_id {kind('doc_id')}, source {kind('source')}, mask int, print binary")
    tested = materialize(tested, "tested")
    firsts = tested.groupBy("print").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return tested.join(firsts, ["doc_id", "print"], "left").select("doc_id", "source", (F.col("mask") + F.when(later, F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the counts of documents, of those labelled good and of those labelled toxic. Labels of one doc_id count once; a null doc_id has none."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return masks.join(marked, "doc_id", "left").groupBy(part.alias("part"), "mask").agg(F.count(F.lit(1)).alias("n"), yes("good").alias("good"), yes("toxic").alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose swap of k and k + 1 leads from one order of n things to the next, through all of them: the greatest thing sweeps through the others' orders."""
    if n < 2:
        return
    down, rest = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(rest, None)
        if k is None:
            return
        yield k + 1 if down else k
        down = not down


class Steps:
    """The counts of one step, of all parts at once, from the cells: table is (parts, kinds, masks)."""

    def __init__(self, table: np.ndarray):
        n = table.shape[2]
        self.table, self.mask, self.known = table, np.arange(n), {}
        self.fails = np.stack([table[:, 0, self.mask >> f & 1 == 1].sum(axis=1) for f in range(n.bit_length() - 1)])
        self.only = np.stack([table[:, 0, 1 << f] for f in range(n.bit_length() - 1)])

    def step(self, f: int, earlier: int) -> np.ndarray:
        """kept, removed, redundant, unique_fails, good_lost and toxic_lost of filter f after the set of earlier filters; rows are parts."""
        if (f, earlier) not in self.known:
            here = (self.mask >> f & 1 == 1) & (self.mask & earlier == 0)
            n, good, toxic = (self.table[:, k, here].sum(axis=1) for k in range(3))
            kept = self.table[:, 0, self.mask & (earlier | 1 << f) == 0].sum(axis=1)
            self.known[f, earlier] = np.stack([kept, n, self.fails[f] - n, self.only[f], good, toxic], axis=1)
        return self.known[f, earlier]


def walk(table: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Orders in the order of the walk, counts (orders, steps, parts, 6) and the Shapley sums (filters, parts)."""
    steps, n = Steps(table), table.shape[2].bit_length() - 1
    order = list(range(n))
    earlier = lambda k: sum(1 << f for f in order[:k])
    now = [steps.step(f, earlier(k)) for k, f in enumerate(order)]
    orders, out, shapley = [], [], np.zeros((n, len(table)), dtype=np.int64)

    def visit():
        orders.append(tuple(order))
        out.append(list(now))
        for f, counts in zip(order, now, strict=True):
            shapley[f] += counts[:, 1]

    visit()
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        now[k], now[k + 1] = steps.step(order[k], earlier(k)), steps.step(order[k + 1], earlier(k + 1))
        visit()
    return orders, np.array(out), shapley


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _walked(batches):
    for b in batches:
        for a in range(0, b.num_rows, 64):
            some = b.slice(a, 64)
            table = np.zeros((some.num_rows, len(_KINDS), 1 << len(FILTERS)), dtype=np.int64)
            for i, found in enumerate(some.column("cells").to_pylist()):
                for c in found:
                    table[i, :, c["mask"]] += [c[k] for k in _KINDS]
            orders, counts, shapley = walk(table)
            parts, steps = some.num_rows, len(FILTERS)
            names = ["".join(FILTERS[f] for f in o) for o in orders]
            part = np.tile(np.arange(parts), len(orders) * steps)
            columns = [some.column("part").take(pa.array(part)), pa.array(np.repeat(names, steps * parts)), pa.array(np.tile(np.repeat(np.arange(1, steps + 1, dtype=np.int32), parts), len(orders)))]
            columns += [pa.array(counts[..., k].reshape(-1)) for k in range(6)]
            columns.append(pa.array(np.concatenate([shapley[list(o)].reshape(-1) for o in orders])))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (value of source), order of the five filters and step, with the columns of AUDIT.

    - Null text is empty: it fails A alone, and E where a smaller doc_id is empty too. Texts are taken whole, at any length.
    - A null source and an empty one are the part ''. A document without a doc_id has no label, never fails E and makes none fail it.
    - Rows with one doc_id and one text are not smaller than each other: none fails E for the other. Each counts.
    - Labels of one doc_id count once, a null label as no. No documents: no rows. Columns other than those named are ignored, whatever their names.

    The cells are the only thing that is shuffled beside doc_ids, masks and fingerprints: at most 32 a part, whatever the number of documents.
    """
    c = cells(failure_masks(docs), labels)
    by_part = c.groupBy("part").agg(F.collect_list(F.struct("mask", *_KINDS)).alias("cells"))
    return by_part.mapInArrow(_walked, AUDIT)


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select part, doc_id,
    (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) then 4 else 0 end)
    + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end) as mask from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join l using (doc_id) group by part, mask),
b as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order, unnest(range(1, 6))::int as step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) as bit,
    unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit]) as earlier
  from b a, b b, b c, b d, b e where (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
r as (select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (earlier | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & bit > 0 and mask & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & bit > 0 and mask & earlier > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & bit > 0 and mask & earlier = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & bit > 0 and mask & earlier = 0), 0)::bigint as toxic_lost
  from c, o group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
