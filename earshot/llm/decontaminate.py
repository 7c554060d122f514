"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

Windows of the length of an item, placed where a document holds a shingle of that item, get 64-bit SimHash fingerprints of their
weighted shingles. A multi-index over bit blocks finds every item within the radius of a window's fingerprint, and the
weighted Jaccard similarity of the shingles decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialize, packed

WIDTH = 5
#: Widths of the bit blocks, and the bits that may differ in the block at hand. By the pigeonhole principle every fingerprint
#: within RADIUS = len(BLOCKS) * (FLIPS + 1) - 1 bits agrees in some block but for FLIPS bits.
BLOCKS, FLIPS = (11, 11, 11, 11, 10, 10), 2
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
_BLANK = r"\x20\x09\x0a\x0b\x0c\x0d"


def _word_hashes(text) -> F.Column:
    """Hashes of the lower-cased words of a text; empty without words."""
    trimmed = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"^{SPACE}", "")
    return F.filter(F.transform(F.split(trimmed, SPACE), lambda w: F.when(w != "", F.xxhash64(w))), lambda h: h.isNotNull())


def _shingles(words, n) -> F.Column:
    """Hashes of the shingles of an array of word hashes: WIDTH words each, all as one where there are fewer."""
    full = F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))
    return F.when(n >= WIDTH, full).when(n > 0, F.array(F.xxhash64(F.lit("short"), words))).otherwise(F.array().cast("array<bigint>"))


def _rid(docs: DataFrame):
    return F.xxhash64(docs["doc_id"], docs["text"])


def _fingerprints(shingled: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of weighted shingles (h, w) per key: bit k is set where the weights of hashes with it outweigh the others."""
    sums = shingled.groupBy(*keys).agg(*[F.sum(F.when(F.shiftright("h", k).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"s{k}") for k in range(64)])
    bits = F.lit(0).cast("long")
    for k in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"s{k}") > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, bits.alias("fp"))


def _blocks(fp: str):
    out, at = [], 0
    for k, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append((k, width, value))
        at += width
    return out


def _indexed(fingerprints: DataFrame, probe: bool) -> DataFrame:
    """One row a block (k, v) of each fingerprint; for a probe one also for each way to change up to FLIPS bits of it."""
    def masks(width):
        return [sum(1 << b for b in c) for r in range(FLIPS + 1) for c in combinations(range(width), r)] if probe else [0]

    def variants(k, width, value):
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks(width)]), lambda m: F.struct(F.lit(k).alias("k"), value.bitwiseXOR(m).alias("v")))

    rows = [variants(*block) for block in _blocks("fp")]
    return fingerprints.withColumn("_b", F.explode(F.flatten(F.array(*rows)))).select(*fingerprints.columns, "_b.k", "_b.v")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, rid (hash of the row's id and text), item_id, start (word of the best window), similarity.

    - Words are lower-cased (A to Z) runs of other than white space; a shingle is five of them, or all where an item or a document has fewer.
    - A shingle weighs ln(1 + items / items that hold it); what no item holds counts as held by one.
    - Windows have an item's length and lie where a shingle of it lies in both, or cover the whole of a shorter document.
    - Null or empty texts of documents and items match nothing. Rows with equal doc_id and text are one document here.
    - A null doc_id or item_id is an id like others. Empty tables give an empty result. Other columns are ignored, whatever their names.
    - Texts of any length are taken whole; of equal windows of an item the first is named.
    """
    items = benchmark.select("item_id", _word_hashes(F.col("text")).alias("words")).withColumn("m", F.size("words")).where("m > 0")
    items = items.select("item_id", F.xxhash64("item_id", "words").alias("iid"), "m", _shingles(F.col("words"), F.col("m")).alias("sh")).dropDuplicates(["iid"])
    items = materialize(items.select("item_id", "iid", "m", F.posexplode("sh").alias("q", "h")), "items")
    n_items = items.agg(F.countDistinct("iid")).first()[0]
    weights = items.groupBy("h").agg(F.countDistinct("iid").alias("df")).select("h", F.log1p(n_items / F.col("df")).alias("w"))
    weights = materialize(weights, "weights")

    texts = docs.select("doc_id", _rid(docs).alias("rid"), _word_hashes(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    found = texts.select("doc_id", "rid", "n", F.posexplode(_shingles(F.col("words"), F.col("n"))).alias("p", "h"))
    hits = found.join(items.select("iid", "h", "q", "m"), "h")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("m")))
    asked = materialize(hits.select("doc_id", "rid", start.alias("start"), F.least("m", "n").alias("m"), "iid").distinct(), "asked")
    windows = asked.select("doc_id", "rid", "start", "m").distinct()

    picked = packed(docs, rid=_rid(docs)).join(windows.select("rid").distinct(), "rid", "left_semi").select("rid", F.col("row.text").alias("text")).dropDuplicates(["rid"])
    picked = picked.select("rid", _word_hashes(F.col("text")).alias("words"))
    cut = windows.join(picked, "rid").select("doc_id", "rid", "start", "m", F.slice("words", F.col("start") + 1, F.col("m")).alias("words"))
    key = ["doc_id", "rid", "start", "m"]
    shingled = cut.select(*key, F.explode(_shingles(F.col("words"), F.col("m"))).alias("h")).groupBy(*key, "h").agg(F.count(F.lit(1)).alias("c"))
    shingled = shingled.join(weights, "h", "left").withColumn("w", F.col("c") * F.coalesce("w", F.log1p(F.lit(float(n_items)))))
    shingled = materialize(shingled, "window-shingles")
    own = items.groupBy("item_id", "iid", "h").agg(F.count(F.lit(1)).alias("c")).join(weights, "h").withColumn("w", F.col("c") * F.col("w"))
    own = materialize(own, "item-shingles")

    # A window meets only the items whose shingle placed it, so the blocks of one item never gather all windows.
    fp_items = _fingerprints(own, ["item_id", "iid"])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    fp_asked = asked.alias("a").join(_fingerprints(shingled, key).alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in key], "a.iid", "b.fp")
    index = _indexed(fp_items, probe=True).withColumnRenamed("fp", "fp_item")
    near = _indexed(fp_asked, probe=False).join(index, ["iid", "k", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_item"))) <= RADIUS).select(*key, "item_id", "iid").distinct()

    total = lambda df, keys, name: df.groupBy(*keys).agg(F.sum("w").alias(name))
    i, s = own.select("iid", "h", F.col("w").alias("wi")), shingled.select(*key, "h", "w")
    eq = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    shared = near.alias("a").join(s.alias("b"), eq).select(*[F.col(f"a.{c}").alias(c) for c in [*key, "item_id", "iid"]], "b.h", "b.w").join(i, ["iid", "h"])
    shared = shared.groupBy(*key, "item_id", "iid").agg(F.sum(F.least("w", "wi")).alias("both"))
    scored = shared.join(total(own, ["iid"], "total_item"), "iid").alias("a").join(total(shingled, key, "total").alias("b"), eq)
    scored = scored.select("a.doc_id", "a.rid", "a.item_id", "a.start", (F.col("both") / (F.col("total_item") + F.col("total") - F.col("both"))).alias("similarity"))
    good = scored.where(F.col("similarity") >= similarity - 1e-9)
    best = F.max(F.struct("similarity", -F.col("start")))
    return good.groupBy("doc_id", "rid", "item_id").agg(best.alias("b")).select("doc_id", "rid", "item_id", (-F.col("b.col2")).alias("start"), F.col("b.similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are, whatever their names. Other cases are as in contaminated."""
    bad = contaminated(docs, benchmark, similarity).select("rid").distinct()
    return packed(docs, rid=_rid(docs)).join(bad, "rid", "left_anti").select("row.*")
