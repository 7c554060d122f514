"""Quality rules with thresholds that follow the data.

Per document, a few counts; per language and source, mergeable quantile sketches of the ratios made from them; the
quartiles of each sketch set that group's fences, and documents outside any fence go.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, packed

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Relative error of the sketches: bucket k holds values in (G**(k-1), G**k].
ERROR = 0.01
_GAMMA = (1 + ERROR) / (1 - ERROR)
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one text: words, code points in words, symbols, later copies of lines, words in repeated 3-word windows, lines with a word."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines))


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    twice = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=n - 2)
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _measured(batches):
    for b in batches:
        at = [c for c in range(b.num_columns) if b.schema.field(c).name == "_text"][0]
        cols = list(zip(*map(measure, b.column(at).to_pylist()), strict=True)) or [()] * 6
        names = [f.name for f in b.schema if f.name != "_text"] + [x.split()[0] for x in MEASURES.split(", ")]
        arrays = [b.column(c) for c in range(b.num_columns) if c != at] + [pa.array(x, pa.int64()) for x in cols]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def quality_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of MEASURES and base_failed."""
    slim = docs.select("doc_id", "lang", "source", F.col("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text") + ", " + MEASURES
    out = slim.mapInArrow(_measured, schema)
    return out.withColumn("base_failed", _failed())


def _failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Ratios: numerator, denominator, whether a low value counts against a document, and the least width of its fence, which keeps clean documents where most have one value.
RATIOS = {
    "word_length": ("word_chars", "n_words", True, 1.0),
    "symbols": ("n_symbols", "n_words", False, 0.10),
    "dup_lines": ("n_dup_lines", "n_lines", False, 0.40),
    "repeats": ("n_repeat_words", "n_words", False, 0.30),
}


def _ratios(m: DataFrame):
    return m.withColumns({k: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0) for k, (n, d, _, _) in RATIOS.items()})


def ratio_sketches(measured: DataFrame, level: list[str]) -> DataFrame:
    """Quantile sketches of the ratios per group: counts of logarithmic buckets, which merge by addition. Documents that failed the base stay out."""
    ok = _ratios(measured.where(~F.col("base_failed")))
    bucket = lambda c: F.when(F.col(c) <= 1e-6, F.lit(-10_000)).otherwise(F.ceil(F.log(F.col(c)) / math.log(_GAMMA))).cast("int")
    long = ok.select(*level, F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(k).alias("bucket")) for k in RATIOS])).alias("x"))
    return long.groupBy(*level, F.col("x.ratio").alias("ratio"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, level: list[str], at=(0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of sketches, one row a group and ratio: n_docs and q0, q1, ... A group has a bounded number of buckets."""
    keys = [*level, "ratio"]
    upto = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    value = F.when(F.col("bucket") == -10_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1))
    s = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).withColumn("value", value)
    return s.groupBy(*keys).agg(F.sum("n").alias("n_docs"), *[F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("value"))).alias(f"q{i}") for i, q in enumerate(at)])


def fences(measured: DataFrame, reach: float = 6.0, weight: float = 200.0) -> DataFrame:
    """low_* and high_* per (lang, source): quartiles -+ reach times the spread between them.

    The sketch of a group's language counts in it as weight documents more: a small group follows its language, a large one itself,
    with no size at which the rule changes. The spread counts as at least a fixed width per ratio, so a group of near-equal clean
    documents keeps them all.
    """
    fine = ratio_sketches(measured, ["lang", "source"])
    coarse = fine.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))  # sketches merge by adding
    share = F.lit(float(weight)) * F.col("n") / F.sum("n").over(Window.partitionBy("lang", "ratio"))
    coarse = coarse.select("lang", "ratio", "bucket", share.alias("n"))
    groups = fine.select("lang", "source").distinct()
    lent = groups.alias("g").join(coarse.alias("c"), F.expr("g.lang <=> c.lang")).select("g.lang", "g.source", "c.ratio", "c.bucket", "c.n")
    merged = fine.withColumn("n", F.col("n").cast("double")).unionByName(lent).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    q = quantiles(merged, ["lang", "source"])
    width = F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v[3]))])
    spread = F.greatest(F.col("q2") - F.col("q0"), F.element_at(width, F.col("ratio")) / reach)
    q = q.withColumn("low", F.col("q0") - reach * spread).withColumn("high", F.col("q2") + reach * spread)
    pick = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c)))
    return q.groupBy("lang", "source").agg(*[pick(k, "high").alias(f"high_{k}") for k in RATIOS], *[pick(k, "low").alias(f"low_{k}") for k, v in RATIOS.items() if v[2]])


def _outside():
    bad = [F.col(f"m.{k}") > F.col(f"l.high_{k}") for k in RATIOS] + [F.col(f"m.{k}") < F.col(f"l.low_{k}") for k, v in RATIOS.items() if v[2]]
    outside = bad[0]
    for x in bad[1:]:
        outside = outside | x
    return F.coalesce(outside, F.lit(False))


def quality_rules(docs: DataFrame, measured: DataFrame | None = None, reach: float = 6.0, weight: float = 200.0) -> DataFrame:
    """One row a document: doc_id, lang, source, the counts, base_failed and kept.

    - Null or empty text has no words and fails the base. A null language or source is a group of its own.
    - Repeated rows are judged alike, each one giving a row. Groups in which all documents fail have no fences, and none is needed.
    - A text of any length is measured whole. Groups whose values tie have fences of the least width around them.
    - An empty table gives an empty result; columns other than doc_id, text, lang and source are ignored.

    measured: the result of quality_measures(docs) where the caller has stored it; without it the texts are read twice.
    """
    m = _ratios(quality_measures(docs) if measured is None else measured).alias("m")
    lim = fences(m, reach, weight).alias("l")
    kept = ~F.col("m.base_failed") & ~_outside()
    return m.join(lim, F.expr("m.lang <=> l.lang and m.source <=> l.source"), "left").select(
        *[f"m.{c}" for c in ("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept.alias("kept"))


def keep_good(docs: DataFrame, reach: float = 6.0, weight: float = 200.0) -> DataFrame:
    """The documents that quality_rules keeps, with their columns as they are, whatever their names. The texts are measured once. Nulls, repeats and empty tables are as in quality_rules."""
    whole = packed(docs, _lang=docs["lang"], _source=docs["source"], _text=docs["text"])
    kind = lambda c: whole.schema[c].dataType
    schema = StructType([StructField("row", kind("row")), StructField("lang", kind("_lang")), StructField("source", kind("_source")), *[StructField(x.split()[0], LongType()) for x in MEASURES.split(", ")]])
    measured = whole.select("row", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "_text").mapInArrow(_measured, schema)
    measured = materialize(measured.withColumn("base_failed", _failed()), "measured")
    lim = materialize(fences(measured, reach, weight), "fences").alias("l")
    good = _ratios(measured.where("not base_failed")).alias("m").join(lim, F.expr("m.lang <=> l.lang and m.source <=> l.source"), "left").where(~_outside())
    return good.select("row.*")
