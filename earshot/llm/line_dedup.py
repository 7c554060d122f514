"""Line dedup by overlapping three-line windows.

Consecutive lines are hashed three at a time, windows that occur more than once anywhere are found by one aggregation,
and every occurrence but the first gives up its lines; overlapping windows merge into one covered stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed

WINDOW = 3
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _rid(docs: DataFrame):
    return F.xxhash64(docs["doc_id"], docs["text"])


def _with_words(lines):
    """Places of the lines that hold a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_HAS_WORD))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """The later occurrences of windows found more than once: id, rid, and the sorted positions starts of a document."""
    at = lambda k: F.get("lines", F.get("at", F.col("pos") + k))
    wide = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), _rid(docs).alias("rid"), F.split(F.col("text"), "\n", -1).alias("lines"))
    wide = wide.withColumn("at", _with_words(F.col("lines"))).where(F.size("at") >= WINDOW)
    windows = wide.select("id", "rid", "lines", "at", F.explode(F.sequence(F.lit(0), F.size("at") - WINDOW)).alias("pos")).select(
        "id", "rid", "pos", F.xxhash64(*[at(k) for k in range(WINDOW)]).alias("h1"), F.xxhash64(F.lit(1), *[at(k) for k in range(WINDOW)]).alias("h2"))
    windows = materialize(windows, "windows")  # texts are split and hashed once
    place = F.struct("id", "rid", "pos")
    seen = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(seen, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text (and n_chars where there is such a column) after the cut, and n_removed_lines, long.

    - Lines are the parts of the text between \\n; only lines with a word enter windows, blank ones between the lines of
      a removed window go with it. Documents with fewer than three such lines have no window and stay as they are.
    - The first occurrence is the least (doc_id, nulls first; then row hash; then position). Rows equal in doc_id and
      text are one document and share its outcome, so exact repeats of a row stay alike.
    - Null text stays null, empty text stays empty, with 0 lines removed. An empty table gives an empty result. A text of any length is
      one task's row; its windows are dealt out.
    - Other columns pass through unchanged, whatever their names; a column n_removed_lines of the caller's is replaced.
    """
    hits = repeated_windows(docs).alias("h")
    own = packed(docs, id=docs["doc_id"], rid=_rid(docs)).alias("d")
    both = own.join(hits, (F.col("d.rid") == F.col("h.rid")) & F.col("d.id").eqNullSafe(F.col("h.id")), "left").select("row", "starts")
    hit = F.col("starts").isNotNull()
    both = both.withColumn("lines", F.when(hit, F.split(F.col("row.text"), "\n", -1)))
    both = both.withColumn("at", F.when(hit, _with_words(F.col("lines"))))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(F.get("at", p), F.get("at", p + (WINDOW - 1))))))
    both = both.withColumn("covered", covered)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    both = both.withColumn("cut", F.when(hit, F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("row.text")))
    new = {"text": F.col("cut"), "n_chars": F.when(hit, F.char_length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    columns = [c for c in docs.columns if c != "n_removed_lines"]
    return both.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns], F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed_lines"))
