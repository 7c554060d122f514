"""From raw documents to a training mix: each stage reads what the one before has written.

In every stage a null text is an empty one, a null doc_id, lang or source a value like others, rows that repeat are rows, texts are taken whole at any
length, no documents give no rows, and columns beside those of documents come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import decontaminate, jaccard, line_dedup, mixing, quality
from earshot.llm.common import discard, materialize, read, tables_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules: an empty text has no words and goes; values on a fence stay."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of windows that occurred before: the copy of least doc_id (null first) keeps its lines, and a text may end up empty."""
    return line_dedup.line_dedup(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id; texts without words have none, so all of them stay."""
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; an item without words is in none."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words that it takes of each, repeats counted: one row a document from which it takes any, without the texts, which are those of the stage before. Documents of one key go by doc_id, then size."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", benchmark_stage), ("mixing sources", mix_stage)]

#: Hashing of shingles, sketches and checkpoints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. Tables that a stage wrote on its way go once its result is stored."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with tables_of(spark) as keep:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{k}")
            keep.append(docs)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
