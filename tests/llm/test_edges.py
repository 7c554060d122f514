"""Every operator and pipeline stage on nulls in all columns, empty tables, repeats, ties, one very long text, and columns of the caller's that clash with names inside."""

import pytest

import corpus_pipeline
from earshot.llm import chat, decontaminate, html_text, jaccard, language_model, line_dedup, mixing, quality, url_filter, warc

EXTRA = "rid _rid _l _a _c _t _starts _row row n id at lines starts covered cut cls h word part key host u f _text _lang path kept".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = " ".join(f"w{k % 9973}" for k in range(300_000))
TEXTS = ["a b c d e f g", "a b c d e f g", "x\ny z\nb\nq", "x\ny z\nb\nq", None, "", " \n ", "one", LONG, "some words " + " ".join(f"v{k}" for k in range(80))]


def docs(spark, rows=None):
    rows = [(i // 2, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, t, None, None) for t in TEXTS] + [(3, "a b c d e f g", None, "s")] * 3 if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], DOCS)


def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g", "r"), (None, "a b c d e f g", "r"), (2, None, "r"), (3, "", "r")], "item_id long, text string, rid string")


def pages(spark, rows=None):
    rows = [(1, "http://h/x", "<p>a"), (1, "http://h/x", "<p>a"), (None, None, None), (2, None, ""), (3, "u", "<p>" + LONG), (4, "http://h", "<p>a")] if rows is None else rows
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in EXTRA))


def talks(spark, rows=None):
    rows = [(1, 0, "a", "hello there my friend"), (1, 0, "a", "hello there my friend"), (1, 1, "b", "> hello there my friend\nyes"), (None, None, None, None), (1, None, "a", "x"), (2, 0, "a", ""), (2, 1, "b", LONG)] if rows is None else rows
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in EXTRA))


def captures(spark, rows=None):
    rows = [("http://a.org/x", "2024-01-02")] * 2 + [(None, "2024-01-02"), ("http://a.org/x", None), ("http://b.org/" + "p/" * 2000, "2024-01-02")] if rows is None else rows
    d = spark.createDataFrame([(*r, *EXTRA) for r in rows], "url string, d string, " + ", ".join(f"{c} string" for c in EXTRA))
    return d.withColumn("fetched_at", d.d.cast("date"))


def events(spark):
    return spark.sql("select 'l' list_name, 'a.org' key, 'block' kind, 'add' action, date('2024-01-01') at union all select null, null, null, null, null")


WHOLE = {
    "op1": (docs, lambda s, d: jaccard.near_components(d), 1), "op2": (pages, lambda s, d: html_text.main_text(d), 1), "op3": (pages, lambda s, d: warc.archive_digests(d), 1),
    "op4": (docs, lambda s, d: mixing.mix(d), 1), "op6": (docs, lambda s, d: line_dedup.line_dedup(d), 1), "op7": (docs, lambda s, d: language_model.score(d), 1), "op8": (talks, lambda s, d: chat.reply_order(d), 1),
    "op9": (captures, lambda s, d: url_filter.filter_urls(d, events(s)), 1), "op10": (docs, lambda s, d: quality.quality_rules(d), 1), "op5": (docs, lambda s, d: decontaminate.contaminated(d, bench(s)), 0),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_operator_on_edges(spark, name):
    table, run, whole = WHOLE[name]
    given = table(spark)
    got = run(spark, given).collect()
    assert got and (not whole or len(got) == given.count())
    assert run(spark, table(spark, [])).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_edges(spark, tmp_path, k):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    given = docs(spark)
    got = stage(spark, given, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == given.columns
        assert all([r[c] for c in EXTRA] == EXTRA for r in got.collect())
    assert len(got.collect()) <= given.count()
    assert stage(spark, docs(spark, []), str(tmp_path)).collect() == []


def test_stage_results(spark, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda rows: sorted(rows, key=str)
    # Line dedup: the first by (id, nulls first) keeps its lines.
    cut = [(r.doc_id, r.text, r.n_chars) for r in stages["line dedup"](spark, docs(spark), str(tmp_path)).where("text like 'x%' or text = ''").collect()]
    assert plain(cut) == plain([(1, "", 0), (1, "", 0), (2, "", 0), (None, "x\ny z\nb\nq", 9), (None, "x\ny z\nb\nq", 9), (None, "", 0)])
    near = stages["n-gram Jaccard join"](spark, docs(spark), str(tmp_path)).collect()
    assert plain((r.doc_id, (r.text or "")[:9]) for r in near if r.text and r.text.strip()) == plain([(0, "a b c d e"), (1, "x\ny z\nb\nq"), (3, "one"), (4, "w0 w1 w2 "), (4, "some word")])
    clean = stages["benchmark decontamination"](spark, docs(spark), str(tmp_path)).collect()
    assert not [r for r in clean if r.text == "a b c d e f g"] and len(clean) == docs(spark).count() - 7
