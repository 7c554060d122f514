"""The operators beside brute force, on small tables with nulls, ties, repeats, empty and long texts, and clashing columns."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest

from earshot.llm import chat, decontaminate, html_text, jaccard, language_model, line_dedup, mixing, quality, url_filter, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, token long"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)], SCHEMA)


def some_texts(seed=3, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(1, 120))]
        out.append(" ".join(w))
        for _ in range(r.randrange(3)):
            v = list(w)
            for _ in range(r.randrange(4)):
                v[r.randrange(len(v))] = f"x{r.randrange(9)}"
            out.append("  ".join(v).upper() if r.random() < 0.2 else "\t".join(v))
    return [*out, None, "", " \n ", "a b", "A  B", "a b c d e f " * 4000]


def test_html(spark):
    page = "<!DOCTYPE html><head><title>T</title></head><body><nav>menu</nav><div class='ad big'>buy</div><article><h1>Head &amp; more</h1><p><b>One\n two<p>three<br>four<div class=\"comments\"><p>reader</p></div><script>x='</p>'</script></article><footer>f"
    assert [t for t, z in html_text.blocks(page) if z == html_text.ARTICLE] == ["Head & more", "One two", "three four"]
    plain = [f"<body><div>{'the same old words in a row every single time here'}</div><p>unique {i} text</p>" for i in range(4)]
    rows = [(i, "http://h/x", p, 9) for i, p in enumerate([page, None, "", "no tags &lt;at all", "<p>cut <b"])] + [(9 + i, "http://g/x", p, 9) for i, p in enumerate(plain)] + [(None, None, "<p>z", 9)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[0].text == "Head & more\n\nOne two\n\nthree four" and got[0].n_chars == len(got[0].text)
    assert [got[k].text for k in (1, 2, 3, 4, None)] == ["", "", "no tags <at all", "cut", "z"]
    assert got[10].text == "unique 1 text"


def test_warc_round_trip_in_small_ranges(spark, tmp_path):
    r = random.Random(1)
    noise = "".join(chr(r.randrange(32, 0x2FF)) for _ in range(30_000))
    pages = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u\r\nX: y", "\r\n\r\nother"), (4, "e", None), (6, "e", ""), (7, "n", noise), (None, "n", "same"), (5, "http://b", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h in pages), key=key)
    for split in (97, 1 << 20):
        assert sorted(map(tuple, warc.archive_digests(df, split=split).collect()), key=key) == want
    assert warc.archive_digests(df.where("false")).collect() == []


def test_archives_lie_where_spark_has_its_files_and_go(spark, tmp_path):
    from earshot.llm.common import shared_dir

    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    shared = os.path.normpath(shared_dir(spark).removeprefix("file:"))
    before = set(os.listdir(shared))
    assert warc.archive_digests(df).count() == 1
    assert not [f for f in set(os.listdir(shared)) - before if f.startswith("warc-")]
    assert warc.archive_digests(df, f"{tmp_path}/own").count() == 1 and os.listdir(f"{tmp_path}/own")
    conf, key = spark._jsc.hadoopConfiguration(), "fs.defaultFS"
    was = conf.get(key)
    conf.set("fs.viewfs.mounttable.other.link./x", f"file://{tmp_path}")
    conf.set(key, "viewfs://other/")
    try:
        with pytest.raises(ValueError, match="can't reach viewfs://other/x/y"):
            warc.archive_digests(df, "/x/y")
    finally:
        conf.set(key, was)
    assert not os.path.exists(f"{tmp_path}/y")


def test_tables_of_one_pipeline_are_its_own(spark):
    import threading

    from earshot.llm.common import materialize, tables_of

    there = lambda df: os.path.exists(os.path.dirname(df.inputFiles()[0]).removeprefix("file://").replace("file:", ""))
    made, inside, done = {}, threading.Event(), threading.Event()

    def other():
        with tables_of(spark) as keep:
            made["other"] = materialize(spark.range(3), "other")
            inside.set()
            done.wait(60)
            keep.append(made["other"])

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with pytest.raises(KeyError), tables_of(spark):
        made["lost"] = materialize(spark.range(3), "lost")
        path = os.path.dirname(made["lost"].inputFiles()[0])
        raise KeyError
    assert not os.path.exists(path.replace("file://", "").replace("file:", ""))
    with tables_of(spark) as keep:
        made["kept"], made["gone"] = materialize(spark.range(3), "kept"), materialize(spark.range(3), "gone")
        gone = os.path.dirname(made["gone"].inputFiles()[0])
        keep.append(made["kept"])
    assert there(made["kept"]) and there(made["other"]) and not os.path.exists(gone.replace("file://", "").replace("file:", ""))
    done.set()
    thread.join()
    assert there(made["other"]) and made["other"].count() == 3


def test_long_words_cost_what_they_are_long(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    texts = {i: "some plain words that all texts have in common, again and again" for i in range(60)}
    for i, n in zip(ids, (400, 800, 3200), strict=True):
        texts[i] = "zq" * (n // 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score(docs).collect()}
    a, b, c = (got[i].score for i in ids)
    assert c < 1.5 * b < 2 * a < 0 and c < -400
    assert all(got[i].bits_per_byte > 0.05 for i in ids)


def test_decontamination(spark):
    r = random.Random(5)
    item = [" ".join(f"q{r.randrange(50)}" for _ in range(n)) for n in (20, 33, 3)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*item, None, ""])], "item_id long, text string, w int")
    noise = " ".join(f"n{r.randrange(90)}" for _ in range(80))
    broken = item[1].split()
    broken[0] = "zzz"
    texts = [noise, noise + " " + item[0].upper() + " " + noise, "\n".join(broken), item[2], item[2] + " more", None, "", noise + item[1][:40]]
    docs = documents(spark, texts)
    got = {(x.doc_id, x.item_id, x.start) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0, 80), (2, 1, 0), (3, 2, 0)}
    assert sorted(x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()) == [0, 4, 5, 6, 7]
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_lines(spark):
    docs = documents(spark, ["a\nb\nc\nd", "x\na\nb\n\nc\ny", None, "", "a\nb", "p\nq\nr\np\nq\nr"])
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {0: ("a\nb\nc\nd", 0), 1: ("x\ny", 4), 2: (None, 0), 3: ("", 0), 4: ("a\nb", 0), 5: ("p\nq\nr", 3)}


def test_language_model(spark):
    texts = [*some_texts(9, 80), None]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in language_model.score(docs, share=0.005).collect()}
    tokens = {i: [*WORDS.findall((t or "").translate(LOW)), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-6)
        assert r.score < 0 and r.n_bytes == len((texts[i] or "").encode()) and (r.bits_per_byte is None) == (not r.n_bytes)
    assert language_model.score(docs.where("false")).collect() == []


def test_language_model_gains_where_all_words_are_known(spark):
    """Four invented languages: what came before tells which words may come, which the base can't know."""
    r = random.Random(8)
    words = [[f"{chr(97 + 6 * k)}{a}{b}" for a in "aeiouy" for b in "lmnrst"] for k in range(4)]
    texts = [" ".join(r.choice(words[i % 4]) for _ in range(60)) for i in range(400)]
    got = [x for x in language_model.score(documents(spark, texts)).collect() if x.held_out and x.n_known == x.n_tokens]
    assert len(got) > 40
    gain = sum(x.score - x.base_score for x in got) / sum(x.n_tokens for x in got)
    assert gain > 0.35  # a quarter of the words are possible: log10(4) is 0.6


def _model(alphabet, rows):
    import pyarrow as pa

    from earshot.llm.mixing_model import Counts, Gathered, counted, gathered

    column = pa.array(rows, pa.binary())
    got = pa.Table.from_batches(list(counted(alphabet)([pa.RecordBatch.from_arrays([column], names=["symbols"])])))
    table = pa.Table.from_batches(list(gathered(got.sort_by([("ctx", "ascending"), ("sym", "ascending")]).to_batches(max_chunksize=1000))))
    first = alphabet.first_gathered()
    low = [c.as_py() < first for c in table.column("ctx")]
    return Gathered(alphabet, Counts(alphabet, table.filter(pa.array(low))), Counts(alphabet, table.filter(pa.array([not x for x in low])))), table


def test_bits_count_every_context_and_symbols_add_up_to_one():
    import numpy as np

    from earshot.llm.mixing_model import Alphabet, Counts, Dense

    r = np.random.default_rng(6)
    rows = [r.integers(0, 128, n).astype(np.uint8).tobytes() for n in (9, 0, 20_000, 3000, 1)]
    symbol, edge = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in rows]).astype(np.int64), np.cumsum([0, *map(len, rows)])
    alphabet = Alphabet(7, 95, ((), (1,), (1, 2), (2, 3), (1, 2, 3)), 2)
    keys = alphabet.keys(symbol, edge)
    want = collections.Counter(zip(np.concatenate(keys).tolist(), np.tile(symbol, len(keys)).tolist(), strict=True))
    gathered, table = _model(alphabet, rows)
    counts = Counts(alphabet, table)
    for k in keys:
        n, back = counts.paths(k[:300], symbol[:300])
        assert [int(n[back[i], 7]) for i in range(300)] == [want[int(k[i]), int(symbol[i])] for i in range(300)]
        assert [int(n[back[i], 2]) for i in range(40)] == [sum(want[int(k[i]), s] for s in range(128) if s >> 5 == symbol[i] >> 5) for i in range(40)]
    places = language_model.contexts(np.arange(128) % 16)
    keys = np.concatenate([k << 7 | symbol for k in places(symbol, edge)])
    key, n = np.unique(keys, return_counts=True)
    dense = Dense(7, places, Dense.tables(7, language_model.ROWS, key, n), len(language_model.SIZES), 2)
    for model in (gathered, dense):
        model.learn(symbol, edge)
        for past in ([], [3], [3, 99, 7], [int(x) for x in symbol[:5]]):
            total = sum(10 ** model.log10(np.array([*past, s]), np.array([0, len(past) + 1]))[-1] for s in range(128))
            assert abs(total - 1) < 1e-5
    copy = Dense(7, places, (dense.stretch, dense.n), len(language_model.SIZES), 2)
    copy.restore(dense.state())
    assert np.allclose(copy.log10(symbol[:500], np.array([0, 500])), dense.log10(symbol[:500], np.array([0, 500])))


def test_spelling_learns():
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    word = lambda: "".join(r.choice(["ing", "er", "th", "on"]) for _ in range(r.randrange(1, 4))).encode() + b" "
    known = sorted({word() for _ in range(400)})
    model, _ = _model(language_model.SPELLED, known)
    symbol = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in known]).astype(np.int64)
    model.learn(symbol, np.cumsum([0, *map(len, known)]))
    good, bad = model.row_scores(pa.array([b"thoning ", b"qzxv "], pa.binary()))
    assert good > -4 and bad < good - 3


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there.\nSecond line, here"), (1, 1, "assistant", "Fine reply"), (1, 2, "user", "On Monday A wrote:\n> Hello there\n>> nothing\nmy answer"), (1, 3, "user", "> Fine reply\n>> second line here\nok\n"), (2, 0, "user", None), (None, 1, "user", "> Fine reply"), (1, 600, "user", "> hello THERE"), (1, 601, "user", "> ...")]
    got = {(r.conv_id, r.turn): r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].parent_turn for t in (0, 1, 2, 3, 600, 601)] == [None, 0, 0, 1, 0, 600]
    assert [got[1, t].text for t in (2, 3, 600)] == ["my answer", "ok", ""]
    assert got[1, 3].n_linked == 2 and got[1, 2].n_linked == 1 and got[None, 1].parent_turn is None and got[2, 0].text == ""


def test_chat_links_passages_across_lines(spark):
    said = "It was late when we came. The old boat had left the harbour\nand nobody knew where it went. ok"
    rows = [(1, 0, "a", said), (1, 1, "b", "ok"), (1, 2, "a", "Well, ok"), (1, 3, "b", "> the old boat had left the\n> harbour and nobody\n> knew\nTrue"), (1, 4, "a", "> The old boat had left\nno"), (1, 5, "b", "> where it went.\n> ok\n\n> it was early\nyes"), (1, 6, "a", "> old boat harbour nobody\nno")]
    got = {r.turn: r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].parent_turn for t in range(7)] == [None, 0, 1, 0, 0, 0, 5]
    assert [(got[t].n_quotes, got[t].n_linked) for t in range(3, 7)] == [(3, 3), (1, 1), (3, 2), (1, 0)]


def test_urls(spark):
    events = spark.sql("""select list_name, key, kind, action, date(at) at from values ('l','a.org','block','add','2024-01-10'),('l','a.org','block','remove','2024-02-01'),('l','a.org','block','add','2024-03-01'),
      ('m','x.a.org/ok','allow','add','2024-01-01'),('l',null,'block','add','2024-01-01'),('l','a.org','block','add','2024-01-10') as t(list_name,key,kind,action,at)""")
    seen = [("http://a.org/", "2024-01-09"), ("http://a.org/", "2024-01-10"), ("https://u@X.a.org:80/p?q", "2024-01-31"), ("http://a.org", "2024-02-01"), ("http://x.a.org/ok/deep#f", "2024-03-05"), ("http://ba.org/", "2024-03-05"), (None, "2024-03-05"), ("http://a.org/", None), ("nonsense", "2024-03-05")]
    df = spark.createDataFrame([(i, u, d, True) for i, (u, d) in enumerate(seen)], "i int, url string, d string, blocked boolean").selectExpr("i", "url", "date(d) fetched_at", "blocked")
    got = {r.i: r for r in url_filter.filter_urls(df.union(df.where("i = 1")), events).collect()}
    assert [got[i].blocked for i in range(9)] == [False, True, True, False, False, False, False, False, False]
    assert got[4].matched_key == "x.a.org/ok" and got[4].n_active == 2


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(40), f"s{i % 4 if i % 3 else 0}") for i in range(400)] + [(None, None, None), (7, "w w", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert sum(x.taken for x in own) == math.floor(own[0].target + 1e-6) and all(0 <= x.taken <= 2 * x.size for x in own)


def test_quality(spark):
    r = random.Random(4)
    good = [" ".join(f"word{r.randrange(3000)}" for _ in range(100)) for _ in range(250)]
    bad = ["###" + " ### &&&".join(good[0].split()), "a b c " * 100, None, "", "too short"]
    docs = documents(spark, [*good, *bad])
    got = {x.doc_id: x for x in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(250)) and not any(got[250 + i].kept for i in range(5))
    assert [got[250 + i].base_failed for i in range(5)] == [False, True, True, True, True]
    assert sorted(x.doc_id for x in quality.keep_good(docs).collect()) == list(range(250))
