"""Phrases beside counts of all n-grams of a small table."""

import random
import re
from collections import Counter

import pytest

from earshot.llm import collocations as co

TOP = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, top, longest, least):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().translate(TOP).decode()):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, *w[i : i + k]] += 1
    cand = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[1:][i : i + k]) for p, b in cand.items() for k in range(2, len(p) - 1) for i in range(len(p) - k) if 100 * b >= 100 * count[(p[0], *p[1:][i : i + k])]}
    out = {}
    for p, a in cand.items():
        if p in covered:
            continue
        cuts = [(1000 * a * total[p[0]] // (count[p[: k + 1]] * count[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), count[p[: k + 1]], count[(p[0], *p[k + 1 :])]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", "k", 2, "s") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, part long, piece string, key string, n long, size string")


@pytest.mark.parametrize(("part_bytes", "least", "top", "longest"), [(1 << 22, 5, 2000, 5), (300, 2, 2000, 5), (900, 3, 3, 4)])
def test_as_all_counts_say(spark, part_bytes, least, top, longest):
    r = random.Random(least)
    words = ["a", "b", "The", "the", "Ünd", "und", "日本", "x" * 300, "é", "c-d", " ", "#", "q\x1cr"]
    line = lambda: "".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", ",", "\n", " \n ", "\r\n", "\x0b"]) for _ in range(r.randrange(0, 25)))
    rows = [(r.choice(["en", "de", None, "", "e\nn"]), line()) for _ in range(150)] + [("en", None), (None, None), ("en", ""), ("en", " ... ")]
    rows += [("en", "only here in the end. a b a b a b a")] * 7 + [("de", "ein langer Satz ohne Ende " * 40)]
    got = co.collocations(table(spark, rows), top, longest, least, part_bytes).collect()
    want = brute(rows, top, longest, least)
    assert sorted(map(tuple, got)) == want and want


def test_counts_past_64_bits(spark):
    big = 3_000_000_000
    totals = {b"en\n": 40 * big, b"en\na": big, b"en\nb": big, b"en\na b": big}
    assert co.scored(b"en\na b", totals.__getitem__) == (big, big, big, 40 * big, 40_000)
    assert co.scored(b"e\nn\na b c", {b"e\nn\n": 100, b"e\nn\na": 10, b"e\nn\nb c": 10, b"e\nn\na b": 20, b"e\nn\nc": 5, b"e\nn\na b c": 1}.__getitem__) == (1, 10, 10, 100, 1000)  # a tie: the first cut


def test_edges(spark):
    assert co.collocations(table(spark, []), longest=3).collect() == []
    assert co.collocations(table(spark, [("en", None), (None, "")])).collect() == []
    long = "w " * 300_000
    got = co.collocations(table(spark, [("en", long)])).collect()  # one piece of one word, over and over
    assert [(g.phrase, g.a) for g in got] == [(" ".join(["w"] * k), 300_001 - k) for k in range(2, 6)]


def test_a_small_bucket_spills_and_stays_exact(spark, monkeypatch):
    rows = [("en", f"a{i % 700} b{i % 700} c") for i in range(3000)]
    want = brute(rows, 2000, 5, 3)
    real = co._answered
    monkeypatch.setattr(co, "_answered", lambda least, memory: real(least, "16MB"))
    assert sorted(map(tuple, co.collocations(table(spark, rows), least=3, part_bytes=2000).collect())) == want


def test_parts_ask_a_number_of_buckets_that_grows_slower_than_they_do(spark, monkeypatch):
    r = random.Random(7)
    rows = [("en", ". ".join(" ".join(f"w{r.randrange(400)}" for _ in range(12)) for _ in range(40))) for _ in range(160)]
    asked, real = [], co.materialize

    def written(df, name):
        out = real(df, name)
        if name == "pieces":
            asked.append(out.where("bucket is not null").groupBy("part").count().collect())
        return out

    monkeypatch.setattr(co, "materialize", written)
    got = co.collocations(table(spark, rows), least=5, part_bytes=3000).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2000, 5, 5) and got
    (parts,) = asked
    assert len(parts) > 100 and max(p["count"] for p in parts) <= 32  # before, two for each of the more than 100 parts


def test_phrases_of_one_hash_are_counted_apart(monkeypatch):
    mixed = co._mixed
    monkeypatch.setattr(co, "_mixed", lambda words: mixed(words) % co._U(3))
    part = co.Part(["de", "en"], [b"a b a b\nb a", b"a b c\na b\n\nb a b"])
    all_ = part.hashes((2,))[0]
    _, _, keys, n = part.counted(2, all_)
    found = Counter()
    for key, m in zip(keys, n.tolist(), strict=True):
        found[key] += m
    assert found == {b"de\na b": 2, b"de\nb a": 2, b"en\na b": 3, b"en\nb c": 1, b"en\nb a": 1}


def test_a_long_text_is_cut_between_pieces():
    text = b"\n".join([b"a b", b"", b"c" * 30, b"d e f"])
    assert list(co._shares(text, 8)) == [b"a b\n", b"c" * 30, b"d e f"] and b"\n".join(co._shares(text, 8)) == text
    assert list(co._shares(b"x" * 20, 8)) == [b"x" * 20] and list(co._shares(b"", 8)) == [b""]


def test_blocks_come_back_as_they_were():
    h = co.np.array([3, 5, 1 << 40, (1 << 48) - 1], dtype=co.np.uint64)
    n = co.np.array([1, 2, 70_000, 9])
    first, second = map(co._unpacked, co._blocks(h, n, co.np.array([0, 1, 4])))
    assert [first[0].tolist(), second[0].tolist()] == [[3], [5, 1 << 40, (1 << 48) - 1]] and [*first[1], *second[1]] == n.tolist()


def test_rows_of_one_partition_are_dealt_out(spark, monkeypatch):
    r = random.Random(9)
    rows = [(r.choice(["en", "de"]), " ".join(r.choice("abcdef") for _ in range(30))) for _ in range(60)]
    found, real = [], co.materialize

    def written(df, name):
        out = real(df, name)
        found.extend({p["part"] >> 32 for p in out.select("part").distinct().collect()} if name == "pieces" else ())
        return out

    monkeypatch.setattr(co, "materialize", written)
    got = co.collocations(table(spark, rows).coalesce(1), least=4, part_bytes=200).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2000, 5, 4) and got and len(found) > 4
