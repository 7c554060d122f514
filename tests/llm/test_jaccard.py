"""The n-gram Jaccard join beside brute force: components and numbers of links, with hot lists, large groups and rows that share ids."""

import collections
import random
import re

import pytest

from earshot.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """Root (least place) and number of partners of each text."""
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root, links


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(99)}"
    return " ".join(words)


def groups(seed):
    """Near copies of a few texts at all distances, some of them very alike, with passages that many share."""
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    out = []
    for size, edits in ((40, 3), (25, 1), (30, 6), (12, 2)):
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(60, 140))]
        out += [edited(r, base, r.randrange(edits + 1)) for _ in range(size)]
    out += [passage + " " + " ".join(f"v{r.randrange(900)}" for _ in range(r.randrange(4, 40))) for _ in range(40)]
    r.shuffle(out)
    return out


def check(spark, texts, ids, once=True, **how):
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, rid string")
    got = jaccard.near_components(docs, **how).collect()
    root, links = brute(texts)
    assert len(got) == len(texts)
    full = [i for i, t in enumerate(texts) if shingles(t)]
    least = {r: min((ids[i] for i in full if root[i] == r and ids[i] is not None), default=None) for r in {root[i] for i in full}}
    want = sorted(((ids[i], len(shingles(t)), least[root[i]] if i in full else ids[i], links[i]) for i, t in enumerate(texts)), key=str)
    assert sorted(((g.doc_id, g.n_shingles, g.component_id, g.n_links) for g in got), key=str) == want
    if not once:
        return
    kept = jaccard.one_of_each(docs, **how).collect()
    assert len(kept) == len({root[i] for i in full}) + len({(ids[i], texts[i]) for i in range(len(texts)) if i not in full} if None in texts or "" in texts else [i for i in range(len(texts)) if i not in full])
    assert not kept or kept[0].__fields__ == docs.columns


@pytest.mark.parametrize("part,block,pivot", [(2048, 32, 0.25), (7, 4, 0.25), (7, 4, 0.0)])
def test_links_equal_brute_force(spark, monkeypatch, part, block, pivot):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "CELL", part)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOT", pivot)
    texts = [*groups(1), "a b", "A  B", "a b c"]
    check(spark, texts, list(range(len(texts))), once=False, share=0.05)


def test_repeats_shared_and_null_ids(spark):
    texts = groups(2)[:70]
    texts += texts[:20]
    check(spark, texts, [None if i % 3 == 0 else i // 4 for i in range(len(texts))], share=0.02)


def test_no_rows_and_rows_without_words(spark):
    check(spark, [], [])
    check(spark, [None, "", " \n ", "a"], [1, 2, 3, 4])


def test_long_text_and_large_group_of_copies(spark):
    long = " ".join(f"w{k % 7919}" for k in range(800_000))
    docs = spark.range(3000).selectExpr("id doc_id", "'a b c d e f g h' text").union(spark.createDataFrame([(9000, long), (9001, long + " end")], "doc_id long, text string"))
    got = collections.Counter((r.component_id, r.n_links) for r in jaccard.near_components(docs).select("component_id", "n_links").collect())
    assert got == {(0, 2999): 3000, (9000, 1): 2}
