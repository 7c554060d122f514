"""Operators that SQL can't express beside brute force: recall of decontamination, counts of quality rules, repeated runs of pages, quoted passages."""

import collections
import math
import random
import re

from earshot.llm import chat, decontaminate, html_text, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_decontamination_recall(spark):
    """Items with words changed, left out or put in, within noise: nearly all that are similar enough by brute force are found, and no others."""
    r = random.Random(11)
    items = [[f"q{r.randrange(400)}" for _ in range(r.randrange(30, 90))] for _ in range(25)]
    weight = collections.Counter(s for w in items for s in shingles(w))
    w = lambda s: math.log1p(len(items) / weight[s]) if weight[s] else math.log1p(len(items))
    texts, want = [], set()
    for k in range(160):
        i = r.randrange(len(items))
        words = list(items[i])
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [f"z{r.randrange(99)}"] * r.randrange(2)
        head = [f"n{r.randrange(900)}" for _ in range(r.randrange(40))]
        text = head + words + [f"n{r.randrange(900)}" for _ in range(20)]
        texts.append(" ".join(text))
        own, m = shingles(items[i]), len(items[i])
        best = 0.0
        for a in range(max(1, len(text) - m + 1)):
            other = shingles(text[a : a + m])
            both = sum(min(n, other[s]) * w(s) for s, n in own.items())
            best = max(best, both / (sum(n * w(s) for s, n in own.items()) + sum(n * w(s) for s, n in other.items()) - both))
        if best >= 0.8:
            want.add((k, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 40 and got <= want and len(got & want) >= 0.95 * len(want)


def counts(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(3)
    texts = [None, "", "\x0b \n", "a b c", "a b c a b c", "#&\n#&\n\n#&"]
    texts += ["".join(r.choice(["a", "b", "é", "語", " ", " ", "\n", "\t", "#", "|"]) for _ in range(r.randrange(400))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.quality_rules(docs.union(docs.where("doc_id = 4"))).collect()}
    for i, t in enumerate(texts):
        n = counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == n
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (got[i].base_failed and got[i].kept)


def test_runs_that_pages_share_go(spark):
    """Pages without articles: what three contents of a host share for eight tokens goes, wherever its blocks are cut, and only on that host."""
    r = random.Random(9)
    shared = [" ".join(f"m{k}x{i}" for i in range(r.randrange(6, 14))) for k in range(6)]
    pages = []
    for i in range(60):
        blocks = [shared[k] for k in range(6) if r.random() < 0.12] + [" ".join(f"u{i}x{j}" for j in range(r.randrange(3, 9)))]
        r.shuffle(blocks)
        pages.append((i, f"http://h{i % 2}/{i}", blocks))
    streams = {i: " ".join(b).split() for i, _, b in pages}
    of_host = lambda h: {tuple(streams[i]) for i, u, _ in pages if u[8] == h}
    often = {h: collections.Counter(x for s in of_host(h) for x in {s[k : k + 8] for k in range(len(s) - 7)}) for h in "01"}
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame([(i, u, "".join(f"<p>{b}</p>" for b in bs)) for i, u, bs in pages], "page_id long, url string, html string")).collect()}
    changed = 0
    for i, u, blocks in pages:
        s = streams[i]
        hit = {k + j for k in range(len(s) - 7) if often[u[8]][tuple(s[k : k + 8])] >= 3 for j in range(8)}
        at, want = 0, []
        for b in blocks:
            words = b.split()
            flags = [at + k in hit for k in range(len(words))]
            at += len(words)
            keep, k = [], 0
            while k < len(words):
                e = k
                while e < len(words) and flags[e] == flags[k]:
                    e += 1
                if not flags[k] or e - k < min(8, len(words)):
                    keep += words[k:e]
                k = e
            want += [" ".join(keep)] if keep else []
        changed += want != blocks
        assert got[i] == "\n\n".join(want)
    assert changed > 5


def test_lost_texts_of_markup(spark):
    cases = {
        "<p title=it's>Hello there</p><p>more</p><p>don't go</p>": "Hello there\n\nmore\n\ndon't go", "<main><p>lead</p><article>teaser</article><p>tail</p></main>": "lead\n\nteaser\n\ntail",
        "<form><nav>m</nav><h1>Head</h1><p>inside<input name=q></form>": "Head\n\ninside", "<form><label>Name</label></form><p>out": "out", "a < b & c<p>x": "a < b & c\n\nx"}
    rows = [(i, "http://h", k) for i, k in enumerate(cases)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_quotes_and_reply_order(spark):
    """Conversations by rule: messages of unlike words, replies that quote whole lines of an earlier message or go on."""
    r = random.Random(6)
    rows, parent, quoted = [], {}, {}
    for c in range(12):
        said = []
        for t in range(r.randrange(2, 14)):
            own = [" ".join(f"w{r.randrange(10_000)}" for _ in range(r.randrange(5, 9))) for _ in range(2)]
            text = list(own)
            parent[c, t] = t - 1 if t else None
            if t > 1 and r.random() < 0.5:
                q = r.randrange(t)
                text = [f"> {x}" for x in said[q]] + own
                parent[c, t], quoted[c, t] = q, q
            said.append(own)
            rows.append((c, t, "a", "\n".join(text)))
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(x.conv_id, x.turn): x.parent_turn for x in got} == parent and all(x.root_turn == 0 for x in got)
    children = collections.defaultdict(list)
    for (c, t), p in parent.items():
        children[c, p].append(t)

    def walk(c, t):
        yield t
        for x in sorted(children[c, t]):
            yield from walk(c, x)

    def depth(c, t):
        return 0 if t is None else ((c, t) in quoted) + depth(c, parent[c, t])

    for c in range(12):
        own = [x for x in got if x.conv_id == c]
        order = [x.turn for x in own]
        assert all(order.index(x.parent_turn) < order.index(x.turn) for x in own if x.parent_turn is not None)
        assert {x.turn: x.depth for x in own} == {x.turn: depth(c, x.turn) for x in own}
        assert len(own) == len(set(order)) and order[0] == 0
