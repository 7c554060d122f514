"""The audit of filters beside one that applies them one after the other."""

import itertools
import random
import re

from earshot.llm import filter_audit as fa

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(rows):
    """The set of failed filters of each row (doc_id, text)."""
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows) else set()
        out.append(f)
    return out


def brute(rows, labels):
    failed = fails([(i, t) for i, t, _ in rows])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = [], {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                all_fail = sum(x in f for _, f in mine)
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), all_fail - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), []
        seen.append(tuple(order))
        for k in fa.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_as_the_filters_one_after_the_other(spark):
    r = random.Random(5)
    many = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    texts = [None, "", " \n", "one", "ONE TWO", "a # b", many(250, 10_000), many(250, 60), many(199, 10_000), many(200, 10_000), many(300, 40) + " $", "A" * 3 + " " + many(220, 5000), "É" * 90 + "AA", many(20_000, 50), "a\x0bb\x0cc"]
    texts += [texts[6], texts[7], "x y", "x y", "X y", "ab " * 100, "ab " * 100 + "|"]
    rows = [(r.randrange(40), r.choice(texts), r.choice(["s", "t", "", None])) for _ in range(160)] + [(None, t, "s") for t in texts] + [(3, "x y", "s")] * 3
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(30)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (900, 1, 1)]
    clash = "mask long, print string, first string, part string, n long, good string"
    docs = spark.createDataFrame([(*x, 9, "p", "f", "q", 1, "g") for x in rows], f"doc_id long, text string, source string, {clash}")
    marked = spark.createDataFrame([(*x, "s", "t") for x in labels], "doc_id long, quality int, toxic int, source string, text string")
    assert sorted(map(tuple, fa.audit(docs, marked).collect())) == brute(rows, labels)
    assert fa.audit(docs.where("false"), marked).collect() == []
    none = fa.audit(docs, marked.where("false")).selectExpr("count(*) n", "sum(good_lost + toxic_lost) lost").first()
    assert none.n == 3 * 600 and none.lost == 0


def test_what_holds_for_every_order(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["a", "a", "A #", "b " * 400, "c"])], "doc_id long, text string, source string")
    got = fa.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).toPandas()
    assert len(got) == 600
    assert got.groupby("filter_order")["removed"].sum().nunique() == 1  # who goes in the end does not depend on the order
    by_filter = got.assign(f=[o[s - 1] for o, s in zip(got.filter_order, got.step, strict=True)]).groupby("f")
    assert by_filter["shapley"].nunique().eq(1).all()
    assert by_filter["shapley"].first().sum() == 120 * 5
