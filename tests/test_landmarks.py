"""Recordings in mixes: the landmark index beside the exact form that correlates all pairs."""

import numpy as np
import pytest

from earshot.operators import landmarks as lm
from earshot.operators import sound


def table(spark, rows):
    return spark.createDataFrame([(i, float(len(f)), f.tolist()) for i, f in rows], "id long, length double, frames array<array<int>>")


def library(noise, seed=7, n=40):
    """Recordings, and two mixes that hold some of them a little changed."""
    r = np.random.default_rng(seed)
    parts = {i: r.integers(0, 128, (int(r.integers(30, 90)), 12)) for i in range(n)}
    changed = lambda x: np.clip(x + np.round(r.normal(0, noise, x.shape)), 0, 127).astype(int)
    mixes = {1000 + m: np.concatenate([changed(parts[i]) for i in range(m * 12, m * 12 + 12)]) for m in range(2)}
    return mixes, parts


@pytest.mark.parametrize("noise", [0.0, 3.0])
def test_finds_what_the_exact_form_finds(spark, noise):
    mixes, parts = library(noise)
    long, short = table(spark, mixes.items()), table(spark, parts.items())
    key = lambda rows: {(r.mix, r.id): (r.start, r.finish) for r in rows}
    exact = key(sound.found_in_mixes(long, short).collect())
    found = key(lm.without_overlaps(lm.hits(long, short)).collect())
    assert len(exact) >= 20
    assert sum(found.get(k) == v for k, v in exact.items()) >= 0.95 * len(exact)
    assert set(found) <= {(1000 + m, i) for m in range(2) for i in range(m * 12, m * 12 + 12)}


def test_hot_landmarks_are_split_and_change_nothing(spark):
    mixes, parts = library(0.0, n=26)
    for i in range(6):  # recordings of two seconds over and over: one landmark has very many places
        parts[500 + i] = np.tile(parts[0][:2], (20, 1))
    long, short = table(spark, mixes.items()), table(spark, parts.items())
    a, b = lm.landmarks(long), lm.landmarks(short)
    rows = lambda block: sorted(map(tuple, lm.votes(a, b, block).collect()))
    assert rows(10**9) == rows(3)
    assert max(r["count"] for r in b.groupBy("key").count().collect()) > 90


def test_votes_beside_all_pairs(spark):
    mixes, parts = library(0.0, n=26)
    got = {(r.mix, r.id, r.off): r.votes for r in lm.votes(lm.landmarks(table(spark, mixes.items())), lm.landmarks(table(spark, parts.items()))).collect()}

    def marks(f):
        d = np.diff(f.astype(int), axis=0)
        p = []
        for row in d:
            up = sorted(range(12), key=lambda i: (-row[i], i))
            p.append((up[0], up[1], up[-1]) if row[up[0]] > 0 and row[up[-1]] < 0 else None)
        return {(t, p[t], p[t + s], s) for t in range(len(p)) for s in (1, 2, 3) if t + s < len(p) and p[t] and p[t + s]}

    want = {}
    for m, f in mixes.items():
        for i, g in parts.items():
            for t, a, b, s in marks(f):
                for u, c, d, v in marks(g):
                    if (a, b, s) == (c, d, v) and t >= u:
                        want[m, i, t - u] = want.get((m, i, t - u), 0) + 1
    assert got == want


def test_silence_and_short_recordings(spark):
    mixes, parts = library(0.0, n=26)
    quiet = table(spark, [(1, np.zeros((60, 12), int)), (2, parts[0][:20]), (3, np.full((500, 12), 7))])
    assert lm.landmarks(quiet.where("id <> 2")).count() == 0
    assert lm.hits(table(spark, mixes.items()), quiet).count() == 0
    assert lm.hits(quiet, table(spark, parts.items())).count() == 0
    assert lm.landmarks(quiet.where("false")).count() == 0


def test_stretches_and_missing_bands_change_no_landmark(spark):
    mixes, parts = library(0.0, n=26)
    curves = table(spark, [*mixes.items(), *parts.items()])
    rows = lambda span: sorted(map(tuple, lm.landmarks(curves, span=span).collect()))
    assert rows(1) == rows(7) == rows(10**6) and len(rows(7)) > 5000
    f = [x.tolist() for x in parts[0][:12]]
    whole = {(r.at, r.key) for r in lm.landmarks(table(spark, [(1, parts[0][:12])])).collect()}
    odd = {1: f, 2: [*f[:5], None, *f[6:]], 3: [*f[:5], f[5][:11], *f[6:]], 4: [*f[:5], [None, *f[5][1:]], *f[6:]], 5: None, 6: [], 7: f[:1], 8: [[1]] * 9}
    got = {}
    for r in lm.landmarks(spark.createDataFrame([*odd.items()], "id long, frames array<array<int>>"), span=4).collect():
        got.setdefault(r.id, set()).add((r.at, r.key))
    without = {(at, key) for at, key in whole if not {at, at + key % 10} & {4, 5}}  # the steps to and from a second that lacks bands
    assert got == {1: whole, 2: without, 3: without, 4: without}
