"""Product codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm import pivots

VEC = "vec_id long, embedding array<double>, label int, code string, error long"


def by_hand(rows, parts, entries, rounds, scale=256):
    kept = [(i, [min(max(math.floor(scale * x), -(1 << 25)), 1 << 25) for x in v], y) for i, v, y in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    if not firsts:
        return []
    dim = len(firsts[min(firsts)])
    kept = [r for r in kept if len(r[1]) == dim]
    d = dim // parts
    start = [firsts[i] for i in sorted(firsts)[:entries] if len(firsts[i]) == dim]
    cut = lambda v, p: v[p * d:(p + 1) * d]
    book = [[cut(v, p) for v in start] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((dist(cut(v, p), e), j) for j, e in enumerate(book[p]))
    for _ in range(rounds):
        new = [list(b) for b in book]
        for p in range(parts):
            for j in range(len(book[p])):
                mine = [cut(v, p) for _, v, _ in kept if near(v, p)[1] == j]
                if mine:
                    new[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
        book = new
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), y) for i, v, y in kept]
    sums = {}
    for _, _, e, y in coded:
        sums[y] = sums.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return [(i, c, e, sums[y], sha) for i, c, e, y in coded]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_codes_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.3]) if i % 3 else rng.gauss(0, 0.2) for _ in range(12)], i % 4 or None) for i in range(300)]  # many ties
    rows += [(i, list(rows[9][1]), 7) for i in range(300, 380)] + [(5, list(rows[5][1]), 1), (6, [0.1] * 12, 2), (None, [0.4] * 12, 3)]
    rows += [(400, None, 1), (401, [], 1), (402, [None] * 12, 1), (403, [math.nan] * 12, 1), (404, [math.inf] * 12, 1), (405, [0.1] * 11, 1), (406, [0.1] * 8, 1),
             (407, [1e30] * 12, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VEC).repartition(3)
    got = pivots.compress(df, parts=4, entries=10).collect()
    assert ordered(got) == ordered(by_hand(rows, 4, 10, 2))


def test_few_vectors_and_none(spark):
    rows = [(3, [0.5, -0.25], 1), (1, [0.5, 0.75], None)]
    got = pivots.compress(spark.createDataFrame([(*r, "", 0) for r in rows], VEC), parts=2).collect()
    assert ordered(got) == ordered(by_hand(rows, 2, 64, 2)) and {r.error for r in got} == {0}
    assert pivots.compress(spark.createDataFrame([], VEC)).count() == 0
    assert pivots.compress(spark.createDataFrame([(None, [0.5] * 16, 1, "", 0)], VEC)).count() == 0


def test_bounds_save_evaluations_and_lose_nothing():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-200, 200, (500, 4)), rng.integers(-200, 200, (64, 4))
    book[40] = book[3]  # a tie goes to the lower index
    fixed = pivots.choose_pivots(book, 4)
    far = pivots.pivot_distances(x, fixed).astype("<f4").astype(float)
    where, gap, done = pivots.nearest(x, far, book, pivots.pivot_distances(book, fixed))
    full = np.square(x[:, None] - book[None]).sum(axis=2)
    assert (where == full.argmin(axis=1)).all() and (gap == full.min(axis=1)).all()
    assert done < 0.35 * full.size


def test_decode_gives_the_entries(spark):
    rows = [(i, [i / 7 % 1, i / 3 % 1, 0.5, -0.5], 0, "", 0) for i in range(40)]
    table, book, fixed = pivots.fit(spark.createDataFrame(rows, VEC), parts=2, entries=4)
    for r in pivots.decode(pivots.encode(table, book, fixed), book).collect():
        x = [math.floor(256 * v) for v in rows[r.vec_id][1]]
        assert sum((a - b) ** 2 for a, b in zip(x, r.approx)) == r.error
    with pytest.raises(ValueError):
        pivots.encode(table, np.zeros((2, 300, 2), np.int64), fixed)
