"""Loops that keep a log: results do not depend on when it is folded, and rounds add to it instead of rewriting it."""

import heapq
import random

import pytest

from tallyloom.operators import graph
from tallyloom.session import Log


def dijkstra(edges, source):
    near, best, heap = {}, {}, [(0.0, source)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in near.get(x, ()):
                heapq.heappush(heap, (d + w, y))
    return best


@pytest.mark.parametrize("fold_at", [2, 32])
def test_distances_equal_dijkstra(spark, fold_at):
    rng = random.Random(fold_at)
    edges = [(i, i + 1, 1.0) for i in range(12)] + [(rng.randrange(13), rng.randrange(13), float(rng.randint(1, 30))) for _ in range(15)] + [(50, 51, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = graph.distances(df, spark.createDataFrame([(0,), (5,)], "id long"), fold_at=fold_at).collect()
    want = {(s, i): d for s in (0, 5) for i, d in dijkstra(edges, s).items()}
    assert len(got) == len(want) and {(r.source, r.id): r.distance for r in got} == want


def test_distances_of_no_sources_and_no_edges(spark):
    e, s = spark.createDataFrame([], "src long, dst long, weight double"), spark.createDataFrame([(1,)], "id long")
    assert [tuple(r) for r in graph.distances(e, s).collect()] == [(1, 1, 0.0)]
    assert graph.distances(e, s.limit(0)).count() == 0


def levels(edges, ids):
    open_, level, now, at = {i: 0 for i in ids}, {}, [], 0
    for _, b in edges:
        open_[b] += 1
    now = [i for i in ids if not open_[i]]
    while now:
        level |= {i: at for i in now}
        freed = []
        for a, b in edges:
            if a in now:
                open_[b] -= 1
                freed += [b] if not open_[b] else []
        now, at = freed, at + 1
    return level


@pytest.mark.parametrize("fold_at", [2, 32])
def test_levels_equal_peeling(spark, fold_at):
    rng = random.Random(fold_at)
    edges = {(i, i + 1) for i in range(8)} | {tuple(sorted(rng.sample(range(14), 2))) for _ in range(25)} | {(20, 21), (21, 20), (3, 20), (21, 22)}
    df = spark.createDataFrame(sorted(edges) * 2, "src long, dst long")
    ids = {x for e in edges for x in e}
    assert {r.id: r.level for r in graph.topo_order(df, fold_at=fold_at).collect()} == levels(edges, ids)


def test_rounds_add_only_what_they_find(spark, monkeypatch):
    sizes, add = [], Log.add
    monkeypatch.setattr(Log, "add", lambda self, rows: (lambda out: (sizes.append(out.count()), out)[1])(add(self, rows)))
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(10)], "src long, dst long, weight double")
    assert graph.distances(chain, spark.createDataFrame([(0,)], "id long"), directed=True).count() == 11
    assert sizes == [1] * 11 + [0]
