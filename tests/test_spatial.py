"""Joins and neighbours against brute force, with boxes of all sizes, ties and outliers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordering, setops, spatial

SHAPE = "id long, min_x double, min_y double, max_x double, max_y double"


def boxes(n, seed, sizes=(0.0, 1.0, 30.0), span=200.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-span, span), rng.uniform(-span, span), rng.choice(sizes) * rng.random(), rng.choice(sizes) * rng.random()
        out.append((i, x, y, x + w, y + h))
    return out


def touch(a, b):
    return a[1] <= b[3] and a[2] <= b[4] and a[3] >= b[1] and a[4] >= b[2]


def inside(a, b):
    return b[1] <= a[1] and b[2] <= a[2] and b[3] >= a[3] and b[4] >= a[4]


@pytest.mark.parametrize("per_task", [200_000, 7])
def test_joins_of_all_sizes(spark, per_task):
    a = boxes(300, 1) + [(1000, -1e7, -1e7, 1e7, 1e7), (1001, -math.inf, -1.0, math.inf, 1.0), (1002, 16.0, 16.0, 16.0, 16.0), (1003, 1e300, 0.0, 2e300, 1.0)]
    q = boxes(200, 2, (4.0, 90.0)) + [(2000, -1e9, -1e9, 1e9, 1e9), (2001, 0.0, 0.0, 16.0, 16.0), (2002, -math.inf, -math.inf, math.inf, math.inf)]
    gaps = [(3000, None, 0.0, 1.0, 1.0), (3001, math.nan, 0.0, 1.0, 1.0)]
    items, asks = spark.createDataFrame(a + gaps, SHAPE), spark.createDataFrame(q + gaps, SHAPE)
    got = spatial.spatial_intersects(items, asks, 4.0, per_task=per_task).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(x[0], y[0]) for x in a for y in q if touch(x, y)}
    got = spatial.spatial_contains(items, asks, 4.0, per_task=per_task).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(x[0], y[0]) for x in a for y in q if inside(x, y)}


def test_a_continent_touches_four_cells(spark):
    df = spark.range(100_000).select("id", *[(F.col("id") % 400 + d).cast("double").alias(n) for n, d in (("min_x", 0), ("min_y", 0), ("max_x", 1), ("max_y", 1))])
    df = df.union(spark.createDataFrame([(-1, -1e6, -1e6, 1e6, 1e6)], SHAPE))
    made = spatial.level_cells(spatial._usable(df, 1.0), 1.0, [], "b")
    per = made.groupBy(F.col("b.id").alias("id")).count().agg(F.max("count"), F.sum("count")).first()
    assert per[0] <= 4 and per[1] <= 4 * 100_001
    # the other side has one higher level: everybody lies there once more
    again = spatial.level_cells(spatial._usable(df, 1.0), 1.0, [0, 21], "b")
    assert again.count() <= per[1] + 4 * 100_001


def test_a_hot_cell_is_dealt_on_both_sides(spark):
    left = spark.range(3000).select((F.col("id") % 1).alias("k"), F.col("id").alias("a"))
    right = spark.range(900).select((F.col("id") % 1).alias("k"), F.col("id").alias("b"))
    both = ordering.meet(left, right, ["k"], 100)
    assert both.count() == 3000 * 900 and both.distinct().count() == 3000 * 900
    one = ordering.meet(left.limit(5), right.limit(3), ["k"], 100)
    assert one.count() == 15
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def nearest(a, p, k, most=math.inf):
    def gap(b):
        dx, dy = max(b[1] - p[1], p[1] - b[3], 0.0), max(b[2] - p[2], p[2] - b[4], 0.0)
        return math.sqrt(dx * dx + dy * dy)
    return [(p[0], i, pytest.approx(d), r) for r, (d, i) in enumerate(sorted((gap(b), b[0]) for b in a if gap(b) <= most)[:k], 1)]


@pytest.mark.parametrize("k,most", [(4, None), (3, 25.0), (700, None)])
def test_neighbours_by_brute_force(spark, k, most):
    a = boxes(500, 3, (0.0, 2.0, 50.0)) + [(900 + i, 5.0, 5.0, 5.0, 5.0) for i in range(80)]  # many ties
    a += [(2000, 1e9, -1e9, 1e9, -1e9), (2001, -1e5, -1e5, 1e5, -9e4)]  # an outlier, and a continent
    rng = random.Random(4)
    pts = [(i, rng.uniform(-250, 250), rng.uniform(-250, 250)) for i in range(60)] + [(70, 1e7, 3.0), (71, 5.0, 5.0), (72, -1e12, 0.0), (71, 5.0, 5.0)]
    got = spatial.knn(spark.createDataFrame(a + [(9999, None, 0.0, 0.0, 0.0)], SHAPE), spark.createDataFrame(pts + [(99, None, 1.0)], "id long, x double, y double"), k, most)
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.point_id, []).append(tuple(r))
    for p in pts:
        assert sorted(by.get(p[0], []), key=lambda r: r[3]) == nearest(a, p, k, math.inf if most is None else most)


def test_an_outlier_does_not_enlarge_the_pyramid(spark):
    a = spark.range(20_000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 10).alias(n) for n, s in (("min_x", 1), ("min_y", 2), ("max_x", 1), ("max_y", 2))])
    far = spark.createDataFrame([(-1, 1e10, 1e10, 1e10, 1e10)], SHAPE)
    _, plain = spatial.pyramid(a, 3)
    at, deep = spatial.pyramid(a.union(far), 3)
    crowd = at.groupBy("cx", "cy").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    assert crowd <= 32 and sum(n.count() for n in deep) < sum(n.count() for n in plain) + 20_000


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SHAPE), spark.createDataFrame(boxes(5, 1), SHAPE)
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert spatial.knn(none, pts, 2).count() == 0 and spatial.knn(some, pts.limit(0), 2).count() == 0
    assert spatial.spatial_intersects(none, some, 1.0).count() == 0 and spatial.spatial_contains(some, none, 1.0).count() == 0
    assert spatial.knn(some, pts, 9).count() == 5


def ring(points):
    """Monotone chain, for comparison."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return half(pts) + half(pts[::-1])


def test_hulls_of_many_shapes(spark):
    rng = random.Random(6)
    shapes = {
        "one": [(1.0, 1.0)] * 3, "two": [(0.0, 0.0), (2.0, 1.0)], "line": [(float(i), float(2 * i)) for i in range(9)],
        "flat": [(float(i), 3.0) for i in range(9)], "grid": [(float(i % 7), float(i // 7)) for i in range(49)] * 2,
        "circle": [(round(1000 * math.cos(t / 10)), round(1000 * math.sin(t / 10))) for t in range(63)],
        "cloud": [(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(3000)], None: [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(40)]}
    rows = [(k, float(x), float(y)) for k, ps in shapes.items() for x, y in ps] + [("one", None, 1.0), ("one", math.nan, 1.0), ("one", math.inf, 1.0)]
    got: dict = {}
    for r in spatial.convex_hull(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", per_task=50).collect():
        got.setdefault(r.k, []).append((r.i, (r.x, r.y)))
    want = {k: list(enumerate(ring([(float(x), float(y)) for x, y in ps]))) for k, ps in shapes.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert spatial.convex_hull(spark.createDataFrame([], "k string, x double, y double"), ["k"], "x", "y").count() == 0


def test_hull_needs_no_python(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = spatial.convex_hull(df, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def consolidated(ranges):
    """Row by row, as defined."""
    rows: dict = {}
    for s, t, a, b, z in ranges:
        for r in range(min(t, b), max(t, b) + 1):
            rows.setdefault((s, r), set()).update(range(min(a, z), max(a, z) + 1))
    out, open_ = [], {}
    for (s, r) in sorted(rows, key=lambda k: (str(k[0]), k[1])):
        cells, spans = sorted(rows[s, r]), []
        for c in cells:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        for a, z in spans:
            top = open_.pop((s, r - 1, a, z), r)
            open_[s, r, a, z] = top
    return sorted(((s, t, a, r, z) for (s, r, a, z), t in open_.items()), key=str)


@pytest.mark.parametrize("per_task", [200_000, 5])
def test_consolidation_by_rows(spark, per_task):
    rng = random.Random(7)
    rs = [(rng.choice(["x", "y", None]), t := rng.randint(1, 40), a := rng.randint(1, 12), t + rng.choice([0, 1, 9]), a + rng.choice([0, 1, 4])) for _ in range(120)]
    rs += [("x", 5, 5, 3, 2), ("z", 1, 1, 1, 1), ("z", 2, 1, 2, 1), ("z", 4, 1, 4, 1), ("z", 1, 2, 4, 2)] + rs[:10]
    df = spark.createDataFrame(rs, "s string, t int, a int, b int, z int")
    got = setops.range_consolidate(df, "s", "t", "a", "b", "z", per_task=per_task).select("s", "t", "a", "b", "z").collect()
    assert sorted(map(tuple, got), key=str) == consolidated(rs)
    flat = [r for r in rs if abs(r[3] - r[1]) <= 1]
    got = setops.range_consolidate(spark.createDataFrame(flat, df.schema), "s", "t", "a", "b", "z", per_task=per_task).select("s", "t", "a", "b", "z").collect()
    assert sorted(map(tuple, got), key=str) == consolidated(flat)


def test_tall_ranges_cost_two_events(spark):
    most = 1_048_576
    df = spark.range(300).selectExpr("'s' s", "cast(id % 7 + 1 as int) t", "cast(2 * id as int) a", f"cast({most} - id % 5 as int) b", "cast(2 * id as int) z")
    got = setops.range_consolidate(df, "s", "t", "a", "b", "z").collect()
    assert len(got) == 300 and {(r.t, r.b) for r in got} == {(i % 7 + 1, most - i % 5) for i in range(300)}
    both = df.unionByName(spark.createDataFrame([("s", 10, 0, 10, 700)], "s string, t int, a int, b int, z int"))
    # one row across all columns cuts every tall range in two, and is whole itself
    assert setops.range_consolidate(both, "s", "t", "a", "b", "z").count() == 601


def test_joins_are_cut_by_pairs(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(901).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    for per in (1, 1000, 10**9):
        both = ordering.meet_pairs(left, right, ["k"], per) if per > 1 else ordering.meet_pairs(left.limit(9), right.limit(7), ["k"], per)
        assert {tuple(r) for r in both.select("a", "b").collect()} == {(a, b) for a in range(1000 if per > 1 else 9) for b in range(901 if per > 1 else 7) if a % 2 == b % 3}
    # few rows, many pairs: one task would have them all if partitions were merged by size
    box = spark.range(1000).select("id", *[(F.col("id") % 3 + d).cast("double").alias(n) for n, d in (("min_x", 0), ("min_y", 0), ("max_x", 3), ("max_y", 3))])
    for join in (spatial.spatial_intersects, spatial.spatial_contains):
        got = join(box, box, 16.0, per_task=1000)
        assert got.rdd.getNumPartitions() > 1 and got.distinct().count() == got.count() > 300_000


def test_a_node_knows_the_middles_of_its_items(spark):
    wide = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 8.0), (2, 2.0, 1.0, 18.0, 7.0), (3, 30.0, 0.0, 10.0, 8.0)], SHAPE).union(
        spark.range(64).select("id", *[F.lit(10.0).alias(n) for n in spatial.BOX]))
    root = spatial.pyramid(wide, 1)[1][0].select(F.explode("children").alias("c")).agg(F.min("c.box.min_x"), F.max("c.box.max_x"), F.min("c.box.min_mid_x"), F.max("c.box.max_mid_x")).first()
    # the third is turned around: no point of it is sure, so both its ends count
    assert tuple(root) == (0.0, 20.0, 10.0, 30.0)


def test_points_of_a_place_ask_once_and_equal_items_stand_for_k(spark, monkeypatch):
    seen = {}
    build, join = spatial.pyramid, spatial.meet_pairs
    monkeypatch.setattr(spatial, "pyramid", lambda items, k: seen.update(items=items.count()) or build(items, k))
    monkeypatch.setattr(spatial, "meet_pairs", lambda a, b, *r: seen.update(asked=a.select("x", "y").distinct().count()) or join(a, b, *r))
    bs = [(i * 7 % 300, 0.0, 0.0, 4.0, 4.0) for i in range(300)] + [(300 + b[0], *b[1:]) for b in boxes(20, 3)]
    ps = [(i, float(i % 3), 1.0) for i in range(90)] + [(7, 50.0, 50.0)]
    got = {}
    for r in spatial.knn(spark.createDataFrame(bs, SHAPE), spark.createDataFrame(ps, "id long, x double, y double"), 3).collect():
        got.setdefault((r.point_id, r.rank), []).append((r.item_id, r.distance))
    for p in ps:
        for rank, want in enumerate(nearest(bs, p, 3), 1):
            assert want[1] in [x[0] for x in got[p[0], rank]]
    assert sum(map(len, got.values())) == 3 * len(ps)
    assert seen == {"items": 23, "asked": 4}


def test_equal_boxes_meet_as_one_row(spark, monkeypatch):
    met = []
    join = spatial.meet_pairs
    monkeypatch.setattr(spatial, "meet_pairs", lambda a, b, *r: met.append((a.distinct().count(), b.distinct().count())) or join(a, b, *r))
    monkeypatch.setattr(spatial, "_ALIKE", 400)
    a = [(i, 1.0, 1.0, 2.0, 2.0) for i in range(500)] + [(i, 3.0, 3.0, 3.5, 3.5) for i in range(500, 520)] + [(None, 1.0, 1.0, 2.0, 2.0), (3, None, 1.0, 2.0, 2.0), (3, 1.0, float("nan"), 2.0, 2.0)]
    b = [(i, 0.5, 0.5, 2.5, 2.5) for i in range(40)] + [(7, 0.5, 0.5, 2.5, 2.5)]
    x, y = spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)
    want = sorted((i, q[0]) for i in [*range(500), -1] for q in b)
    for f in (spatial.spatial_intersects, spatial.spatial_contains):
        assert sorted((-1 if r[0] is None else r[0], r[1]) for r in f(x, y, 16.0).collect()) == want
    assert all(max(m) <= 4 for m in met)
