"""NULL keys, NULL order values and NULL lookup values never lose a row."""

from pyspark.sql import functions as F

from tallyloom.operators import lookups, series, stats
from tallyloom.operators.ordering import carry_forward, order_stats, with_prefix

ROWS = [("a", 1.0, 1.0), ("a", None, 2.0), ("a", 3.0, 4.0), (None, 2.0, 8.0), (None, None, 16.0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, o double, v double")


def test_running_total_keeps_null_keys_and_orders(spark):
    got = series.running_total(frame(spark), ["k"], [F.col("o"), F.col("v")], "v").collect()
    assert {(r.k, r.o): r.running_total for r in got} == {("a", None): 2.0, ("a", 1.0): 3.0, ("a", 3.0): 7.0, (None, None): 16.0, (None, 2.0): 24.0}


def test_positions_and_sizes(spark):
    got = with_prefix(frame(spark), ["k"], [F.col("o")], size="size").collect()
    assert sorted((r.k or "", r.pos, r["size"]) for r in got) == [("", 0, 2), ("", 1, 2), ("a", 0, 3), ("a", 1, 3), ("a", 2, 3)]


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (5.0,)], "o double")
    got = with_prefix(df, [], [F.col("o")]).collect()
    assert [repr(r.o) for r in sorted(got, key=lambda r: r.pos)] == ["None", "1.0", "5.0", "nan"]


def test_carry_forward(spark):
    got = carry_forward(frame(spark), ["k"], [F.col("o"), F.col("v")], None, {"c": F.col("v")}).collect()
    assert len(got) == 5 and all(r.c == r.v for r in got)


def test_order_statistics_of_the_null_group(spark):
    got = {r.k: r.m for r in order_stats(frame(spark), ["k"], F.col("v"), {"m": lambda n: F.floor(n / 2)}).collect()}
    assert got == {"a": 2.0, None: 16.0}
    assert {r.k: r["median"] for r in stats.median(frame(spark), ["k"], "v").collect()} == {"a": 2.0, None: 12.0}
    assert {r.k: r.med for r in stats.boxplot(frame(spark), ["k"], "v").collect()} == {"a": 2.0, None: 16.0}
    assert {r.k: r["count"] for r in stats.population(frame(spark), ["k"], "v").collect()} == {"a": 3, None: 2}


def test_anova_of_the_null_key(spark):
    df = spark.createDataFrame([(None, g, v) for g, v in [("x", 1.0), ("x", 2.0), ("y", 5.0), ("y", 6.0)]], "b string, g string, v double")
    got = stats.anova_oneway(df, "g", "v", by=["b"]).collect()
    assert len(got) == 1 and got[0].k == 2 and got[0].n_total == 4


def test_rolling_and_last_n(spark):
    df = spark.createDataFrame([(None, float(i), float(i)) for i in range(6)], "k string, o double, v double")
    out = series.rolling(df, ["k"], [F.col("o")], "v", 2)
    assert sorted(r.moving_average for r in out.collect()) == [1.5, 2.5, 3.5, 4.5]
    assert series.last_n(df, ["k"], [F.col("o")], "v", 2).count() == 2
    assert series.diff_neighbours(df, ["k"], [F.col("o")], "v").count() == 6


def test_lookups_return_every_left_row(spark):
    left = spark.createDataFrame([(1, "a", 2.5), (2, "a", None), (3, None, 2.5), (4, None, None)], "id int, k string, x double")
    right = spark.createDataFrame([("a", 2.0, 0, "two"), ("a", 3.0, 1, "three"), (None, 1.0, 2, "one")], "k string, y double, pos int, name string")
    args = (left, right, ["k"], "x", "y", "pos", ["name"])
    assert {r.id: r.name for r in lookups.lookup_asof(*args).collect()} == {1: "two", 2: None, 3: "one", 4: None}
    assert {r.id: r.name for r in lookups.lookup_asof(*args, forward=True).collect()} == {1: "three", 2: None, 3: None, 4: None}
    assert {r.id: r.name for r in lookups.lookup_nearest(*args, key=["id"]).collect()} == {1: "two", 2: None, 3: "one", 4: None}


def test_letters_never_repeat(spark):
    got = [r.l for r in spark.range(2000).select(stats.step_letters(F.col("id")).alias("l")).collect()]
    assert got[:3] == ["a", "b", "c"] and got[25:28] == ["z", "aa", "ab"] and len(set(got)) == 2000


