"""Chunks of ordered work are cut by load, whatever the values look like."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordering, series, stats
from tallyloom.operators.ordering import CHUNK, Down, with_chunks, with_prefix

ROWS = 400_000


def loads(df, keys, order):
    per = with_chunks(df, keys, order).groupBy(CHUNK).count().collect()
    return sorted(r["count"] for r in per)


@pytest.mark.parametrize("value", [
    "1000.0 + id / 1e9",  # all values within a thousandth
    "if(id % 10 > 0, 5.0, cast(id as double))",  # one value in nine of ten rows
    "pow(2.0, pmod(xxhash64(id), 900))",  # outliers of any size
])
def test_no_band_is_one_chunk(spark, value):
    df = spark.range(ROWS).withColumn("v", F.expr(value))
    for order in ([F.col("v"), F.col("id")], [Down(F.col("v")), F.col("id")]):
        got = loads(df, [], order)
        assert len(got) == ordering.chunk_count(df) and got[-1] < 2 * ROWS / len(got)


def test_a_busy_hour_of_a_hot_key_lies_in_many_chunks(spark):
    hour = F.lit("2024-01-01 10:00:00").cast("timestamp")
    busy = F.col("id") % 10 > 0
    df = spark.range(ROWS).select("id", F.when(busy, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"),
                                  F.when(busy, hour + F.make_dt_interval(secs=(F.col("id") % 60).cast("decimal(18,6)"))).otherwise(
                                      hour + F.make_dt_interval(days=(F.col("id") % 365).cast("int"))).alias("ts"))
    placed = with_chunks(df, ["k"], [F.col("ts"), F.col("id")])
    hot = placed.where("k = 'hot'").groupBy(CHUNK).count().collect()
    assert len(hot) > 50 and max(r["count"] for r in hot) < 2 * ROWS / 64
    got = series.running_total(df.withColumn("one", F.lit(1)), ["k"], [F.col("ts"), F.col("id")], "one")
    sums = got.groupBy("k").agg(F.max("running_total").alias("last"), F.count("*").alias("n"), F.countDistinct("running_total").alias("d")).collect()
    assert len(sums) == 101 and all(r["last"] == r["n"] == r["d"] for r in sums)


def test_what_crosses_chunks_is_small_and_broadcast(spark):
    df = spark.range(ROWS).select("id", (F.col("id") % 50_000).alias("k"), F.rand(1).alias("v"))
    src = with_chunks(df, ["k"], [F.col("v"), F.col("id")])
    several = src.groupBy("k").agg(F.countDistinct(CHUNK).alias("n")).where("n > 1").agg(F.sum("n")).first()[0]
    assert several < 2 * ordering.chunk_count(df)
    plan = with_prefix(df, ["k"], [F.col("v"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("REPARTITION") == 0


def test_order_statistics_of_a_narrow_band(spark):
    df = spark.range(ROWS).select((F.lit(7.0) + F.pmod(F.xxhash64("id"), F.lit(300_000)) / 1e10).alias("v"), (F.col("id") % 3 == 0).alias("k"))
    got = {r.k: r for r in stats.boxplot(df, ["k"], "v").collect()}
    values: dict = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)
    for k, vs in values.items():
        vs.sort()
        n = len(vs)
        assert (got[k].n, got[k].whisker_min, got[k].q1, got[k].med, got[k].q3, got[k].whisker_max) == (n, vs[0], vs[n // 4], vs[n // 2], vs[3 * n // 4], vs[-1])


@pytest.mark.parametrize("ascending", [True, False])
def test_carry_across_chunks_that_hold_nothing(spark, ascending):
    rows = 20_000
    df = spark.range(rows).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id").isin(10, 15_001), F.col("id")).alias("v"))
    got = {(r.k, r.id): r.x for r in ordering.carry_forward(df, ["k"], [F.col("id")], None, {"x": F.col("v")}, ascending).collect()}
    for k, at in ((0, 10), (1, 15_001)):
        assert all(got[k, i] == (at if (i >= at if ascending else i <= at) else None) for i in range(k, rows, 2))


def test_empty_and_null_places(spark):
    shape = "k string, o double, id long"
    assert with_prefix(spark.createDataFrame([], shape), ["k"], [F.col("o"), F.col("id")], size="n").count() == 0
    rows = [(None, None, i) for i in range(40)] + [("a", float("nan"), i) for i in range(40)]
    got = with_prefix(spark.createDataFrame(rows, shape), ["k"], [Down(F.col("o")), F.col("id")], size="n").collect()
    assert len(got) == 80 and all(r.pos == r.id and r.n == 40 for r in got)
