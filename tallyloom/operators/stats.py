"""Grouped statistics, variance analysis, histograms, densities and regression."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tallyloom.operators.ordering import join_same, order_stats

# Critical ranges of the multiple-range test at alpha 0.05 and
# unlimited degrees of freedom, for 1..20 spanned means.
DUNCAN_Q = (0, 2.77, 2.92, 3.02, 3.09, 3.15, 3.19, 3.23, 3.26, 3.29,
            3.31, 3.33, 3.35, 3.37, 3.39, 3.40, 3.41, 3.43, 3.44, 3.45)


def _one(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery (broadcast by Spark, no join)."""
    return df.select(F.struct("*")).scalar()


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd"),
        (sd / F.sqrt(F.count(v))).alias("sem"), F.min(v).alias("min"), F.max(v).alias("max"))


def anova_oneway(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """One-way ANOVA table, one row per ``by`` key.

    Two levels: per group (n, mean, sample variance), then over groups, so no data
    row ever meets the grand mean.
    """
    by = by or []
    v = F.col(value)
    per = df.where(v.isNotNull()).groupBy(*by, group).agg(
        F.count(v).alias("_n"), F.avg(v).alias("_m"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("_s2"))
    grand = per.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("grand_mean"))
    met = join_same(per, grand, by) if by else per.withColumn("grand_mean", grand.scalar())
    tab = met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n_total"), F.max("grand_mean").alias("grand_mean"),
        F.sum((F.col("_n") - 1) * F.col("_s2")).alias("ssw"),
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("grand_mean"), F.lit(2))).alias("ssb"))
    return (
        tab.withColumn("sst", F.col("ssb") + F.col("ssw"))
        .withColumn("df_b", F.col("k") - 1)
        .withColumn("df_w", F.col("n_total") - F.col("k"))
        .withColumn("msb", F.try_divide("ssb", F.col("df_b").cast("double")))
        .withColumn("msw", F.try_divide("ssw", F.col("df_w").cast("double")))
        .withColumn("f", F.try_divide("msb", "msw")))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction (modified Lentz)."""
    if not 0.0 < x < 1.0:
        return x
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    value = d
    for m in range(1, 201):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 / ((1.0 + coef * d) or tiny)
            c = (1.0 + coef / c) or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-12:
            break
    return front * value


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df_b: pd.Series, df_w: pd.Series) -> pd.Series:
    """Upper tail of F; runs on per-test aggregates, never on data rows."""
    return pd.Series([
        None if pd.isna(s) else _beta_tail(w / 2.0, b / 2.0, w / (w + b * s)) for s, b, w in zip(f, df_b, df_w)
    ], dtype="float64")


def anova_pvalue(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", f_tail("f", F.col("df_b").cast("double"), F.col("df_w").cast("double")))


def step_letters(step: Column) -> Column:
    """a, b, ..., z, aa, ab, ...: every step of 0 or more has letters of its own."""
    def last(n: Column) -> Column:
        return F.char(F.lit(97) + F.pmod(n, F.lit(26)))

    rest = F.floor(step / 26) - 1
    far = F.floor(rest / 26) - 1
    two = F.concat(last(rest), last(step))
    three = F.when(far < 0, two).when(far < 26, F.concat(last(far), two)).otherwise(F.concat(F.lit("s"), step.cast("string")))
    return F.when(rest < 0, last(step)).otherwise(three)


def duncan(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Group letters by descending mean; a letter step at each neighbour gap ≥ q(2)·se.

    This is the simplification of the source toolkit, in which the letters of a
    run depend on neighbour gaps only, and alpha is fixed at 0.05.
    """
    by = by or []
    stats = group_stats(df.where(F.col(value).isNotNull()), [*by, group], value)
    whole = W.partitionBy(*by)
    ranked = whole.orderBy(F.col("mean").desc(), F.col(group))
    n_all, k = F.sum("n").over(whole), F.count(F.lit(1)).over(whole)
    df_w = n_all - k
    msw = F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd")).over(whole) / df_w
    q2 = F.when(df_w >= 120, F.lit(DUNCAN_Q[1])).otherwise(F.lit(DUNCAN_Q[1]) * (1 + 1 / df_w))
    step = (F.lag("mean").over(ranked) - F.col("mean")) >= F.col("_q") * F.sqrt(F.col("_msw") / F.col("_nbar"))
    return (
        stats.withColumn("_msw", msw).withColumn("_nbar", n_all / k).withColumn("_q", q2)
        .withColumn("_step", F.when(step, 1).otherwise(0))
        .withColumn("_run", F.sum("_step").over(ranked.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("letter", step_letters(F.col("_run")))
        .select(*by, group, "n", "mean", "sd", "sem", "letter"))


def full_analysis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Letters per group with the ANOVA table beside each."""
    table = anova_pvalue(anova_oneway(df, group, value)).select("f", "df_b", "df_w", "msw", "p_value")
    return duncan(df, group, value).withColumn("_t", _one(table)).select("*", "_t.*").drop("_t")


def stats_preflight(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: number of groups, smallest group, NaN/Inf values, and whether tests may run."""
    v = F.col(value)
    odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    per = df.groupBy(group).agg(F.count(v).alias("_n"), F.count_if(odd).alias("_odd"))
    return per.agg(
        F.count(F.lit(1)).alias("groups"), F.min("_n").alias("min_n"), F.sum("_odd").alias("not_finite"),
    ).withColumn("ok", (F.col("groups") >= 2) & (F.col("min_n") >= 2) & (F.col("not_finite") == 0))


# --- histograms -----------------------------------------------------------

def _bins(df: DataFrame, value: str, lo: Column, hi: Column, width: Column, count: Column, outliers: bool) -> DataFrame:
    """Counts per bin including empty ones: (bin, left, count)."""
    v = F.col(value)
    bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    spec = bounds.select(lo.alias("lo"), hi.alias("hi"), width.alias("w"), count.cast("long").alias("k")) \
        .withColumn("hi", F.col("lo") + F.col("k") * F.col("w")).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    s = _one(spec)
    at = F.floor((v - F.col("_s.lo")) / F.col("_s.w")).cast("long")
    last = F.col("_s.k") - 1
    inside = F.when((v >= F.col("_s.lo")) & (v <= F.col("_s.hi")), F.least(at, last))
    if outliers:
        inside = F.when(v < F.col("_s.lo"), F.lit(0)).when(v > F.col("_s.hi"), last).otherwise(inside)
    hits = df.where(v.isNotNull()).select(v, s.alias("_s")).select(inside.alias("bin")).where(F.col("bin").isNotNull())
    counted = hits.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    # bins are unrolled in two steps, so that no row holds more than a block of them
    block = F.lit(65536).cast("long")
    blocks = spec.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("k") - 1, F.lit(0)), block)).alias("_from"), "k", "lo", "w").where("k > 0")
    frame = blocks.select(F.explode(F.sequence("_from", F.least(F.col("_from") + block, F.col("k")) - 1)).alias("bin"), "lo", "w")
    return frame.join(counted, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("left"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram_count(df: DataFrame, value: str, count: int, outliers: bool = False) -> DataFrame:
    lo, hi = F.col("lo"), F.col("hi")
    return _bins(df, value, lo, hi, (hi - lo) / count, F.lit(count), outliers)


def histogram_size(df: DataFrame, value: str, size: float, outliers: bool = False) -> DataFrame:
    """Bins of a fixed size from the smallest value; values past the last edge are dropped."""
    lo, hi = F.col("lo"), F.col("hi")
    return _bins(df, value, lo, hi, F.lit(size), F.floor((hi - lo) / size), outliers)


def histogram_norm(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Probability, peak-normalised height, cumulative count and cumulative probability."""
    keys = keys or []
    whole = W.partitionBy(*keys)
    total = F.sum("count").over(whole)
    running = F.sum("count").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return hist.select(
        *keys, "bin", "count", (F.col("count") / total).alias("probability"),
        (F.col("count") / F.max("count").over(whole)).alias("normalized"),
        running.alias("cumulative"), (running / total).alias("cumulative_probability"))


def cumulative_hist(df: DataFrame, keys: list[str], value: str, size: float) -> DataFrame:
    """Cumulative counts of fixed-size bins per series; the window runs over bins, not rows."""
    per = df.groupBy(*keys, F.floor(F.col(value) / size).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("cumulative", F.sum("count").over(w))


# --- order statistics -----------------------------------------------------

def percentile_lower(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Sorted value at int(p·n/100) clamped to the sample; never interpolated."""
    def at(p):
        return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.floor(F.lit(float(p)) * n / 100)))
    return order_stats(df, keys, F.col(value), {name: at(p) for name, p in percents.items()})


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    mid = order_stats(df, keys, F.col(value), {
        "_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)})
    return mid.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def boxplot(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return order_stats(df, keys, F.col(value), {
        "whisker_min": lambda n: F.lit(0), "q1": lambda n: F.floor(n / 4), "med": lambda n: F.floor(n / 2),
        "q3": lambda n: F.floor(3 * n / 4), "whisker_max": lambda n: n - 1})


def population(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    stats = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("sd"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))
    return join_same(stats, median(df, keys, value).select(*keys, "median"), keys, "left")


def describe(df: DataFrame, value: str, keys: list[str] | None = None, ignore_nan: bool = False) -> DataFrame:
    """Sum, mean, and both forms of variance, SD and standard error; NaN optionally skipped."""
    v = F.col(value)
    if ignore_nan:
        v = F.when(~F.isnan(v), v)
    n = F.sqrt(F.count(v))
    return df.groupBy(*(keys or [])).agg(
        F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"),
        F.var_samp(v).alias("variance"), F.var_pop(v).alias("variance_p"),
        F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("sd_p"),
        (F.stddev_samp(v) / n).alias("sem"))


def vertical_stats(df: DataFrame, array: str, ignore_nan: bool = False) -> DataFrame:
    """Per-position statistics of equal-length arrays (matrix columns)."""
    long = df.select(F.posexplode(array).alias("pos", "_v")).withColumn("_v", F.col("_v").cast("double"))
    if ignore_nan:
        long = long.where(~F.isnan("_v"))
    return long.groupBy("pos").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"),
        (F.stddev_samp("_v") / F.sqrt(F.count("_v"))).alias("sem"))


def sum_vertically(df: DataFrame, array: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return df.select(*keys, F.posexplode(array).alias("pos", "_v")).groupBy(*keys, "pos").agg(
        F.sum(F.col("_v").cast("double")).alias("total"))


def grid_halve(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """2×2 block means of a cell table; an odd last row or column is dropped."""
    size = _one(df.agg(F.max(row).alias("r"), F.max(col).alias("c")))
    even = df.withColumn("_m", size).where(
        (F.col(row) < F.floor((F.col("_m.r") + 1) / 2) * 2) & (F.col(col) < F.floor((F.col("_m.c") + 1) / 2) * 2))
    return even.groupBy(F.floor(F.col(row) / 2).cast("long").alias(row), F.floor(F.col(col) / 2).cast("long").alias(col)).agg(
        F.avg(value).alias(value))


# --- regression and densities ---------------------------------------------

def linear_regression(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Least squares per key with the fitted end points at the smallest and largest x."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset"),
        F.regr_r2(y, x).alias("r_squared"), F.min(x).alias("x0"), F.max(x).alias("x1"))
    return fit.withColumn("y0", F.col("slope") * F.col("x0") + F.col("offset")).withColumn(
        "y1", F.col("slope") * F.col("x1") + F.col("offset"))


def _kernel(name: str, u: Column) -> Column:
    size = F.abs(u)
    return {
        "epanechnikov": F.when(size <= 1, (1 - u * u) * 0.75).otherwise(0.0),
        "gaussian": F.exp(u * u * -0.5) / math.sqrt(2 * math.pi),
        "uniform": F.when(size <= 1, F.lit(0.5)).otherwise(0.0),
        "triangular": F.when(size < 1, 1 - size).otherwise(0.0),
    }[name]


def kde(df: DataFrame, value: str, points: int = 21, kernel: str = "epanechnikov") -> DataFrame:
    """Density at ``points`` evenly spaced x over the sample's range.

    One pass: every grid point is one partial sum of the same aggregate, so the
    rows are neither multiplied by the grid nor shuffled.
    """
    v = F.col(value)
    src = df.where(v.isNotNull()).select(v)
    base = src.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")) \
        .withColumn("h", F.lit((24 * math.sqrt(math.pi)) ** (1 / 3)) * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-1 / 3)))
    s = _one(base)
    x = [F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo")) * i / (points - 1) for i in range(points)]
    sums = src.withColumn("_s", s).agg(
        *[F.sum(F.when(F.col("_s.h") > 0, _kernel(kernel, (x[i] - v) / F.col("_s.h")))).alias(f"k{i}") for i in range(points)])
    rows = sums.select(F.posexplode(F.array(*[f"k{i}" for i in range(points)])).alias("i", "total"))
    t = rows.withColumn("_s", s)
    return t.select(
        "i", (F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo")) * F.col("i") / (points - 1)).alias("x"),
        F.coalesce(F.col("total") / (F.col("_s.n") * F.nullif(F.col("_s.h"), F.lit(0.0))), F.lit(0.0)).alias("density"))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(z * z * -0.5) / (sd * math.sqrt(2 * math.pi))


def bar_summary(df: DataFrame, group: str, value: str, error_bars: bool = True) -> DataFrame:
    d = duncan(df, group, value)
    return d.select(group, "mean", (F.col("sem") if error_bars else F.lit(0.0)).alias("error"), "letter")


def share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value, total and percent per key."""
    per = df.groupBy(*keys).agg(F.sum(value).alias("value"))
    total = _one(df.agg(F.sum(value).alias("total")))
    return per.withColumn("total", total.getField("total")).withColumn("percent", F.col("value") / F.col("total") * 100)


def matrix(df: DataFrame, row: str, column: str, categories: list, agg: Column) -> DataFrame:
    """Series × category matrix; categories are listed, so no pass is spent finding them."""
    return df.groupBy(row).pivot(column, categories).agg(agg)


def category_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("entries"))
