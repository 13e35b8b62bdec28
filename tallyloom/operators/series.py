"""Rolling and resampled series; every operator splits a series over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.ordering import join_same, with_neighbours, with_prefix


def positioned(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return with_prefix(df, keys, order, pos="pos")


def rolling(df: DataFrame, keys: list[str], order: list[Column], value: str, window: int,
            pad: bool = False, k: float = 2.0) -> DataFrame:
    """Moving mean, sample SD and bands.  Output starts at position ``window`` (0-based):
    the first full window is dropped too.  ``pad`` keeps the earlier rows with NaN."""
    if window < 2:
        raise ValueError("window must be at least 2")
    at = positioned(df, keys, order)

    def build(w):
        span = w.rowsBetween(1 - window, 0)
        return {"moving_average": F.avg(value).over(span), "moving_sd": F.stddev_samp(value).over(span)}

    out = with_neighbours(at, keys, "pos", window - 1, 0, build)
    out = out.withColumn("upper", F.col("moving_average") + k * F.col("moving_sd")) \
        .withColumn("lower", F.col("moving_average") - k * F.col("moving_sd"))
    late = F.col("pos") >= window
    if not pad:
        return out.where(late)
    nan = F.lit(float("nan"))
    for c in ("moving_average", "moving_sd", "upper", "lower"):
        out = out.withColumn(c, F.when(late, F.col(c)).otherwise(nan))
    return out


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    return with_prefix(df, keys, order, pos=None, sums={"running_total": F.col(value)})


def diff_neighbours(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Difference from the previous and the next item of the series."""
    v = F.col(value)
    return with_neighbours(positioned(df, keys, order), keys, "pos", 1, 1, lambda w: {
        "diff_prev": v - F.lag(v).over(w), "diff_next": v - F.lead(v).over(w)})


def minmax_decimate(df: DataFrame, keys: list[str], pos: str, value: str, period: int = 1000) -> DataFrame:
    """Smallest and largest value of each run of ``period`` samples."""
    return df.groupBy(*keys, F.floor(F.col(pos) / period).cast("long").alias("run")).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("samples"))


def ohlc_resample(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, unit: str = "day") -> DataFrame:
    """Open, high, low, close per interval; map-side combined."""
    at = F.struct(F.col(ts), F.col(tie))
    return df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bar")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("ticks"))


def last_n(df: DataFrame, keys: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """Ring-buffer view of a series: its last n values, with all-time min, max and count beside them."""
    sized = with_prefix(df, keys, order, pos="pos", size="total")
    kept = sized.where(F.col("pos") >= F.col("total") - n)
    ends = df.groupBy(*keys).agg(F.min(value).alias("all_min"), F.max(value).alias("all_max"))
    return join_same(kept, ends, keys).withColumn("newest", F.col("pos") == F.col("total") - 1)


def range_in(df: DataFrame, keys: list[str], x: str, lo, hi, value: str) -> DataFrame:
    """Value range of a log inside an x range."""
    return df.where((F.col(x) >= lo) & (F.col(x) < hi)).groupBy(*keys).agg(
        F.min(value).alias("y_min"), F.max(value).alias("y_max"), F.count(F.lit(1)).alias("n"))


