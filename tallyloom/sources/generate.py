"""Seeded series generators; a series is (key, i, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.operators.ordering import with_prefix


def frame(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).withColumnRenamed("id", "i")


def consecutive(i: Column, first: float = 0.0, step: float = 1.0) -> Column:
    return F.lit(float(first)) + i * step


def linear_range(i: Column, count: int | Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + i * (F.lit(float(high - low)) / (F.lit(count) - 1 if isinstance(count, int) else count - 1))


def sin(i: Column, count: int | Column, mult: float = 1.0, offset: float = 0.0, oscillations: float = 1.0, phase: float = 0.0) -> Column:
    last = (F.lit(count) if isinstance(count, int) else count) - 1
    return F.sin(i * (F.lit(2 * math.pi * oscillations) / last) + phase * 2 * math.pi) * mult + offset


def square(i: Column, period: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(F.floor(i / period) % 2 == 0, float(low)).otherwise(float(high))


def hashed_unit(i: Column, seed: int, draw: int = 0) -> Column:
    """Uniform number in [0, 1) from the row's number alone: the same in every layout and every recomputed task."""
    digits = F.substr(F.md5(F.concat_ws("-", F.lit(seed), i, F.lit(draw)).cast("binary")), F.lit(1), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def random_sample(i: Column, seed: int, mult: float = 1.0, offset: float = 0.0) -> Column:
    return hashed_unit(i, seed) * mult + offset


def random_normal(i: Column, seed: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller transform of two uniform numbers of the row."""
    size = F.sqrt(F.log(1 - hashed_unit(i, seed)) * -2)
    return size * F.cos(hashed_unit(i, seed, 1) * (2 * math.pi)) * sd + mean


def add_noise(value: Column, i: Column, magnitude: float, seed: int) -> Column:
    return value + (hashed_unit(i, seed) - 0.5) * magnitude


def random_walk(df: DataFrame, keys: list[str], i: str, step: Column, offset: float = 0.0) -> DataFrame:
    """Cumulative sum of steps along each key."""
    out = with_prefix(df, keys, [F.col(i)], F.floor(F.col(i) / 65536), pos=None, sums={"walk": step})
    return out.withColumn("walk", F.col("walk") + offset)
