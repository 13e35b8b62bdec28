"""Grouped samples from CSV, JSON and tables, in long form (label, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse_group_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``label,value`` lines without header; short, blank or non-numeric lines are skipped."""
    parts = F.split(column, ",", -1)
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("label"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("value")) \
        .where((F.col("label") != "") & F.col("value").isNotNull())


def read_group_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_group_lines(spark.read.text(path))


def parse_group_json(docs: DataFrame, column: str = "value") -> DataFrame:
    """Objects of label -> number array."""
    per = docs.select(F.explode(F.from_json(column, "map<string,array<double>>")).alias("label", "_v"))
    return per.select("label", F.explode("_v").alias("value"))


def read_group_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_group_json(spark.read.text(path, wholetext=True))


def to_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(F.trim(F.col(group).cast("string")).alias("label"), F.col(value).try_cast("double").alias("value")) \
        .where((F.col("label") != "") & F.col("value").isNotNull())


def to_groups_multi(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Several value columns: the mean of the filled ones; a row with none is dropped."""
    cells = F.array_compact(F.array(*[F.col(v).try_cast("double") for v in values]))
    mean = F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), F.size(cells).cast("double"))
    return df.select(F.trim(F.col(group).cast("string")).alias("label"), mean.alias("value")).where((F.col("label") != "") & F.col("value").isNotNull())


def append_rows(table: DataFrame, rows: DataFrame, computed: dict[str, Column] | None = None) -> DataFrame:
    """Rows added by column name; computed columns are carried on to the new rows."""
    for name, c in (computed or {}).items():
        rows = rows.withColumn(name, c)
    return table.unionByName(rows, allowMissingColumns=True)


def replace_rows(table: DataFrame, rows: DataFrame, computed: dict[str, Column] | None = None) -> DataFrame:
    """Rows in the table's shape that take the place of all present rows; write with mode overwrite."""
    for name, c in (computed or {}).items():
        rows = rows.withColumn(name, c)
    have = set(rows.columns)
    types = dict(table.dtypes)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in table.columns])


def save_rows(rows: DataFrame, path: str, replace: bool = False) -> None:
    rows.write.mode("overwrite" if replace else "append").parquet(path)
