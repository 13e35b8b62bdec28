"""Pivot tables: aggregates, totals and show-as calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The summary functions of a pivot value field.
SUMMARIES = {
    "sum": F.sum, "count": F.count, "average": F.avg, "min": F.min, "max": F.max, "product": F.product,
    "countNumbers": lambda c: F.count(c.try_cast("double")), "stddev": F.stddev_samp, "stddevp": F.stddev_pop,
    "var": F.var_samp, "varp": F.var_pop,
}


def summary(field: str, function: str = "sum") -> Column:
    return SUMMARIES[function](F.col(field))


def pivot(df: DataFrame, rows: list[str], column: str | None, items: list, values: list[tuple[str, str]],
          report_filter: Column | None = None) -> DataFrame:
    """Row labels × listed column items × (field, function) values."""
    src = df.where(report_filter) if report_filter is not None else df
    aggs = [summary(f, fn).alias(f"{fn}_{f}") for f, fn in values]
    grouped = src.groupBy(*rows)
    return (grouped.pivot(column, items) if column else grouped).agg(*aggs)


def pivot_totals(df: DataFrame, rows: list[str], values: list[tuple[str, str]], grand: bool = True,
                 subtotals: str = "bottom", at_cube: bool = False) -> DataFrame:
    """Aggregates with subtotals and grand total from one grouping-sets pass.

    ``level`` counts the rolled-up columns; ``place`` orders totals above or below
    their detail rows.
    """
    grouped = df.cube(*rows) if at_cube else df.rollup(*rows)
    ids = F.grouping_id()
    aggs = [summary(f, fn).alias(f"{fn}_{f}") for f, fn in values]
    out = grouped.agg(ids.cast("long").alias("grouping"), *aggs).withColumn("level", F.bit_count("grouping"))
    if not grand:
        out = out.where(F.col("level") < len(rows))
    if subtotals == "none":
        out = out.where((F.col("level") == 0) | (F.col("level") == len(rows)))
    return out.withColumn("place", F.when(F.col("level") == 0, 0).otherwise(-1 if subtotals == "top" else 1))


def show_as(table: DataFrame, row: str, column: str, value: str, base_column: object = None) -> DataFrame:
    """All show-as calculations of an aggregated (row, column, value) table.

    Works on the pivoted cells only, whose number is rows × column items.  Previous
    and next refer to the column order within a row.
    """
    v = F.col(value)
    along = W.partitionBy(row).orderBy(column)
    in_row, in_col = W.partitionBy(row), W.partitionBy(column)
    total = table.agg(F.sum(value)).scalar()
    prev, nxt = F.lag(v).over(along), F.lead(v).over(along)
    base = F.max(F.when(F.col(column) == base_column, v)).over(in_row)
    r, c = F.sum(v).over(in_row), F.sum(v).over(in_col)
    return table.select(
        row, column, v.alias("normal"), (v - prev).alias("difference_prev"), (v - nxt).alias("difference_next"),
        (v - base).alias("difference_base"), F.try_divide(v, base).alias("percent_of_base"),
        F.try_divide(v - prev, prev).alias("percent_difference_prev"),
        F.sum(v).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("running_total"),
        F.try_divide(v, r).alias("percent_of_row"), F.try_divide(v, c).alias("percent_of_column"),
        F.try_divide(v, total).alias("percent_of_total"), F.try_divide(v * total, r * c).alias("index_value"))
