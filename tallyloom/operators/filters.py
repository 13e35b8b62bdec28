"""Spreadsheet-style criteria, filters, conditional rules, validation and profiling."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.cells import ERRORS
from tallyloom.operators.ordering import order_stats

_PREFIX = re.compile(r"^(<>|>=|<=|=|>|<)?(.*)$", re.S)


# --- wildcards and criteria -------------------------------------------------

def wildcard_regex(pattern: str, whole: bool = True) -> str:
    """Java regex of a ``* ? ~`` pattern."""
    out = []
    for esc, star, one, other in re.findall(r"~(.)|(\*)|(\?)|(.)", re.sub(r"(?<!~)((?:~~)*)~$", r"\1", pattern), re.S):
        out.append(".*" if star else "." if one else re.escape(esc or other))
    body = "".join(out)
    return f"(?isu)^{body}$" if whole else f"(?isu){body}"


def wildcard_match(col: Column, pattern: str, whole: bool = True) -> Column:
    return F.coalesce(col.rlike(wildcard_regex(pattern, whole)), F.lit(False))


def _compare(op: str | None, left: Column, right: Column) -> Column:
    return {None: left == right, "=": left == right, "<>": left != right, ">": left > right,
            "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def criteria_match(col: Column, criterion: str | float | bool | None, dtype: str = "string") -> Column:
    """Boolean column of a COUNTIF-style criterion on a typed column.

    ``dtype`` is number, string or boolean.  A number operand also matches text that
    reads as that number; otherwise types must agree, and ``<>`` holds across types.
    """
    if criterion is None:
        op, operand = "=", 0.0
    elif isinstance(criterion, str):
        op, text = _PREFIX.match(criterion).groups()
        operand = text
        if text.upper() in ("TRUE", "FALSE"):
            operand = text.upper() == "TRUE"
        else:
            try:
                operand = float(text.replace(",", "")) if re.fullmatch(r"\s*[-+]?[\d,]*\.?\d+(?:[eE][-+]?\d+)?\s*", text) else text
            except ValueError:
                pass
    else:
        op, operand = None, criterion
    other = F.lit(op == "<>")
    if operand == "" and isinstance(operand, str):
        blank = col.isNull()
        if op is None:
            return blank | (F.coalesce(col == "", F.lit(False)) if dtype == "string" else F.lit(False))
        return {"=": blank, "<>": ~blank}.get(op, F.lit(False))
    if isinstance(operand, bool):
        return F.coalesce(_compare(op, col.cast("int"), F.lit(int(operand))), other) if dtype == "boolean" else other
    if isinstance(operand, float):
        if dtype == "boolean":
            return other
        number = col.try_cast("double") if dtype == "string" else col.cast("double")
        return F.coalesce(_compare(op, number, F.lit(operand)), other)
    if dtype != "string":
        return other
    if op in (None, "=", "<>"):
        hit = wildcard_match(col, operand)
        return F.when(col.isNull(), other).otherwise(~hit if op == "<>" else hit)
    return F.coalesce(_compare(op, F.lower(col), F.lit(operand.lower())), F.lit(False))


# --- auto filters ------------------------------------------------------------

def filter_values(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    cond = F.lit(True)
    for name, values in allowed.items():
        cond = cond & F.col(name).isin(values)
    return df.where(cond)


def custom_condition(col: Column, op: str, *args) -> Column:
    """One custom filter condition; text is compared without case, blanks satisfy only negations.

    Equal and not-equal take ``* ? ~`` patterns on text.
    """
    text = isinstance(args[0], str)
    if text and op in ("eq", "ne"):
        same = wildcard_match(col.cast("string"), args[0])
        return same if op == "eq" else ~same
    if op == "ne":
        return ~F.coalesce(col == F.lit(args[0]), F.lit(False))
    c = F.lower(col) if text else col
    a = [F.lit(x.lower() if text else x) for x in args]
    yes = {
        "eq": lambda: c == a[0], "gt": lambda: c > a[0], "lt": lambda: c < a[0],
        "ge": lambda: c >= a[0], "le": lambda: c <= a[0],
        "between": lambda: (c >= a[0]) & (c <= a[1]), "notBetween": lambda: (c < a[0]) | (c > a[1]),
        "begins": lambda: c.startswith(a[0]), "ends": lambda: c.endswith(a[0]), "contains": lambda: c.contains(a[0]),
    }
    if op in yes:
        return F.coalesce(yes[op](), F.lit(False))
    base = op.removeprefix("not")
    return ~F.coalesce(yes[base[0].lower() + base[1:]](), F.lit(False))


def filter_custom(df: DataFrame, column: str, first: tuple, second: tuple | None = None, connector: str = "and") -> DataFrame:
    cond = custom_condition(F.col(column), *first)
    if second:
        more = custom_condition(F.col(column), *second)
        cond = cond & more if connector == "and" else cond | more
    return df.where(cond)


def filter_date_group(df: DataFrame, column: str, moment: datetime, unit: str) -> DataFrame:
    """Same year … second as ``moment``, stated as a half-open range so that it is pushed to the scan."""
    fields = ["year", "month", "day", "hour", "minute", "second"]
    keep = fields.index(unit) + 1
    parts = [moment.year, moment.month, moment.day, moment.hour, moment.minute, moment.second][:keep]
    low = datetime(*(parts + [1, 1, 1][keep:3] if keep < 3 else parts))
    start = F.lit(low.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    step = {"year": "INTERVAL 1 YEAR", "month": "INTERVAL 1 MONTH"}.get(unit, f"INTERVAL 1 {unit.upper()}")
    return df.where((F.col(column) >= start) & (F.col(column) < start + F.expr(step)))


def filter_top_n(df: DataFrame, column: str, n: int, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Rows at or beyond the n-th largest (smallest) number, ties kept.

    A count takes its threshold from a distributed top-n up to 10,000 items, beyond that
    from exact order statistics, as does a percent, which is a share of all rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    v = F.col(column)
    if percent:
        edge = order_stats(df, [], v, {"t": lambda c: F.ceil(c * float(n) / 100) - 1}, descending=not bottom).select("t").scalar()
    elif n > 10_000:
        edge = order_stats(df, [], v, {"t": lambda c: F.least(F.lit(n), c) - 1}, descending=not bottom).select("t").scalar()
    else:
        best = df.select(v.alias("v")).where(v.isNotNull()).orderBy(F.col("v").asc() if bottom else F.col("v").desc()).limit(n)
        edge = best.agg(F.max("v") if bottom else F.min("v")).scalar()
    return df.where(v <= edge if bottom else v >= edge)


def filter_average(df: DataFrame, column: str, above: bool = True) -> DataFrame:
    mean = df.agg(F.avg(column)).scalar()
    return df.where(F.col(column) > mean if above else F.col(column) < mean)


def range_slice(df: DataFrame, pos: str, first: int, last: int, columns: list[str]) -> DataFrame:
    return df.where(F.col(pos).between(first, last)).select(pos, *columns)


def search_text(df: DataFrame, row: str, columns: list[str], needle: str) -> DataFrame:
    cells = df.select(row, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([row], columns, "column", "text")
    return cells.where(F.contains(F.lower("text"), F.lit(needle.lower())))


def drop_unused(df: DataFrame, columns: list[str], predicate: Column | None = None) -> DataFrame:
    kept = df.dropna(how="all", subset=columns)
    return kept.where(predicate) if predicate is not None else kept


def is_ascending(df: DataFrame, keys: list[str], order: Column, value: str, chunk: Column) -> DataFrame:
    """Is the series sorted?  Chunks are checked alone, then their end points in order."""
    inside = W.partitionBy(*keys, "_chunk").orderBy("_o")
    rows = df.select(*keys, F.col(value).alias("_v"), order.alias("_o"), chunk.alias("_chunk"))
    flagged = rows.withColumn("_bad", F.col("_v") < F.lag("_v").over(inside))
    per = flagged.groupBy(*keys, "_chunk").agg(
        F.bool_or(F.coalesce("_bad", F.lit(False))).alias("_bad"),
        F.min_by("_v", "_o").alias("_first"), F.max_by("_v", "_o").alias("_last"))
    walk = W.partitionBy(*keys).orderBy("_chunk")
    gap = F.coalesce(F.col("_first") < F.lag("_last").over(walk), F.lit(False))
    return per.withColumn("_bad", F.col("_bad") | gap).groupBy(*keys).agg((~F.bool_or("_bad")).alias("ascending"))


# --- conditional rules --------------------------------------------------------

def flag_occurrence(df: DataFrame, column: str) -> DataFrame:
    """Adds ``is_duplicate`` / ``is_unique`` for a column.

    Counting per value first keeps a frequent value from collecting in one task; the
    value table is joined back and a hot value is split by adaptive skew handling.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_seen"))
    return df.join(counts, column, "left").withColumn("is_duplicate", F.coalesce(F.col("_seen") > 1, F.lit(False))) \
        .withColumn("is_unique", F.coalesce(F.col("_seen") == 1, F.lit(False))).drop("_seen")


def rule(col: Column, kind: str, *args) -> Column:
    """Row-local conditional rule as a boolean flag."""
    text = lambda: F.lower(col.cast("string"))
    word = lambda: F.lit(str(args[0]).lower())
    table = {
        "contains": lambda: F.contains(text(), word()), "notContains": lambda: ~F.contains(text(), word()),
        "startsWith": lambda: F.startswith(text(), word()), "endsWith": lambda: F.endswith(text(), word()),
        "isBlank": lambda: F.coalesce(F.trim(col.cast("string")) == "", F.lit(True)),
        "notBlank": lambda: F.coalesce(F.trim(col.cast("string")) != "", F.lit(False)),
        "isError": lambda: col.cast("string").isin(*ERRORS),
        "notError": lambda: ~col.cast("string").isin(*ERRORS),
        "expression": lambda: args[0],
    }
    found = table[kind]() if kind in table else custom_condition(col, kind, *args)
    return F.coalesce(found, F.lit(False))


# The relative date periods.
PERIODS = ("yesterday", "today", "tomorrow", "last7Days", "lastWeek", "thisWeek", "nextWeek", "lastMonth", "thisMonth", "nextMonth")


def flag_time_period(ts: Column, as_of: str, period: str) -> Column:
    """Is the date in a period relative to a given day?  Weeks start on Sunday."""
    day = ts.cast("date")
    ref = F.lit(as_of).cast("date")
    week = F.date_sub(ref, F.dayofweek(ref) - 1)
    month = F.trunc(ref, "month")
    start, days = {
        "yesterday": (F.date_sub(ref, 1), 1), "today": (ref, 1), "tomorrow": (F.date_add(ref, 1), 1),
        "last7Days": (F.date_sub(ref, 6), 7), "lastWeek": (F.date_sub(week, 7), 7), "thisWeek": (week, 7),
        "nextWeek": (F.date_add(week, 7), 7),
    }.get(period, (None, None))
    if start is None:
        shift = {"lastMonth": -1, "thisMonth": 0, "nextMonth": 1}[period]
        return (day >= F.add_months(month, shift)) & (day < F.add_months(month, shift + 1))
    return (day >= start) & (day < F.date_add(start, days))


def scale_bucket(df: DataFrame, column: str, thresholds: list[tuple[str, float]], name: str = "bucket") -> DataFrame:
    """Bucket of a value among thresholds: min, max, number, percent (of range) or percentile (of rank)."""
    v = F.col(column)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    scope = ends.select(F.struct("lo", "hi")).scalar()
    picks = {f"p{i}": (lambda p: lambda n: F.floor((n - 1) * p / 100))(p) for i, (k, p) in enumerate(thresholds) if k == "percentile"}
    if picks:
        ranks = order_stats(df, [], v, picks).select(F.struct(*picks)).scalar()
    edges = []
    for i, (kind, p) in enumerate(thresholds):
        edges.append({
            "min": lambda: F.col("_s.lo"), "max": lambda: F.col("_s.hi"), "number": lambda: F.lit(float(p)),
            "percent": lambda: F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo")) * p / 100,
            "percentile": lambda: F.col(f"_r.p{i}"),
        }[kind]())
    out = df.withColumn("_s", scope)
    if picks:
        out = out.withColumn("_r", ranks)
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(v >= e, 1).otherwise(0)
    ratio = F.try_divide(v - F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo"))
    return out.withColumn(name, bucket).withColumn("position", ratio).select(*df.columns, name, "position")


def validate_rules(df: DataFrame, key: str, rules: list[tuple]) -> DataFrame:
    """Violation rows (key, rule, value).  A rule is (name, column, kind, op, *args)."""
    found = []
    for name, column, kind, op, *args in rules:
        c = F.col(column)
        measured = {"whole": c, "decimal": c, "date": c, "time": F.date_format(c, "HH:mm:ss"),
                    "textLength": F.length(c.cast("string")), "list": c}[kind]
        good = measured.isin(args) if kind == "list" else custom_condition(measured, op, *args)
        if kind == "whole":
            good = good & (c == F.floor(c))
        found.append(F.when(c.isNotNull() & ~good, F.struct(F.lit(name).alias("rule"), c.cast("string").alias("value"))))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(key, F.explode_outer(hits).alias("_h")).where("_h is not null").select(key, "_h.rule", "_h.value")


def column_profile(df: DataFrame, numbers: list[str], texts: list[str], dates: list[str]) -> DataFrame:
    """One row per column from a single aggregation pass over all columns."""
    none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = []
    for c in [*numbers, *texts, *dates]:
        x = F.col(c)
        num, txt, dt = c in numbers, c in texts, c in dates
        cells.append(F.struct(
            F.lit(c).alias("column"), (F.count_if(x.isNull()) > 0).alias("has_blank"), F.lit(num).alias("has_number"),
            (F.coalesce(F.bool_and(x.cast("double") == F.floor(x.cast("double"))), F.lit(False)) if num else F.lit(False)).alias("all_integer"),
            (F.count(x) > 0 if txt else F.lit(False)).alias("has_text"),
            (F.coalesce(F.max(F.length(x)) > 255, F.lit(False)) if txt else F.lit(False)).alias("long_text"),
            F.lit(dt).alias("has_date"),
            (F.min(x).cast("double") if num else none_n).alias("min_value"), (F.max(x).cast("double") if num else none_n).alias("max_value"),
            (F.date_format(F.min(x), "yyyy-MM-dd HH:mm:ss") if dt else none_t).alias("min_date"),
            (F.date_format(F.max(x), "yyyy-MM-dd HH:mm:ss") if dt else none_t).alias("max_date")))
    return df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).select(
        F.explode_outer(F.array(*[f"c{i}" for i in range(len(cells))])).alias("p")).where("p is not null").select("p.*")


# --- criteria aggregates --------------------------------------------------------

def count_ifs(df: DataFrame, criteria: list[Column], keys: list[str] | None = None, name: str = "n") -> DataFrame:
    cond = criteria[0]
    for c in criteria[1:]:
        cond = cond & c
    return df.groupBy(*(keys or [])).agg(F.count_if(cond).alias(name))


def tally_if(df: DataFrame, value: str, criteria: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Sum, average, smallest, largest and count of numbers in rows meeting every criterion."""
    cond = criteria[0]
    for c in criteria[1:]:
        cond = cond & c
    v = F.when(cond, F.col(value))
    return df.groupBy(*(keys or [])).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.avg(v).alias("average"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def count_family(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*(keys or [])).agg(
        F.count(c.try_cast("double")).alias("count_numbers"), F.count(c).alias("count_nonblank"),
        F.count_if(c.isNull() | (c.cast("string") == "")).alias("count_blank"))


def cell_number(kind: Column, num: Column, flag: Column) -> Column:
    """Number of a typed cell for the A-family: text is 0, booleans 0/1, blank ignored."""
    return F.when(kind == "number", num).when(kind == "text", 0.0).when(kind == "boolean", flag.cast("double"))


def a_family(df: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.avg(value).alias("average"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_samp(value).alias("stdev"), F.stddev_pop(value).alias("stdevp"),
        F.var_samp(value).alias("var"), F.var_pop(value).alias("varp"))


def dev_sq(value: Column) -> Column:
    return F.var_pop(value) * F.count(value)


def geomean(value: Column) -> Column:
    """Geometric mean; NULL when a value is not positive."""
    return F.when(F.min(value) > 0, F.exp(F.avg(F.ln(F.when(value > 0, value)))))


def totals_row(df: DataFrame, spec: dict[str, str], label: str | None = None) -> DataFrame:
    """The totals row of a table: one function per column."""
    fn = {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg, "count": F.count,
          "countNumbers": lambda c: F.count(F.col(c).try_cast("double")), "stddev": F.stddev_samp, "variance": F.var_samp}
    row = df.agg(*[fn[f](c).alias(c) for c, f in spec.items()])
    return row.withColumn("row", F.lit(label)) if label else row


def large_k(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """k-th largest value per key (NULL when there are fewer)."""
    return order_stats(df, keys, F.col(value), {"value": lambda n: F.lit(k - 1)}, descending=True)


