"""Exact, approximate and positional lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.filters import criteria_match
from tallyloom.operators.ordering import carry_forward, join_same


def _fold(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    # a blank lookup value acts as the number 0
    return F.lower(F.col(name)) if kind == "string" else F.coalesce(F.col(name), F.lit(0).cast(kind))


def lookup_exact(left: DataFrame, right: DataFrame, left_key: str, right_key: str, pos: str, take: list[str]) -> DataFrame:
    """First right row (by position) with an equal key; text ignores case; no match gives NULL and ``found`` false.

    The right side is reduced to one row per key with map-side combining, so a
    frequent key on the right never multiplies the left.
    """
    first = right.groupBy(F.lower(right_key) if dict(right.dtypes)[right_key] == "string" else F.col(right_key)).agg(
        F.min_by(F.struct(*take), F.col(pos)).alias("_row"))
    first = first.toDF("_k", "_row").where(F.col("_k").isNotNull())
    joined = left.withColumn("_k", _fold(left, left_key)).join(first, "_k", "left")
    return joined.select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in take], F.col("_row").isNotNull().alias("found"))


def lookup_asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, pos: str, take: list[str],
                forward: bool = False) -> DataFrame:
    """Nearest right row at or before (``forward``: at or after) each left key, within ``by``.

    Both sides are unioned and the latest right row is carried to the left rows: one
    shuffle on (by, chunk of keys), no range join.  Equal keys count as a match; of equal
    right keys the last position is taken looking back, the first looking ahead.
    Every left row comes back; one without a lookup value is unmatched.
    """
    pack = F.struct(F.col("_k").alias("key"), *take)
    rows_l = left.withColumn("_id", F.struct(*left.columns)).select(
        *by, F.col(left_on).alias("_k"), F.lit(0 if forward else 1).alias("_side"), F.lit(None).cast("long").alias("_p"), "_id")
    shape = F.lit(None).cast(dict(rows_l.dtypes)["_id"])
    rows_r = right.withColumn("_k", F.col(right_on)).select(
        *by, "_k", F.lit(1 if forward else 0).alias("_side"), F.col(pos).cast("long").alias("_p"), shape.alias("_id"), pack.alias("_row"))
    both = rows_l.unionByName(rows_r, allowMissingColumns=True).where(F.col("_k").isNotNull())
    out = carry_forward(both, by, [F.col("_k"), F.col("_side"), F.col("_p")], None,
                        {"_hit": F.col("_row")}, ascending=not forward)
    hits = out.where(F.col("_id").isNotNull())
    found = hits.select("_id.*", F.col("_hit.key").alias("matched_key"), *[F.col(f"_hit.{c}").alias(c) for c in take])
    kinds = dict(found.dtypes)
    lone = left.where(F.col(left_on).isNull()).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("matched_key", *take)])
    return found.unionByName(lone)


def lookup_nearest(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, pos: str, take: list[str],
                   key: list[str], digits: int | None = None) -> DataFrame:
    """Right row with the smallest distance to the left key; the lower key wins a tie.

    ``digits``: distances that agree to so many decimals tie, whatever their binary fractions.
    """
    apart = lambda d: d if digits is None else F.round(d, digits)
    back = lookup_asof(left, right, by, left_on, right_on, pos, take)
    ahead = lookup_asof(left, right, by, left_on, right_on, pos, take, forward=True)
    b = back.select(*left.columns, F.struct("matched_key", *take).alias("_b"))
    a = ahead.select(*[F.col(k) for k in key], F.struct("matched_key", *take).alias("_a"))
    both = join_same(b, a, key, "left")
    closer = F.when(F.col("_b").isNull() | F.col("_b.matched_key").isNull(), F.col("_a")).when(
        F.col("_a.matched_key").isNull(), F.col("_b")).when(
        apart(F.col(left_on) - F.col("_b.matched_key")) <= apart(F.col("_a.matched_key") - F.col(left_on)), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_n", closer).select(*left.columns, "_n.*")


def match_first(df: DataFrame, column: str, pos: str, targets: list[str], dtype: str = "string") -> DataFrame:
    """1-based position of the first value meeting each target (wildcards allowed); one aggregate pass for all targets."""
    hits = df.agg(*[F.min(F.when(criteria_match(F.col(column), t, dtype) & F.col(column).isNotNull(), F.col(pos))).alias(f"t{i}")
                    for i, t in enumerate(targets)])
    rows = F.array(*[F.struct(F.lit(t).alias("target"), (F.col(f"t{i}") + 1).cast("long").alias("position")) for i, t in enumerate(targets)])
    return hits.select(F.explode(rows).alias("r")).select("r.*")


def match_desc(left: DataFrame, right: DataFrame, left_on: str, right_on: str, pos: str) -> DataFrame:
    """MATCH on descending data: first exact hit, else the last row holding the smallest value above the target."""
    per = right.groupBy(F.col(right_on).alias("_v")).agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"))
    out = lookup_asof(left, per, [], left_on, "_v", "first_pos", ["first_pos", "last_pos"], forward=True)
    return out.withColumn("position", F.when(F.col("matched_key") == F.col(left_on), F.col("first_pos")).otherwise(F.col("last_pos")) + 1) \
        .select(*left.columns, "matched_key", "position")


def lookup_row(matrix: DataFrame, row: str, headers: list[str], left: DataFrame, left_row: str, left_header: str) -> DataFrame:
    """Horizontal lookup: the header axis becomes rows, then it is an equality join."""
    cells = matrix.unpivot([row], headers, "_h", "value").withColumn("_h", F.lower("_h")).withColumnRenamed(row, "_r")
    keyed = left.withColumn("_h", F.lower(left_header)).withColumn("_r", F.col(left_row))
    return keyed.join(cells, ["_r", "_h"], "left").select(*left.columns, "value")


def index_at(cells: DataFrame, pos: str, columns: list[str], requests: DataFrame, row: str, col: str) -> DataFrame:
    """Value at a 1-based (row, column) of a positioned table."""
    packed = cells.select((F.col(pos) + 1).alias(row), F.array(*[F.col(c).cast("string") for c in columns]).alias("_cells"))
    return requests.join(packed, row, "left").withColumn("value", F.get("_cells", F.col(col).cast("int") - 1)).drop("_cells")
