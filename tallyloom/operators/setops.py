"""Set algebra on cells, interval consolidation and paragraph comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.operators.ordering import meet
from tallyloom.session import cut_lineage


def _side(df: DataFrame, pred: Column | None) -> DataFrame:
    return (df.where(pred) if pred is not None else df).select("row", "col")


def cells_union(a: DataFrame, b: DataFrame, pred_a: Column | None = None, pred_b: Column | None = None) -> DataFrame:
    return _side(a, pred_a).union(_side(b, pred_b)).distinct()


def cells_intersection(a: DataFrame, b: DataFrame, pred_a: Column | None = None, pred_b: Column | None = None) -> DataFrame:
    return _side(a, pred_a).intersect(_side(b, pred_b))


def cells_difference(a: DataFrame, b: DataFrame, pred_a: Column | None = None, pred_b: Column | None = None) -> DataFrame:
    return _side(a, pred_a).subtract(_side(b, pred_b))


def _runs(spans: DataFrame, keys: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """Number of the run of overlapping or adjacent spans that each distinct start of a key belongs to."""
    per = spans.groupBy(*keys, lo).agg(F.max(hi).alias("_far"))
    along = W.partitionBy(*keys).orderBy(lo)
    reach = F.max("_far").over(along.rowsBetween(W.unboundedPreceding, -1))
    opened = per.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach + 1), 1).otherwise(0))
    return opened.select(*keys, lo, F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)).alias(name))


def _banded(src: DataFrame, key: list[str], per_task: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Ranges with the numbers of the first band they cross and of the first one after them, and the bands."""
    step = cut_lineage if n > per_task else (lambda df: df)  # a split join reads its sides more than once
    strip = step(meet(src, _runs(src, ["_sh", "_no"], "_a", "_z", "_strip"), ["_sh", "_no", "_a"], per_task, n))
    one = cut_lineage(meet(strip, _runs(strip, ["_sh", "_no", "_strip"], "_t", "_b", "_run"), ["_sh", "_no", "_strip", "_t"], per_task, n))
    events = one.select(*key, F.explode(F.array(F.col("_t"), F.col("_b") + 1)).alias("_at")).distinct()
    along = W.partitionBy(*key).orderBy("_at")
    bands = step(events.select(*key, "_at", F.row_number().over(along).alias("_band"), F.lead("_at").over(along).alias("_until")))
    opens = bands.select(*key, F.col("_at").alias("_t"), F.col("_band").alias("_i"))
    closes = bands.select(*key, (F.col("_at") - 1).alias("_b"), F.col("_band").alias("_j"))
    return meet(step(meet(one, opens, [*key, "_t"], per_task, n)), closes, [*key, "_b"], per_task, n), bands


def range_consolidate(ranges: DataFrame, sheet: str, top: str, left: str, bottom: str, right: str, per_task: int = 2_000_000) -> DataFrame:
    """Disjoint rectangles covering exactly the cells of overlapping or adjacent ranges.

    Column intervals are merged per row, then equal intervals of adjacent rows are stacked.
    Rows are not unrolled: a range is two events, its first row and the row after its last,
    and what is merged are the bands between distinct events.  Ranges that no column chain
    and then no row chain connects never meet, so a range only crosses bands that other
    ranges of its own cluster open.  A sheet's width and height (16,384 and 1,048,576)
    bound every window; frequent starts are dealt over tasks.  Where ranges have four rows or
    fewer on average, their rows serve as bands and need no events.
    """
    ends = [F.least(top, bottom).alias("_t"), F.greatest(top, bottom).alias("_b"), F.least(left, right).alias("_a"), F.greatest(left, right).alias("_z")]
    src = ranges.select(F.coalesce(F.col(sheet).cast("string"), F.lit("")).alias("_sh"), F.col(sheet).isNull().alias("_no"), *ends).dropna(subset=["_t", "_b", "_a", "_z"]).groupBy("_sh", "_no", "_t", "_a", "_z").agg(F.max("_b").alias("_b"))
    src = cut_lineage(src)
    n, spanned = src.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_b") - F.col("_t") + 1), F.lit(0))).first()
    if spanned <= 4 * n:  # so flat that rows are the cheaper bands
        key = ["_sh", "_no"]
        placed = src.withColumn("_i", F.col("_t")).withColumn("_j", F.col("_b") + 1)
    else:
        key = ["_sh", "_no", "_strip", "_run"]
        placed, bands = _banded(src, key, per_task, n)
    crossed = placed.select(*key, F.explode(F.sequence(F.col("_i"), F.col("_j") - 1)).alias("_band"), "_a", "_z").groupBy(*key, "_band", "_a").agg(F.max("_z").alias("_z"))
    across = W.partitionBy(*key, "_band").orderBy("_a")
    reach = F.max("_z").over(across.rowsBetween(W.unboundedPreceding, -1))
    opened = crossed.withColumn("_new", F.when(reach.isNull() | (F.col("_a") > reach + 1), 1).otherwise(0))
    grouped = opened.withColumn("_g", F.sum("_new").over(across.rowsBetween(W.unboundedPreceding, 0)))
    merged = grouped.groupBy(*key, "_band", "_g").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    stack = W.partitionBy(*key, "_a", "_z").orderBy("_band")
    tall = merged.withColumn("_k", F.col("_band") - F.row_number().over(stack))
    if spanned <= 4 * n:
        tall = tall.select("*", F.col("_band").alias("_at"), (F.col("_band") + 1).alias("_until"))
    else:
        tall = tall.join(bands, [*key, "_band"])
    out = tall.groupBy(*key, "_a", "_z", "_k").agg(F.min("_at").alias("_t"), F.max("_until").alias("_u"))
    kinds = dict(ranges.dtypes)
    return out.select(F.when(~F.col("_no"), F.col("_sh").cast(kinds[sheet])).alias(sheet), *[c.cast(kinds[n]).alias(n) for n, c in (
        (top, F.col("_t")), (left, F.col("_a")), (bottom, F.col("_u") - 1), (right, F.col("_z")))])


def doc_compare(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraph difference of two versions per document: added, removed, modified.

    Equal paragraphs pair up by (digest, occurrence); what is left over at the same
    index on both sides is a modification.
    """
    def paragraphs(df, side):
        t = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
        rows = df.select(key, F.posexplode(t).alias("index", "_t")).where(F.col("_t") != "")
        order = W.partitionBy(key, "_h").orderBy("index")
        # the paragraph's rank among the kept ones is its index in the comparison
        nth = F.row_number().over(W.partitionBy(key).orderBy("index")) - 1
        return rows.withColumn("_h", F.xxhash64("_t")).withColumn("_n", F.row_number().over(order)).select(
            key, "_h", "_n", nth.alias(f"i_{side}"), F.col("_t").alias(f"{side}_text"))

    both = paragraphs(old, "old").join(paragraphs(new, "new"), [key, "_h", "_n"], "full")
    gone = both.where(F.col("i_new").isNull()).select(key, F.col("i_old").alias("index"), "old_text")
    come = both.where(F.col("i_old").isNull()).select(key, F.col("i_new").alias("index"), "new_text")
    kind = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").otherwise("modified")
    return gone.join(come, [key, "index"], "full").select(key, "index", kind.alias("change"), "old_text", "new_text")
