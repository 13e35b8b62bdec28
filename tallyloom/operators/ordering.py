"""Ordered computations that do not depend on one task holding a whole key.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task.  When a
key may hold a third of the data that task never ends.  The helpers here split
each key into *chunks*: disjoint intervals of its order.  Work inside a chunk is a
window over ``(key, chunk)``; what must cross chunks (counts, sums, last values)
is aggregated per chunk first and scanned over the small chunk table.

Chunks are cut by load.  A hash sample of fixed size of (key, order) gives bounds of
about equal count, whatever the values look like: a narrow band, an hour that holds
most of a key, or one key with most rows is cut as often as its count asks for, because
bounds compare all order columns, the last of which is an id.  Each row finds its
chunk by binary search among the bounds, so nothing is shuffled to place it.  Only keys
that lie in several chunks need anything from outside their chunk.  Of two neighbouring
chunks at most one key lies in both, so there are fewer than twice as many such
(key, chunk) pairs as chunks, and these are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.session import cut_lineage

CHUNK = "_chunk"
_SAMPLES = 24  # per chunk: loads then stay within about half and twice of the mean
_MOST_CHUNKS = 2048


@dataclass(frozen=True)
class Down:
    """A column of a descending order (NULL last)."""
    column: Column


Order = list[Column | Down]


def _plain(order: Order) -> list[Column]:
    return [c.column if isinstance(c, Down) else c for c in order]


def _sorts(order: Order) -> list[Column]:
    return [c.column.desc() if isinstance(c, Down) else c.asc() for c in order]


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, so that no group is lost; the left side's keys stay."""
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    cond = None
    for k, n in names.items():
        one = F.col(k).eqNullSafe(F.col(n))
        cond = one if cond is None else cond & one
    return left.join(other, cond, how).drop(*names.values())


def meet(left: DataFrame, right: DataFrame, keys: list[str], per_task: int, rows: int | None = None) -> DataFrame:
    """Equality join in which a key with many rows, on either side or both, is dealt over several tasks.

    A key over ``per_task`` rows (or a two-thousandth of its side, if that is more) is split:
    its left rows are dealt to ``a`` parts and its right rows to ``b``, and each of the a x b
    pairs of parts meets once.  Fewer than four thousand keys can be that large, so that
    the table of their parts is broadcast; no row is shuffled to learn its part.  ``rows``
    is the size of the larger side where it is known; no key of a small table needs splitting.
    """
    if rows is not None and rows <= per_task:
        return left.join(right, keys)

    def loads(df, name):
        per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        most = F.greatest(F.lit(per_task), F.floor(df.agg(F.count(F.lit(1))).scalar() / 2000))
        return per.withColumn(f"{name}_parts", F.ceil(F.col(name) / most).cast("int"))

    split = loads(left, "_l").join(loads(right, "_r"), keys).where("_l_parts > 1 or _r_parts > 1").select(*keys, "_l_parts", "_r_parts")
    a, b = _dealt(left, split, keys, "l", "r"), _dealt(right, split, keys, "r", "l")
    return a.join(b, [*keys, "_meet_l", "_meet_r"]).drop("_meet_l", "_meet_r")


_PAIRS = 20_000_000  # of a task of `meet_pairs`


def meet_pairs(left: DataFrame, right: DataFrame, keys: list[str], pairs: int = _PAIRS, weights: tuple[str, str] | None = None) -> DataFrame:
    """Equality join whose work is its pairs rather than its rows: tasks are cut by the number of pairs.

    A few megabytes of rows can make billions of pairs, and partitions merged by their size would
    leave these to one task.  The pairs of each key are counted first; the join gets a task per
    ``pairs`` of them, and a key with more than a quarter of that is dealt to parts on both
    sides.  There are fewer such keys than rows over sqrt(pairs), and their table is broadcast.
    ``weights`` names a column of each side if its rows stand for several.
    """
    def loads(df, name, weight):
        return df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias(name))

    of_left, of_right = weights or (None, None)
    per = cut_lineage(loads(left, "_l", of_left).join(loads(right, "_r", of_right), keys))
    made = per.agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.sum(F.col("_l") + F.col("_r"))).first()
    tasks = min(20_000, math.ceil(max((made[0] or 0) / pairs, (made[1] or 0) / 1_000_000)))
    if tasks <= 1:
        return left.join(right, keys)
    # part of a side: about the square root of the quarter, less of the longer side if the other is short
    most = max(1.0, pairs / 4)
    part = lambda own, other: F.ceil(F.col(own) / F.greatest(F.lit(math.sqrt(most)), most / F.col(other))).cast("int")
    split = per.where(F.col("_l").cast("double") * F.col("_r") > most).select(*keys, part("_l", "_r").alias("_l_parts"), part("_r", "_l").alias("_r_parts"))
    a, b = _dealt(left, split, keys, "l", "r"), _dealt(right, split, keys, "r", "l")
    to = [*keys, "_meet_l", "_meet_r"]
    return a.repartition(tasks, *to).join(b.repartition(tasks, *to).hint("shuffle_hash"), to).drop("_meet_l", "_meet_r")


def _dealt(df: DataFrame, split: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Rows of keys in ``split`` with a part of their own side by hash, once for each part of the other side."""
    one = F.lit(1)
    spread = F.sequence(F.lit(0), F.coalesce(F.col(f"_{other}_parts"), one) - 1)
    mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(f"_{own}_parts"), one)).cast("int")
    return df.join(F.broadcast(split), keys, "left").select(*df.columns, mine.alias(f"_meet_{own}"), F.explode(spread).alias(f"_meet_{other}"))


def number_chunk(value: Column, grain: int = 256) -> Column:
    """Monotone bucket of a number with about 1/grain relative width, for callers who know that no bucket is large."""
    x = value.cast("double")
    # NaN sorts last, and so does its chunk; NULL sorts first, as a NULL chunk does
    return F.when(F.isnan(x), F.lit(2 ** 62)).when(x.isNotNull(), (F.signum(x) * F.floor(F.log1p(F.abs(x)) * grain)).cast("long"))


def time_chunk(ts: Column, unit: str = "hour") -> Column:
    """Monotone bucket of a timestamp, for callers who know that no bucket is large."""
    return F.date_trunc(unit, ts)


# --- chunks by load ---------------------------------------------------------------

def _before(a: Column, b: Column, down: list[bool]) -> Column:
    """Does the struct ``a`` stand before ``b``?  Single fields compare as structs, which order NULL and NaN as a sort does."""
    if not any(down):
        return a < b
    out = F.lit(False)
    for i in reversed(range(len(down))):
        x, y = a[f"c{i}"], b[f"c{i}"]
        less = (F.struct(y.alias("v")) < F.struct(x.alias("v"))) if down[i] else (F.struct(x.alias("v")) < F.struct(y.alias("v")))
        out = less | (x.eqNullSafe(y) & out)
    return out


def chunk_bounds(df: DataFrame, keys: list[str], order: Order, chunks: int) -> DataFrame:
    """One row with the sorted array ``bounds``, at most ``chunks`` - 1 places that cut ``df`` into runs of about equal count.

    Equal places count once, so that a place that repeats for ever does not fill the sample.
    """
    down = [False] * len(keys) + [isinstance(c, Down) for c in order]
    place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*map(F.col, keys), *_plain(order)])])
    src = df.select(place.alias("p"))
    rows = src.agg(F.count(F.lit(1))).scalar()
    span = 1 << 48
    sample = src.where(F.pmod(F.xxhash64("p"), F.lit(span)).cast("double") * rows < float(span) * _SAMPLES * chunks)
    ordered = F.array_sort(F.collect_set("p"), lambda a, b: F.when(_before(a, b, down), -1).when(_before(b, a, down), 1).otherwise(0)) if any(down) \
        else F.array_sort(F.collect_set("p"))
    slot = lambda i: F.floor(i * chunks / F.size("s"))
    cut = sample.agg(ordered.alias("s")).select(F.filter("s", lambda _, i: (i > 0) & (slot(i) != slot(i - 1))).alias("bounds"))
    return cut_lineage(cut)


def chunk_count(df: DataFrame) -> int:
    """Enough chunks for every task of a shuffle to have several."""
    return min(_MOST_CHUNKS, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_chunks(df: DataFrame, keys: list[str], order: Order, source: DataFrame | None = None) -> DataFrame:
    """Add CHUNK, the number of bounds at or before the row; ``source`` is a cheaper table with the same places to sample."""
    chunks = chunk_count(df)
    down = [False] * len(keys) + [isinstance(c, Down) for c in order]
    here = F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*map(F.col, keys), *_plain(order)])])
    bounds = chunk_bounds(df if source is None else source, keys, order, chunks).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(chunks.bit_length()))])

    def search(b: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
            at + s > F.size(b), at).when(_before(here, F.get(b, at + s - 1), down), at).otherwise(at + s))

    # named once and read once: the optimizer puts the subquery in its place, and no row carries the array
    return df.select("*", bounds.alias("_bounds")).select(*df.columns, F.transform(F.array("_bounds"), search)[0].alias(CHUNK))


def _outer(df: DataFrame, keys: list[str], aggs: list[Column], scans: list[tuple[str, Column]]) -> DataFrame:
    """(keys, CHUNK, what the key's other chunks tell) of the keys that lie in several chunks.

    ``aggs`` are computed per (key, chunk); ``scans`` names windows over them (see ``_walks``).
    """
    whole = W.partitionBy(*keys) if keys else W.partitionBy()
    per = df.groupBy(*keys, CHUNK).agg(*aggs).withColumn("_parts", F.count(F.lit(1)).over(whole)).where("_parts > 1")
    return per.select(*keys, CHUNK, *[c.alias(n) for n, c in scans])


def _walks(keys: list[str], ascending: bool = True) -> tuple:
    """Windows over the chunk table: the chunks before one of a key, and all of its chunks."""
    whole = W.partitionBy(*keys) if keys else W.partitionBy()
    return whole.orderBy(F.col(CHUNK).asc() if ascending else F.col(CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1), whole


def with_prefix(
    df: DataFrame,
    keys: list[str],
    order: Order,
    chunk: Column | None = None,
    pos: str | None = "pos",
    sums: dict[str, Column] | None = None,
    size: str | None = None,
    totals: dict[str, Column] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position in the key's order, running sums, the key's size and sums over the whole key.

    ``order`` must be total (end it with an id) for a repeatable position.  Chunks are cut
    by load (``source``: see :func:`with_chunks`) unless ``chunk`` gives a monotone bucket
    of the order whose loads are known to be small.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    if size:
        totals[size] = F.lit(1).cast("long")
    src = with_chunks(df, keys, order, source) if chunk is None else df.withColumn(CHUNK, chunk)
    for name, c in [*sums.items(), *totals.items()]:
        src = src.withColumn(f"_in_{name}", c)
    before, whole = _walks(keys)
    zero = F.lit(0)
    scans = [("_o_pos", F.coalesce(F.sum("_n").over(before), zero)), *[(f"_o_{s}", F.coalesce(F.sum(f"_t_{s}").over(before), zero)) for s in sums],
             *[(f"_w_{s}", F.sum(f"_t_{s}").over(whole)) for s in totals]]
    outer = _outer(src, keys, [F.count(F.lit(1)).alias("_n"), *[F.sum(f"_in_{s}").alias(f"_t_{s}") for s in {**sums, **totals}]], scans)
    part = W.partitionBy(*keys, CHUNK)
    inside = part.orderBy(*_sorts(order))
    running = inside.rowsBetween(W.unboundedPreceding, 0)
    local = src
    if pos:
        local = local.withColumn("_l_pos", F.row_number().over(inside) - 1)
    for s in sums:
        local = local.withColumn(f"_l_{s}", F.sum(f"_in_{s}").over(running))
    for s in totals:
        local = local.withColumn(f"_a_{s}", F.sum(f"_in_{s}").over(part))
    # chunks cut by load: few pairs, see above; other chunks may be many
    out = join_same(local, F.broadcast(outer) if chunk is None else outer, [*keys, CHUNK], "left")
    cols = [F.col(c) for c in df.columns]
    if pos:
        cols.append((F.coalesce("_o_pos", zero) + F.col("_l_pos")).cast("long").alias(pos))
    cols += [(F.coalesce(f"_o_{s}", zero) + F.coalesce(f"_l_{s}", zero)).alias(s) for s in sums]
    cols += [F.coalesce(f"_w_{s}", f"_a_{s}").alias(s) for s in totals]
    return out.select(*cols)


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    pos: str,
    before: int,
    after: int,
    build: Callable[[W], dict[str, Column]],
    block: int = 65536,
) -> DataFrame:
    """Window functions that look at most ``before`` rows back and ``after`` ahead.

    Rows carry their position already (:func:`with_prefix`).  A block is a run of
    positions; the few rows at a block's edges are copied to the neighbouring
    block, so each block is windowed on its own and no key has to fit in a task.
    """
    block = max(block, 4 * (before + after + 1))
    at = F.col(pos)
    home = F.floor(at / block).cast("long")
    inner = (at % block).cast("long")
    copies = [F.struct(home.alias("b"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(inner >= block - before, F.struct((home + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when(inner < after, F.struct((home - 1).alias("b"), F.lit(False).alias("own"))))
    spread = df.withColumn("_c", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull()))).select(
        *df.columns, F.col("_c.b").alias("_block"), F.col("_c.own").alias("_own"))
    w = W.partitionBy(*keys, "_block").orderBy(pos)
    built = build(w)
    out = spread.select(*df.columns, "_own", *[c.alias(n) for n, c in built.items()])
    return out.where("_own").drop("_own")


def carry_forward(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None, values: dict[str, Column], ascending: bool = True,
) -> DataFrame:
    """For each row, the last non-null ``values`` at or before it in the key's order.

    With ``ascending=False`` the next non-null value at or after it.  Expressions in
    ``order`` are always given ascending and must be total.  Chunks as in :func:`with_prefix`.
    """
    src = with_chunks(df, keys, order) if chunk is None else df.withColumn(CHUNK, chunk)
    for n, c in values.items():
        src = src.withColumn(f"_v_{n}", c)
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.max_by if ascending else F.min_by
    # The scan sees only earlier chunks (later ones when looking ahead).
    edge, _ = _walks(keys, ascending)
    outer = _outer(src, keys, [pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_e_{n}") for n in values],
                   [(f"_c_{n}", F.last(f"_e_{n}", ignorenulls=True).over(edge)) for n in values])
    inside = W.partitionBy(*keys, CHUNK).orderBy(*[(c.asc() if ascending else c.desc()) for c in order]).rowsBetween(
        W.unboundedPreceding, 0)
    local = src.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in values])
    out = join_same(local, F.broadcast(outer) if chunk is None else outer, [*keys, CHUNK], "left")
    return out.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def order_stats(
    df: DataFrame, keys: list[str], value: Column, picks: dict[str, Callable[[Column], Column]], descending: bool = False,
) -> DataFrame:
    """Exact order statistics per key: ``picks[name](n)`` is a 0-based sorted index.

    Equal values collapse to counts before the shuffle; running counts over chunks cut by
    load tell which value each index falls on.  Unlike an exact percentile aggregate, no
    buffer ever holds a key's values, and no task all values of a key or of a band.
    Columns: keys, ``n``, one per pick (NULL when the index is outside 0..n-1).
    """
    v = F.col("_v")
    raw = df.select(*keys, value.cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    counts = raw.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = with_prefix(counts, keys, [Down(v) if descending else v], pos=None, sums={"_hi": F.col("_n")}, totals={"_size": F.col("_n")}, source=raw)

    def hit(fn):
        at = fn(F.col("_size")).cast("long")
        return (at >= F.col("_hi") - F.col("_n")) & (at < F.col("_hi"))

    return upto.groupBy(*keys).agg(F.max("_size").alias("n"), *[F.max(F.when(hit(fn), v)).alias(name) for name, fn in picks.items()])
