"""Typed sorts, bounded limits and ranking helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.ordering import Down, Order, with_prefix


def type_rank(kind: Column) -> Column:
    # Order of cell types in a sort.
    return F.when(kind == "number", 0).when(kind == "text", 1).when(kind == "boolean", 2).when(kind == "error", 3).otherwise(4)


def _nulls_last(c: Column, ascending: bool) -> Order:
    return [c.isNull(), c] if ascending else [Down(c)]


def typed_keys(kind: Column, num: Column, text: Column, flag: Column, ascending: bool = True,
               match_case: bool = False, ignore_blanks: bool = True) -> Order:
    """Sort keys of a typed cell: numbers < text < booleans < errors < blanks.

    Descending reverses the types; ignored blanks stay last either way, otherwise a
    blank sorts as empty text.
    """
    blank = kind == "blank"
    rank = type_rank(kind if ignore_blanks else F.when(blank, F.lit("text")).otherwise(kind))
    word = text if ignore_blanks else F.coalesce(text, F.lit(""))
    word = word if match_case else F.lower(word)
    signed = rank if ascending else F.when(rank == 4, 4).otherwise(-rank)
    return [signed, *(k for c in (num, word, flag.cast("int")) for k in _nulls_last(c, ascending))]


def sorted_by(df: DataFrame, order: Order, into: str | None) -> DataFrame:
    """The rows in order, or, with ``into``, their 0-based places in that order as a column.

    Places are counted in chunks cut at sampled bounds, so neither way sorts the table in one task.
    """
    if into:
        return with_prefix(df, [], order, pos=into)
    return df.orderBy(*[c.column.desc() if isinstance(c, Down) else c.asc() for c in order])


def sort_typed(df: DataFrame, cell: str, pos: str, into: str | None = None, **opts) -> DataFrame:
    """Stable sort by a typed cell struct(kind, num, text, flag)."""
    c = F.col(cell)
    return sorted_by(df, [*typed_keys(c["kind"], c["num"], c["text"], c["flag"], **opts), F.col(pos)], into)


def sort_multi(df: DataFrame, keys: list[tuple[str, bool, bool, bool]], pos: str, into: str | None = None) -> DataFrame:
    """Sort by several (column, ascending, ignore_blanks, match_case) keys, input order last."""
    types = dict(df.dtypes)
    order = []
    for name, asc, ignore_blanks, match_case in keys:
        c = F.col(name)
        if types[name] == "string":
            c = c if match_case else F.lower(c)
            c = c if ignore_blanks else F.coalesce(c, F.lit(""))
        order += _nulls_last(c, asc)
    return sorted_by(df, [*order, F.col(pos)], into)


def clamp_limit(limit: int | None, default: int = 50, most: int | None = None) -> int:
    """The asked number of rows, or ``default`` if none is asked; ``most`` bounds it only where it is given."""
    asked = default if not limit or limit <= 0 else limit
    return asked if most is None else max(1, min(most, asked))


def limit_clamp(df: DataFrame, order: list[Column], limit: int | None = None, default: int = 50, most: int | None = None) -> DataFrame:
    """A top-k report, executed as a distributed top-k."""
    return df.orderBy(*order).limit(clamp_limit(limit, default, most))
