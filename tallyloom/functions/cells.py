"""Information, logic, shape, finance and combinatorial functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Error texts in the order of their type numbers.
ERRORS = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"]
TYPE_NUMBERS = {"number": 1, "text": 2, "boolean": 4, "error": 16, "blank": 1}


# --- information: a cell is (kind, number, text, flag, error) -------------------------

def error_type(error: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(e) for e in ERRORS]), error), F.lit(0)).cast("int")


def is_blank(kind: Column) -> Column:
    return kind == "blank"


def is_error(kind: Column) -> Column:
    return kind == "error"


def is_err(kind: Column, error: Column) -> Column:
    return (kind == "error") & (F.coalesce(error, F.lit("")) != "#N/A")


def is_na(kind: Column, error: Column) -> Column:
    return (kind == "error") & (F.coalesce(error, F.lit("")) == "#N/A")


def is_logical(kind: Column) -> Column:
    return kind == "boolean"


def is_number(kind: Column) -> Column:
    return kind == "number"


def is_text(kind: Column) -> Column:
    return kind == "text"


def is_nontext(kind: Column) -> Column:
    return kind != "text"


def is_even(number: Column) -> Column:
    return F.pmod(number.cast("bigint"), F.lit(2)) == 0


def is_odd(number: Column) -> Column:
    return F.pmod(number.cast("bigint"), F.lit(2)) != 0


def is_ref(_: Column) -> Column:
    """A column value is never a reference."""
    return F.lit(False)


def n(kind: Column, number: Column, flag: Column) -> Column:
    """Number of a cell: booleans 0/1, text and blank 0, error NULL."""
    return F.when(kind == "number", number).when(kind == "boolean", flag.cast("double")).when(kind != "error", 0.0)


def na() -> Column:
    return F.lit(None).cast("double")


def type_number(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TYPE_NUMBERS.items() for x in kv])[kind]


# --- logic ----------------------------------------------------------------------------

def all_of(*conds: Column) -> Column:
    """AND over the conditions that have a value; NULL when none has."""
    filled = F.array_compact(F.array(*conds))
    return F.when(F.size(filled) > 0, F.forall(filled, lambda x: x))


def any_of(*conds: Column) -> Column:
    filled = F.array_compact(F.array(*conds))
    return F.when(F.size(filled) > 0, F.exists(filled, lambda x: x))


def negate(cond: Column) -> Column:
    return ~cond


def if_(cond: Column, then: Column, otherwise: Column | None = None) -> Column:
    return F.when(cond, then).otherwise(otherwise if otherwise is not None else F.lit(False))


def if_error(value: Column, instead: Column) -> Column:
    """``value`` comes from a try_* expression, so its error is NULL."""
    return F.coalesce(value, instead)


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


# --- finance ----------------------------------------------------------------------------

# All four follow from one equation: an opening sum and equal payments, each grown at the
# rate to the end of the last period, balance the closing sum.

def _growth(rate: Column, periods: Column) -> Column:
    return F.pow(rate + 1, periods)


def _payments_worth(rate: Column, periods: Column, at_start: bool) -> Column:
    """Closing worth of a payment of 1 per period."""
    at_end = F.coalesce((_growth(rate, periods) - 1) / F.nullif(rate, F.lit(0.0)), periods)
    return at_end * (rate + 1) if at_start else at_end


def closing_balance(rate: Column, periods: Column, payment: Column, opening: Column, at_start: bool) -> Column:
    return opening * _growth(rate, periods) + payment * _payments_worth(rate, periods, at_start)


def fv(rate: Column, periods: Column, pmt: Column, pv: Column, at_start: bool = False) -> Column:
    return -closing_balance(rate, periods, pmt, pv, at_start)


def pmt(rate: Column, periods: Column, pv: Column, future: Column | None = None, at_start: bool = False) -> Column:
    owed = pv * _growth(rate, periods) + (future if future is not None else F.lit(0.0))
    early = rate + 1 if at_start else F.lit(1.0)
    level = -owed / early / F.nullif(_payments_worth(rate, periods, False), F.lit(0.0))
    return F.when((periods != 0) & (rate > -1), level)


def ipmt(rate: Column, period: Column, periods: Column, pv: Column, future: Column | None = None, at_start: bool = False) -> Column:
    """Interest part of one payment: the rate on the balance before it."""
    last = F.ceil(periods).cast("double")
    level = pmt(rate, last, pv, future, at_start)
    interest = -closing_balance(rate, period - 1, level, pv, at_start) * rate
    return F.when((rate > -1) & (periods > 0) & period.between(F.lit(1), last), interest / (rate + 1) if at_start else interest)


# --- combinatorics and distributions ------------------------------------------------------

def log_factorial(x: Column) -> Column:
    """Stirling series above 20, a product below; relative error under 1e-12."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(x, F.lit(20)).cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * i)
    z = x.cast("double") + 1
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (z * 12) - 1 / (z * z * z * 360) + 1 / (z * z * z * z * z * 1260)
    return F.when(x <= 20, F.ln(F.when(x < 1, 1.0).otherwise(small))).otherwise(series)


_EXACT = 60


def factorial(x: Column) -> Column:
    return F.when(x >= 0, F.when(x <= 20, F.factorial(F.least(x.cast("int"), F.lit(20))).cast("double")).otherwise(F.exp(log_factorial(x))))


def combin(total: Column, chosen: Column) -> Column:
    """Ways to choose: an exact running product over a smaller side of at most ``_EXACT``, else by logarithms of factorials."""
    a, k = F.floor(total).cast("double"), F.floor(chosen).cast("double")
    side = F.least(k, a - k)
    steps = F.sequence(F.lit(1), F.greatest(F.least(side, F.lit(_EXACT)).cast("int"), F.lit(1)))
    ways = F.aggregate(steps, F.lit(1.0), lambda p, i: p * (a - i + 1) / i)
    return F.when((a >= k) & (k >= 0), F.when(side == 0, 1.0).when(side <= _EXACT, ways).otherwise(F.exp(_log_combin(a, k))))


def _log_combin(a: Column, k: Column) -> Column:
    return log_factorial(a) - log_factorial(k) - log_factorial(a - k)


def binom_dist(successes: Column, trials: Column, p: Column, cumulative: bool = False) -> Column:
    """Binomial mass or distribution; NULL for an impossible probability.

    The distribution sums masses within forty deviations of the mode or of ``successes``:
    what lies beyond is less than the last bit of a double.  So a row costs the square root
    of its trials, not their number.
    """
    x, m = F.floor(successes).cast("long"), F.floor(trials).cast("double")

    def mass(i):
        plain = combin(m, i) * F.pow(p, i) * F.pow(1 - p, m - i)
        inner = (p > 0) & (p < 1) & (F.least(i, m - i) > _EXACT)
        return F.when(inner, F.exp(_log_combin(m, i) + i * F.ln(p) + (m - i) * F.log1p(-p))).otherwise(plain)

    possible = (p >= 0) & (p <= 1) & (x >= 0) & (x <= m)
    if not cumulative:
        return F.when(possible, mass(x.cast("double")))
    wide = 40 * F.sqrt(m * p * (1 - p)) + 40
    low = F.greatest(F.lit(0), F.floor(F.least(x.cast("double"), m * p) - wide)).cast("long")
    high = F.least(x, F.ceil(m * p + wide).cast("long"))
    # a row of impossible arguments has an empty range of its own
    span = F.when(possible, F.sequence(F.least(low, high), high))
    return F.when(possible, F.aggregate(span, F.lit(0.0), lambda t, i: t + mass(i.cast("double"))))


def fisher(x: Column) -> Column:
    return F.when((x > -1) & (x < 1), F.ln((x + 1) / (1 - x)) * 0.5)


# --- shape ------------------------------------------------------------------------------------

def column_number(df: DataFrame, name: str) -> int:
    return df.columns.index(name) + 1


def shape(df: DataFrame) -> DataFrame:
    """ROWS and COLUMNS of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def transpose(df: DataFrame, label: str, columns: list[str], labels: list) -> DataFrame:
    """Columns become rows; the listed row labels become columns."""
    return df.unpivot([label], columns, "column", "value").groupBy("column").pivot(label, labels).agg(F.first("value"))


def hyperlink(url: Column, friendly: Column | None = None) -> Column:
    """The shown text of a link."""
    return F.coalesce(friendly, url) if friendly is not None else url
