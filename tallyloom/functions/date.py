"""Spreadsheet date functions on DATE and TIMESTAMP columns; an error is NULL.

Dates are real dates, not serial numbers, so the 1900 leap-year quirk has no place.
NOW and TODAY take the moment from the caller so that results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date(year: Column, month: Column, day: Column) -> Column:
    """Month and day may run over; years below 1900 count from 1900."""
    y = F.floor(year) + F.when(F.floor(year) < 1900, 1900).otherwise(0)
    first = F.add_months(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), (F.floor(month) - 1).cast("int"))
    return F.date_add(first, (F.floor(day) - 1).cast("int"))


def datevalue(text: Column) -> Column:
    return text.try_cast("timestamp").cast("date")


def timevalue(text: Column) -> Column:
    """Fraction of a day."""
    parts = F.split(F.element_at(F.split(F.trim(text), " "), -1), ":")
    n = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.when(F.size(parts) >= 2, (n(0) * 3600 + n(1) * 60 + n(2)) / 86400)


def time(hour: Column, minute: Column, second: Column) -> Column:
    total = F.floor(hour) * 3600 + F.floor(minute) * 60 + F.floor(second)
    return F.when((hour >= 0) & (minute >= 0) & (second >= 0), F.pmod(total, F.lit(86400)) / 86400.0)


def now(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def today(moment: str) -> Column:
    return F.lit(moment).cast("date")


def days(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def datedif(start: Column, end: Column, unit: str) -> Column:
    s, e = start.cast("date"), end.cast("date")
    late = F.when(F.day(e) >= F.day(s), 0).otherwise(1)
    follows = (F.month(e) > F.month(s)) | ((F.month(e) == F.month(s)) & (F.day(e) >= F.day(s)))
    months = (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s) - late
    if unit == "Y":
        out = F.year(e) - F.year(s) - F.when(follows, 0).otherwise(1)
    elif unit == "M":
        out = months
    elif unit == "D":
        out = F.datediff(e, s)
    elif unit == "MD":
        # the start's day in the month before the end, running over where that month is shorter
        anchor = F.date_add(F.add_months(F.trunc(e, "month"), -1), F.day(s) - 1)
        out = F.when(late == 0, F.day(e) - F.day(s)).otherwise(F.datediff(e, anchor))
    elif unit == "YM":
        out = F.pmod(F.month(e) + 12 - F.month(s) - late, F.lit(12))
    elif unit == "YD":
        year = F.year(s) + F.when(follows, 0).otherwise(1)
        moved = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), F.month(e) - 1), F.day(e) - 1)
        out = F.datediff(moved, s)
    else:
        return F.lit(None).cast("int")
    return F.when(s <= e, out)


def days360(start: Column, end: Column, european: bool = False) -> Column:
    s, e = start.cast("date"), end.cast("date")
    sd, ed = F.day(s), F.day(e)
    if european:
        sd, ed = F.least(sd, F.lit(30)), F.least(ed, F.lit(30))
    else:
        sd = F.when(s == F.last_day(s), 30).otherwise(sd)
        ed = F.when((ed == 31) & (sd == 30), 30).otherwise(ed)
    return (F.year(e) - F.year(s)) * 360 + (F.month(e) - F.month(s)) * 30 + ed - sd


def edate(start: Column, months: Column) -> Column:
    return F.add_months(start.cast("date"), months)


def eomonth(start: Column, months: Column) -> Column:
    return F.last_day(F.add_months(start.cast("date"), months))


def isoweeknum(d: Column) -> Column:
    return F.weekofyear(d)


# First day of the week per flag, Monday = 0.
_WEEK_START = {1: 6, 2: 0, 3: 0, 11: 0, 12: 1, 13: 2, 14: 3, 15: 4, 16: 5, 17: 6}


def weekday(d: Column, flag: int = 1) -> Column:
    if flag not in _WEEK_START:
        return F.lit(None).cast("int")
    return F.pmod(F.weekday(d) - _WEEK_START[flag], F.lit(7)) + (0 if flag == 3 else 1)


def weeknum(d: Column, flag: int = 1) -> Column:
    """Weeks of a year are counted from the one holding January 1st; flag 21 is the ISO week."""
    if flag == 21:
        return isoweeknum(d)
    if flag not in _WEEK_START or flag == 3:
        return F.lit(None).cast("int")
    first = F.trunc(d, "year")
    lead = F.pmod(F.weekday(first) - _WEEK_START[flag], F.lit(7))
    return (F.floor((F.datediff(d, first) + lead) / 7) + 1).cast("int")


def _days_listed(holidays: list[str]) -> Column:
    return F.array_sort(F.array_distinct(F.array(*[F.lit(h).cast("date") for h in holidays])))


def _weekdays_until(d: Column) -> Column:
    """Weekdays up to and including a day, from a Monday far back."""
    x = F.datediff(d, F.lit("1899-01-02").cast("date"))
    return F.floor(x / 7) * 5 + F.least(F.pmod(x, F.lit(7)), F.lit(4)) + 1


def networkdays(start: Column, end: Column, holidays: list[str] | None = None) -> Column:
    """Working days between two dates, both counted; negative when they are reversed."""
    a, b = F.least(start.cast("date"), end.cast("date")), F.greatest(start.cast("date"), end.cast("date"))
    n = _weekdays_until(b) - _weekdays_until(F.date_sub(a, 1))
    if holidays:
        n = n - F.size(F.filter(_days_listed(holidays), lambda h: (h >= a) & (h <= b) & (F.weekday(h) < 5)))
    return (n * F.when(start.cast("date") > end.cast("date"), -1).otherwise(1)).cast("int")


def _step_weekdays(d: Column, n: Column) -> Column:
    dow = F.weekday(d)
    fwd = F.date_add(F.date_sub(d, F.greatest(dow - 4, F.lit(0))), (n + F.floor((F.least(dow, F.lit(4)) + n) / 5) * 2).cast("int"))
    back_from, low = F.when(dow > 4, F.date_add(d, 7 - dow)).otherwise(d), F.when(dow > 4, 0).otherwise(dow)
    back = F.date_sub(back_from, (-n + F.floor((4 - low - n) / 5) * 2).cast("int"))
    return F.when(n > 0, fwd).when(n < 0, back).otherwise(d)


def workday(start: Column, offset: Column, holidays: list[str] | None = None) -> Column:
    """The working day ``offset`` working days away; each holiday passed moves the target one further."""
    d, n = start.cast("date"), offset.cast("int")
    out = _step_weekdays(d, n)
    if not holidays:
        return out
    on = lambda way: F.filter(_days_listed(holidays), lambda h: (F.weekday(h) < 5) & ((h > d) if way > 0 else (h < d)))
    ahead = F.aggregate(on(1), out, lambda t, h: F.when(h <= t, _step_weekdays(t, F.lit(1))).otherwise(t))
    behind = F.aggregate(F.reverse(on(-1)), out, lambda t, h: F.when(h >= t, _step_weekdays(t, F.lit(-1))).otherwise(t))
    return F.when(n > 0, ahead).when(n < 0, behind).otherwise(d)


def yearfrac(start: Column, end: Column, basis: int = 0) -> Column:
    s, e = start.cast("date"), end.cast("date")
    gap = F.datediff(e, s).cast("double")
    if basis == 1:
        leaps = lambda y: F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
        years = F.year(e) - F.year(s) + 1
        total = years * 365 + leaps(F.year(e)) - leaps(F.year(s) - 1)
        out = F.try_divide(gap, F.try_divide(total.cast("double"), years.cast("double")))
    else:
        out = {0: lambda: days360(s, e) / 360.0, 2: lambda: gap / 360.0, 3: lambda: gap / 365.0, 4: lambda: days360(s, e, True) / 360.0}[basis]()
    return F.abs(out)


def parts(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}


