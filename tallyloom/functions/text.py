"""Spreadsheet text functions: Column in, Column out; an error is NULL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from tallyloom.operators.filters import wildcard_regex

CELL_LIMIT = 32767  # Fixed value: longest cell text.


def _half_width() -> tuple[str, str]:
    """Full-width characters and their half-width forms, from the compatibility data of Unicode."""
    back = {unicodedata.normalize("NFKC", chr(h)): chr(h) for h in range(0xFF61, 0xFFA0)}
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs["\u3000"] = " "
    for c in [*range(0x30A1, 0x30F7), 0x3001, 0x3002, 0x300C, 0x300D, 0x30FB, 0x30FC]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base in back:
            pairs[chr(c)] = back[base]
    return "".join(pairs), "".join(pairs.values())


_FULL, _HALF = _half_width()
_CODES = [c for c in range(128, 160) if bytes([c]).decode("cp1252", "ignore")]
_LATIN = "".join(chr(c) for c in _CODES)
_ANSI = "".join(bytes([c]).decode("cp1252") for c in _CODES)


def asc(text: Column) -> Column:
    return F.translate(text, _FULL, _HALF)


def char(number: Column) -> Column:
    n = F.floor(number).cast("int")
    return F.when(n.between(1, 255), F.translate(F.char(n), _LATIN, _ANSI))


def code(text: Column) -> Column:
    return F.when(text != "", F.ascii(F.translate(F.left(text, F.lit(1)), _ANSI, _LATIN)))


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x80-\x9f]", "")


def concat(*texts: Column) -> Column:
    return F.concat(*[F.coalesce(t.cast("string"), F.lit("")) for t in texts])


def exact(a: Column, b: Column) -> Column:
    return a == b


def _grouped(number: Column, decimals: int) -> Column:
    return F.format_number(F.round(number, decimals), max(decimals, 0))


def dollar(number: Column, decimals: int = 2) -> Column:
    rounded = F.round(number, decimals)
    return F.concat(F.when(rounded < 0, "-").otherwise(""), F.lit("$"), _grouped(F.abs(number), decimals))


def fixed(number: Column, decimals: int = 2, no_commas: bool = False) -> Column:
    out = _grouped(number, decimals)
    return F.replace(out, F.lit(","), F.lit("")) if no_commas else out


def find(needle: str, text: Column, start: int = 1) -> Column:
    """1-based position with regard to case."""
    at = F.locate(needle, text, start)
    return F.when((F.lit(start) <= F.length(text) + 1) & (at > 0), at)


def search(needle: str, text: Column, start: int = 1) -> Column:
    """1-based position of a wildcard pattern without regard to case."""
    rx = wildcard_regex(needle, whole=False)
    rest = F.substr(text, F.lit(start))
    at = F.regexp_instr(rest, F.lit(rx)) if rx is not None else F.lit(0)
    return F.when((F.lit(start) <= F.length(text) + 1) & (at > 0), at + (start - 1))


def left(text: Column, n: int = 1) -> Column:
    return F.left(text, F.lit(n)) if n >= 0 else F.lit(None).cast("string")


def right(text: Column, n: int = 1) -> Column:
    return F.when(F.lit(n) >= F.length(text), text).otherwise(F.right(text, F.lit(n))) if n >= 0 else F.lit(None).cast("string")


def mid(text: Column, start: int, n: int) -> Column:
    return F.substring(text, start, n) if start >= 1 and n >= 0 else F.lit(None).cast("string")


def proper(text: Column) -> Column:
    """A letter after a letter is lower case, any other letter upper case."""
    chars = F.split(text, "")
    cased = F.transform(chars, lambda c, i: F.when((i > 0) & F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(cased, "")


def replace(text: Column, start: int, n: int, new: str) -> Column:
    if start < 1 or n < 0:
        return F.lit(None).cast("string")
    return F.concat(F.left(text, F.lit(start - 1)), F.lit(new), F.substr(text, F.lit(start + n)))


def rept(text: Column, n: Column) -> Column:
    count = F.floor(n).cast("int")
    return F.when((count >= 0) & (F.length(text) * count <= CELL_LIMIT), F.repeat(text, count))


def substitute(text: Column, old: str, new: str, nth: int | None = None) -> Column:
    if old == "":
        return text
    if nth is None:
        return F.replace(text, F.lit(old), F.lit(new))
    head = F.substring_index(text, old, nth)
    return F.when(head == text, text).otherwise(F.concat(head, F.lit(new), F.substr(text, F.length(head) + len(old) + 1)))


def t(kind: Column, text: Column) -> Column:
    return F.when(kind == "text", text).otherwise("")


def textjoin(delimiter: str, ignore_empty: bool, *texts: Column) -> Column:
    items = [x.cast("string") for x in texts]
    if ignore_empty:
        return F.concat_ws(delimiter, *[F.nullif(x, F.lit("")) for x in items])
    return F.concat_ws(delimiter, *[F.coalesce(x, F.lit("")) for x in items])


def trim(text: Column) -> Column:
    """Outer spaces off, inner runs of spaces to one."""
    return F.trim(F.regexp_replace(text, " +", " "))


def value(text: Column) -> Column:
    """Number of a text with optional thousands separators, percent sign or currency sign."""
    bare = F.regexp_replace(F.trim(text), r"[,$]", "")
    share = bare.endswith("%")
    return F.when(share, F.regexp_replace(bare, "%$", "").try_cast("double") / 100).otherwise(bare.try_cast("double"))


def numbervalue(text: Column, decimal: str = ".", group: str = ",") -> Column:
    """Number of a text in given separators; blanks are dropped, each trailing % divides by 100."""
    bare = F.regexp_replace(text, r"\s", "")
    marks = F.length(F.regexp_extract(bare, "%+$", 0))
    head, tail = F.substring_index(bare, decimal, 1), F.substr(bare, F.length(F.substring_index(bare, decimal, 1)) + 1)
    # a group separator behind the decimal separator is an error
    good = ~F.contains(tail, F.lit(group))
    plain = F.concat(F.replace(head, F.lit(group), F.lit("")), F.replace(tail, F.lit(decimal), F.lit(".")))
    number = F.regexp_replace(plain, "%+$", "").try_cast("double")
    return F.when(bare == "", 0.0).when(good, number / F.pow(F.lit(100.0), marks))


def _java_date(pattern: str) -> str:
    out, p, hour = "", pattern.lower(), False
    i = 0
    while i < len(p):
        j = i
        while j < len(p) and p[j] == p[i]:
            j += 1
        run, n = p[i], j - i
        if run == "m":
            out += ("m" if hour else "M") * n
        elif run == "h":
            out, hour = out + "H" * n, True
        else:
            out += run * n
            if run in "yd":
                hour = False
        i = j
    return out


def text(value: Column, pattern: str, is_date: bool = False) -> Column:
    """TEXT for simple number patterns (0, 0.00, #,##0.00, 0%) and date patterns."""
    if is_date:
        return F.date_format(value, _java_date(pattern))
    share = pattern.endswith("%")
    body = pattern.rstrip("%")
    decimals = len(body.split(".")[1]) if "." in body else 0
    number = value * 100 if share else value
    out = fixed(number, decimals, no_commas="," not in body)
    return F.concat(out, F.lit("%")) if share else out
