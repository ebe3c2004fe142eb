"""Conversions that comparisons, sorts and computations apply to values.

Storage is text or native columns; the operator names the type. Text is converted by these
expressions, which stay inside code generation; native numbers and timestamps are used as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First year of the hundred that two-digit years stand for. A parameter, so that results don't depend on today.
PIVOT = 1965

_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_DIGITS = {2: r"^\s*([01]+)", 8: r"^\s*([0-7]+)", 16: r"^\s*(?:0[xX])?([0-9a-fA-F]+)"}


def text(c: Column) -> Column:
    """The value as text; missing is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def atof(c: Column) -> Column:
    """The number that a text begins with, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text(c), _NUMBER, 1).try_cast("double"), F.lit(0.0))


def strict_number(c: Column) -> Column:
    """0 for empty text, the leading number, or null where a text doesn't begin with one."""
    t = F.trim(text(c))
    return F.when(t == "", F.lit(0.0)).otherwise(F.regexp_extract(t, _NUMBER, 1).try_cast("double"))


def is_numeric_text(c: Column) -> Column:
    """Blanks, a sign, digits with at most one point: what distributions and statistics count as a number (the empty text too)."""
    return text(c).rlike(r"^ *[+-]?[0-9]*\.?[0-9]*$")


def based(c: Column, base: int, wrap: bool = True) -> Column:
    """The leading digits of ``base`` as an integer, 0 if there are none; with ``wrap`` as a signed 32-bit one."""
    digits = F.regexp_extract(text(c), _DIGITS[base], 1)
    value = F.coalesce(F.conv(F.when(digits != "", digits), base, 10).try_cast("decimal(20,0)"), F.lit(0))
    if not wrap:
        return value
    low = (value % F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def length(c: Column) -> Column:
    return F.octet_length(text(c))


def upper_key(c: Column) -> Column:
    return F.upper(text(c))


def dictionary_key(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^A-Za-z0-9 \t]", "")


def printable_key(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^\x20-\x7e]", "")


def unblanked(c: Column) -> Column:
    return F.regexp_replace(text(c), r"^\s+", "")


def subfield(c: Column, first: tuple[int, int], last: tuple[int, int] | None = None, split: str = " \t") -> Column:
    """Characters from ``first`` = (field, character) to ``last``, both counted from 1; fields end at any of ``split``.

    Without ``last`` to the end; a ``last`` character of 0 is its field's end.
    """
    fields = F.split(text(c), "[" + "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in split) + "]")
    (m, n), head = first, lambda k: F.coalesce(F.get(fields, k - 1), F.lit(""))
    if last is None:
        rest = F.array_join(F.slice(fields, m + 1, 1 << 20), "")
        return F.concat(F.substring(head(m), max(1, n), 1 << 30), rest)
    p, q = last
    if p == m:
        return F.substring(head(m), max(1, n), q - max(1, n) + 1 if q else 1 << 30)
    parts = [F.substring(head(m), max(1, n), 1 << 30), *(head(k) for k in range(m + 1, p)), F.substring(head(p), 1, q) if q else head(p)]
    return F.concat(*parts)


_CLOCK = r"(?:\s*(?<![0-9])|\s+)?(?:([0-9]{1,2})[:.]([0-9]{1,2})(?:[:.]([0-9]{1,2}))?|([0-9]{2})([0-9]{2})([0-9]{2}))?\s*$"
_DATE = (
    r"^\s*(?:(?:(?:([0-9]{1,2})(?:/([0-9]{1,2})/|-([0-9]{1,2})-)|([0-9]{1,2})\.([0-9]{1,2})\.)([0-9]{4}|[0-9]{1,2})"
    r"|((?:[0-9]{2})?[0-9]{2})([0-9]{2})([0-9]{2}))(?![0-9])" + _CLOCK + r"|((?:[0-9]{2})?[0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})\s*$)[\s\S]*|^[\s\S]*"
)
#: Year, month, day, hour, minute and second of what ``_DATE`` matches, each after a 0: a cast that fails is slow. For what is no date all are 0.
_DATE_FIELDS = "0$6$7$16,0$1$5$8$17,0$2$3$4$9$18,0$10$13$19,0$11$14$20,0$12$15$21"


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def with_date(t: Column, use: Callable[[Column, Column, Column, Column], Column], pivot: int = PIVOT, constant: bool = False) -> Column:
    """``use`` of year, month, day and second of the day; null where the text is no date. The text is read once.

    ``constant``: ``t`` is one, and so is the result, which the optimizer then computes itself.
    """
    once = (lambda c, f: f(c)) if constant else _once

    def parts(fields: Column) -> Column:
        year, month, day, hour, minute, second = (F.get(fields, F.lit(k)).cast("int") for k in range(6))
        full = F.when(F.length(F.get(fields, F.lit(0))) <= 3, pivot + F.pmod(year - F.lit(pivot % 100), F.lit(100))).otherwise(year)
        good = month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 60)
        return F.when(good, use(full, month, day, hour * 3600 + minute * 60 + second))

    return once(F.split(F.regexp_replace(t, _DATE, _DATE_FIELDS), ","), parts)


def date_key(c: Column, date_only: bool = False, pivot: int = PIVOT, native: bool = False, constant: bool = False) -> Column:
    """A number that orders dates and times, null for what is none. Every month has 31 places, so 2/31 is a date.

    Text may be M/D/Y, M-D-Y, D.M.Y, [YY]YYMMDD, each with H:M[:S], H.M[.S] or HHMMSS after it, or one number of 12 or 14 digits.
    ``native``: ``c`` is a date or timestamp column. ``constant``: ``c`` is a constant text.
    """

    def key(year: Column, month: Column, day: Column, second: Column) -> Column:
        whole = ((year.cast("long") * 12 + month - 1) * 31 + day - 1) * 86400
        return whole if date_only else whole + second

    if native:
        return key(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    return with_date(text(c), key, pivot, constant)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def java_pattern(pattern: str) -> str:
    """The library dialect of regular expressions as a Java one.

    ``|`` and ``?`` are plain characters, ``^`` is special only at the start and ``$`` at the end, ``(...)$n`` is a
    group, a backslash makes the next character plain.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            i += 1
            out.append(pattern[i] if pattern[i].isalnum() else "\\" + pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            end = n - 1 if end < 0 else end
            inside = pattern[i + 1 : end]
            out.append("[" + inside.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        elif c in "|?":
            out.append("\\" + c)
        elif c == "^":
            out.append("^" if i == 0 else "\\^")
        elif c == "$":
            if out and out[-1] == ")" and i + 1 < n and pattern[i + 1].isdigit():
                i += 1
            else:
                out.append("$" if i == n - 1 else "\\$")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def basic_pattern(pattern: str) -> str:
    """An ed-style basic expression (groups and bounds with a backslash, ``+ ? | ( ) {`` plain) as a Java one."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            x = pattern[i]
            out.append(x if x in "(){}" else x if x.isalnum() and not x.isdigit() else "\\" + x)
        elif c in "+?|(){}":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)
