"""Computed and reformatted values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillbase.functions import typed

_TOKEN = re.compile(r"\s*(?:([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+)|([A-Za-z_][\w#]*)|(.))")


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if typed.is_number(df, name) else typed.atof(F.col(name))


class _Parser:
    """Sums, products, signs, parentheses, constants, attributes and functions of one attribute."""

    def __init__(self, df: DataFrame, source: str):
        self.df = df
        self.tokens = [m.group(1) or m.group(2) or m.group(3) for m in _TOKEN.finditer(source.strip())]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise ValueError(f"{wanted or 'a value'} expected, not {token or 'the end'}")
        self.at += 1
        return token

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-") and self.peek():
            left = left + self.product() if self.take() == "+" else left - self.product()
        return left

    def product(self) -> Column:
        left = self.factor()
        while self.peek() in ("*", "/", "%") and self.peek():
            op, right = self.take(), self.factor()
            if op == "*":
                left = left * right
            elif op == "/":
                left = F.when(right == 0, F.lit(0.0)).otherwise(left / F.when(right != 0, right))
            else:
                a, b = left.cast("long"), right.cast("long")
                left = F.when(b == 0, F.lit(0.0)).otherwise((a % F.when(b != 0, b)).cast("double"))
        return left

    def factor(self) -> Column:
        token = self.take()
        if token in "+-":
            inner = self.factor()
            return -inner if token == "-" else inner
        if token == "(":
            inner = self.sum()
            self.take(")")
            return inner
        if token[0].isdigit() or token[0] == ".":
            return F.lit(float(token))
        if self.peek() == "(" and token in ("abs", "bin", "oct", "hex", "len"):
            self.take("(")
            name = self.take()
            self.take(")")
            if token == "abs":
                return F.abs(_number(self.df, name))
            if token == "len":
                return typed.length(F.col(name)).cast("double")
            return typed.based(F.col(name), {"bin": 2, "oct": 8, "hex": 16}[token]).cast("double")
        return _number(self.df, token)


def expression(df: DataFrame, source: str) -> Column:
    """The arithmetic expression ``source`` over the attributes of ``df``, in double precision; dividing by zero gives 0."""
    parser = _Parser(df, source)
    value = parser.sum()
    if parser.peek():
        raise ValueError(f"{parser.peek()} isn't expected here")
    return value


def compute(df: DataFrame, form: str | None = "%.3f", **results: str) -> DataFrame:
    """Set attributes to expressions, all over the original values; ``form`` formats them (None: numbers)."""
    values = {name: expression(df, source) for name, source in results.items()}
    return df.withColumns({k: F.format_string(form, v) if form else v for k, v in values.items()})


_DATE_MARKS = {"": "/", "/": "/", "-": "-", ".": ".", "#": ""}


def date_text(c: Column, mark: str = "/", century: bool = False, native: bool = False, pivot: int = typed.PIVOT) -> Column:
    """A date rewritten as M/D/Y, M-D-Y, D.M.Y (mark ``.``) or YYMMDD (mark ``#``); empty for what is no date."""

    def told(year: Column, month: Column, day: Column, second: Column) -> Column:
        y = F.lpad(year.cast("string"), 4, "0") if century else F.lpad((year % 100).cast("string"), 2, "0")
        m, d = F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
        parts = (y, m, d) if mark == "#" else (d, m, y) if mark == "." else (m, d, y)
        return F.concat_ws(_DATE_MARKS[mark], *parts)

    whole = F.when(c.isNotNull(), told(F.year(c), F.month(c), F.dayofmonth(c), F.lit(0))) if native else typed.with_date(typed.text(c), told, pivot)
    return F.coalesce(whole, F.lit(""))


def time_text(c: Column, mark: str = ":", seconds: bool = True, native: bool = False, pivot: int = typed.PIVOT) -> Column:
    """The time of day as H:M:S, H.M.S (mark ``.``) or HHMMSS (mark ``#``)."""
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")

    def told(second: Column) -> Column:
        parts = [two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), *([two(second % 60)] if seconds else [])]
        return F.concat_ws("" if mark == "#" else mark, *parts)

    if native:
        whole = F.when(c.isNotNull(), told(F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)))
    else:
        whole = typed.with_date(typed.text(c), lambda year, month, day, second: told(second), pivot)
    return F.coalesce(whole, F.lit(""))


def reformat(c: Column, form: str) -> Column:
    """A value through one conversion: ``%d %o %x %X %b %e %f %g %s`` with flags, width and precision, or a name of ``TRANSFORMS``."""
    if form in TRANSFORMS:
        return TRANSFORMS[form](c)
    m = re.fullmatch(r"(.*?)%([-+ 0#]*)([0-9]*)(\.[0-9]+)?([doxXbefgGs])(.*)", form, re.S)
    if not m:
        raise ValueError(f"{form} has no conversion")
    before, flags, width, precision, kind, after = m.groups()
    number = typed.atof(c)
    spec = f"%{flags}{width}{precision or ''}"
    if kind == "b":
        digits = F.bin(number.cast("long"))
        out = F.lpad(digits, int(width), "0" if "0" in flags else " ") if width else digits
    elif kind in "doxX":
        out = F.format_string(f"%{flags}{width}{kind}", number.cast("long"))
    elif kind == "s":
        out = F.format_string(spec + "s", typed.text(c))
    elif kind in "gG":
        out = shortest(number, int((precision or ".6")[1:]) or 1)
    else:
        out = F.format_string(spec + kind, number)
    return F.concat(F.lit(before.replace("%%", "%")), out, F.lit(after.replace("%%", "%")))


def shortest(number: Column, digits: int = 11) -> Column:
    """A number with ``digits`` significant digits and no trailing zeros, as ``%.<digits>g`` gives it."""
    size = F.when(number == 0, 0).otherwise(F.floor(F.log10(F.abs(number))).cast("int"))
    plain = F.format_string("%s", F.round(number.cast(f"decimal(38,{18})"), 18))
    parts = [F.when(size == k, F.format_string(f"%.{max(0, digits - 1 - k)}f", number)) for k in range(-5, digits)]
    fixed = F.coalesce(*parts, plain)
    trimmed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    sci = F.regexp_replace(F.format_string(f"%.{digits - 1}e", number), r"\.?0+e", "e")
    return F.when((size < -4) | (size >= digits), sci).otherwise(trimmed)


TRANSFORMS = {
    "trim": lambda c: F.trim(typed.text(c)),
    "ltrim": lambda c: F.ltrim(typed.text(c)),
    "rtrim": lambda c: F.rtrim(typed.text(c)),
    "tolower": lambda c: F.lower(typed.text(c)),
    "toupper": lambda c: F.upper(typed.text(c)),
    "trlower": lambda c: F.lower(F.trim(typed.text(c))),
    "trupper": lambda c: F.upper(F.trim(typed.text(c))),
    "ltrlower": lambda c: F.lower(F.ltrim(typed.text(c))),
    "ltrupper": lambda c: F.upper(F.ltrim(typed.text(c))),
    "rtrlower": lambda c: F.lower(F.rtrim(typed.text(c))),
    "rtrupper": lambda c: F.upper(F.rtrim(typed.text(c))),
}


def rewrite(df: DataFrame, **forms: str) -> DataFrame:
    """Reformat attributes in place, each by a conversion or a transform."""
    return df.withColumns({name: reformat(F.col(name), form) for name, form in forms.items()})


def build(df: DataFrame, result: str, form: str, *names: str) -> DataFrame:
    """Set ``result`` to ``form`` with each ``%`` conversion filled from the next of ``names``."""
    parts = re.findall(r"%%|%[-+ 0#]*[0-9]*(?:\.[0-9]+)?[a-zA-Z]|[^%]+", form)
    left, out = list(names), []
    for p in parts:
        if p[0] == "%" and p != "%%":
            out.append(reformat(F.col(left.pop(0)), p))
        else:
            out.append(F.lit("%" if p == "%%" else p))
    if left:
        raise ValueError(f"no conversion is left for {left}")
    return df.withColumn(result, F.concat(*out))


def newlines_out(c: Column, mark: str = "~") -> Column:
    return F.translate(typed.text(c), "\n", mark)


def newlines_in(c: Column, mark: str = "~") -> Column:
    return F.translate(typed.text(c), mark, "\n")
