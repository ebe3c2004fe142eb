"""Typed comparisons as Columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rillbase.functions import typed
from rillbase.plans import where

_BASES = {"b": 2, "o": 8, "h": 16}


def compared(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


class Keys:
    """Comparison keys of the columns of a frame; ``column`` tells an attribute's column name."""

    def __init__(self, df: DataFrame, column, pivot: int = typed.PIVOT):
        self.df, self.column, self.pivot = df, column, pivot

    def key(self, attr: where.Attr, kind: str, joined: bool = False) -> Column:
        """``joined``: what is missing matches nothing, as the empty side of an outer join."""
        if joined:
            c = F.col(f"`{self.column(attr)}`")
            if kind == "string":
                return c if isinstance(self.df.schema[self.column(attr)].dataType, StringType) else c.cast("string")
            return F.when(c.isNotNull(), self.key(attr, kind)) if kind != "number" or not typed.is_number(self.df, self.column(attr)) or attr.modifier else c
        name = self.column(attr)
        c = F.col(f"`{name}`")
        if attr.name in ("rec#", "seek#"):
            return c
        if kind == "number":
            m = attr.modifier or ""
            if m.startswith("len"):
                return typed.length(c)
            if m[:1] in _BASES:
                return typed.based(c, _BASES[m[0]])
            return c if typed.is_number(self.df, name) else typed.atof(c)
        if kind in ("date", "day"):
            return typed.date_key(c, kind == "day", self.pivot, typed.is_time(self.df, name))
        return typed.upper_key(c) if kind == "caseless" else typed.text(c)

    def constant(self, value: str, attr: where.Attr, kind: str) -> Column:
        if kind == "number" or attr.name in ("rec#", "seek#"):
            if (attr.modifier or "")[:1] in _BASES and attr.name not in ("rec#", "seek#") and not attr.modifier.startswith("len"):
                return typed.based(F.lit(value), _BASES[attr.modifier[0]])
            if value[:2].lower() == "0x":
                return F.lit(int(value, 16))
            number = float(value)
            return F.lit(int(number) if number.is_integer() and abs(number) < 1 << 53 else number)
        if kind in ("date", "day"):
            return typed.date_key(F.lit(value), kind == "day", self.pivot, constant=True)
        width = self.df.schema[self.column(attr)].metadata.get("width") if attr.name not in ("rec#", "seek#") else None
        value = value.ljust(int(width)) if width else value  # fixed-width attributes are padded
        return F.upper(F.lit(value)) if kind == "caseless" else F.lit(value)

    def condition(self, tree) -> Column:
        """The predicate of a tree without ``else`` and without joins."""
        if isinstance(tree, where.And):
            return reduce(and_, map(self.condition, tree.parts))
        if isinstance(tree, where.Or):
            return reduce(or_, map(self.condition, tree.parts))
        if isinstance(tree, where.Compare):
            kind = "number" if tree.attr.name in ("rec#", "seek#") else tree.kind
            if kind.startswith("regex"):
                return self._matches(tree.attr, tree.op, kind, tree.value)
            constant = self.constant(tree.value, tree.attr, kind)
            if kind == "string" and tree.value and isinstance(self.df.schema[self.column(tree.attr)].dataType, StringType):
                # Missing is the empty text; said this way the comparison reaches the scan.
                plain = F.col(f"`{self.column(tree.attr)}`")
                found = compared(plain, tree.op, constant)
                return found | plain.isNull() if tree.op in ("!=", "<", "<=") else found
            return compared(self.key(tree.attr, kind), tree.op, constant)
        if isinstance(tree, where.Match):
            return self.matched(tree)
        if isinstance(tree, where.Member):
            return self._member(tree)
        raise TypeError(f"{type(tree).__name__} isn't a predicate")

    def matched(self, tree: where.Match) -> Column:
        kind = "number" if tree.left.name in ("rec#", "seek#") or tree.right.name in ("rec#", "seek#") else tree.kind
        if kind.startswith("regex"):
            raise ValueError("two attributes can't be compared by a regular expression")
        return compared(self.key(tree.left, kind, True), tree.op, self.key(tree.right, kind, True))

    def _matches(self, attr, op, kind, value) -> Column:
        pattern = typed.java_pattern(value)
        found = typed.text(F.col(f"`{self.column(attr)}`")).rlike(("(?i)" if kind == "regex_caseless" else "") + pattern)
        return found if op == "==" else ~found

    def _member(self, tree: where.Member) -> Column:
        if tree.kind.startswith("regex"):
            found = reduce(or_, (reduce(and_, (self._matches(a, "==", tree.kind, v) for a, v in zip(tree.attrs, g))) for g in tree.groups))
        elif len(tree.attrs) == 1:
            attr = tree.attrs[0]
            kind = "number" if attr.name in ("rec#", "seek#") else tree.kind
            plain = kind == "string" and all(g[0] for g in tree.groups) and isinstance(self.df.schema[self.column(attr)].dataType, StringType)
            found = (F.col(f"`{self.column(attr)}`") if plain else self.key(attr, kind)).isin(*[self.constant(g[0], attr, kind) for g in tree.groups])
        else:
            kinds = ["number" if a.name in ("rec#", "seek#") else tree.kind for a in tree.attrs]
            found = reduce(or_, (reduce(and_, (self.key(a, k) == self.constant(v, a, k) for a, k, v in zip(tree.attrs, kinds, g))) for g in tree.groups))
        # What is no date is in no list, so it isn't in this one.
        return found if tree.op == "in" else ~F.coalesce(found, F.lit(False))
