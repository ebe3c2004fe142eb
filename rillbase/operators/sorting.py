"""Typed sort keys, distinct rows and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillbase.functions import typed
from rillbase.storage import written

_KINDS = ("string", "numeric", "caseless", "nocase", "date", "binary", "octal", "hexadecimal", "dictionary", "printable")


@dataclass
class SortKey:
    """``attribute[:modifier...]``: ascending, descending, a kind of comparison, blanks, split=..., field=m.n[-p.q], value=..., nodisplay."""

    name: str
    kinds: list[str] = field(default_factory=list)
    descending: bool = False
    blanks: bool = False
    split: str = " \t"
    ranges: list[tuple] = field(default_factory=list)
    value: str | None = None
    hidden: bool = False

    @classmethod
    def read(cls, spec: str) -> SortKey:
        name, *mods = re.split(r":(?=[a-z])", spec)
        key = cls(name)
        for m in mods:
            if m.startswith("value="):
                key.value = m[6:]
            elif m.startswith("split="):
                key.split = m[6:]
            elif m.startswith("field="):
                for part in m[6:].split(","):
                    a, _, b = part.partition("-")
                    place = lambda x: (int(x.split(".")[0]), int(x.split(".")[1]) if "." in x else 0)
                    key.ranges.append((place(a), place(b) if b else None))
            elif m in ("descending", "ascending"):
                key.descending = m == "descending"
            elif m == "blanks":
                key.blanks = True
            elif m in ("nodisplay", "display"):
                key.hidden = m == "nodisplay"
            elif m in _KINDS:
                key.kinds.append(m)
            elif m not in ("verbose", "noverbose"):
                raise ValueError(f"{m} isn't a modifier")
        return key

    def column(self, df: DataFrame, name: str | None = None, whole: bool = False) -> Column:
        """The value that is compared; ``whole`` leaves sub-fields aside, as distinctness does."""
        name = name or self.name
        c = F.col(f"`{name}`")
        if self.ranges and not whole:
            parts = [typed.subfield(c, a, b, self.split) for a, b in self.ranges]
            c = F.concat(*parts)
        elif not self.kinds and not self.blanks:
            return typed.text(c)
        elif self.kinds == ["numeric"] and typed.is_number(df, name):
            return c
        elif self.kinds == ["date"] and typed.is_time(df, name):
            return F.coalesce(typed.date_key(c, native=True), F.lit(0))
        if self.blanks:
            c = typed.unblanked(c)
        for kind in self.kinds or ["string"]:
            if kind == "numeric":
                c = typed.atof(c)
            elif kind == "date":
                c = F.coalesce(typed.date_key(c), F.lit(0))
            elif kind in ("binary", "octal", "hexadecimal"):
                c = typed.based(c, {"b": 2, "o": 8, "h": 16}[kind[0]], wrap=False)
            elif kind == "dictionary":
                c = typed.dictionary_key(c)
            elif kind == "printable":
                c = typed.printable_key(c)
            elif kind in ("caseless", "nocase"):
                c = F.upper(c)
        return c

    def order(self, df: DataFrame, name: str | None = None) -> Column:
        c = self.column(df, name)
        return c.desc() if self.descending else c.asc()


def keyed(df: DataFrame, keys: list[tuple[SortKey, str]]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the values that its typed keys compare as columns, and the order by these: each is computed once, not for every comparison."""
    names = [f"_key{i}" for i in range(len(keys))]
    orders = [F.col(n).desc() if k.descending else F.col(n).asc() for n, (k, _) in zip(names, keys)]
    return df.withColumns({n: k.column(df, name) for n, (k, name) in zip(names, keys)}), orders


def sort(df: DataFrame, *specs: str) -> DataFrame:
    """Rows by typed keys; keys with a constant value don't count."""
    keys = [SortKey.read(s) for s in specs]
    held, orders = keyed(df, [(k, k.name) for k in keys if k.value is None])
    return held.orderBy(*orders).select(*[f"`{c}`" for c in df.columns])


def unique(df: DataFrame, *specs: str) -> DataFrame:
    """One row for each distinct combination of the typed keys (all attributes by default).

    Which of several is kept is the least of them by all columns, so the result is always the same.
    """
    if not specs:
        return df.distinct()
    keys = [SortKey.read(s).column(df, whole=True).alias(f"_k{i}") for i, s in enumerate(specs)]
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def first_of_each(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the typed order (ties: the least row)."""
    by = [SortKey.read(s).order(df) for s in order]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by, *[F.col(c) for c in df.columns])))
    return ranked.where("_rank = 1").drop("_rank")


def numbered(df: DataFrame, *order: str, name: str = "rec#", by: tuple[str, ...] = ()) -> DataFrame:
    """Record numbers from 1 in the typed order, of the whole table or within ``by``.

    The whole table is numbered without gathering it: range partitions are sorted and counted, and
    a partition's numbers start after those of the partitions before it. The sorted rows are written to the
    shared folder once, since ranges come from samples and would not be the same the next time. Rows that the order
    leaves equal are numbered by all their attributes, so the numbers are always the same.
    """
    ties = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    if by:
        keys = [*(SortKey.read(s).order(df) for s in order), *ties]
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("long"))
    held, orders = keyed(df, [(k, k.name) for k in map(SortKey.read, order)])
    keys = [*orders, *ties]
    placed = held.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[f"`{c}`" for c in df.columns])
    rows = written(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")  # one row for each partition
    low = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return joined.withColumn(name, F.col("_base") + low + 1).drop("_at", "_part", "_base")


def is_sorted(df: DataFrame, record: str, *specs: str) -> DataFrame:
    """One row with ``is_sorted``: whether the rows, in the order of ``record``, are in the typed order.

    Neighbours are compared within range partitions and then at their borders.
    """
    keys = [SortKey.read(s) for s in specs]
    picked = df.select(F.col(record).alias("_r"), *[k.column(df).alias(f"_k{i}") for i, k in enumerate(keys)])
    rows = picked.repartitionByRange("_r").withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy("_r")
    names = [f"_k{i}" for i in range(len(keys))]
    falls = F.lit(False)
    for n, k in reversed(list(zip(names, keys))):
        a, b = F.lag(n).over(w), F.col(n)
        worse = a < b if k.descending else a > b
        falls = F.when(worse, True).when(a == b, falls).otherwise(False)
    inside = rows.withColumn("_bad", F.coalesce(falls, F.lit(False)))
    ends = inside.groupBy("_part").agg(F.max("_bad").alias("_bad"), F.min_by(F.struct(*names), "_r").alias("_lo"), F.max_by(F.struct(*names), "_r").alias("_hi"))
    border = Window.orderBy("_part")
    crossed = F.lit(False)
    for n, k in reversed(list(zip(names, keys))):
        a, b = F.lag("_hi").over(border)[n], F.col("_lo")[n]
        worse = a < b if k.descending else a > b
        crossed = F.when(worse, True).when(a == b, crossed).otherwise(False)
    return ends.select("_bad", F.coalesce(crossed, F.lit(False)).alias("_cross")).agg((~F.coalesce(F.max(F.col("_bad") | F.col("_cross")), F.lit(False))).alias("is_sorted"))
