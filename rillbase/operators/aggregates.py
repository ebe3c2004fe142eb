"""Distributions, cross-tabulations and summary statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillbase.functions import typed


def _number(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The number of a value, and whether it is one."""
    if typed.is_number(df, name):
        return F.col(name).cast("double"), F.col(name).isNotNull()
    return typed.atof(F.col(name)), typed.is_numeric_text(F.col(name))


def tally(df: DataFrame, by: str, total: bool = False) -> DataFrame:
    """``<by>, count`` for each value; with ``total`` a last row TOTAL."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    if total:
        out = out.select(F.col(by).cast("string").alias(by), "count").unionAll(df.agg(F.lit("TOTAL").alias(by), F.count(F.lit(1)).alias("count")))
    return out


def distribution(df: DataFrame, number: str, by: str) -> DataFrame:
    """``<by>, total, count`` of the rows whose ``number`` is one; empty text counts as 0."""
    value, good = _number(df, number)
    return df.where(good).groupBy(by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("count"))


def column_name(value: object, prefix: str = "v") -> str:
    """A value as an attribute name: what isn't a letter, digit or ``_`` becomes ``_``, a digit in front gets ``prefix``."""
    name = re.sub(r"[^A-Za-z0-9_]", "_", str(value))
    return name if name[:1].isalpha() or name[:1] == "_" else prefix + name


def _pivot_values(df: DataFrame, across: str, values: list | None, most: int) -> list:
    if values is not None:
        return list(values)
    found = sorted((r[0] for r in df.select(across).where(F.col(across).isNotNull()).distinct().limit(most + 1).collect()), key=lambda v: (str(type(v)), v))
    if len(found) > most:
        raise ValueError(f"{across} has more than {most} values; a cross-tabulation has a column for each")
    return found


def cross_sum(df: DataFrame, number: str, by: str, across: str, values: list | None = None, missing: str | None = None, most: int = 1000) -> DataFrame:
    """Sums of ``number`` by ``by`` (rows) and ``across`` (columns); a cell without rows is null, or ``missing`` as text."""
    value, good = _number(df, number)
    rows = df.where(good)
    values = _pivot_values(rows, across, values, most)
    cells = [F.sum(F.when(F.col(across) == F.lit(v), value)).alias(column_name(v)) for v in values]
    out = rows.groupBy(by).agg(*cells)
    if missing is not None:
        out = out.select(by, *[F.when(F.col(c).isNull(), F.lit(missing)).otherwise(F.format_string("%.0f", c)).alias(c) for c in out.columns[1:]])
    return out


def cross_tally(df: DataFrame, by: str, across: str, values: list | None = None, total: bool = False, most: int = 1000) -> DataFrame:
    """Counts by ``by`` and ``across``; a cell without rows is 0. With ``total`` a last row TOTAL of the columns."""
    values = _pivot_values(df, across, values, most)
    cells = [F.count(F.when(F.col(across) == F.lit(v), 1)).alias(column_name(v)) for v in values]
    out = df.groupBy(by).agg(*cells)
    if total:
        out = out.select(F.col(by).cast("string").alias(by), *out.columns[1:]).unionAll(df.agg(F.lit("TOTAL").alias(by), *cells))
    return out


def statistics(df: DataFrame, *names: str) -> DataFrame:
    """``aname, total, count, average, min, max, std_dev`` for each attribute in one pass.

    Empty and non-numeric values are left out of their attribute only; the deviation is that of the population;
    an attribute without numbers has 0 everywhere.
    """
    structs = []
    for n in names:
        value, good = _number(df, n)
        v = F.when(good & (typed.text(F.col(n)) != ""), value)
        structs.append(
            F.struct(
                F.lit(n).alias("aname"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("count"), F.coalesce(F.avg(v), F.lit(0.0)).alias("average"),
                F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std_dev"),
            )
        )
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def merge_values(df: DataFrame, name: str, order: str, separator: str = ",") -> DataFrame:
    """Rows equal in all attributes but ``name`` (and ``order``) as one, their values joined in the order of ``order``."""
    others = [c for c in df.columns if c not in (name, order)]
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), typed.text(F.col(name)).alias("v")))), lambda x: x["v"]), separator)
    return df.groupBy(*others).agg(joined.alias(name)).select(*[c for c in df.columns if c != order])


def unmerge_values(df: DataFrame, name: str, separator: str = ",") -> DataFrame:
    """A row for each part of ``name``; a separator at the end has nothing after it."""
    t = typed.text(F.col(name))
    trimmed = F.when(t.endswith(separator) & (t != ""), t.substr(F.lit(1), F.length(t) - len(separator))).otherwise(t)
    parts = F.split(trimmed, re.escape(separator).replace("\\,", ","))
    return df.withColumn(name, F.explode(parts))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"))
