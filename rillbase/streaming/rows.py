"""Row-local operators on a streaming DataFrame.

Selection, projection, computing and reformatting look at one row at a time, so they run
unchanged on a stream. Record numbers, ``else``, joins, sorting and distinct rows need the whole
table and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rillbase.functions import scalar
from rillbase.plans import where
from rillbase.plans.conditions import Keys


def select_stream(df: DataFrame, clause: str | list[str]) -> DataFrame:
    """The rows of a stream that meet a where-clause of one table."""
    tree = where.normal(where.parse(clause))
    if any(a.name in ("rec#", "seek#") for a in where.attributes(tree)) or _ordered(tree):
        raise ValueError("record numbers and else need a whole table")
    return df.where(Keys(df, lambda attr: attr.name).condition(tree))


def _ordered(tree) -> bool:
    if isinstance(tree, where.Else):
        return True
    return isinstance(tree, (where.And, where.Or)) and any(map(_ordered, tree.parts))


def compute_stream(df: DataFrame, form: str | None = "%.3f", **results: str) -> DataFrame:
    return scalar.compute(df, form, **results)


def for_each_row(df: DataFrame, function, schema) -> DataFrame:
    """Rows of a table or a stream through a function from Arrow batches to Arrow batches: the place for callbacks for each row."""
    return df.mapInArrow(function, schema)
