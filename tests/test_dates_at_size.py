"""Dates in texts are read once for each row and place of use, and sorts compare values that are computed once."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from rillbase import queries
from rillbase.functions import scalar, typed
from rillbase.operators import sorting
from rillbase.plans.retrieve import retrieve, select_where

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().partition("== Optimized Logical Plan ==")[2].partition("== Physical Plan ==")[0]


def reads(df):
    return plan(df).count("regexp_")


def test_conditions_read_a_date_once(spark):
    df = spark.createDataFrame([("1/2/99",), ("x",), (None,), ("31.12.1999",)], "day string")
    found = select_where(df, "day d>= 1/1/1999 and day d< 1/3/1999")
    assert reads(found) <= 2
    assert [tuple(r) for r in found.collect()] == [("1/2/99",)]
    # Six places: two comparisons, a list, what is in neither, and null checks at most; it was over a thousand.
    assert reads(queries.QUERIES["fl_date_invalid"](spark, FOLDER)) <= 6


def test_columns_read_a_date_once(spark):
    df = spark.createDataFrame([("1/2/99 3:04",), ("1999,1,2,0,0,0",), ("1/2/99\u0085",), ("12/31/199",)], "day string")
    day = F.col("day")
    got = df.select(typed.date_key(day).alias("k"), scalar.date_text(day, "#").alias("d"), scalar.time_text(day).alias("t"))
    assert reads(got) == 3
    key = ((1999 * 12) * 31 + 1) * 86400
    assert [tuple(r) for r in got.collect()] == [(key + 11040, "990102", "03:04:00"), (None, "", ""), (key, "990102", "00:00:00"), (None, "", "")]


def test_date_key_reads_each_row_once(spark):
    assert reads(queries.QUERIES["fn_date_key"](spark, FOLDER)) == 1


def test_sorts_hold_their_keys(spark):
    df = spark.createDataFrame([("2/1/99", 1), ("31.1.1999", 2), ("x", 3)], "day string, n int")
    for found in (sorting.sort(df, "day:date:descending"), retrieve({"t": df}, "day n", sorted_by="day:date:descending")):
        line = next(x for x in plan(found).splitlines() if "Sort [" in x)
        assert "regexp_" not in line and "_key" in line
        assert found.columns == ["day", "n"] and [r.n for r in found.collect()] == [1, 2, 3]
    numbered = sorting.numbered(df, "day:date:descending")
    assert numbered.columns == ["day", "n", "rec#"] and sorted((r.n, r["rec#"]) for r in numbered.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_numbering_orders_by_held_keys(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sorting, "written", lambda df, tag: seen.append(plan(df)) or df)
    sorting.numbered(spark.createDataFrame([("2/1/99", 1)], "day string, n int"), "day:date")
    lines = [x for x in seen[0].splitlines() if "Sort [" in x or "RepartitionByExpression" in x]
    assert len(lines) == 2 and not any("regexp_" in x for x in lines)
