"""Connected components by alternating star contraction, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: a node hands its neighbours (large: those above it, small: those below) its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    seen = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    told = seen.join(least, "u")
    if large:
        new = told.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        new = told.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return new.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` (the least id in it) for every node of ``edges`` (``a, b`` long, not null).

    Every round is written to the shared folder, so a lost executor repeats one round at most. A hub of a
    third of all edges only meets its own least neighbour, one row, in a join that may be split.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False), "edges")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError("the components did not settle")
    heads = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return heads.unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("component")))
