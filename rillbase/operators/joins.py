"""Two-table joins by attribute names, a join on patterns, and set difference."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.functions import typed
from rillbase.storage import written

#: The least number of pairs for which it pays to divide a join, and the number of parts that larger ones are divided into.
PART_PAIRS, PARTS = 1 << 22, 1024


def _renamed(left: DataFrame, right: DataFrame, dropped: list[str]) -> list:
    """The right table's columns without ``dropped``; a name that the left table has gets a number."""
    taken, out = set(left.columns), []
    for c in right.columns:
        if c in dropped:
            continue
        name, k = c, 1
        while name in taken:
            name, k = f"{c}{k}", k + 1
        taken.add(name)
        out.append(F.col(f"_r.`{c}`").alias(name))
    return out


def _condition(left_keys: list[str], right_keys: list[str]):
    condition = F.lit(True)
    for a, b in zip(left_keys, right_keys):
        condition = condition & (F.col(f"_l.`{a}`") == F.col(f"_r.`{b}`"))
    return condition


def _pairs(left_keys, right_keys) -> tuple[list[str], list[str]]:
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = left_keys if right_keys is None else [right_keys] if isinstance(right_keys, str) else list(right_keys)
    return left_keys, right_keys


def equi_join(left: DataFrame, right: DataFrame, left_keys, right_keys=None) -> DataFrame:
    """All pairs of rows with equal keys; the right table's keys are left out."""
    left_keys, right_keys = _pairs(left_keys, right_keys)
    joined = left.alias("_l").join(right.alias("_r"), _condition(left_keys, right_keys), "inner")
    return joined.select("_l.*", *_renamed(left, right, right_keys))


def outer_join(left: DataFrame, right: DataFrame, left_keys, right_keys=None, blanks: bool = True) -> DataFrame:
    """``equi_join`` and the rows of ``left`` without a partner; their missing text is empty if ``blanks``."""
    left_keys, right_keys = _pairs(left_keys, right_keys)
    joined = left.alias("_l").join(right.alias("_r"), _condition(left_keys, right_keys), "left")
    out = joined.select("_l.*", *_renamed(left, right, right_keys))
    return out.na.fill("", [c for c in out.columns if c not in left.columns]) if blanks else out


def set_difference(left: DataFrame, right: DataFrame, left_keys, right_keys=None) -> DataFrame:
    """The rows of ``left`` that ``equi_join`` would not use."""
    left_keys, right_keys = _pairs(left_keys, right_keys)
    return left.alias("_l").join(right.alias("_r"), _condition(left_keys, right_keys), "left_anti")


def pattern_join(patterns: DataFrame, table: DataFrame, pattern_keys, table_keys, basic: bool = True, block: int = 1000) -> DataFrame:
    """Rows of ``table`` joined with every row of ``patterns`` whose attributes, as regular expressions, match; the patterns are left out.

    Patterns are the small side, a stated query set: they are read in blocks of ``block`` rows, each of which
    is one filter of the table with the patterns compiled once, and no product of the tables is made.
    """
    pattern_keys, table_keys = _pairs(pattern_keys, table_keys)
    translate = typed.basic_pattern if basic else typed.java_pattern
    kept = [c for c in patterns.columns if c not in pattern_keys]
    schema = patterns.select(*kept).schema
    out = None
    rows = patterns.toLocalIterator(prefetchPartitions=True)
    done = False
    while not done:
        part = []
        for row in rows:
            part.append(row)
            if len(part) == block:
                break
        done = len(part) < block
        hits = []
        for i, row in enumerate(part):
            match = F.lit(True)
            for p, t in zip(pattern_keys, table_keys):
                match = match & typed.text(F.col(f"`{t}`")).rlike(translate(row[p] or ""))
            hits.append(F.when(match, F.lit(i)))
        table_names = _renamed(patterns.select(*kept), table, [])
        if not part:
            break
        found = table.alias("_r").select(F.explode(F.array_compact(F.array(*hits))).alias("_hit"), F.struct("_r.*").alias("_r"))
        values = F.array(*[F.struct(*[F.lit(row[c]).cast(schema[c].dataType).alias(c) for c in kept]) if kept else F.struct(F.lit(1).alias("_none")) for row in part])
        named = found.select(F.get(values, F.col("_hit")).alias("_p"), "_r")
        columns = [F.col(f"_p.`{c}`").alias(c) for c in kept] + table_names
        piece = named.select(*columns)
        out = piece if out is None else out.unionAll(piece)
    if out is None:
        empty = patterns.alias("_p").join(table.alias("_r"), F.lit(False), "inner")
        out = empty.select(*[F.col(f"_p.`{c}`") for c in kept], *_renamed(patterns.select(*kept), table, []))
    return out


def _mostly_single(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> bool:
    """Whether the pairs are about as many as the rows, by the distinct keys of both sides as counted approximately."""
    if left_keys and min(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for df in (left, right)) < 1 << 14:
        return True  # tables of a few hundred rows, as nation and region

    def told(df: DataFrame, keys: list[str]) -> DataFrame:
        known = df.where(reduce(and_, (F.col(k).isNotNull() for k in keys), F.lit(True)))
        distinct = F.approx_count_distinct(F.struct(*keys)) if keys else F.lit(1)
        return known.agg(F.count(F.lit(1)).alias("n"), distinct.alias("d"))

    a, b, c, d = told(left, left_keys).crossJoin(told(right, right_keys)).first()
    return a * c <= max(PART_PAIRS, 8 * (a + c)) * max(b, d, 1)


def divided(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], by_left: list[str], by_right: list[str]):
    """Both sides of an inner join whose rows meet many partners, with the columns ``_group`` and ``_part`` to join by instead; None if they meet few.

    The pairs of each key (without keys: all pairs) are a rectangle, cut into parts of about equal size: a row is in one of its rows or columns of
    parts, by a hash of its attributes ``by_left`` or ``by_right``, and goes to each of them. So each pair is in one part, and the parts go to many tasks
    whatever the number of keys. Rows without a partner are left out.
    """
    if _mostly_single(left, right, left_keys, right_keys):
        return None
    names = range(len(left_keys))
    one = left.groupBy(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(left_keys)]).agg(F.count(F.lit(1)).alias("_nl"))
    two = right.groupBy(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(right_keys)]).agg(F.count(F.lit(1)).alias("_nr"))
    met = one.join(two, reduce(and_, (F.col(f"_l{i}") == F.col(f"_r{i}") for i in names), F.lit(True)))
    groups = written(met.withColumn("_group", F.monotonically_increasing_id()), "groups")
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    total = groups.agg(F.sum(pairs)).first()[0] or 0.0
    size = max(PART_PAIRS, total / PARTS)
    down = F.greatest(F.lit(1.0), F.least(F.col("_nl").cast("double"), F.round(F.sqrt(pairs / size * F.col("_nl") / F.col("_nr"))))).cast("long")
    groups = groups.withColumn("_down", down).withColumn("_across", F.least(F.col("_nr"), F.ceil(pairs / size / F.col("_down"))))
    tasks = int(min(PARTS, max(1, total // PART_PAIRS))) + 1

    def side(df: DataFrame, keys: list[str], mark: str, by: list[str], own: str, other: str) -> DataFrame:
        of = F.broadcast(groups) if not keys else groups  # without keys one row
        told = df.join(of, reduce(and_, (F.col(k) == F.col(f"{mark}{i}") for i, k in enumerate(keys)), F.lit(True)))
        place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.col(own)) if by else F.lit(0)
        spread = told.select(*[f"`{c}`" for c in df.columns], "_group", "_across", place.alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("_other"))
        down, across = ("_own", "_other") if own == "_down" else ("_other", "_own")
        part = F.col(down) * F.col("_across") + F.col(across)
        return spread.select(*[f"`{c}`" for c in df.columns], "_group", part.alias("_part")).repartition(tasks, "_group", "_part")

    return side(left, left_keys, "_l", by_left, "_down", "_across"), side(right, right_keys, "_r", by_right, "_across", "_down")
