"""The multi-table query: names and a where-clause to one DataFrame.

Selections come first, then equi-joins, equi outer joins, other joins, other outer joins and
the two kinds of anti-join. An ``or`` that spans tables is the union of its branches, duplicates
kept. A table that is only selected on lets rows pass if any of its rows qualifies.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillbase.functions import typed
from rillbase.operators.joins import divided
from rillbase.operators.sorting import SortKey, keyed, numbered
from rillbase.plans import where
from rillbase.plans.conditions import Keys, compared
from rillbase.storage import written


class _Plan:
    def __init__(self, tables: list[tuple[str, DataFrame]], record_order: dict[str, tuple[str, ...]], pivot: int):
        self.names = [n for n, _ in tables]
        self.sources = [df for _, df in tables]
        self.order, self.pivot = record_order, pivot
        self.numbered: set[int] = set()
        self.used: set[str] = set()

    def table_of(self, attr: where.Attr) -> int:
        if attr.table is not None:
            if attr.table.isdigit():
                return int(attr.table) - 1
            return self.names.index(attr.table)
        for i, df in enumerate(self.sources):
            if attr.name in df.columns:
                return i
        if attr.name == "seek#":
            raise ValueError("seek# is a place in a file, which distributed tables don't have: use rec# with a record_order, or give the table an attribute of that name")
        if attr.name == "rec#":
            return 0
        raise ValueError(f"no table has {attr.name}")

    def column(self, attr: where.Attr) -> str:
        return f"{self.table_of(attr)}.{attr.name}"

    def frame(self, i: int) -> DataFrame:
        df = self.sources[i]
        if i in self.numbered and "rec#" not in df.columns:
            if self.names[i] not in self.order:
                raise ValueError(f"rec# of {self.names[i]} needs its record_order")
            df = numbered(df, *self.order[self.names[i]])
        return df.select(*[F.col(f"`{c}`").alias(f"{i}.{c}", metadata=df.schema[c].metadata) for c in df.columns])

    def tables_of(self, tree) -> set[int]:
        return {self.table_of(a) for a in where.attributes(tree)}

    def keys(self, df: DataFrame) -> Keys:
        return Keys(df, self.column, self.pivot)

    def one_table(self, tree) -> bool:
        return len(self.tables_of(tree)) == 1

    def branches(self, tree) -> list[list]:
        """Conjunctions whose union is ``tree``; what touches one table stays one predicate."""
        if self.one_table(tree) and not _has_else_inside(tree):
            return [[tree]]
        if isinstance(tree, where.And):
            return [sum(combo, []) for combo in product(*map(self.branches, tree.parts))]
        if isinstance(tree, where.Or):
            return [b for p in tree.parts for b in self.branches(p)]
        if isinstance(tree, where.Member) and len(self.tables_of(tree)) > 1:
            spread = where.Or(tuple(where.And(tuple(where.Member((a,), "in", tree.kind, ((v,),)) for a, v in zip(tree.attrs, g))) for g in tree.groups))
            return self.branches(where.normal(where.Not(spread)) if tree.op == "!in" else spread)
        if isinstance(tree, where.Else) and not self.one_table(tree):
            raise ValueError("else takes comparisons of one table")
        return [[tree]]

    def ordered_or(self, df: DataFrame, tree) -> tuple[DataFrame, Column]:
        """The predicate of ``tree``, with a column for each left side of ``else`` telling whether any row meets it."""
        if isinstance(tree, where.Else):
            df, left = self.ordered_or(df, tree.first)
            df, right = self.ordered_or(df, tree.second)
            name = f"_any{len(df.columns)}"
            found = df.agg(F.coalesce(F.max(F.coalesce(left, F.lit(False))), F.lit(False)).alias(name))
            return df.join(F.broadcast(found)), left | (right & ~F.col(name))  # one row
        if isinstance(tree, (where.And, where.Or)):
            parts = []
            for p in tree.parts:
                df, c = self.ordered_or(df, p)
                parts.append(c)
            return df, reduce(and_ if isinstance(tree, where.And) else or_, parts)
        return df, self.keys(df).condition(tree)

    def evaluate(self, conjuncts: list, shown: set[int]) -> DataFrame:
        flat: list = []
        for c in conjuncts:
            flat += list(c.parts) if isinstance(c, where.And) and self.one_table(c) else [c]
        frames: dict[int, DataFrame] = {i: self.frame(i) for i in range(len(self.sources))}
        touched: set[int] = set()
        late, matches = [], []
        for c in flat:
            used = self.tables_of(c)
            touched |= used
            if len(used) > 1:
                matches.append(c)
            elif _has_else(c):
                late.append(c)
            else:
                i = next(iter(used))
                frames[i] = frames[i].where(self.keys(frames[i]).condition(c))
        for c in late:
            i = self.table_of(where.attributes(c)[0])
            columns = frames[i].columns
            df, condition = self.ordered_or(frames[i], c)
            frames[i] = df.where(condition).select(*[f"`{x}`" for x in columns])
        groups: list[tuple[set[int], DataFrame]] = [({i}, df) for i, df in frames.items()]
        waiting = _join_order(matches)
        while waiting:
            members = waiting.pop(0)
            if members[0].join == "inner" and members[0].op == "==":
                sides = [next(g[0] for g in groups if self.table_of(x) in g[0]) for x in (members[0].left, members[0].right)]
                more = [w for w in waiting if w[0].join == "inner" and w[0].op == "==" and sides[0] is not sides[1] and self._across(w[0], sides)]
                waiting = [w for w in waiting if w not in more]
                members = [*members, *sum(more, [])]
            groups = self._joined(groups, members, shown)
        result, gates = None, []
        for members, df in groups:
            if members & shown:
                result = df if result is None else result.crossJoin(df)
            elif members & touched:
                gates.append(df)
        for gate in gates:
            found = gate.select(F.lit(1).alias("_gate")).limit(1)
            result = result.crossJoin(F.broadcast(found)).drop("_gate")  # at most one row
        return result

    def _across(self, m: where.Match, sides: list[set[int]]) -> bool:
        a, b = self.table_of(m.left), self.table_of(m.right)
        return (a in sides[0] and b in sides[1]) or (a in sides[1] and b in sides[0])

    def _joined(self, groups, members: list[where.Match], shown: set[int]):
        first = members[0]
        a, b = self.table_of(first.left), self.table_of(first.right)
        left = next(g for g in groups if a in g[0])
        right = next(g for g in groups if b in g[0])
        if left is right:
            df = left[1]
            condition = reduce(and_, (self.keys(df).condition(m) for m in members))
            if first.join == "anti":
                condition = ~F.coalesce(condition, F.lit(False))
            return [g for g in groups if g is not left] + [(left[0], df.where(condition))]
        rest = [g for g in groups if g is not left and g is not right]

        def side(m: where.Match) -> tuple[Column, Column]:
            forward = self.table_of(m.left) in left[0]
            kind = "number" if "rec#" in (m.left.name, m.right.name) else m.kind
            x, y = self.keys(left[1] if forward else right[1]).key(m.left, kind, True), self.keys(right[1] if forward else left[1]).key(m.right, kind, True)
            return (x, y) if forward else (y, x)

        # What is equated is a column of its own, so that it is computed once and not by each step of the join.
        equal, others = [m for m in members if m.op == "=="], [m for m in members if m.op != "=="]
        names = [(f"_a{i}", f"_b{i}") for i in range(len(equal))]
        keys = [side(m) for m in equal]
        one = left[1].withColumns({a: x for (a, _), (x, _) in zip(names, keys)})
        two = right[1].withColumns({b: y for (_, b), (_, y) in zip(names, keys)})

        def forms(m: where.Match) -> Column:
            x, y = side(m)
            return compared(x, m.op, y) if self.table_of(m.left) in left[0] else compared(y, m.op, x)

        condition = reduce(and_, [*(F.col(a) == F.col(b) for a, b in names), *map(forms, others)])
        left, right, columns = (left[0], one), (right[0], two), (left[1].columns, right[1].columns)
        if first.join == "inner":
            # Keys read from texts are written once: counting and joining would each read them anew.
            read = [any(m.kind in ("date", "day") and not typed.is_time(df, self.column(a)) for m in equal for a in (m.left, m.right) if self.column(a) in df.columns) for df in (one, two)]
            columns = tuple([c for c in names_of if c in self.used] if slow else names_of for names_of, slow in zip(columns, read))
            one, two = (
                written(df.select(*[f"`{c}`" for c in [*kept, *(pair[i] for pair in names)]]), "keys") if slow else df
                for i, (df, kept, slow) in enumerate(zip((one, two), columns, read))
            )
            by = [[c for c, t in df.dtypes if c in self.used and not t.startswith(("map", "variant"))] for df in (one, two)]
            parts = divided(one, two, [a for a, _ in names], [b for _, b in names], *by)
            if parts:
                one, two = (df.withColumnsRenamed({"_group": f"_group{i}", "_part": f"_part{i}"}) for i, df in enumerate(parts))
                condition = reduce(and_, [F.col("_group0") == F.col("_group1"), F.col("_part0") == F.col("_part1"), *map(forms, others)])
            return rest + [(left[0] | right[0], one.join(two, condition).select(*[f"`{c}`" for c in sum(columns, [])]))]
        if first.join == "anti":
            only_left = left[1].join(right[1], condition, "left_anti").select(*[f"`{c}`" for c in columns[0]])
            only_right = right[1].join(left[1], condition, "left_anti").select(*[f"`{c}`" for c in columns[1]])
            if left[0] & shown and right[0] & shown:
                return rest + [(left[0] | right[0], only_left.crossJoin(only_right))]
            keep, df = (left[0], only_left) if left[0] & shown else (right[0], only_right)
            return rest + [(keep, df)]
        return rest + [(left[0] | right[0], left[1].join(right[1], condition, first.join).select(*[f"`{c}`" for c in sum(columns, [])]))]


def _has_else(tree) -> bool:
    return isinstance(tree, where.Else) or _has_else_inside(tree)


def _has_else_inside(tree) -> bool:
    return isinstance(tree, (where.And, where.Or)) and any(map(_has_else, tree.parts))


def _join_order(matches: list[where.Match]) -> list[list[where.Match]]:
    """Matches of one pair of tables and one kind of join together, in the order of evaluation."""
    ranks = {("inner", True): 0, ("full", True): 1, ("left", True): 1, ("inner", False): 2, ("full", False): 3, ("left", False): 3, ("anti", True): 4, ("anti", False): 5}
    pairs: dict[tuple, list[where.Match]] = {}
    for m in matches:
        kind = "anti" if m.join == "anti" else "outer" if m.join != "inner" else "inner"
        pairs.setdefault((frozenset((m.left.table, m.right.table)) if m.left.table and m.right.table else frozenset((m.left, m.right)), kind), []).append(m)
    groups = [sorted(g, key=lambda m: m.op != "==") for g in pairs.values()]
    return sorted(groups, key=lambda g: ranks[g[0].join, g[0].op == "=="])


def retrieve(
    tables: dict[str, DataFrame] | list[tuple[str, DataFrame]],
    select: list[str] | str = "all",
    where_clause: str | list[str] | None = None,
    sorted_by: list[str] | str | None = None,
    unique: bool = False,
    limit: int | None = None,
    caseless: bool = False,
    record_order: dict[str, tuple[str, ...]] | None = None,
    blanks: bool = False,
    pivot: int = typed.PIVOT,
) -> DataFrame:
    """Rows of ``tables`` that meet the where-clause, projected and sorted.

    ``select``: ``[table.]attribute[:modifier...] [as name]`` each, or ``all`` (``all:nodisplay=a,b``: without those), words or one
    text. Tables used twice are ``1.attribute`` and ``2.attribute``. ``sorted_by``: sort keys, or ``all`` for every selected attribute.
    ``record_order``: for tables whose ``rec#`` is used, the keys that number their records. ``blanks``: missing values of outer joins
    become empty strings in text columns. Without a where-clause the result is the product of the tables.
    """
    pairs = list(tables.items()) if isinstance(tables, dict) else list(tables)
    plan = _Plan(pairs, record_order or {}, pivot)
    tree = where.normal(where.parse(where_clause, caseless)) if where_clause else None
    items = _selection(plan, select)
    sort_words = sorted_by.split() if isinstance(sorted_by, str) else list(sorted_by or [])
    sort_keys = [] if sort_words == ["all"] else [SortKey.read(w) for w in sort_words]
    named = {name: (attr, key) for attr, name, key in items}
    used = [a for a, _, k in items if k.value is None] + [where.attribute(k.name) for k in sort_keys if k.name not in named] + (where.attributes(tree) if tree else [])
    plan.used = {plan.column(a) for a in used}
    plan.numbered = {plan.table_of(a) for a in used if a.name == "rec#"}
    shown = {plan.table_of(a) for a, _, k in items if k.value is None} or {0}
    hidden = [(where.attribute(k.name), k) for k in sort_keys if k.name not in named]
    columns = [
        *((F.lit(k.value) if k.value is not None else F.col(f"`{plan.column(a)}`")).alias(name) for a, name, k in items),
        *(F.col(f"`{plan.column(a)}`").alias(f"_sort{i}") for i, (a, _) in enumerate(hidden)),
    ]
    branches = plan.branches(tree) if tree else [[]]
    df = None
    for b in branches:
        part = plan.evaluate(b, shown).select(*columns)
        df = part if df is None else df.unionAll(part)
    if blanks:
        df = df.na.fill("")
    if unique:
        typed_keys = [(name, k) for _, name, k in items if k.value is None]
        if any(k.kinds or k.blanks for _, k in typed_keys):
            row = F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row")
            df = df.groupBy(*[k.column(df, name, whole=True).alias(f"_k{i}") for i, (name, k) in enumerate(typed_keys)]).agg(row).select("_row.*")
        else:
            df = df.distinct()
    if sort_words == ["all"]:
        df, orders = keyed(df, [(k, name) for _, name, k in items if k.value is None])
        df = df.orderBy(*orders)
    elif sort_keys:
        places = {k.name: f"_sort{i}" for i, (_, k) in enumerate(hidden)}
        told_keys = []
        for k in sort_keys:
            name = places.get(k.name, k.name)
            told = named.get(k.name)
            if told and not k.kinds:
                k.kinds = told[1].kinds
            told_keys.append((k, name))
        df, orders = keyed(df, told_keys)
        df = df.orderBy(*orders)
    df = df.select(*[f"`{name}`" for _, name, k in items if not k.hidden])
    return df if limit is None else df.limit(limit)


def _selection(plan: _Plan, select: list[str] | str) -> list[tuple[where.Attr, str, SortKey]]:
    words = select.split() if isinstance(select, str) else [w for s in select for w in ([s] if ":value=" in s else s.split())]
    items, i = [], 0
    while i < len(words):
        word = words[i]
        table, _, rest = word.rpartition(".") if word.split(":")[0].endswith("all") else ("", "", word)
        if rest == "all" or rest.startswith("all:"):
            without = rest.partition("nodisplay=")[2].split(",")
            for t in [plan.table_of(where.Attr("all", table))] if table else range(len(plan.sources)):
                for f in plan.sources[t].schema:
                    if f.name not in without and not f.metadata.get("hidden"):
                        taken = {n for _, n, _ in items}
                        name = f.name if f.name not in taken else f"{f.name}{sum(n.rstrip('0123456789') == f.name for n in taken)}"
                        items.append((where.Attr(f.name, str(t + 1)), name, SortKey(f.name)))
            i += 1
            continue
        key = SortKey.read(word)
        attr = where.attribute(key.name)
        name = attr.name
        if i + 2 < len(words) + 0 and i + 1 < len(words) and words[i + 1] == "as":
            name = words[i + 2]
            i += 2
        items.append((attr, name, key))
        i += 1
    return items


class Prepared:
    """A query that is read once and run with constants for the words ``$name`` of its where-clause."""

    def __init__(self, select: list[str] | str, where_clause: str | list[str], **options):
        self.select, self.options = select, options
        self.words = where.split(where_clause) if isinstance(where_clause, str) else list(where_clause)
        where.parse(self.words)
        self.names = {w[1:] for w in self.words if w[:1] == "$" and w[1:].isidentifier()}

    def run(self, tables: dict[str, DataFrame] | list[tuple[str, DataFrame]], **values) -> DataFrame:
        if set(values) != self.names:
            raise ValueError(f"values are needed for {sorted(self.names)}")
        words = [str(values[w[1:]]) if w[:1] == "$" and w[1:] in values else w for w in self.words]
        return retrieve(tables, self.select, words, **self.options)


def exists(*args, **kwargs) -> DataFrame:
    """One row with ``found``: whether ``retrieve`` with these arguments has a row."""
    return retrieve(*args, **kwargs).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def select_where(df: DataFrame, clause: str | list[str], caseless: bool = False, pivot: int = typed.PIVOT) -> DataFrame:
    """The rows of one table that meet a where-clause; it pushes down to the scan as a filter."""
    return retrieve([("t", df)], "all", clause, caseless=caseless, pivot=pivot)
