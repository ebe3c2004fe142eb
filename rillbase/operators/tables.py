"""Whole-table operations: append, ordered merge, keyed comparison, reshaping and updates.

Each gives the new table; ``overwrite`` puts it in a table's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillbase.functions import scalar, typed
from rillbase.operators.sorting import SortKey, numbered
from rillbase.plans.conditions import Keys
from rillbase.plans import where
from rillbase.plans.retrieve import select_where


def append(base: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables; what a table lacks is null."""
    for df in more:
        base = base.unionByName(df, allowMissingColumns=True)
    return base


def insert_from(base: DataFrame, rows: DataFrame, renames: dict[str, str] | None = None, constants: dict[str, object] | None = None, number: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """``base`` and the rows of another table: ``renames`` (theirs: ours), ``constants`` for ours, ``number`` gets the row's number in ``order``. Attributes without a source are empty."""
    constants = constants or {}
    if number:
        rows = numbered(rows, *order, name="rec#")
        constants = constants | {number: F.col("`rec#`")}
    for theirs, ours in (renames or {}).items():
        rows = rows.withColumnRenamed(theirs, ours)
    values = []
    for f in base.schema:
        given = constants.get(f.name)
        c = given if isinstance(given, Column) else F.lit(given) if f.name in constants else F.col(f.name) if f.name in rows.columns else F.lit("" if f.dataType.simpleString() == "string" else None)
        values.append(c.cast(f.dataType).alias(f.name))
    return base.unionByName(rows.select(*values))


def ordered_merge(base: DataFrame, rows: DataFrame, keys: list[str], policy: str = "all", limit: int | None = None, exactly: int | None = None) -> DataFrame:
    """``rows`` merged into ``base`` by ``keys``: ``all`` keeps everything, ``unique`` only rows whose key is new, ``replace`` puts rows in the place of those with their key.

    Of ``rows`` with one key the least row counts, unless all are kept. More than ``limit`` merged rows are an error, and so are other than ``exactly``.
    """
    if exactly is not None and rows.limit(exactly + 1).count() != exactly:
        raise ValueError(f"not {exactly} rows to merge")
    if limit is not None and rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows to merge")
    names = [SortKey.read(k).name for k in keys]
    if policy == "all":
        return base.unionByName(rows)
    one = rows.groupBy(*names).agg(F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("_r")).select("_r.*")
    if policy == "replace":
        return base.join(one.select(*names), names, "left_anti").select(*base.columns).unionByName(one)
    return base.unionByName(one.join(base.select(*names), names, "left_anti").select(*rows.columns))


def merge_numbers(base: DataFrame, rows: DataFrame, keys: list[str], order: tuple[str, ...], policy: str = "unique") -> DataFrame:
    """``rows`` that ``ordered_merge`` would put into ``base``, numbered from 1: ``recQ#`` among all rows in ``order``, ``recK#`` among the first of each
    key, ``recM#`` among those merged. ``order`` must tell the rows apart."""
    names = [SortKey.read(k).name for k in keys]
    asked = numbered(rows, *order, name="recQ#")
    first = asked.groupBy(*names).agg(F.min(F.struct("`recQ#`", *[F.col(f"`{c}`") for c in rows.columns if c not in names])).alias("_r")).select(*names, "_r.*")
    kept = numbered(first, "recQ#:numeric", name="recK#")
    if policy == "unique":
        kept = kept.join(base.select(*names).distinct(), names, "left_anti")
    return numbered(kept, "recK#:numeric", name="recM#").select(*rows.columns, "`recQ#`", "`recK#`", "`recM#`")


def merge_by_record(base: DataFrame, rows: DataFrame, order: tuple[str, ...], at: str, policy: str = "replace", exactly: int | None = None) -> DataFrame:
    """``rows`` merged into ``base`` by the record number that their attribute ``at`` names: ``replace`` puts a row in the place of that record,
    ``insert`` before it. The result has ``rec#``, its records numbered anew; a number beyond the table appends.

    ``base`` is numbered in ``order``. With ``exactly`` another number of rows is an error.
    """
    if exactly is not None and (n := rows.limit(exactly + 1).count()) != exactly:
        raise ValueError(f"{exactly} rows are to be merged, not {'more' if n > exactly else n}")
    old = numbered(base, *order, name="_rec").withColumn("_new", F.lit(1))
    new = rows.select(*base.columns, F.col(at).cast("long").alias("_rec")).withColumn("_new", F.lit(0))
    if policy == "replace":
        old = old.join(new.select("_rec").distinct(), "_rec", "left_anti")
    both = old.select(*base.columns, "_rec", "_new").unionByName(new)
    return numbered(both, "_rec:numeric", "_new:numeric", *order).drop("_rec", "_new")


def difference(one: DataFrame, two: DataFrame, keys: list[str], compare: list[str] | dict[str, str] | None = None, ignore: list[str] = (), show: list[str] = (), kinds: dict[str, str] | None = None) -> DataFrame:
    """A keyed comparison: ``<keys>, status, differs, <show>...``.

    ``status`` is ``extra1``, ``extra2`` or ``differ``; ``differs`` names the attributes that do. Equal rows are left out. Rows that share a key
    are paired in the order of their other attributes. ``compare``: attributes, or {ours: theirs}; ``kinds``: comparison kinds (string by default).
    """
    pairs = compare if isinstance(compare, dict) else {c: c for c in (compare or [c for c in one.columns if c in two.columns and c not in keys])}
    pairs = {a: b for a, b in pairs.items() if a not in ignore}

    def ranked(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in df.columns if c not in keys] or [F.lit(1)])
        rows = df.withColumn("_n", F.row_number().over(w))
        return rows.select(*keys, "_n", F.lit(True).alias(f"_in{side}"), *[F.col(c).alias(f"{side}.{c}") for c in columns])

    a = ranked(one, "1", list(dict.fromkeys([*pairs, *show])))
    b = ranked(two, "2", list(dict.fromkeys(pairs.values())))
    joined = a.join(b, [*keys, "_n"], "full")

    differs = []
    for x, y in pairs.items():
        kind = (kinds or {}).get(x, "string")
        left, right = F.col(f"`1.{x}`"), F.col(f"`2.{y}`")
        if kind == "number":
            u = left.cast("double") if typed.is_number(one, x) else typed.atof(left)
            v = right.cast("double") if typed.is_number(two, y) else typed.atof(right)
        elif kind in ("date", "day"):
            u, v = typed.date_key(left, kind == "day", native=typed.is_time(one, x)), typed.date_key(right, kind == "day", native=typed.is_time(two, y))
        elif kind == "caseless":
            u, v = typed.upper_key(left), typed.upper_key(right)
        else:
            u, v = typed.text(left), typed.text(right)
        differs.append(F.when(~u.eqNullSafe(v), F.lit(x)))
    both = F.col("_in1") & F.col("_in2")
    names = F.array_join(F.array_compact(F.array(*differs)), ",") if differs else F.lit("")
    told = joined.withColumn("differs", F.when(both, names).otherwise(F.lit("")))
    status = F.when(F.col("_in2").isNull(), "extra1").when(F.col("_in1").isNull(), "extra2").when(F.col("differs") != "", "differ")
    return told.withColumn("status", status).where("status is not null").select(*keys, "status", "differs", *[F.col(f"`1.{c}`").alias(c) for c in show])


def only(diff: DataFrame, extra: tuple[str, ...] = ("1", "2"), differing: bool = True) -> DataFrame:
    """A comparison without the rows that only the tables not in ``extra`` have, and without those that differ."""
    shown = [f"extra{t}" for t in extra] + ["differ"] * differing
    return diff.where(F.col("status").isin(shown))


def difference_counts(diff: DataFrame) -> DataFrame:
    """``status, records`` of a comparison."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


def to_packets(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``packet, name, value``: each row as a packet, numbered in the typed order, one row for each attribute."""
    rows = numbered(df, *order, name="packet")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), typed.text(F.col(c)).alias("value")) for c in df.columns])
    return rows.select("packet", F.inline(cells))


def from_packets(packets: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the attributes ``names`` from ``packet, name, value``; one that a packet lacks is empty. Of repeated ones the greatest counts."""
    cells = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit("")).alias(n) for n in names]
    return packets.groupBy("packet").agg(*cells).select("packet", *names)


def packet_text(packets: DataFrame) -> DataFrame:
    """``value``: each packet of ``packet, name, value`` as text: a line of five marks with its number, then a line of name and value for each
    attribute in the order of the names' places (``at``, if there) or of the names. A line end in a value goes on in a line that begins with a tab."""
    place = F.col("at") if "at" in packets.columns else F.lit(0)
    lines = F.sort_array(F.collect_list(F.struct(place.alias("at"), "name", F.replace(F.col("value"), F.lit("\n"), F.lit("\n\t")).alias("value"))))
    body = F.array_join(F.transform("lines", lambda x: F.concat(x["name"], F.lit("\t"), x["value"])), "\n")
    return packets.groupBy("packet").agg(lines.alias("lines")).select(F.concat(F.lit("#####\t"), F.col("packet").cast("string"), F.lit("\n"), body).alias("value"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """``packet, name, value`` of the packets in text files, split at their first lines by the reader, so a file is read by many tasks."""
    text = F.regexp_replace("value", "\n$", "")
    parts = F.split(text, "\n(?!\t)")
    lines = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.replace(x, F.lit("\n\t"), F.lit("\n")))
    cells = F.transform(lines, lambda x: F.struct(F.substring_index(x, "\t", 1).alias("name"), F.regexp_extract(x, "(?s)^[^\t]*\t?(.*)$", 1).alias("value")))
    rows = spark.read.option("lineSep", "#####\t").text(path).where("value <> ''")
    return rows.select(F.get(parts, F.lit(0)).cast("long").alias("packet"), F.inline(cells))


def fit_to(df: DataFrame, schema) -> DataFrame:
    """``df`` in the shape of another schema: its attributes by name, created empty where missing, padded or cut to their ``width``."""
    out = []
    for f in schema:
        c = typed.text(F.col(f.name)) if f.name in df.columns else F.lit("")
        width = f.metadata.get("width") if f.metadata else None
        if width:
            pad = F.lpad if f.metadata.get("justify") == "r" else F.rpad
            c = pad(F.substring(c, 1, int(width)), int(width), " ")
        out.append(c.alias(f.name, metadata=f.metadata or {}))
    return df.select(*out)


_MODIFIERS = ("ltrim", "rtrim", "trim", "tolower", "toupper")


def _new_value(df: DataFrame, name: str, op: str, value: Column, form: str | None, modifiers: list[str]) -> Column:
    old = F.col(f"`{name}`")
    if op == "=":
        new = value
        for m in modifiers:
            if m in _MODIFIERS:
                new = scalar.TRANSFORMS[m](new)
    else:
        base = next((b for m, b in (("binary", 2), ("octal", 8), ("hexadecimal", 16)) if m in modifiers), None)
        num = (lambda c: typed.based(c, base).cast("double")) if base else (lambda c: c.cast("double"))
        a = num(typed.text(old)) if base else old.cast("double") if typed.is_number(df, name) else typed.atof(old)
        b = num(value) if base else value.cast("double") if not isinstance(value, str) else F.lit(float(value))
        checked = F.when(b == 0, F.raise_error(F.lit(f"{name}: division by zero")).cast("double")).otherwise(b)
        new = {"+=": a + b, "-=": a - b, "*=": a * b, "/=": a / checked, "%=": (a.cast("long") % checked.cast("long")).cast("double")}[op]
        if not typed.is_number(df, name):
            new = scalar.reformat(new, form) if form else scalar.shortest(new, 11)
        form = None
    if form:
        new = scalar.reformat(new, form)
    return new


def _changed(df: DataFrame, old: Column, name: str, op: str, b: Column) -> Column:
    """``old``, the attribute ``name`` of ``df``, after an arithmetic operator with ``b``."""
    a = old.cast("double") if typed.is_number(df, name) else typed.atof(old)
    checked = F.when(b == 0, F.raise_error(F.lit(f"{name}: division by zero")).cast("double")).otherwise(b)
    new = {"+=": a + b, "-=": a - b, "*=": a * b, "/=": a / checked}[op]
    return new if typed.is_number(df, name) else scalar.shortest(new, 11)


def alter(df: DataFrame, changes: list[tuple], where_clause: str | list[str] | None = None) -> DataFrame:
    """Change attributes of the rows that meet the where-clause.

    Each change is ``(attribute, operator, value)`` or with modifiers and a format after it. Operators are ``= += -= *= /= %=`` with a
    constant, and the same after ``f`` with an attribute of the row. All values are those before the change. A division by zero is an error.
    """
    met = F.coalesce(_predicate(df, where_clause), F.lit(False)) if where_clause else F.lit(True)
    new = {}
    for name, op, value, *rest in changes:
        modifiers, form = (rest[0] if rest else []), (rest[1] if len(rest) > 1 else None)
        field = op[:1] == "f"
        op = op[1:] if field else op
        if op in ("/=", "%=") and not field and float(value) == 0:
            raise ValueError(f"{name} can't be divided by zero")
        source = F.col(f"`{value}`") if field else F.lit(value)
        if field and op != "=" and not typed.is_number(df, value):
            source = typed.atof(source)
        elif not field and op != "=" and not any(m in ("binary", "octal", "hexadecimal") for m in modifiers):
            source = F.lit(float(value))
        new[name] = F.when(met, _new_value(df, name, op, source, form, modifiers)).otherwise(F.col(f"`{name}`")).cast(df.schema[name].dataType)
    return df.withColumns(new)


def _predicate(df: DataFrame, clause) -> Column:
    return Keys(df, lambda attr: attr.name).condition(where.normal(where.parse(clause)))


def alter_from(df: DataFrame, other: DataFrame, keys: list[str] | dict[str, str], changes: dict[str, str | tuple[str, str]], where_clause: str | None = None, with_clause: str | None = None) -> DataFrame:
    """Change attributes by the row of ``other`` with the same keys. ``changes``: ours to theirs, or to ``(operator, theirs)`` with one of
    ``f= f+= f-= f*= f/=``. Rows without a partner, and those that don't meet ``where_clause``, stay; ``with_clause`` chooses rows of ``other``.

    A row for which ``other`` gives different new values is an error, and so is a division by zero.
    """
    names = keys if isinstance(keys, dict) else {k: k for k in keys}
    other = select_where(other, with_clause) if with_clause else other
    operators = {a: "f=" if isinstance(c, str) else c[0] for a, c in changes.items()}
    changes = {a: c if isinstance(c, str) else c[1] for a, c in changes.items()}
    met = F.coalesce(_predicate(df, where_clause), F.lit(False)) if where_clause else F.lit(True)
    df = df.withColumn("_met", met)
    told = other.groupBy(*names.values()).agg(
        *[F.first(v).alias(f"_v{i}") for i, v in enumerate(changes.values())], F.count_distinct(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in changes.values()])).alias("_kinds")
    )
    condition = None
    for a, b in names.items():
        c = F.col(f"_l.`{a}`") == F.col(f"_r.`{b}`")
        condition = c if condition is None else condition & c
    joined = df.alias("_l").join(told.alias("_r"), condition, "left")
    found = F.col("_r._kinds").isNotNull()
    values = {}
    for i, name in enumerate(changes):
        kind, given = df.schema[name].dataType, F.col(f"_r._v{i}")
        if operators[name] != "f=":
            given = given.cast("double") if typed.is_number(other, changes[name]) else typed.atof(given)
            given = _changed(df, F.col(f"_l.`{name}`"), name, operators[name][1:], given)
        checked = F.when(F.col("_r._kinds") > 1, F.raise_error(F.lit(f"{name} would get several values")).cast(kind)).otherwise(given.cast(kind))
        values[name] = F.when(found & F.col("_l._met"), checked).otherwise(F.col(f"_l.`{name}`"))
    return joined.select(*[values.get(c, F.col(f"_l.`{c}`")).alias(c) for c in df.columns if c != "_met"])


def delete(df: DataFrame, where_clause: str | list[str]) -> DataFrame:
    """The rows that don't meet the where-clause."""
    return df.where(~F.coalesce(_predicate(df, where_clause), F.lit(False)))


def delete_with(df: DataFrame, other: DataFrame, keys: list[str] | dict[str, str], where_clause: str | None = None) -> DataFrame:
    """The rows without a partner by ``keys`` among the rows of ``other`` that meet the where-clause."""
    names = keys if isinstance(keys, dict) else {k: k for k in keys}
    gone = select_where(other, where_clause) if where_clause else other
    gone = gone.select(*[F.col(b).alias(a) for a, b in names.items()]).distinct()
    return df.join(gone, list(names), "left_anti").select(*df.columns)


def overwrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Put ``df``, which may read from ``path``, in the place of the table there: it is written beside it first, then moved."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(path + "._new"), hadoop.Path(path + "._old")
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + "._new")
    fs.delete(old, True)
    if fs.exists(hadoop.Path(path)):
        fs.rename(hadoop.Path(path), old)
    fs.rename(new, hadoop.Path(path))
    fs.delete(old, True)


def save(df: DataFrame, path: str, onto: bool = False) -> None:
    """Write a table: ``into`` a place that must be free, or ``onto`` one that may be there."""
    df.write.mode("append" if onto else "errorifexists").parquet(path)

