"""Reports for people: tables, blocks and formatted lines.

Lines are built by the executors; only a report that is printed is brought to the driver, and
at most ``rows`` of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillbase.functions import scalar, typed
from rillbase.sources.descriptor import Descriptor


def repeated_blank(df: DataFrame, names: list[str], order: list[str], within: list[str] = ()) -> DataFrame:
    """Values equal to those of the row before, in ``order``, as empty text; an attribute only if those named before it are equal too."""
    w = Window.partitionBy(*within).orderBy(*order) if within else Window.orderBy(*order)
    same, out = F.lit(True), {}
    for n in names:
        same = same & F.coalesce(typed.text(F.lag(n).over(w)) == typed.text(F.col(n)), F.lit(False))
        out[n] = F.when(same & (F.row_number().over(w) > 1), F.lit("")).otherwise(typed.text(F.col(n)))
    return df.withColumns(out)


def table_lines(df: DataFrame, friendly: bool = False, gap: str = " ") -> DataFrame:
    """``line``: the attributes of each row padded and cut to their print widths."""
    parts = []
    for a in Descriptor.of(df.schema).attributes:
        if a.hidden:
            continue
        c = F.substring(typed.text(F.col(f"`{a.name}`")), 1, a.print_width)
        if a.justify == "c":
            left = F.floor((F.lit(a.print_width) - F.length(c)) / 2).cast("int")
            c = F.rpad(F.concat(F.repeat(F.lit(" "), left), c), a.print_width, " ")
        else:
            c = F.lpad(c, a.print_width, " ") if a.justify == "r" else F.rpad(c, a.print_width, " ")
        parts.append(c)
    return df.select(F.concat_ws(gap, *parts).alias("line"))


def table_report(df: DataFrame, rows: int = 1000, page: int = 60, friendly: bool = False) -> str:
    """A report of the first ``rows`` rows with a heading on every page of ``page`` lines."""
    shown = [a for a in Descriptor.of(df.schema).attributes if not a.hidden]
    names = [(a.label if friendly and a.label else a.name)[: a.print_width] for a in shown]
    head = " ".join(n.rjust(a.print_width) if a.justify == "r" else n.ljust(a.print_width) for n, a in zip(names, shown))
    rule = " ".join("-" * a.print_width for a in shown)
    lines = [r.line.rstrip() for r in table_lines(df).limit(rows).collect()]
    pages = [lines[i : i + page] for i in range(0, len(lines), page)] or [[]]
    return "\f".join("\n".join([head.rstrip(), rule, *p]) + "\n" for p in pages)


def block_lines(df: DataFrame, friendly: bool = False) -> DataFrame:
    """``block``: each row as lines of ``label: value``."""
    attrs = [a for a in Descriptor.of(df.schema).attributes if not a.hidden]
    names = [a.label if friendly and a.label else a.name for a in attrs]
    width = max((len(n) for n in names), default=0)
    return df.select(F.concat_ws("\n", *[F.concat(F.lit(f"{n.ljust(width)}: "), typed.text(F.col(f"`{a.name}`"))) for n, a in zip(names, attrs)]).alias("block"))


def format_lines(df: DataFrame, form: str, names: list[str] | None = None, number: Column | None = None) -> DataFrame:
    """``line``: ``form`` filled from the attributes in turn: ``%s`` a value, ``%n`` the name of the next attribute, ``%d`` the record number (``number``)."""
    left, parts = list(names or df.columns), []
    for p in re.findall(r"%%|%[-0-9.]*[a-zA-Z]|[^%]+", form):
        if p == "%%":
            parts.append(F.lit("%"))
        elif p[0] != "%":
            parts.append(F.lit(p.replace("\\n", "\n").replace("\\t", "\t")))
        elif p[-1] == "n":
            parts.append(F.lit(left[0]))
        elif p[-1] == "d":
            parts.append(number.cast("string"))
        else:
            parts.append(scalar.reformat(F.col(f"`{left.pop(0)}`"), p))
    return df.select(F.concat(*parts).alias("line"))


def html_lines(df: DataFrame) -> DataFrame:
    """``line``: each row as a row of an HTML table, with markup in values escaped."""
    cells = []
    for c in df.columns:
        t = typed.text(F.col(f"`{c}`"))
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            t = F.replace(t, F.lit(mark), F.lit(name))
        cells += [F.lit("<td>"), t, F.lit("</td>")]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))
