"""Delimited and fixed-width text files as DataFrames and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillbase.functions import typed
from rillbase.sources.descriptor import Attribute, Descriptor, read_descriptor


def _pattern(d: Descriptor) -> str:
    """One group for each attribute; a backslash keeps a delimiter in a value."""
    out = []
    for a in d.attributes:
        if a.width is not None:
            out.append(f"(.{{0,{a.width}}})" if a is d.attributes[-1] else f"(.{{{a.width}}})")
        elif a.delimiter == "\n":
            out.append("(.*)")
        else:
            x = re.escape(a.delimiter)
            out.append(rf"((?:\\.|[^\\{x}])*){x}")
    return "(?s)^" + "".join(out) + "$"


def records(lines: DataFrame, d: Descriptor, line: str = "value", policy: str = "permissive") -> DataFrame:
    """Attributes of each line. ``permissive``: a malformed line has empty attributes and ``_malformed``; ``drop``: it is left out; ``fail``: it is an error."""
    pattern = _pattern(d)
    text = typed.text(F.col(line))
    good = text.rlike(pattern)
    out: list[Column] = []
    for i, a in enumerate(d.attributes):
        value = F.regexp_extract(text, pattern, i + 1)
        if a.delimiter is not None and a.delimiter != "\n":
            value = F.regexp_replace(value, r"\\" + "(" + re.escape(a.delimiter) + r"|\\)", "$1")
        out.append(value.alias(a.name, metadata=a.field().metadata))
    if policy == "drop":
        return lines.where(good).select(*out)
    if policy == "fail":
        checked = F.when(good, text).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), text)))
        return records(lines.select(checked.alias(line)), d, line, "drop")
    return lines.select(*out, (~good).alias("_malformed"))


def read_table(spark: SparkSession, path: str, descriptor: Descriptor | str, policy: str = "drop") -> DataFrame:
    """A flat file, compressed or not (``.gz``, ``.bz2``). ``%description`` lines at its head are no records."""
    d = read_descriptor(descriptor) if isinstance(descriptor, str) else descriptor
    return records(spark.read.text(path), d, policy=policy)


def read_inline(spark: SparkSession, path: str, policy: str = "drop") -> DataFrame:
    """A flat file that begins with its own descriptor. Only the head is read for it; it has at most a thousand lines."""
    head = [r.value for r in spark.read.text(path).limit(1000).collect()]
    if not head or not head[0].startswith("%description") or "%enddescription" not in head:
        raise ValueError(f"{path} has no description at its head")
    end = head.index("%enddescription")
    lines = spark.read.text(path)
    # A scan has no order, so each line of the description goes once by its text; equal lines beyond that are records.
    described, alike = spark.createDataFrame([(x,) for x in head[: end + 1]], "value string"), F.col("value").isin(head[: end + 1])
    kept = lines.where(~alike).unionByName(lines.where(alike).exceptAll(described))
    return records(kept, read_descriptor("\n".join(head[1:end])), policy=policy)


def to_lines(df: DataFrame, descriptor: Descriptor | None = None, delimiter: str | None = None) -> DataFrame:
    """``value``: each row as a line; delimiters in values get a backslash, fixed widths are padded or cut. ``delimiter`` replaces all delimiters."""
    d = descriptor or Descriptor.of(df.schema)
    parts: list[Column] = []
    for i, a in enumerate(d.attributes):
        value, last = typed.text(F.col(f"`{a.name}`")), i == len(d.attributes) - 1
        mark = delimiter if delimiter is not None and not last else a.delimiter
        if a.width is not None and delimiter is None:
            pad = F.lpad if a.justify == "r" else F.rpad
            parts.append(pad(F.substring(value, 1, a.width), a.width, " "))
        elif last or mark == "\n":
            parts.append(F.translate(value, "\n", "~"))
        else:
            escaped = F.regexp_replace(value, r"([\\" + re.escape(mark) + "])", r"\\$1")
            parts.append(F.concat(F.translate(escaped, "\n", "~"), F.lit(mark)))
    return df.select(F.concat(*parts).alias("value"))


def write_table(df: DataFrame, path: str, descriptor: Descriptor | None = None, onto: bool = False, compression: str = "none") -> None:
    to_lines(df, descriptor).write.mode("append" if onto else "errorifexists").option("compression", compression).text(path)


def in_memory(spark: SparkSession, rows: list[tuple], descriptor: Descriptor | str) -> DataFrame:
    """A table of rows given by the caller."""
    d = read_descriptor(descriptor) if isinstance(descriptor, str) else descriptor
    return spark.createDataFrame(rows, d.schema())


def load(spark: SparkSession, source: str, descriptor: Descriptor | str, target: str) -> None:
    """Append a flat file to a table, all of it or nothing: one malformed record fails the write before it is committed."""
    read_table(spark, source, descriptor, "fail").write.mode("append").parquet(target)


def unload(spark: SparkSession, table: str, target: str, descriptor: Descriptor | None = None) -> None:
    """Write a table as a flat file and remove the table."""
    write_table(spark.read.parquet(table), target, descriptor)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def describe(df: DataFrame) -> DataFrame:
    """``attribute, kind, justify, width, label`` of each attribute."""
    rows = [(a.name, f"w{a.width}" if a.width is not None else "t" + a.delimiter.replace("\n", "\\n").replace("\t", "\\t"), a.justify, a.print_width, a.label) for a in Descriptor.of(df.schema).attributes]
    return df.sparkSession.createDataFrame(rows, "attribute string, kind string, justify string, width int, label string")


__all__ = ["Attribute", "Descriptor", "describe", "in_memory", "load", "read_inline", "read_table", "records", "to_lines", "unload", "write_table"]
