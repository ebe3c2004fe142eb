"""Rule-based record validation.

A script has a rule on each line, ``condition : code``; a rule indented under another only
runs for records that meet the other. Records get the codes of the rules they fail.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillbase.functions import typed

_TOKEN = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|([0-9]+\.?[0-9]*|\.[0-9]+)|(\#!=|\#==|\$<=|\$>=|\$<|\$>|%%|==|!=|<=|>=|[|&<>$%+\-*/!(),])|([A-Za-z_]\w*))""")
_LEVELS = [["|"], ["&"], ["==", "!=", "#==", "#!=", "%", "%%", "<", "<=", ">", ">=", "$<", "$<=", "$>", "$>="], ["$"], ["+", "-"], ["*", "/"]]


@dataclass
class Rule:
    condition: str
    code: str
    nested: list[Rule] = field(default_factory=list)


def script(text: str) -> list[Rule]:
    """Rules of a script; a rule may have no code if others are indented under it."""
    top: list[Rule] = []
    stack: list[tuple[int, list[Rule]]] = [(-1, top)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
        body, _, code = line.strip().rpartition(":")
        rule = Rule(body.strip(), code.strip()) if body else Rule(line.strip(), "")
        while stack[-1][0] >= depth:
            stack.pop()
        stack[-1][1].append(rule)
        stack.append((depth, rule.nested))
    return top


class _Expression:
    """Conditions and values over the attributes of a record. Values are text; a condition has a value as 1 or 0."""

    def __init__(self, df: DataFrame, source: str, tables: dict[str, tuple[str, str]]):
        self.df, self.tables = df, tables
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"can't read {source[at:]!r}")
            kind = next(i for i in range(4) if m.group(i + 1) is not None)
            self.tokens.append((kind, m.group(kind + 1)))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def level(self, n: int = 0) -> tuple[str, Column]:
        if n == len(_LEVELS):
            return self.prefixed()
        left = self.level(n + 1)
        while self.peek()[0] == 2 and self.peek()[1] in _LEVELS[n]:
            left = self.applied(self.take()[1], left, self.level(n + 1))
        return left

    def applied(self, op: str, a, b) -> tuple[str, Column]:
        if op in "|&":
            x, y = truth(a), truth(b)
            return "bool", x | y if op == "|" else x & y
        if op in ("%", "%%"):
            if not isinstance(b[1], str):
                raise ValueError("a pattern has to be a constant")
            p = typed.java_pattern(b[1])
            return "bool", as_text(a).rlike(f"^(?:{p})$" if op == "%" else f"^(?:{p})(?: (?:{p}))*$")
        if op == "$":
            return "text", F.concat(as_text(a), as_text(b))
        if op in "+-*/":
            x, y = as_number(a), as_number(b)
            return "number", {"+": x + y, "-": x - y, "*": x * y}.get(op) if op != "/" else F.when(y == 0, F.lit(0.0)).otherwise(x / F.when(y != 0, y))
        numeric = op[0] == "#" or op in ("<", "<=", ">", ">=")
        x, y = (as_number(a), as_number(b)) if numeric else (as_text(a), as_text(b))
        op = op.lstrip("#$")
        return "bool", {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def prefixed(self):
        if self.peek() == (2, "!"):
            self.take()
            return "bool", ~truth(self.prefixed())
        if self.peek() == (2, "-"):
            self.take()
            return "number", -as_number(self.prefixed())
        return self.primary()

    def primary(self):
        kind, token = self.take()
        if kind == 0:
            return "constant", re.sub(r"\\(.)", r"\1", token) if "\\" in token and not re.search(r"\\[.\[\]*+(){}^$]", token) else token
        if kind == 1:
            return "number", F.lit(float(token))
        if (kind, token) == (2, "("):
            inner = self.level()
            self.expect(")")
            return inner
        if kind != 3:
            raise ValueError(f"{token} isn't expected here")
        if self.peek() == (2, "("):
            self.take()
            args = []
            while self.peek() != (2, ")"):
                args.append(self.level())
                if self.peek() == (2, ","):
                    self.take()
            self.take()
            return self.called(token, args)
        return "text", typed.text(F.col(f"`{token}`"))

    def expect(self, token):
        if self.take() != (2, token):
            raise ValueError(f"{token} expected")

    def called(self, name, args):
        if name == "size":
            return "number", F.octet_length(as_text(args[0])).cast("double")
        if name == "substr":
            start, rest = as_number(args[1]).cast("int"), as_text(args[0])
            return "text", F.substring(rest, start, as_number(args[2]).cast("int") if len(args) > 2 else F.lit(1 << 30))
        if name == "index":
            return "number", F.instr(as_text(args[0]), as_text(args[1])).cast("double")
        if name == "rindex":
            s, t = as_text(args[0]), as_text(args[1])
            back = F.instr(F.reverse(s), F.reverse(t))
            return "number", F.when(back == 0, 0.0).otherwise((F.length(s) - back - F.length(t) + 2).cast("double"))
        if name in ("date", "time"):
            return "text", F.date_format(F.current_timestamp(), "MM/dd/yy" if name == "date" else "HH:mm:ss")
        if name == "tblsearch":
            return "bool", F.col(f"_found_{args[0][1]}_{args[1][1]}")
        raise ValueError(f"{name} isn't supported")


def as_text(value) -> Column:
    kind, c = value
    if kind == "constant":
        return F.lit(c)
    if kind == "bool":
        return F.when(c, "1").otherwise("0")
    if kind == "number":
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c


def as_number(value) -> Column:
    kind, c = value
    if kind == "number":
        return c
    if kind == "bool":
        return F.when(c, 1.0).otherwise(0.0)
    return typed.atof(F.lit(c) if kind == "constant" else c)


def truth(value) -> Column:
    kind, c = value
    if kind == "bool":
        return F.coalesce(c, F.lit(False))
    if kind == "number":
        return c != 0
    c = F.lit(c) if kind == "constant" else c
    return (c != "") & (c != "0")


def condition(df: DataFrame, source: str) -> Column:
    """The condition ``source`` of the rule language as a Column."""
    parser = _Expression(df, source, {})
    value = parser.level()
    if parser.at != len(parser.tokens):
        raise ValueError(f"{parser.tokens[parser.at][1]} isn't expected here")
    return truth(value)


_SEARCH = re.compile(r'tblsearch\(\s*"(\w+)"\s*,\s*"(\w+)"\s*,\s*(\w+)\s*\)')


def validate(df: DataFrame, rules: list[Rule] | str, keys: list[str], tables: dict[str, DataFrame] | None = None, messages: DataFrame | None = None) -> DataFrame:
    """``<keys>, code`` for every rule that a record fails, and ``message`` from ``messages`` (``code, message``) if given.

    ``tblsearch("table", "attribute", ours)`` is true if the table has a row with that value; it is a join with the table's distinct values.
    """
    rules = script(rules) if isinstance(rules, str) else rules
    searches = set()

    def walk(rs):
        for r in rs:
            searches.update(_SEARCH.findall(r.condition))
            walk(r.nested)

    walk(rules)
    for table, attr, ours in sorted(searches):
        known = tables[table].select(typed.text(F.col(attr)).alias("_v")).distinct().withColumn(f"_found_{table}_{attr}", F.lit(True))
        df = df.join(known, typed.text(F.col(ours)) == F.col("_v"), "left").drop("_v")
    codes = []

    def collect(rs, parents):
        for r in rs:
            source = _SEARCH.sub(lambda m: f'tblsearch("{m.group(1)}","{m.group(2)}")', r.condition)
            met = condition(df, source)
            if r.code:
                codes.append(F.when(parents & ~met, F.lit(r.code)))
            collect(r.nested, parents & met)

    collect(rules, F.lit(True))
    out = df.select(*keys, F.explode(F.array_compact(F.array(*codes))).alias("code"))
    return out if messages is None else out.join(messages.select("code", "message"), "code", "left").select(*keys, "code", "message")


def structural_errors(records: DataFrame, limit: int | None = None) -> DataFrame:
    """One row with ``errors``: records that a permissive flat-file scan found malformed; more than ``limit`` are an error."""
    counted = records.agg(F.count(F.when(F.col("_malformed"), 1)).alias("errors"))
    if limit is not None:
        counted = counted.select(F.when(F.col("errors") > limit, F.raise_error(F.lit("too many malformed records")).cast("long")).otherwise(F.col("errors")).alias("errors"))
    return counted
