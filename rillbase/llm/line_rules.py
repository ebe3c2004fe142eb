"""Quality rules with cross-document line frequency (operator 10), in DataFrame operations only.

Lines are normalised and hashed; the distinct documents of each host that hold a line are
counted; lines above the host's limit are taken away, and a document that loses more than
``most_removed`` of its words is rejected, as is one that fails the per-document base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = r"[\x20\x09-\x0D]+"
_IN_WORD = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words in ``window``-word windows that occur twice or more in ``words``.

    Window hashes are compared by sorting them with their places, so the work is n log n in
    the words of a text, and only for texts whose windows are not all distinct.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda v, j: F.coalesce(F.get(s, j)["x"] == v["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda v, j: same(v, j - 1) | same(v, j + 1)), lambda v: v["i"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda v, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - v, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return _let(_let(placed, places), union)

    def count(w: Column) -> Column:
        # Each word is hashed once, and a window by the hashes of its words.
        grams = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))
        hashes = _let(F.transform(w, lambda x: F.xxhash64(x)), grams)
        return F.when(F.size(w) < window + 1, 0).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return _let(words, count)


def base_rules(docs: DataFrame) -> DataFrame:
    """The per-document figures and ``base_failed`` for ``doc_id, text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_IN_WORD))
    facts = docs.select(
        "doc_id",
        F.size(words_of(text)).cast("long").alias("n_words"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words_of(text)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return facts.withColumn("base_failed", failed)


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, host, line, other, n`` (two 64-bit hashes of the normalised line, words in it) for every line that has a word."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    lines = F.transform(F.split(text, "\n"), words_of)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.explode(lines).alias("words"))
    line = F.array_join("words", " ")
    return rows.select("doc_id", "host", F.xxhash64(line).alias("line"), F.xxhash64(F.lit(7), line).alias("other"), F.size("words").alias("n")).where("n > 0")


def frequent_lines(docs: DataFrame, share: float, least_docs: int) -> DataFrame:
    """``host, line, other``: lines held by more distinct documents of the host than ``least_docs`` and than ``share`` of them all."""
    counts = line_rows(docs).groupBy("host", "line", "other").agg(F.count_distinct("doc_id").alias("n_docs")).where(F.col("n_docs") > least_docs)
    hosts = docs.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count_distinct("doc_id").alias("of"))
    return counts.join(hosts, "host").where(F.col("n_docs") > share * F.col("of")).select("host", "line", "other")


def quality_rules(docs: DataFrame, share: float = 0.01, least_docs: int = 10, most_removed: float = 0.5) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words``.

    A hot host or a boilerplate line of a third of all rows spreads over tasks: documents are counted by
    (host, line, document) first, and the join with the frequent lines, whose side has each key once, may be
    split by the adaptive planner. A null text has no words (and fails the base rules); a null host is the host
    with the empty name; rows that share a ``doc_id`` are one document to the line counts and to the verdict,
    and each gives its row; null ids are not counted as documents and lose nothing. An empty table gives an empty one.
    Columns beyond ``doc_id, text, source`` are ignored.
    """
    docs = docs.select("doc_id", "text", "source")
    frequent = frequent_lines(docs, share, least_docs)
    removed = line_rows(docs).where("doc_id is not null").join(frequent, ["host", "line", "other"]).groupBy("doc_id").agg(F.sum("n").alias("removed_words"))
    facts = base_rules(docs).join(removed, "doc_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    depleted = F.col("removed_words") > most_removed * F.col("n_words")
    return facts.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
g AS (SELECT doc_id, gram FROM p GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM p JOIN g USING (doc_id, gram)) GROUP BY doc_id),
l AS (SELECT doc_id, host, line FROM d, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
norm AS (SELECT doc_id, host, array_to_string(ws, ' ') AS line, len(ws) AS n
         FROM (SELECT doc_id, host, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM l)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS of FROM d GROUP BY host),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS n FROM norm GROUP BY ALL) JOIN hosts USING (host) WHERE n > 10 AND n > 0.01 * of),
gone AS (SELECT doc_id, sum(n) AS n FROM norm JOIN freq USING (host, line) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT removed_words > 0.5 * n_words AS kept, removed_words
FROM f
"""
