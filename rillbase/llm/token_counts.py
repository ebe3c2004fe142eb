"""Token counts by a map-side two-tier lookup (operator 8).

Tier one is a broadcast table of the lengths, in tokens, of frequent pre-token units;
tier two is a cache in each Python worker for what the table misses. A text is never
sent anywhere: the plan is a scan and one Python node, with no exchange of units.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.llm.common import by_chars, texts_of
from rillbase.llm.units import default_path, encoder, spaced_units, text_buffer, tokenizer, unit_edges, unit_marks

#: Rows that the table of frequent units is drawn from, and its entries at most. They decide which
#: tier finds a unit, so only speed; counts are exact whatever the table holds.
TABLE_ROWS, TABLE_UNITS = 4000, 1 << 16


def frequent_lengths(docs: DataFrame, path: str, rows: int = TABLE_ROWS, most: int = TABLE_UNITS) -> tuple[list[bytes], list[int]]:
    """The most frequent units of about ``rows`` rows and their lengths: at most ``most`` of at most 64 bytes, whatever the input.

    Each task counts the units of its own rows of the sample; only the counts of units that it met twice are united.
    """
    if not spaced_units(path):
        return [], []
    n = docs.count()
    if not n:
        return [], []

    def count(batches):
        seen: Counter = Counter()
        for whole in batches:
            for batch in by_chars(whole, "text"):
                buf, edges = text_buffer(batch.column("text"))
                cuts, raw = unit_edges(buf, edges, unit_marks(path))[0].tolist(), buf.tobytes()
                seen.update(raw[a:b] for a, b in zip(cuts, cuts[1:]) if b - a <= 64)
        often = [(u, k) for u, k in seen.most_common(most) if k > 1]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in often], pa.binary()), pa.array([k for _, k in often], pa.int64())], ["unit", "n"])

    found = docs.select("text").sample(min(1.0, rows / n), seed=7).mapInArrow(count, "unit binary, n long")
    best = found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most)
    known = [bytes(r.unit) for r in best.select("unit").collect()]
    return known, [len(x) for x in tokenizer(path).encode_batch_fast([u.decode() for u in known], add_special_tokens=False)]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, table_rows: int = TABLE_ROWS, table_units: int = TABLE_UNITS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id``, ``text``).

    ``path`` is a file of the tokenizers library (``.json``) or of sentencepiece (``.model``); texts are only cut into units where that
    changes no token, and are encoded whole elsewhere. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids each give
    their row. An empty table gives an empty table. A very long text is counted in blocks. Other columns are ignored, whatever their names.
    """
    path = path or default_path()
    docs = texts_of(docs)
    table = frequent_lengths(docs, path, table_rows, table_units)
    told, key = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def count(batches):
        encode = encoder(path, counts=True, frequent=told.value, key=key)
        for whole in batches:
            for batch in by_chars(whole, "text"):
                tokens, _ = encode(batch.column("text"))
                sizes = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
