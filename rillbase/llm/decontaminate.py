"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 5).

An item of m characters that occurs with at most e edits keeps m - q + 1 - e * q of its q-grams,
and all of them on neighbouring diagonals. Shared q-grams are counted in overlapping bands of
diagonals; bands that meet the bound are aligned within the band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.llm.common import by_chars, fresh_worker, shared_place, texts_of
from rillbase.llm.shingles import mix

Q, RATE, BLOCK_BYTES = 12, 0.06, 4 << 20
_BITS = 22
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def folded(text: str) -> str:
    """Lower case, one space for a run of white space."""
    return " ".join(text.lower().split())


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all 12-grams of ``codes``."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * _ODD[3]
        h ^= h >> np.uint64(29)
        h4 = h[:-1] * _ODD[0] + h[1:]
        h4 = h4[:-2] * _ODD[1] + h4[2:]
        h8 = h4[:-4] * _ODD[2] + h4[4:]
        return mix(h8[:-4] * _ODD[0] + h4[8:])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Items:
    """Items of one block with the places of their q-grams, sorted by hash."""

    ids: list[int]
    texts: list[str]
    rate: float

    def __post_init__(self):
        sizes = np.array([len(t) for t in self.texts], np.int64)
        # Never more edits than leave a q-gram of the item whole.
        self.budget = np.minimum((sizes * self.rate).astype(np.int64), np.maximum(0, sizes // Q - 1))
        self.least = np.maximum(1, sizes - Q + 1 - self.budget * Q)
        self.sizes = sizes
        grams = [gram_hashes(_codes(t)) for t in self.texts]
        hashes = np.concatenate(grams or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.item, self.place, self.first, self.count = item[order], place[order], first, count
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self.hashes >> np.uint64(64 - _BITS)] = True
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < Q]


def aligned(item: str, text: str, begin: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """``edits, begin, end`` of the best occurrence of ``item`` in ``text`` that starts at ``begin`` to ``begin + width`` less one, within ``budget`` edits."""
    low = max(0, begin)
    exact = text.find(item, low, max(0, begin + width) + len(item))
    if exact >= 0:
        return 0, exact, exact + len(item)
    if not budget:
        return None
    span = width + 2 * budget
    start = begin - budget
    p = _codes(item)
    t = np.zeros(span + len(item), np.int64)
    a, b = max(0, start), min(len(text), start + len(t))
    if b <= a:
        return None
    t[a - start : b - start] = _codes(text[a:b])
    steps = np.arange(span)
    # Places outside the text cost more than any budget.
    row, came = np.where((steps + start >= 0) & (steps + start <= len(text)), 0, budget + 1), steps.copy()
    for i, c in enumerate(p):
        same = row + (t[i : i + span] != c)
        skip = np.append(row[1:] + 1, budget + 1)
        best = np.where(skip < same, skip, same)
        origin = np.where(skip < same, np.append(came[1:], 0), came)
        # Insertions: the best value to the left plus the distance, with the start it came from.
        packed = ((best - steps) << 20) | origin
        run = np.minimum.accumulate(packed)
        row, came = (run >> 20) + steps, run & ((1 << 20) - 1)
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), max(0, start + int(came[k])), min(len(text), start + len(item) + k)


def occurrences(texts: list[str], items: Items):
    """``(text number, item number, begin, end, edits)``, the best in each run of overlapping bands; places are in the folded texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    h = gram_hashes(_codes("￿".join(texts)))
    at = np.flatnonzero(items.map[h >> np.uint64(64 - _BITS)])
    slot = np.minimum(np.searchsorted(items.hashes, h[at]), max(0, len(items.hashes) - 1))
    good = items.hashes[slot] == h[at] if len(items.hashes) else np.zeros(0, bool)
    at, slot = at[good], slot[good]
    # Hits are taken a few texts at a time, which bounds what repeated q-grams expand to.
    owner = np.searchsorted(begins, at, side="right") - 1
    weight = np.cumsum(items.count[slot]) // 500_000 if len(at) else at
    cuts = [0, *(i for i in (np.flatnonzero(np.diff(weight)) + 1).tolist() if owner[i] != owner[i - 1]), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        yield from _bands(texts, items, begins, at[a:b], slot[a:b])
    for i in items.short:
        for n, text in enumerate(texts):
            if (x := text.find(items.texts[i])) >= 0:
                yield n, i, x, x + len(items.texts[i]), 0


def _bands(texts, items, begins, at, slot):
    count = items.count[slot]
    which = np.repeat(np.arange(len(at)), count)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    entry = items.first[slot][which] + inner
    item, y, x = items.item[entry], items.place[entry], at[which]
    text = np.searchsorted(begins, x, side="right") - 1
    diagonal = x - begins[text] - y + items.sizes[item]
    width = items.budget[item] + 1
    band = diagonal // width
    # Each diagonal counts in its band and in the one that overlaps it from below.
    key = np.stack([np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([band, band - 1])], 1)
    order = np.lexsort(key.T[::-1])
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(key, axis=0) != 0).any(1)))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    best = None
    for k in np.flatnonzero(counts >= items.least[key[new, 1]]).tolist():
        n, i, b = (int(v) for v in key[new[k]])
        w = int(items.budget[i]) + 1
        hit = aligned(items.texts[i], texts[n], b * w - int(items.sizes[i]), 2 * w, w - 1)
        if hit is None:
            continue
        edits, begin, end = hit
        if best and best[:2] == (n, i) and begin < best[3]:
            if edits < best[4]:
                best = (n, i, begin, end, edits)
            continue
        if best:
            yield best
        best = (n, i, begin, end, edits)
    if best:
        yield best


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[str, int]:
    """Where the items were written in blocks, and how many these are."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    place, blocks = shared_place(benchmark.sparkSession, "items"), max(1, -(-size // block_bytes))
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).write.partitionBy("block").parquet(place)
    return place, blocks


def _items(place: str, b: int, rate: float) -> Items:
    """The items of one block, which a task reads for itself: no driver holds them."""
    fs, base = pafs.FileSystem.from_uri(place) if "://" in place else (pafs.LocalFileSystem(), place)
    rows = []
    if fs.get_file_info(f"{base}/block={b}").type == pafs.FileType.Directory:
        table = pads.dataset(f"{base}/block={b}", filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
        rows = sorted(zip(table.column("item_id").to_pylist(), map(folded, table.column("text").to_pylist())), key=lambda r: (r[0] is not None, r[0], r[1]))
    return Items([i for i, _ in rows], [t for _, t in rows], rate)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, begin, end, edits``: every benchmark item found in a document within its edit budget.

    Texts and items are compared folded (lower case, single spaces), and ``begin`` and ``end`` are characters of the folded
    text. An item's budget is ``rate`` of its length, less where no q-gram would stay whole; items under ``Q`` characters
    match as they are, those without text never. Items are taken in blocks of about ``block_bytes`` characters, which bounds what a task
    holds; each block is one scan of the documents, without an exchange. Null texts match nothing; rows that share
    a ``doc_id`` give theirs each, and items that share an ``item_id`` theirs. Empty tables give an empty result.
    """
    docs = texts_of(docs)
    place, blocks = _blocks(benchmark, block_bytes)
    schema = "doc_id long, item_id long, begin long, end long, edits long"
    out = None
    for b in range(blocks):

        def find(batches, b=b):
            fresh_worker()
            block = _items(place, b, rate)
            for whole in batches:
                for batch in by_chars(whole, "text", 1_000_000):
                    ids, texts = batch.column("doc_id").to_pylist(), [folded(t) for t in batch.column("text").to_pylist()]
                    hits = sorted({(n, i, b, e, k) for n, i, b, e, k in occurrences(texts, block)})
                    columns = list(zip(*((ids[n], block.ids[i], b, e, k) for n, i, b, e, k in hits))) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "begin", "end", "edits"])

        part = docs.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, as they are. Each row is judged by its own text, whether its ``doc_id`` is null or
    repeated; null texts stay. A scan for each block of items, without an exchange."""
    place, blocks = _blocks(benchmark, block_bytes)
    for b in range(blocks):

        def keep(batches, b=b):
            fresh_worker()
            block = _items(place, b, rate)
            for whole in batches:
                for batch in by_chars(whole, "text", 1_000_000):
                    hits = {n for n, *_ in occurrences([folded(t or "") for t in batch.column("text").to_pylist()], block)}
                    yield batch.filter(pa.array([n not in hits for n in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
