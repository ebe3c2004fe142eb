"""Packing token streams by minimum bin slack (operator 2).

Every document is cut into whole windows and one remainder. Remainders are gathered, and
for each window the largest remainder is taken with the multiset of other lengths that
comes closest to the capacity: a subset-sum program over the histogram of lengths, whose
states are the bits of one integer, with the counts found by walking back. Only what no
window takes is cut: first to fill a window's slack, at the very end into powers of two.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillbase.llm.common import by_chars, texts_of
from rillbase.llm.units import default_path, encoder


def best_multiset(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` of a multiset drawn from ``counts`` (length: how many), and that multiset."""
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not bits >> room & 1:
            part = min(part, left)
            steps.append((length, part, bits))
            bits |= bits << (length * part) & mask
            left -= part
            part *= 2
        if bits >> room & 1:
            break
    total = at = bits.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] += part
    return total, dict(taken)


class Packer:
    """Packs pieces ``(doc, start, ids, doc_tokens)``; ids are numpy arrays of at most ``capacity``."""

    def __init__(self, capacity: int, first_id: int, pending: int = 8192):
        self.capacity, self.pending, self.next = capacity, pending, first_id
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._close([(doc, at, ids[at : at + self.capacity], total)])
        if whole < total:
            self._put((doc, whole, ids[whole:].copy(), total))  # what waits holds no whole batch
            if self.n >= self.pending:
                self._pack(self.pending // 4)

    def _put(self, piece: tuple) -> None:
        self.waiting[len(piece[2])].append(piece)
        self.n += 1

    def _take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.popleft()
        if not pieces:
            del self.waiting[length]
        self.n -= 1
        return piece

    def _pack(self, keep: int) -> None:
        """Fill windows until at most ``keep`` pieces wait."""
        while self.n > keep:
            largest = max(self.waiting)
            counts = {k: len(v) for k, v in self.waiting.items()}
            counts[largest] -= 1
            total, chosen = best_multiset(counts, self.capacity - largest)
            chosen[largest] = chosen.get(largest, 0) + 1
            again = min(len(self.waiting[k]) // n for k, n in chosen.items()) if total + largest == self.capacity else 1
            for _ in range(again):
                window = [self._take(k) for k, n in chosen.items() for _ in range(n)]
                slack = self.capacity - total - largest
                if slack and self.n:
                    doc, start, ids, whole = self._take(max(self.waiting))
                    window.append((doc, start, ids[:slack], whole))
                    self._put((doc, start + slack, ids[slack:], whole))
                    slack = 0
                if slack:
                    self._split(window)
                else:
                    self._close(window)

    def _split(self, pieces: list[tuple]) -> None:
        """The last, unfilled window as windows of powers of two, which need no padding."""
        used = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        for power in (1 << b for b in reversed(range(used.bit_length())) if used >> b & 1):
            window = []
            while power:
                doc, start, ids, whole = pieces.pop()
                window.append((doc, start, ids[:power], whole))
                if len(ids) > power:
                    pieces.append((doc, start + power, ids[power:], whole))
                power -= len(window[-1][2])
            self._close(window)

    def finish(self) -> None:
        self._pack(0)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each task packs the documents of its partition as they stream by, so nothing is exchanged and
    a task holds one batch and a bounded number of remainders. ``sequence_id`` has the partition
    in its upper bits; scan partitions are the same on a retry, and so are the pieces.
    A null or empty text is the end id alone. Repeated rows and rows with null ids are packed each; an empty table has no pieces. A very
    long text is whole windows, wherever it ends. Other columns are ignored, whatever their names.
    """
    path = path or default_path()
    docs = texts_of(docs)
    kind = docs.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches):
        encode = encoder(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)

        def rows():
            columns = list(zip(*packer.out)) or [()] * 7
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", *names])

        id_type = None
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for batch in by_chars(whole, "text"):
                ids, edges = encode.ended(batch.column("text"), end_id)
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), edges, edges[1:]):
                    packer.add(doc, ids[a:b])
                if packer.out:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return docs.mapInArrow(pack, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names))
