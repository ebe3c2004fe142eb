"""Exact tokenization through caches of units.

A byte-level BPE of this family splits a text into pre-tokens by a pattern in which a single
space between two non-space characters always begins a pre-token, a single line end between
two such characters is one by itself, and a run of letters always ends before a mark other
than an apostrophe. So a text may be cut at these places without changing a token: the pieces
("units", each a whole number of pre-tokens) are encoded once in a worker. Units are found,
hashed, looked up and compared with their cached bytes in arrays, a block of text at a time.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from rillbase.llm.common import kept_in_worker
from rillbase.llm.shingles import mix

#: Bytes of a block, and of the longest unit that is cached. They bound memory, never results.
_BLOCK, _LONGEST = 1 << 20, 64
_TABLE_BITS = 22
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xE7037ED1A0B428DB
_GAP = np.zeros(256, bool)
_GAP[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Last bytes of the three-byte white space that begins with E2 80.
_THIN = [*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF]
_TOKENIZERS: dict[str, object] = kept_in_worker({})


def tokenizer(path: str):
    """The tokenizer of ``path`` (tokenizers for ``.json``, sentencepiece for ``.model``), loaded once in a process and never threaded."""
    if path not in _TOKENIZERS:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            _TOKENIZERS[path] = SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spec(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as file:
        return json.load(file)


def spaced_units(path: str) -> bool:
    """Whether texts may be cut into units for this tokenizer: a bare byte-level pre-tokenizer and no normalizer."""
    if path.endswith(".model"):
        return False
    spec = _spec(path)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and " " not in t["content"] and "\n" not in t["content"] for t in spec.get("added_tokens", []))
    return plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


@cache
def unit_marks(path: str) -> np.ndarray:
    """The ASCII marks before which a run of letters may be cut: none that is part of an added token, and no apostrophe."""
    marks = np.zeros(256, bool)
    marks[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True
    marks[[ord("'"), *(b for t in _spec(path).get("added_tokens", []) for b in t["content"].encode() if b < 0x80)]] = False
    return marks


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    tables = []
    with np.errstate(over="ignore"):
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_BLOCK + 1, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
    return tables[0], tables[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the edges of its texts."""
    wide = pa.types.is_large_string(column.type)
    if not pa.types.is_string(column.type) and not wide:
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def gaps(buf: np.ndarray) -> np.ndarray:
    """Which bytes are of white space, of one to three bytes. It includes what only some pattern libraries take for it, which does no harm here."""
    gap = _GAP[buf]
    at = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    if len(at):
        one = buf[at]
        two, three = (buf[np.minimum(at + k, len(buf) - 1)] for k in (1, 2))
        short = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        long = (one == 0xE1) & ((two == 0x9A) & (three == 0x80) | (two == 0xA0) & (three == 0x8E))
        long |= (one == 0xE2) & ((two == 0x80) & np.isin(three, _THIN) | (two == 0x81) & (three == 0x9F))
        long |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
        for k, found in enumerate((short | long, short | long, long)):
            gap[at[found] + k] = True
    return gap


def unit_edges(buf: np.ndarray, edges: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the units of the texts in ``buf``, and for each unit whether it may stand after another in one string that is encoded at once."""
    gap = gaps(buf)
    spaced = (buf == 0x20) | (buf == 0x0A)
    spaced[1:] &= ~gap[:-1]
    spaced[:-1] &= ~gap[1:]
    # What stands on either side of a text's first or last byte is of another text.
    spaced[edges[edges < len(buf)]] = False
    spaced[edges[1:] - 1] = False
    cut = spaced.copy()
    cut[1:] |= _LETTER[buf[:-1]] & marks[buf[1:]]
    cut[edges[edges < len(buf)]] = True
    starts = np.flatnonzero(cut)
    found = np.append(starts, len(buf))
    return found, spaced[starts] & ~gap[found[1:] - 1]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of ranges of these sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class UnitEncoder:
    """Token ids or token counts of texts, with a bounded cache of units.

    ``frequent``: units known beforehand and their token counts (counts only), which always stay. ``most``: entries kept of all
    others; when there are more, only those that were used again stay.
    """

    def __init__(self, path: str, counts: bool = False, frequent: tuple[list[bytes], list[int]] | None = None, most: int = 500_000):
        self.encoder, self.counts, self.most = tokenizer(path), counts, most
        self.cut = spaced_units(path)
        size = self.encoder.vocab_size() if path.endswith(".model") else self.encoder.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if self.cut:
            self.marks = unit_marks(path)
            added = {t["id"]: len(t["content"].encode()) for t in _spec(path).get("added_tokens", [])}
            self.widths = np.zeros(max(self.encoder.get_vocab().values()) + 1, np.int64)
            for token, i in self.encoder.get_vocab().items():
                self.widths[i] = added.get(i, len(token))
        self.frequent = frequent or ([], [])
        self._clear()
        known, lengths = self.frequent
        for a in range(0, len(known), 10_000):
            part = known[a : a + 10_000]
            ends = np.cumsum([len(u) for u in part])
            starts, raw = ends - np.diff(ends, prepend=0), np.frombuffer(b"".join(part), np.uint8)
            self._store(raw, starts, ends, self._hashes(raw, starts, ends), np.array(lengths[a : a + 10_000], np.int64), None)
        self.pinned = self.n

    def _clear(self) -> None:
        self.n = 0
        self.table = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.hash = np.zeros(1024, np.uint64)
        self.at, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.first, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.again = np.zeros(1024, bool)
        self.bytes, self.n_bytes = np.zeros(1 << 14, np.uint8), 0
        self.pool, self.n_pool = np.zeros(1 << 14, self.dtype), 0

    @staticmethod
    def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, back = _powers()
        with np.errstate(over="ignore"):
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
            return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def _store(self, buf, starts, ends, hashes, lengths, ids) -> np.ndarray:
        """Add units (all different) to the cache; their slots."""
        n, sizes = len(starts), ends - starts

        def room(name, used, more):
            old = getattr(self, name)
            if used + more > len(old):
                new = np.zeros(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

        for name in ("hash", "at", "size", "first", "length", "again"):
            room(name, self.n, n)
        slots = np.arange(self.n, self.n + n)
        room("bytes", self.n_bytes, int(sizes.sum()))
        taken = _ranges(starts, sizes)
        self.bytes[self.n_bytes : self.n_bytes + len(taken)] = buf[taken]
        self.at[slots], self.size[slots] = self.n_bytes + np.cumsum(sizes) - sizes, sizes
        self.n_bytes += len(taken)
        self.hash[slots], self.length[slots], self.again[slots] = hashes, lengths, False
        if ids is not None:
            room("pool", self.n_pool, len(ids))
            self.pool[self.n_pool : self.n_pool + len(ids)] = ids
            self.first[slots] = self.n_pool + np.cumsum(lengths) - lengths
            self.n_pool += len(ids)
        self.n += n
        places = (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        busy = self.table[places] >= 0
        places[busy] ^= 1
        self.table[places] = slots
        return slots

    def _trim(self) -> None:
        """Keep the frequent units and those that were used again, unless these are too many as well."""
        kept = np.flatnonzero(self.again[: self.n] | (np.arange(self.n) < self.pinned))
        if len(kept) > self.pinned + self.most // 2:
            kept = np.arange(self.pinned)
        old = (self.bytes, self.at[kept], self.at[kept] + self.size[kept], self.hash[kept], self.length[kept])
        first, pool = self.first[kept], self.pool
        self._clear()
        ids = None if self.counts else pool[_ranges(first, old[4])]
        self._store(*old, ids)

    def _whole(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and (unless only counted) the ids of strings that are encoded one by one."""
        if not strings:
            return np.zeros(0, np.int64), np.zeros(0, self.dtype)
        if hasattr(self.encoder, "encode_batch_fast"):
            found = self.encoder.encode_batch_fast(strings, add_special_tokens=False)
            lengths = np.array([len(x) for x in found], np.int64)
            ids = [] if self.counts else [np.array(x.ids, self.dtype) for x in found if len(x)]
        else:
            found = self.encoder.encode(strings, num_threads=1)
            lengths = np.array([len(x) for x in found], np.int64)
            ids = [np.array(x, self.dtype) for x in found if len(x)]
        return lengths, np.concatenate(ids) if ids else np.zeros(0, self.dtype)

    def _encoded(self, raws: list[bytes], joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and ids of units. Those that may stand after each other are encoded in strings of many, and told apart by the bytes of their tokens."""
        lengths, first, parts, held = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64), [], 0
        sizes = np.array([len(r) for r in raws], np.int64)
        single = np.flatnonzero(~joins).tolist()
        many = np.flatnonzero(joins)
        for block in (many[i : i + 512] for i in range(0, len(many), 512)):
            ids = np.array(self.encoder.encode(b"".join([raws[i] for i in block.tolist()]).decode(), add_special_tokens=False).ids, np.int64)
            ends = np.cumsum(sizes[block])
            told = np.cumsum(self.widths[ids])
            cuts = np.searchsorted(told, ends) + 1
            if len(told) and cuts[-1] == len(told) and np.array_equal(told[cuts - 1], ends):
                lengths[block] = np.diff(cuts, prepend=0)
                first[block] = held + cuts - lengths[block]
                parts.append(ids.astype(self.dtype))
                held += len(ids)
            else:
                single += block.tolist()
        more, ids = self._whole([raws[i].decode() for i in single])
        lengths[single] = more
        first[single] = held + np.cumsum(more) - more
        return lengths, ids[:0] if self.counts else np.concatenate([*parts, ids])[_ranges(first, lengths)]

    def _found(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slots of units, -1 where they are not cached. What has the hash of a cached unit is compared with it byte by byte."""
        places = (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        slots = self.table[places].astype(np.int64)
        slots[self.hash[slots] != hashes] = -1
        open_ = np.flatnonzero(slots < 0)
        other = self.table[places[open_] ^ 1].astype(np.int64)
        slots[open_] = np.where(self.hash[other] == hashes[open_], other, -1)
        hit = np.flatnonzero(slots >= 0)
        if len(hit):
            k, slot = sizes[hit], slots[hit]
            before = np.cumsum(k) - k
            own = _ranges(starts[hit], k)
            told = own + np.repeat(self.at[slot] - starts[hit], k)
            differs = buf[own] != self.bytes[np.minimum(told, len(self.bytes) - 1)]
            odd = (self.size[slot] != k) | (np.add.reduceat(differs, before) > 0)
            slots[hit[odd]] = -1
            self.again[slots[hit[~odd]]] = True
        return slots

    def _block(self, buf: np.ndarray, edges: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and ids of the units with these edges, in order."""
        starts, ends = edges[:-1], edges[1:]
        sizes = ends - starts
        short = sizes <= _LONGEST
        hashes, slots = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
        if short.any():
            hashes[short] = self._hashes(buf, starts[short], ends[short])
            slots[short] = self._found(buf, starts[short], sizes[short], hashes[short])
        hit, missing = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        n, first = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        n[hit], first[hit] = self.length[slots[hit]], self.first[slots[hit]]
        if not len(missing):
            return n, self.pool[:0] if self.counts else self.pool[_ranges(first, n)]
        raw, kinds = buf.tobytes(), {}
        which = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(starts[missing].tolist(), ends[missing].tolist())])
        # A unit may stand in a row of others if it may wherever it was found here.
        may = np.ones(len(kinds), bool)
        may[which[~joins[missing]]] = False
        lengths, ids = self._encoded(list(kinds), may)
        begins = np.cumsum(lengths) - lengths
        n[missing] = lengths[which]
        out = self.pool[:0]
        if not self.counts:
            out = np.empty(int(n.sum()), self.dtype)
            at = np.cumsum(n) - n
            out[_ranges(at[hit], n[hit])] = self.pool[_ranges(first[hit], n[hit])]
            out[_ranges(at[missing], n[missing])] = ids[_ranges(begins[which], n[missing])]
        one = np.unique(which, return_index=True)[1]
        kept = np.flatnonzero(short[missing[one]])
        if len(kept):
            if self.n - self.pinned + len(kept) > self.most:
                self._trim()
            at = missing[one[kept]]
            self._store(buf, starts[at], ends[at], hashes[at], lengths[kept], None if self.counts else ids[_ranges(begins[kept], lengths[kept])])
        return n, out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token counts of the texts of ``column`` (strings without nulls) and, unless only counted, their ids, one text after another."""
        if not self.cut:
            return self._whole(column.to_pylist())
        buf, texts = text_buffer(column)
        if not len(buf):
            return np.zeros(len(column), np.int64), np.zeros(0, self.dtype)
        edges, joins = unit_edges(buf, texts, self.marks)
        lengths, ids, a = [], [], 0
        while a < len(joins):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + _BLOCK, side="right")) - 1)
            n, found = self._block(buf[edges[a] : edges[b]], edges[a : b + 1] - edges[a], joins[a:b])
            lengths.append(n), ids.append(found)
            a = b
        total = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        return np.diff(total[np.searchsorted(edges, texts)]), np.concatenate(ids)


    def ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, list[int]]:
        """The ids of the texts of ``column``, ``end_id`` after each, and the edges of the texts among them."""
        lengths, ids = self(column)
        ends = np.cumsum(lengths)
        return np.insert(ids, ends, self.dtype.type(end_id)), [0, *(ends + np.arange(1, len(ends) + 1)).tolist()]


_ENCODERS: dict[tuple, UnitEncoder] = kept_in_worker({})


def encoder(path: str, counts: bool = False, frequent: tuple[list[bytes], list[int]] | None = None, key: object = None) -> UnitEncoder:
    """The worker's encoder for these arguments, kept from task to task. ``key`` tells tables of frequent units apart."""
    at = (path, counts, key)
    if at not in _ENCODERS:
        if len(_ENCODERS) >= 2:
            _ENCODERS.clear()
        _ENCODERS[at] = UnitEncoder(path, counts, frequent)
    return _ENCODERS[at]
