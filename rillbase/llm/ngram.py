"""Unbounded n-gram scoring over sharded suffix arrays (operator 6).

The training tokens lie in shards. How often grams of 2, 3 and ``LEAD`` tokens occur is united from all shards by key. What
of the texts longer matches can come from (runs of places whose ``LEAD`` tokens a held-out text has, or that recur in training from a place on that
has what a training text begins with) goes into suffix arrays, equal runs once with how many they are, and the like runs of held-out texts are searched for
there: how far the text matches, and how often what it needs of those matches occurs; lengths are united by their maximum over the arrays, counts are summed. With c the count of the
context, k of its continuation by the token, and p the smoothed unigram probability,

    P(token | context) = (k + a p) / (c + a),   a = ``weight`` * c ** ``growth``,

which sums to 1 over the vocabulary and one unknown token. A training text's longest context is
all that comes before a token, since the text itself is in training; so only its start is searched for.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.llm.common import by_chars, fresh_worker, kept_in_worker, shared_place, texts_of, written
from rillbase.llm.shingles import joined, mix, word_hashes, words

END = np.uint64(0x9E3779B97F4A7C15)
#: Tokens of the longest grams that are counted by key; and bits of the keys by which an array is asked whether it has them.
LEAD, _BITS = 4, 25
#: Bytes of text in a shard, about. A task takes some 40 bytes of memory for each of its tokens.
SHARD_BYTES = 28 << 20
#: Tokens that are hashed, scored or searched from at a time: what is made of all tokens of a shard at once decides how much memory a task takes.
BLOCK = 1 << 18
#: Tokens of queries that are searched for together, about: each step of a search takes its time however few they are.
TOGETHER = 1 << 21
WEIGHT, GROWTH, ADD = 3.0, 0.9, 0.1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, which compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return _numbers(raw).astype(np.int64)


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and the number of tokens of each."""
    buf, begins = joined(texts)
    buf = _LOWER[buf]
    starts, ends, firsts = words(buf, begins)
    hashes = word_hashes(buf, starts, ends)
    hashes[hashes == END] += np.uint64(1)
    return np.insert(hashes, firsts[1:], END), np.diff(firsts) + 1


_SHARD = "shard long, name string"


def _filesystem(place: str):
    return pafs.FileSystem.from_uri(place) if "://" in place else (pafs.LocalFileSystem(), place)


def _save(place: str, columns: dict[str, pa.Array]) -> str:
    """Write arrays of any lengths to a file of a new name at ``place``. Token rows go from task to task in such files: they are too large to pass
    through the rows of a table, which only name them. Files of lost attempts are named by no row."""
    fs, base = _filesystem(place)
    fs.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.arrow"
    lists = [pa.array([v], pa.list_(v.type)) if not pa.types.is_binary(v.type) else v for v in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    with fs.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return name


def _load(place: str, name: str) -> dict:
    """The arrays of such a file: numpy arrays, and bytes where binary."""
    fs, base = _filesystem(place)
    with fs.open_input_file(f"{base}/{name}") as file, pa.ipc.open_stream(file) as reader:
        batch = reader.read_next_batch()
    out = {}
    for k in batch.schema.names:
        column = batch.column(k)
        if pa.types.is_binary(column.type):
            out[k] = column[0].as_py()
        else:
            out[k] = column.flatten() if k == "doc_ids" else column.flatten().to_numpy(zero_copy_only=False)
    return out


def shards_of(docs: DataFrame, place: str, most: int = SHARD_BYTES) -> DataFrame:
    """The texts as token shards of about ``most`` bytes of text, in files at ``place``: a sorted table of distinct hashes and, for each token, its place in it."""

    def build(batches):
        fresh_worker(True)
        held, size, number = [], 0, TaskContext.get().partitionId() << 20

        def flush():
            hashes = np.unique(np.concatenate([h[2] for h in held]))
            tokens = np.concatenate([np.searchsorted(hashes, h[2]).astype(np.uint32)[h[3]] for h in held])
            out_ = np.array([o for h in held for o in h[4]], bool)
            name = _save(
                place,
                {
                    "doc_ids": pa.array([i for h in held for i in h[0]], pa.int64()), "held": pa.array(out_),
                    "sizes": pa.array(np.concatenate([h[1] for h in held]).astype(np.int64)), "hashes": pa.array([hashes.tobytes()], pa.binary()), "tokens": pa.array([planes(tokens)], pa.binary()),
                },
            )
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name])], ["shard", "name"])

        for whole in batches:
            for batch in by_chars(whole, "text", 2_000_000):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                hashes, sizes = token_hashes(texts)
                out = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids]
                kinds, local = np.unique(hashes, return_inverse=True)
                held.append((ids, sizes, kinds, local.astype(np.int32), out))
                size += int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
                if size >= most:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return docs.mapInArrow(build, _SHARD)


def unigrams(shards: DataFrame, place: str, buckets: int) -> DataFrame:
    """``shard, bucket, counts`` (training counts of the shard's hashes in the bucket, in their order) and, once for each bucket, ``types, total``."""

    def ask(batches):
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("name").to_pylist()):
                row = _load(place, name)
                hashes, counts = np.frombuffer(row["hashes"], np.uint64), _train_counts(row)
                bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                blobs = [(hashes[order[a:b]].tobytes(), planes(counts[order[a:b]])) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * buckets), pa.array(np.arange(buckets)), pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.binary())], ["shard", "bucket", "hashes", "counts"])

    def answer(batches):
        held, now = [], None

        def close():
            hashes = np.concatenate([np.frombuffer(h[1], np.uint64) for h in held])
            counts = np.concatenate([unplanes(h[2]) for h in held])
            kinds, at = np.unique(hashes, return_inverse=True)
            total = np.bincount(at, counts, len(kinds)).astype(np.int64)
            ends = np.cumsum([len(h[1]) // 8 for h in held])
            parts = np.split(total[at], ends[:-1])
            facts = [(int((total > 0).sum()), int(total.sum()))] + [(0, 0)] * (len(held) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held]), pa.array([now] * len(held)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary()), pa.array([f[0] for f in facts]), pa.array([f[1] for f in facts])],
                ["shard", "bucket", "counts", "types", "total"],
            )

        for batch in batches:
            for shard, bucket, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "bucket", "hashes", "counts"))):
                if bucket != now and held:
                    yield from close()
                    held = []
                now = bucket
                held.append((shard, hashes, counts))
        if held:
            yield from close()

    asked = shards.select("shard", "name").mapInArrow(ask, "shard long, bucket long, hashes binary, counts binary")
    return asked.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(answer, "shard long, bucket long, counts binary, types long, total long")


def _train_counts(row: dict) -> np.ndarray:
    train, tokens = np.repeat(~row["held"], row["sizes"]), _numbers(row["tokens"])
    return np.bincount(tokens[train], minlength=len(row["hashes"]) // 8)


class SuffixArray:
    """The suffixes of a shard's training texts in order. A suffix ends with its text, whose end is a token. ``weights``: how often each text occurs."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, weights: np.ndarray | None = None):
        # 32-bit numbers wherever they do: a shard has under 2**31 tokens, and memory is what bounds it.
        small = np.int32
        self.tokens, self.hashes, self.n = tokens.astype(small, copy=False), hashes, len(tokens)
        del tokens
        ends = np.cumsum(sizes).astype(small)
        self.stop = np.repeat(ends, sizes)
        n = self.n
        # Rank by the first token, then by twice as many tokens in each round, only where ranks are still shared.
        order = np.argsort(self.tokens)
        rank = self._ranks(self.tokens[order], order)
        del order
        width, open_ = 1, np.arange(n, dtype=small)
        while len(open_) and width <= n:
            after = open_ + small(width)
            second = np.where(after < self.stop[open_], rank[np.minimum(after, n - 1)] + small(1), small(0))
            del after
            key = rank[open_].astype(np.int64)
            key *= n + 1
            key += second
            del second
            by = np.argsort(key)
            key, open_ = key[by], open_[by]
            del by
            new = np.concatenate(([True], key[1:] != key[:-1]))
            del key
            # An open group keeps its places; ranks are the place of a group's first member.
            first = rank[open_]
            index = np.arange(len(open_), dtype=small)
            base = np.maximum.accumulate(np.where(np.concatenate(([True], first[1:] != first[:-1])), index, small(0)))
            rank[open_] = first + np.maximum.accumulate(np.where(new, index, small(0))) - base
            del first, base, index
            sizes_ = np.diff(np.append(np.flatnonzero(new), len(open_)))
            shared = np.repeat(sizes_ > 1, sizes_)
            # Suffixes that have ended are equal for good; one that just ends is yet to come before those that go on.
            open_ = np.sort(open_[shared & (open_ + 2 * width <= self.stop[open_])])
            width *= 2
        self.order = np.argsort(rank).astype(small)
        del rank
        o = self.order
        self.rank = self.triples = None
        second = np.where(o + small(1) < self.stop[o], self.tokens[np.minimum(o + small(1), n - 1)] + small(1), small(0))
        #: The first two tokens of each suffix, in order: where a search begins.
        self.pairs = self.tokens[o].astype(np.int64)
        self.pairs <<= 32
        self.pairs += second
        del second
        self.sums = _sums(mix(hashes), self.tokens)
        #: How often what comes before each place of the order occurs.
        self.before = np.arange(n + 1)
        if weights is not None:
            np.cumsum(np.repeat(weights, sizes)[o], out=self.before[1:])

    @staticmethod
    def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        if not len(values):
            return rank
        new = np.concatenate(([True], values[1:] != values[:-1]))
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order), dtype=np.int32), np.int32(0)))
        return rank

    def token_at(self, place: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The token ``depth`` after the suffix at ``place`` of the order, one more than its number; 0 after the text's end."""
        at = self.order[place] + depth
        return np.where(at < self.stop[self.order[place]], self.tokens[np.minimum(at, self.n - 1)] + 1, 0)

    def next_part(self, low: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts with ``wanted`` (+1) as third token of the intervals that begin at ``low`` and agree in two, by keys of a dense rank of the first two and the third."""
        if self.rank is None:
            self.rank = np.cumsum(np.concatenate(([False], self.pairs[1:] != self.pairs[:-1])), dtype=np.int32)
            self.triples = self.rank.astype(np.int64)
            self.triples <<= 32
            for a in range(0, self.n, BLOCK):
                self.triples[a : a + BLOCK] += self.token_at(np.arange(a, min(self.n, a + BLOCK)), 2)
        key = (self.rank[low].astype(np.int64) << 32) + wanted
        return np.searchsorted(self.triples, key, "left"), np.searchsorted(self.triples, key, "right")

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the intervals whose suffixes have ``wanted`` (+1) at ``depth``, by binary search."""
        out = []
        for above in (0, 1):
            a, b = low.copy(), high.copy()
            while True:
                live = np.flatnonzero(a < b)
                if not len(live):
                    break
                mid = (a[live] + b[live]) >> 1
                less = self.token_at(mid, depth[live]) < wanted[live] + above
                a[live[less]] = mid[less] + 1
                b[live[~less]] = mid[~less]
            out.append(a)
        return out[0], out[1]


_cache: list[np.ndarray] = kept_in_worker([])
_BASE = np.uint64(0xE7037ED1A0B428DB)


def _powers(n: int) -> np.ndarray:
    if not _cache or len(_cache[0]) < n:
        with np.errstate(over="ignore"):
            table = np.full(max(n, 1 << 20), _BASE, np.uint64)
            table[0] = 1
            _cache[:] = [np.cumprod(table, dtype=np.uint64)]
    return _cache[0][:n]


def _sums(mixed: np.ndarray, tokens: np.ndarray | None = None) -> np.ndarray:
    """Sums, from 0 on, of what the tokens have in ``mixed`` (or of ``mixed``) times the powers of the base."""
    n = len(mixed if tokens is None else tokens)
    powers, out = _powers(n), np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            np.multiply(mixed[a:b] if tokens is None else mixed[tokens[a:b]], powers[a:b], out=out[a + 1 : b + 1])
        return np.cumsum(out, out=out)


def common(sa: SuffixArray, place: np.ndarray, ids: np.ndarray, sums: np.ndarray, at: np.ndarray, stop: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many tokens from ``place`` in the shard and from ``at`` in the query agree, at least ``known``; by galloping over block hashes."""
    most = np.minimum(sa.stop[place] - place, stop - at)
    low, high = known.copy(), most.copy()
    powers = _powers(max(sa.n, len(sums)) + 1)
    step = np.full(len(place), 8, np.int64)

    def same(i, length):
        with np.errstate(over="ignore"):
            p, q = place[i], at[i]
            x = (sa.sums[p + length] - sa.sums[p]) * powers[np.maximum(q - p, 0)]
            y = (sums[q + length] - sums[q]) * powers[np.maximum(p - q, 0)]
            return x == y

    # Most agree in little more: the next tokens are compared as they are, one by one.
    live = np.flatnonzero(low < high)
    for _ in range(4):
        ok = sa.tokens[place[live] + low[live]] == ids[at[live] + low[live]]
        high[live[~ok]] = low[live[~ok]]
        live = live[ok]
        low[live] += 1
        live = live[low[live] < high[live]]
    while len(live):
        tried = np.minimum(low[live] + step[live], high[live])
        ok = same(live, tried)
        low[live[ok]] = tried[ok]
        step[live[ok]] *= 2
        high[live[~ok]] = tried[~ok] - 1
        step[live[~ok]] = np.maximum(1, (high[live[~ok]] - low[live[~ok]] + 1) >> 1)
        live = live[low[live] < high[live]]
    return low


def search(sa: SuffixArray, ids: np.ndarray, sums: np.ndarray, starts: np.ndarray, stop: np.ndarray, order: np.ndarray, few: int = 16):
    """Matches of the query tokens ``ids`` (numbers in the shard, -1: none) from each of ``starts`` up to ``stop``. ``order``: the numbers of the starts
    with a second token, by what they begin with.

    ``(start number, first depth, last depth, count)`` for the depths from 2 that an interval of the array was followed through, and ``(start number, depth,
    length, count)`` for each of its last suffixes: there it counts for each depth beyond ``depth`` up to ``length``.
    """
    counted, single = [], []
    first, second = ids[starts[order]], ids[starts[order] + 1]
    known = (first >= 0) & (second >= 0)
    many = order[known]
    # Numbers of tokens ascend with their hashes in every shard, so these keys ascend as well.
    key = (first[known] << 32) + second[known] + 1
    low = np.searchsorted(sa.pairs, key, "left")
    hit = np.flatnonzero(sa.pairs[np.minimum(low, sa.n - 1)] == key)
    many, low, high = many[hit], low[hit], np.searchsorted(sa.pairs, key[hit], "right")
    depth = np.full(len(many), 2, np.int64)
    while len(many):
        alone = (high - low <= few) & (depth > 2)
        if int((high - low).sum()) <= 1 << 17:  # the last ones, not step by step
            alone = depth > 2
        every = [x[alone] for x in (many, low, high - low, depth)]
        counted.append(np.stack([every[0], every[3], every[3], (sa.before[high] - sa.before[low])[alone]], 1))
        block = np.cumsum(every[2]) >> 17
        for c in range(int(block[-1]) + 1 if len(block) else 0):  # bounds what occurrences expand to
            m, a, k, d = (x[block == c] for x in every)
            which = np.repeat(np.arange(len(m)), k)
            at = _ranges(a, k)
            place = sa.order[at].astype(np.int64)
            length = common(sa, place, ids, sums, starts[m][which], stop[m][which], d[which])
            more = length > d[which]
            at = at[more]
            single.append(np.stack([m[which][more], d[which][more], length[more], sa.before[at + 1] - sa.before[at]], 1))
        many, low, high, depth = (x[~alone] for x in (many, low, high, depth))
        # An interval agrees with the query as far as its first and its last suffix do.
        last = depth
        if len(many) and depth[0] > 2:
            ends = [common(sa, sa.order[x].astype(np.int64), ids, sums, starts[many], stop[many], depth) for x in (low, high - 1)]
            last = np.minimum(*ends)
        counted.append(np.stack([many, depth, last, sa.before[high] - sa.before[low]], 1))
        room = starts[many] + last < stop[many]
        many, low, high, depth = many[room], low[room], high[room], last[room]
        wanted = ids[starts[many] + depth] + 1
        known = wanted > 0
        many, low, high, depth, wanted = (x[known] for x in (many, low, high, depth, wanted))
        low, high = sa.next_part(low, wanted) if len(depth) and depth[0] == 2 else sa.narrow(low, high, depth, wanted)
        live = high > low
        many, low, high, depth = many[live], low[live], high[live], depth[live] + 1
    none = np.zeros((0, 4), np.int64)
    return np.concatenate(counted) if counted else none, np.concatenate(single) if single else none


def search_in_parts(sa: SuffixArray, ids: np.ndarray, sums: np.ndarray, starts: np.ndarray, stop: np.ndarray, order: np.ndarray, part: int = BLOCK):
    """``search``, some starts at a time, which bounds its memory."""
    found = [search(sa, ids, sums, starts, stop, order[i : i + part]) for i in range(0, max(1, len(order)), part)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_GRAMS = "shard long, bucket long, keys binary, counts binary"
_COUNTS = "shard long, bucket long, counts binary"


def packed(values: np.ndarray) -> bytes:
    """Numbers of up to 64 bits as the byte planes that they need."""
    wide = np.ascontiguousarray(values.astype("<u8"))
    width = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
    return bytes([width]) + np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """As 32-bit numbers where these do."""
    width, n = raw[0], (len(raw) - 1) // raw[0]
    wide = np.zeros((n, 4 if width < 4 else 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, n).T
    return wide.view("<i4" if width < 4 else "<i8").ravel()


def gram_keys(base: np.ndarray, depth: int) -> np.ndarray:
    """60-bit keys of the ``depth`` tokens from each place, one less than ``depth`` fewer than there are tokens; ``base``: their mixed hashes. What runs
    over a text's end is for the caller to leave out."""
    if len(base) < depth:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = base
        for d in range(1, depth):
            out = out[:-1] * _STEP + base[d:]
    return (mix(out) >> np.uint64(4)).astype(np.int64)


class _Home:
    """A shard of tokens as its file has it: ``held`` for each text, ``of_held`` and ``left`` (tokens to the text's end) for each token."""

    def __init__(self, row: dict):
        self.held, self.sizes = row["held"], row["sizes"]
        self.tokens, self.hashes = _numbers(row["tokens"]).view(np.int32), np.frombuffer(row["hashes"], np.uint64)
        self.n = len(self.tokens)
        ends = np.cumsum(self.sizes)
        self.firsts = ends - self.sizes
        self.left = np.repeat(ends.astype(np.int32), self.sizes)
        self.left -= np.arange(self.n, dtype=np.int32)
        self.of_held = np.repeat(self.held, self.sizes)
        start = self.of_held.copy()
        start[self.firsts] = True
        #: Places that are searched from: all of held-out texts, and the first of others; and the number of each text's first.
        self.starts = np.flatnonzero(start)
        self.number = np.searchsorted(self.starts, self.firsts)

    def places(self, depth: int, may: np.ndarray | None = None) -> np.ndarray:
        """Where ``depth`` tokens of one text begin, all of whose pairs ``may`` occur where it matters."""
        ok = self.left >= depth
        for d in range(depth - 1 if may is not None else 0):
            ok[: self.n - d] &= may[d:]
        return np.flatnonzero(ok).astype(np.int32)

    def keys(self, depth: int, at: np.ndarray) -> np.ndarray:
        """Keys of the grams at the places ``at``, which ascend."""
        mixed, out = mix(self.hashes), np.empty(len(at), np.int64)
        begins = np.arange(0, self.n, BLOCK)
        for begin, a, b in zip(begins.tolist(), *(np.searchsorted(at, begins + x).tolist() for x in (0, BLOCK))):
            if a < b:
                out[a:b] = gram_keys(mixed[self.tokens[begin : begin + BLOCK + depth - 1]], depth)[at[a:b] - begin]
        return out

    def distinct(self, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the grams at ``at`` in order, and twice their training count (and one if a held-out text has them)."""
        keys = self.keys(depth, at)
        keys <<= 1
        keys += ~self.of_held[at]
        del at
        keys.sort()
        trained = np.bitwise_and(keys, 1, out=np.empty(len(keys), np.int8), casting="unsafe")
        keys >>= 1
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        keys = keys[new]
        if not len(keys):
            return keys, trained.astype(np.int64)
        # Of equal keys those of held-out texts come first.
        heads, also = np.flatnonzero(new), 1 - trained[new]
        del new
        counts = np.add.reduceat(trained, heads, dtype=np.int32 if len(trained) < 1 << 29 else np.int64)
        counts *= 2
        counts += also
        return keys, counts

    def asked(self, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``distinct``, but four times the training count, and two if a training text begins with them, and one if a held-out text has them."""
        keys, counts = self.distinct(depth, at)
        counts = (counts >> 1 << 2) + (counts & 1)
        first = self.firsts[~self.held & (self.sizes >= depth)]
        first = first[np.isin(first, at, assume_unique=True)]
        counts[np.searchsorted(keys, self.keys(depth, first))] |= 2
        return keys, counts

    def slots(self, depth: int, at: np.ndarray) -> np.ndarray:
        """Each place's number among the distinct keys."""
        keys, slot, base = self.keys(depth, at), np.empty(len(at), np.int32), 0
        del at
        for part in range(8):  # by the first three of their 60 bits: what is sorted with places is an eighth of the keys
            here = np.flatnonzero((keys >= part << 57) & (keys < (part + 1) << 57))
            some = keys[here]
            order = np.argsort(some)
            some = some[order]
            new = np.ones(len(some), np.int32)
            new[1:] = some[1:] != some[:-1]
            number = np.cumsum(new, dtype=np.int32)
            number += np.int32(base - 1)
            slot[here[order]] = number
            base += int(new.sum())
        return slot


def _asked(shard: int, keys: np.ndarray, counts: np.ndarray, buckets: int, base: int) -> pa.RecordBatch:
    """Rows of ``_GRAMS``: ranges of keys go to buckets from ``base`` on."""
    step = (1 << 60) // buckets + 1
    cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.int64) * step)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * buckets), pa.array(np.arange(base, base + buckets)), pa.array([packed(np.diff(keys[a:b], prepend=0)) for a, b in zip(cut, cut[1:])], pa.binary()),
            pa.array([packed(counts[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
        ],
        ["shard", "bucket", "keys", "counts"],
    )


def _named(shard: int, name: str) -> pa.RecordBatch:
    """A row of ``_GRAMS`` that only carries the name of a file back to its shard."""
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([-1 - shard]), pa.array([name.encode()], pa.binary()), pa.array([b""], pa.binary())], ["shard", "bucket", "keys", "counts"])


def united(asked: DataFrame, first_only: bool = False) -> DataFrame:
    """For the grams that each shard asked about (``_GRAMS``), in their order: four times the count in all training texts, and two if any of them begins with them, and one if any held-out text has them.
    With ``first_only`` the sum of plain counts to the first shard that asked, and 0 to others."""

    def answer(batches):
        fresh_worker(True)
        told, now = [], None

        def close():
            ends = np.cumsum([len(t[1]) for t in told])
            keys, counts = (np.concatenate([t[i] for t in told]) for i in (1, 2))
            if first_only:
                _, first, at = np.unique(keys, return_index=True, return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                total[first] = np.bincount(at, counts)
            else:
                _, at = np.unique(keys, return_inverse=True)
                total = np.bincount(at, counts >> 2).astype(np.int64) * 4 + (np.bincount(at, counts & 2) > 0) * 2 + (np.bincount(at, counts & 1) > 0)
                total = total[at]
            parts = np.split(total, ends[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told]), pa.array([now] * len(told)), pa.array([packed(p) for p in parts], pa.binary())], ["shard", "bucket", "counts"])

        for batch in batches:
            for shard, bucket, keys, counts in zip(*(batch.column(c) for c in ("shard", "bucket", "keys", "counts"))):
                shard, bucket = shard.as_py(), bucket.as_py()
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([-1]), pa.array([keys.as_py()], pa.binary())], ["shard", "bucket", "counts"])
                    continue
                if bucket != now and told:
                    yield from close()
                    told = []
                now = bucket
                told.append((shard, np.cumsum(unpacked(keys.as_py())), unpacked(counts.as_py())))
        if told:
            yield from close()

    return asked.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(answer, _COUNTS)


def ask_pairs(shards: DataFrame, place: str, buckets: int) -> DataFrame:
    """Every shard's pairs of tokens, as ``united`` takes them."""

    def ask(batches):
        fresh_worker(True)
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("name").to_pylist()):
                home = _Home(_load(place, name))
                yield _asked(shard, *home.asked(2, home.places(2)), buckets, 0)

    return shards.select("shard", "name").mapInArrow(ask, _GRAMS)


def _told(shards: DataFrame, told: DataFrame, n: int, make, schema: str) -> DataFrame:
    """``make(shard, name, file, parts)`` for each shard, with what ``united`` told it: the counts of all buckets in order, one array each, and the file named on the way."""
    rows = shards.select("shard", F.lit(-2).cast("long").alias("bucket"), F.col("name").cast("binary").alias("counts")).unionByName(told)

    def each(batches):
        fresh_worker(True)
        now, name, file, parts = None, None, None, []
        for batch in batches:
            for shard, bucket, counts in zip(*(batch.column(c) for c in ("shard", "bucket", "counts"))):
                bucket = bucket.as_py()
                if bucket == -2:
                    if name is not None:
                        yield from make(now, name, file, parts)
                        fresh_worker(True)
                    now, name, file, parts = shard.as_py(), counts.as_py().decode(), None, [np.zeros(0, np.int64)]
                elif bucket == -1:
                    file = counts.as_py().decode()
                else:
                    parts.append(unpacked(counts.as_py()))
        if name is not None:
            yield from make(now, name, file, parts)

    return rows.repartition(n, "shard").sortWithinPartitions("shard", "bucket").mapInArrow(each, schema)


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    """All ``parts`` as one array; the list is emptied."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _matters(home: _Home, at: np.ndarray, told: np.ndarray) -> np.ndarray:
    """For all places whether the gram there, about which ``told`` was told, is in training (held-out texts), or in a held-out text or in training elsewhere (others)."""
    out = np.zeros(home.n, bool)
    out[at] = np.where(home.of_held[at], told > 3, (told > 7) | (told & 1 > 0))
    return out


def _kept(home: _Home, at: np.ndarray, told: np.ndarray) -> np.ndarray:
    """For all places of training texts whether the ``LEAD`` tokens there, about which ``told`` was told, can be part of a match of what is searched for: if a
    held-out text has them, or if they follow, over places that all recur in training, a place that recurs and has what a training text begins with."""
    recurs, begun, out = np.zeros(home.n, bool), np.zeros(home.n, bool), np.zeros(home.n, bool)
    recurs[at] = (told > 7) & ~home.of_held[at]
    begun[at] = told & 2 > 0
    out[at] = (told & 1 > 0) & ~home.of_held[at]
    _, last = _runs(recurs)
    begun = np.flatnonzero(begun & recurs)
    run, of = np.unique(np.searchsorted(last, begun), return_index=True)
    out[_ranges(begun[of], last[run] + 1 - begun[of])] = True
    return out


def ask_more(shards: DataFrame, pairs: DataFrame, place: str, files: str, n: int, buckets: int) -> DataFrame:
    """Grams of three and of ``LEAD`` tokens whose pairs all matter, as ``united`` takes them; what was told about pairs goes to a file."""

    def make(shard, name, _, parts):
        home, counts = _Home(_load(place, name)), _taken(parts)
        at = home.places(2)
        told = counts[home.slots(2, at)]
        del counts
        may, two = _matters(home, at, told), np.zeros(home.n, told.dtype)
        two[at] = told >> 2
        yield _named(shard, _save(files, {"may": pa.array([np.packbits(may).tobytes()], pa.binary()), "two": pa.array([packed(two[home.starts])], pa.binary())}))
        del two, told, at
        for k, depth in enumerate((3, LEAD)):
            yield _asked(shard, *home.asked(depth, home.places(depth, may)), buckets, k * buckets)

    return _told(shards, pairs, n, make, _GRAMS)


def _runs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true ``bits``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], bits, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2] - 1


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


_PARTS = "shard long, known string, kept string, query string"


def parts_of(shards: DataFrame, more: DataFrame, place: str, files: str, n: int, buckets: int) -> DataFrame:
    """What of each shard goes into suffix arrays (``kept``) and what is searched for (``query``), and counts of up to ``LEAD`` tokens at its starts (``known``), in files.

    A match of ``LEAD`` tokens or more begins at each place of a run of places whose ``LEAD`` tokens matter, so these runs, with the tokens that they
    reach, are all that counts of longer grams come from. What recurs in training only, and is no part of what follows a training text's beginning
    elsewhere, is not searched for by any text, so it is not kept (``_kept``).
    """

    def make(shard, name, file, parts):
        home, pairs, counts = _Home(_load(place, name)), _load(files, file), _taken(parts)
        may = np.unpackbits(np.frombuffer(pairs["may"], np.uint8), count=home.n).astype(bool)
        known = {"two": pairs.pop("two")}
        keys, _ = home.distinct(3, at := home.places(3, may))
        size, three = len(keys), np.zeros(len(home.starts), np.int64)
        asked = np.flatnonzero(np.isin(home.starts, at, assume_unique=True))
        three[asked] = counts[np.searchsorted(keys, home.keys(3, home.starts[asked]))] >> 2
        known["three"] = packed(three)
        del keys, three
        slot = home.slots(LEAD, at := home.places(LEAD, may))
        told = counts[size:][slot]
        del counts, slot
        lead = np.zeros(home.n, told.dtype)
        lead[at] = told >> 2
        known["lead"] = packed(lead[home.starts])
        kept, searched = _kept(home, at, told), _matters(home, at, told) & home.of_held
        del told, at, may

        def region(first, last):
            size = last - first + LEAD
            kinds, tokens = np.unique(home.tokens[_ranges(first, size)], return_inverse=True)
            return size, {"sizes": pa.array(size), "hashes": pa.array([home.hashes[kinds].tobytes()], pa.binary()), "tokens": pa.array([planes(tokens)], pa.binary())}

        _, columns = region(*_runs(kept))
        kept = _save(files, columns)
        # A training text is searched for from its first place, as far as it may recur.
        first, last = _runs((lead > 1) & ~home.of_held)
        own = np.isin(first, home.firsts)
        also, until = _runs(searched)
        first, last, whole = np.concatenate((also, first[own])), np.concatenate((until, last[own])), np.arange(len(also) + int(own.sum())) < len(also)
        order = np.argsort(first)
        first, last, whole = first[order], last[order], whole[order]
        size, columns = region(first, last)
        marks = home.keys(LEAD, _ranges(first, np.where(whole, size - LEAD + 1, 1))) >> 28
        columns |= {"whole": pa.array(whole), "first": pa.array(np.searchsorted(home.starts, first)), "marks": pa.array([planes(marks)], pa.binary())}
        query = _save(files, columns)
        known = _save(files, {k: pa.array([v], pa.binary()) for k, v in known.items()})
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([known]), pa.array([kept]), pa.array([query])], [x.split()[0] for x in _PARTS.split(", ")])

    return _told(shards, more, n, make, _PARTS)


def run_keys(row: dict) -> np.ndarray:
    """60-bit keys of the runs of a ``kept`` file."""
    sizes, tokens = row["sizes"], unplanes(row["tokens"])
    if not len(sizes):
        return np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        values = mix(np.arange(len(tokens), dtype=np.uint64) - np.repeat(begin, sizes).astype(np.uint64) + END)
        values *= mix(np.frombuffer(row["hashes"], np.uint64))[tokens]
        return (mix(np.add.reduceat(values, begin) + sizes.astype(np.uint64)) >> np.uint64(4)).astype(np.int64)


def kept_once(parts: DataFrame, files: str, n: int, buckets: int) -> DataFrame:
    """``kept, kept_tokens``: the runs of all ``kept`` files, equal ones once with how many they are (``weights``), in files of their own. Copies of a text and
    passages that many texts have are most of the runs."""

    def ask(batches):
        fresh_worker(True)
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("kept").to_pylist()):
                yield _asked(shard, *np.unique(run_keys(_load(files, name)), return_counts=True), buckets, 0)

    def make(shard, name, _, told):
        row, weights = _load(files, name), _taken(told)
        _, first = np.unique(run_keys(row), return_index=True)
        first, weights, sizes = first[weights > 0], weights[weights > 0], row["sizes"]
        size = sizes[first]
        kinds, tokens = np.unique(unplanes(row["tokens"])[_ranges((np.cumsum(sizes) - sizes)[first], size)], return_inverse=True)
        hashes = np.frombuffer(row["hashes"], np.uint64)[kinds]
        kept = _save(files, {"sizes": pa.array(size), "weights": pa.array(weights.astype(np.int64)), "hashes": pa.array([hashes.tobytes()], pa.binary()), "tokens": pa.array([planes(tokens)], pa.binary())})
        yield pa.RecordBatch.from_arrays([pa.array([kept]), pa.array([int(size.sum())])], ["kept", "kept_tokens"])

    told = united(parts.select("shard", "kept").mapInArrow(ask, _GRAMS), first_only=True)
    return _told(parts.select("shard", F.col("kept").alias("name")), told, n, make, "kept string, kept_tokens long")


def matches(groups: DataFrame, n: int, parts: str, files: str) -> DataFrame:
    """``shard, blob``: what the suffix array of one group of ``kept`` files has of the queries of each home shard (listed at ``parts``), where it has any."""

    def find(batches):
        fresh_worker(True)
        fs, base = _filesystem(parts)
        for batch in batches:
            for names in batch.column("names").to_pylist():
                if not names:
                    continue
                rows = [_load(files, name) for name in names]
                hashes = np.unique(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]))
                tokens = np.concatenate([np.searchsorted(hashes, np.frombuffer(r["hashes"], np.uint64))[unplanes(r["tokens"])] for r in rows])
                sizes, weights = (np.concatenate([r[k] for r in rows]) for k in ("sizes", "weights"))
                del rows
                if not len(tokens):
                    continue
                tokens = tokens.astype(np.int32)
                sa, mixed = SuffixArray(tokens, sizes, hashes, weights), mix(hashes)
                there = np.zeros(1 << _BITS, bool)
                for a in range(0, sa.n, BLOCK):
                    keys = gram_keys(mixed[tokens[a : a + BLOCK + LEAD - 1]], LEAD) >> (60 - _BITS)
                    there[keys[sa.stop[a : a + len(keys)] - np.arange(a, a + len(keys)) >= LEAD]] = True
                del tokens, keys, mixed
                listed = pads.dataset(base, schema=pa.schema([("shard", pa.int64()), ("query", pa.string())]), filesystem=fs, format="parquet").to_table()
                waiting, size = [], 0
                for home, query in zip(listed.column("shard").to_pylist(), listed.column("query").to_pylist()):
                    wanted = _wanted(sa, there, _load(files, query))
                    if wanted:
                        waiting.append((home, wanted))
                        size += len(wanted["ids"])
                    if size >= TOGETHER:
                        yield from _matched(sa, waiting)
                        size = 0
                if waiting:
                    yield from _matched(sa, waiting)
                del sa, waiting
                fresh_worker(True)

    return groups.repartitionByRange(n, "number").mapInArrow(find, "shard long, blob binary")


def _wanted(sa: SuffixArray, there: np.ndarray, q: dict) -> dict[str, np.ndarray] | None:
    """The part of a file of queries whose first ``LEAD`` tokens are ``there``: ``ids`` of the tokens of its regions in the array (-1: none) and mixed hashes, and for each start its place in them,
    the place where its region ends, its ``number`` in its home shard, and whether it follows the start before it."""
    whole, sizes = q["whole"], q["sizes"]
    each = np.where(whole, sizes - LEAD + 1, 1)
    hit = np.flatnonzero(there[unplanes(q["marks"]) >> (32 - _BITS)])
    if not len(hit):
        return None
    region = np.repeat(np.arange(len(sizes)), each)[hit]
    inner = hit - (np.cumsum(each) - each)[region]
    used, region = np.unique(region, return_inverse=True)
    tokens = unplanes(q["tokens"])[_ranges((np.cumsum(sizes) - sizes)[used], sizes[used])]
    hashes, kinds = np.frombuffer(q["hashes"], np.uint64), np.zeros(len(q["hashes"]) // 8, bool)
    kinds[tokens] = True
    kinds = np.flatnonzero(kinds)
    slot = np.minimum(np.searchsorted(sa.hashes, hashes[kinds]), len(sa.hashes) - 1)
    ids = np.full(len(hashes), -1, np.int64)
    ids[kinds] = np.where(sa.hashes[slot] == hashes[kinds], slot, -1)
    ends = np.cumsum(sizes[used])
    follows = np.zeros(len(hit), bool)
    follows[1:] = (region[1:] == region[:-1]) & (inner[1:] == inner[:-1] + 1)
    return {
        "ids": ids[tokens], "mixed": mix(hashes)[tokens], "starts": (ends - sizes[used])[region] + inner, "stop": ends[region], "number": q["first"][used][region] + inner, "follows": follows,
    }


def _matched(sa: SuffixArray, wanted: list[tuple[int, dict]]):
    """``shard, blob`` for several homes; the list is emptied. A blob has rows ``start number, first depth, last depth, count`` beyond ``LEAD`` tokens; depths that the place before reaches as well are left out."""
    shift = np.cumsum([0, *(len(w["ids"]) for _, w in wanted)])
    of = np.repeat(np.arange(len(wanted), dtype=np.int32), [len(w["starts"]) for _, w in wanted])
    starts, stop = (np.concatenate([w.pop(k) + a for (_, w), a in zip(wanted, shift)]) for k in ("starts", "stop"))
    number, follows, ids, mixed = (np.concatenate([w.pop(k) for _, w in wanted]) for k in ("number", "follows", "ids", "mixed"))
    homes = [home for home, _ in wanted]
    wanted.clear()
    sums = _sums(mixed)
    del mixed
    n = len(starts)
    # Ends of matches never decrease along places that follow each other: between two with the same end, all have it.
    heads = np.flatnonzero(~follows)
    along = (np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))).astype(np.int32)
    edge = np.append(~follows[1:], True)
    end, rows, counts = np.full(n, -1, np.int64), [], []
    for step in (64, 16, 4, 1):
        open_ = np.flatnonzero(end < 0)
        if step < 64:
            known = np.flatnonzero(end >= 0)
            after = np.searchsorted(known, open_)
            low, high = end[known[after - 1]], end[known[np.minimum(after, len(known) - 1)]]
            end[open_[low == high]] = low[low == high]
            open_ = open_[low != high]
        chosen = open_[(along[open_] % step == 0) | edge[open_]]
        if not len(chosen):
            continue
        chosen = chosen[np.argsort((ids[starts[chosen]] << 32) + ids[starts[chosen] + 1])]
        counted, single = search_in_parts(sa, ids, sums, starts, stop, chosen)
        length = (ids[starts] >= 0).astype(np.int64)
        for found in (counted, single):
            np.maximum.at(length, found[:, 0], found[:, 2])
        end[chosen] = starts[chosen] + length[chosen]
        # An array has under 2**31 tokens, and so has a block of queries; what occurs may occur more often.
        single[:, 1] += 1
        rows += [counted[:, :3].astype(np.int32), single[:, :3].astype(np.int32)]
        counts += [counted[:, 3].copy(), single[:, 3].copy()]
        del counted, single, found
    del ids, sums, stop, chosen, open_, along, edge
    before = np.where(follows, np.concatenate(([-1], end[:-1])), -1)
    least = np.maximum(LEAD + 1, before - starts + 1).astype(np.int32)
    del before, end, starts, follows
    for i, r in enumerate(rows):
        r[:, 1] = np.maximum(r[:, 1], least[r[:, 0]])
        more = r[:, 1] <= r[:, 2]
        rows[i], counts[i] = r[more], counts[i][more]
    rows, count = np.concatenate(rows), np.concatenate(counts)
    at, low, high = rows.T.copy()
    del r, more, rows, counts
    order = np.lexsort((high, low, at))
    at, low, high, count = at[order], low[order], high[order], count[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    new = np.flatnonzero(new)
    if not len(new):
        return
    at, low, high, count = at[new], low[new], high[new], np.add.reduceat(count, new, dtype=np.int64)
    cut = np.searchsorted(of[at], np.arange(len(homes) + 1))
    for home, a, b in zip(homes, cut, cut[1:]):
        if a == b:
            continue
        parts = [packed(x) for x in (np.diff(number[at[a:b]], prepend=0), low[a:b], (high - low)[a:b], count[a:b])]
        blob = zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(p) for p in parts], "<u4").tobytes(), *parts]))
        yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([blob], pa.binary())], ["shard", "blob"])


class _Found:
    """United results of the suffix arrays for one home shard: where, by start and depth, counts change; and each start's longest match."""

    def __init__(self):
        self.keys, self.changes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, blob: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        ends = 16 + np.cumsum(np.frombuffer(raw[:16], "<u4").astype(np.int64))
        at, low, more, count = (unpacked(raw[a:b]) for a, b in zip([16, *ends], ends))
        at = np.cumsum(at) << 32
        self.waiting.append((at + low, count))
        self.waiting.append((at + low + more + 1, -count))
        self.size += 2 * len(at)
        if self.size > 1_500_000:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(w[0] for w in self.waiting)])
        changes = np.concatenate([self.changes, *(w[1] for w in self.waiting)])
        self.waiting, self.size = [], 0
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.changes = np.bincount(inverse, changes, len(self.keys)).astype(np.int64)

    def close(self, n: int) -> None:
        """Nothing is added any more; ``n``: the number of starts."""
        self.merge()
        # The last change of a start is one beyond its longest match: there nothing is left.
        self.counts = np.concatenate(([0], np.cumsum(self.changes)))
        self.longest = np.zeros(n, np.int64)
        np.maximum.at(self.longest, self.keys >> 32, (self.keys & ((1 << 32) - 1)) - 1)

    def count(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.keys, (start << 32) | depth, "right")]


def evidence(found: _Found, known: list[np.ndarray], once: np.ndarray, home: _Home) -> tuple[np.ndarray, np.ndarray]:
    """For each token the counts of its longest context and of the context with it; 0 for no context. ``once``: unigram counts of the tokens;
    ``known``: counts of 2, 3 and ``LEAD`` tokens from each start."""
    n = len(once)
    longest = found.longest
    for depth, counts in enumerate(known, 2):
        longest = np.maximum(longest, np.where(counts > 0, depth, 0))
    context, pair = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def count(start, depth):
        out = found.count(start, depth)
        for d, counts in enumerate(known, 2):
            out = np.where(depth == d, counts[start], out)
        return out

    # Where nothing else has what a training text begins with, it is there once itself.
    trained = ~home.held
    context[~home.of_held] = pair[~home.of_held] = 1
    context[home.firsts], pair[home.firsts] = 0, 0
    begun = [np.maximum(c, 1) for c in (once[home.firsts], *(counts[home.number] for counts in known), np.ones(len(home.sizes), np.int64))]
    for depth, (c, k) in enumerate(zip(begun, begun[1:]), 1):
        at = np.flatnonzero(trained & (home.sizes > depth))
        context[home.firsts[at] + depth], pair[home.firsts[at] + depth] = c[at], k[at]
    for d in np.flatnonzero(home.held | (longest[home.number] > LEAD)).tolist():
        a, m, s = int(home.firsts[d]), int(home.sizes[d]), int(home.number[d])
        if m < 2:
            continue
        if home.held[d]:
            i = np.arange(m)
            far = np.maximum.accumulate(i + np.maximum(longest[s : s + m], once[a : a + m] > 0))
            t = i[1:]
            best = np.searchsorted(far, t)
            depth = np.maximum(t - best, 0)
            has = depth > 0
            best = np.minimum(best, m - 1)
            c = np.where(depth == 1, once[a + best], count(s + best, depth))
            k = count(s + best, depth + 1)
            context[a + 1 : a + m], pair[a + 1 : a + m] = np.where(has, c, 0), np.where(has, k, 0)
        else:
            r = min(m, int(longest[s]) + 1)
            c = count(np.full(r, s), np.arange(1, r + 1))
            c[0] = once[a]
            c = np.maximum(c, 1)
            context[a + 1 : a + r], pair[a + 1 : a + r] = c[:-1], c[1:]
    return context, pair


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, weight: float = WEIGHT, growth: float = GROWTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    A text whose ``crc32(doc_id) mod 10`` is 0 is held out, all others are training. Null texts are empty: one end token. A null id is held out.
    Rows that share a ``doc_id`` are texts of their own. An empty table gives an empty one. A task holds one shard, or one suffix array and one block of
    queries. Passages that held-out texts share with training are looked up in every array, of which there are as many as ``shard_bytes`` allows.
    """
    spark = docs.sparkSession
    place = shared_place(spark, "lm")
    tokens, files = f"{place}/tokens", f"{place}/parts-of-shards"
    shards_of(texts_of(docs), tokens, shard_bytes).write.option("compression", "zstd").parquet(f"{place}/shards")
    shards = spark.read.schema(_SHARD).parquet(f"{place}/shards")
    n = max(1, shards.count())
    spread_out = shards.select("shard", "name").repartition(n)
    buckets = min(4096, max(8, 2 * n))
    unigrams(spread_out, tokens, buckets).write.option("compression", "zstd").parquet(f"{place}/unigrams")
    once = spark.read.schema("shard long, bucket long, counts binary, types long, total long").parquet(f"{place}/unigrams")
    types, total = (int(x or 0) for x in once.agg(F.sum("types"), F.sum("total")).first())
    pairs = written(united(ask_pairs(spread_out, tokens, buckets)), "lm-pairs")
    more = written(united(ask_more(shards, pairs, tokens, files, n, buckets)), "lm-grams")
    parts_of(shards, more, tokens, files, n, buckets).write.option("compression", "zstd").parquet(f"{place}/parts")
    parts = spark.read.schema(_PARTS).parquet(f"{place}/parts")
    kept = sorted((r.kept, r.kept_tokens) for r in kept_once(parts, files, n, buckets).where("kept_tokens > 0").collect())
    groups, size, whole = [[]], 0, sum(k for _, k in kept)
    most = whole / max(1, -(-whole // max(1, shard_bytes // 10)))
    for name, k in kept:
        if groups[-1] and size + k / 2 > most:
            groups, size = [*groups, []], 0
        groups[-1].append(name)
        size += k
    found = matches(spark.createDataFrame(list(enumerate(groups)), "number long, names array<string>"), len(groups), f"{place}/parts", files)
    rows = shards.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("bucket"), "name", F.lit(None).cast("binary").alias("blob"))
    others = [
        parts.select("shard", F.lit(1).alias("kind"), F.col("known").alias("name")),
        once.select("shard", F.lit(2).alias("kind"), "bucket", F.col("counts").alias("blob")),
        found.select("shard", F.lit(3).alias("kind"), "blob"),
    ]
    for part in others:
        rows = rows.unionByName(part, allowMissingColumns=True)

    def finish(name: str, known: str, answers: dict[int, bytes], found: _Found) -> pa.RecordBatch:
        row = _load(tokens, name)
        home, known = _Home(row), _load(files, known)
        del row["tokens"]
        bucket = (home.hashes >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        counts = np.empty(len(home.hashes), np.int64)
        counts[order] = np.concatenate([np.frombuffer(answers[b], "<i8") for b in range(buckets)])
        del order, bucket
        once_, sizes = counts[home.tokens], home.sizes
        found.close(len(home.starts))
        c, k = evidence(found, [unpacked(known[x]) for x in ("two", "three", "lead")], once_, home)
        n_known, base, score = np.empty(len(sizes), np.int64), np.empty(len(sizes)), np.empty(len(sizes))
        # Some whole texts at a time.
        edges = np.append(np.unique(np.searchsorted(home.firsts, np.arange(0, home.n, BLOCK))), len(sizes))
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            here = slice(home.firsts[i], home.firsts[j - 1] + sizes[j - 1])
            p = (once_[here] + ADD) / (total + ADD * (types + 1))
            a = weight * np.power(np.maximum(c[here], 1), growth)
            q = np.where(c[here] > 0, (k[here] + a * p) / (c[here] + a), p)
            for out, x in ((n_known, (once_[here] > 0).astype(np.int64)), (base, np.log10(p)), (score, np.log10(q))):
                out[i:j] = np.add.reduceat(x, home.firsts[i:j] - home.firsts[i])
        arrays = [row["doc_ids"], pa.array(home.held), pa.array(sizes), pa.array(n_known), pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _OUT.split(", ")])

    def unite(batches):
        fresh_worker(True)
        name, known, answers, found = None, None, {}, _Found()
        for batch in batches:
            for kind, bucket, told, blob in zip(*(batch.column(c) for c in ("kind", "bucket", "name", "blob"))):
                kind = kind.as_py()
                if kind == 0:
                    if name:
                        yield finish(name, known, answers, found)
                    name, answers, found = told.as_py(), {}, _Found()
                elif kind == 1:
                    known = told.as_py()
                elif kind == 2:
                    answers[bucket.as_py()] = blob.as_py()
                else:
                    found.add(blob.as_py())
        if name:
            yield finish(name, known, answers, found)

    return rows.repartition(n, "shard").sortWithinPartitions("shard", "kind", "bucket").mapInArrow(unite, _OUT)
