"""Suffix-array removal of repeated byte strings across a corpus (operator 1).

Equal 100-byte windows hold the same leftmost least 32-byte gram at the same place, so every
window belongs to that gram (its anchor), and the consecutive windows of one anchor make a
fragment of at most 168 bytes. Anchors are exchanged as packed hashes; an anchor seen once has
no repeated window, and equal fragments are one entry from the start. Only the texts of
different fragments with one anchor are fetched, and these shards are put into suffix arrays
by two-stage sorting: suffixes smaller than their successors are sorted directly, the others
are induced by a scan of the first-byte buckets; adjacent common prefixes of ``width`` bytes
then give the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.llm.common import fresh_worker, texts_of, written
from rillbase.llm.shingles import mix

WIDTH, GRAM = 100, 32
_GROUP = 1 << 20
_rng = np.random.default_rng(5)
_BYTE, _OTHER = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BASE = np.uint64(0xE7037ED1A0B428DB)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        with np.errstate(over="ignore"):
            for base in (_BASE, _BACK):
                table = np.full(_GROUP + 1, base, np.uint64)
                table[0] = 1
                _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def fragments(buf: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The fragments of the texts that ``ends`` cuts ``buf`` into (at most 2**20 bytes).

    ``text`` (its number), ``first`` (first window, in ``buf``), ``lead`` (anchor less first window),
    ``n`` (windows less one), ``anchor`` and ``content`` (hashes).
    """
    size, span = len(buf), width - gram + 1
    begins = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - begins)
    valid = np.arange(size) + width <= ends[text] if size else np.zeros(0, bool)
    if not valid.any():
        return {k: np.zeros(0, np.int64) for k in ("text", "first", "lead", "n", "anchor", "content")}
    with np.errstate(over="ignore"):
        h = _BYTE[buf]
        for step, odd in zip((1, 2, 4, 8, 16), _ODD):
            h = h[:-step] * odd + h[step:]
        h = mix(h)
        key = (h & ~np.uint64(_GROUP - 1)) | np.arange(len(h), dtype=np.uint64)
        least, have = key, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        at = np.flatnonzero(valid)
        own = (least[at] & np.uint64(_GROUP - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
        first, last = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
        power, back = _power_tables()
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OTHER[buf] * power[:size], dtype=np.uint64)))
        content = mix((total[last + width] - total[first]) * back[first])
    return {"text": text[first], "first": first, "lead": own[new] - first, "n": last - first, "anchor": h[own[new]], "content": content}


def _pieces(ids: list, raws: list[bytes], width: int):
    """Groups ``(ids, starts, bytes)`` of at most 2**20 bytes; a longer text is cut with an overlap of ``width`` - 1."""
    group, held = [], 0
    for doc, raw in zip(ids, raws):
        step = _GROUP - width + 1
        for start in range(0, max(1, len(raw) - width + 1), step):
            part = raw[start : start + _GROUP]
            if len(part) < width:
                continue
            if held + len(part) > _GROUP:
                yield group
                group, held = [], 0
            group.append((doc, start, part))
            held += len(part)
    if group:
        yield group


_ENTRY = [("anchor", 5), ("content", 6), ("doc", 8), ("first", 5), ("lead", 1), ("n", 1)]
_BYTES = sum(k for _, k in _ENTRY)


def _packed(table: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    """Byte planes, so that what is alike in a column compresses."""
    return b"".join(np.ascontiguousarray(table[k][at].astype("<i8" if k == "doc" else "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for k, w in _ENTRY)


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    n, planes, at, out = len(raw) // _BYTES, np.frombuffer(raw, np.uint8), 0, {}
    for k, w in _ENTRY:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = planes[at : at + n * w].reshape(w, n).T
        out[k] = wide.view("<i8").ravel()
        at += n * w
    return out


def _classes(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor, content and place, and which entries of it begin a class of equal fragments."""
    order = np.lexsort((t["first"], t["doc"], t["n"] * 256 + t["lead"], t["content"], t["anchor"]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = np.logical_or.reduce([t[k][a] != t[k][b] for k in ("anchor", "content", "lead", "n")])
    return order, new


def _spans(t: dict[str, np.ndarray], at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, begin, end`` of the bytes under these fragments, united where they meet."""
    doc, begin = t["doc"][at], t["first"][at]
    end = begin + t["n"][at] + width
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    top = end.copy()
    shift = np.cumsum(new).astype(np.int64) * (int(end.max()) + 1)
    top = np.maximum.accumulate(top + shift) - shift
    new[1:] |= begin[1:] > top[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], begin[heads], top[np.concatenate((heads[1:], [len(doc)])) - 1]


_ROW = "kind int, doc long, begin long, end long, key long, lead int, packed binary"
_FIELDS = [("kind", pa.int32()), ("doc", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("key", pa.int64()), ("lead", pa.int32()), ("packed", pa.binary())]


def _rows(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, [k for k, _ in _FIELDS])


def _removed(spans: tuple) -> pa.RecordBatch:
    return _rows(len(spans[0]), kind=np.zeros(len(spans[0]), np.int32), doc=spans[0], begin=spans[1], end=spans[2], key=spans[0])


def _anchors(docs: DataFrame, buckets: int, width: int, most: int = 32 << 20) -> DataFrame:
    """Map side: kind 0, spans repeated within a task; kind 1, the entries left, packed by bucket (``key``)."""

    def find(batches):
        fresh_worker()
        held, size = [], 0

        def flush():
            t = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            order, new = _classes(t)
            if not new.all():
                yield _removed(_spans(t, order[~new], width))
            kept = order[new]
            bucket = (t["bucket"][kept]).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            kept, bucket = kept[by], bucket[by]
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [_packed(t, kept[a:b]) for a, b in zip(heads, [*heads[1:], len(kept)])]
            yield _rows(len(heads), kind=np.ones(len(heads), np.int32), key=bucket[heads], packed=blobs)

        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                for group in _pieces(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), width):
                    buf = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
                    ends = np.cumsum([len(g[2]) for g in group])
                    f = fragments(buf, ends, width)
                    begins = np.concatenate(([0], ends[:-1]))
                    starts, ids = np.array([g[1] for g in group], np.int64), np.array([g[0] for g in group], np.int64)
                    anchor = f["anchor"].astype(np.uint64)
                    held.append(
                        {
                            "bucket": (anchor >> np.uint64(40)) % np.uint64(buckets), "anchor": (anchor & np.uint64((1 << 40) - 1)).astype(np.int64),
                            "content": (f["content"].astype(np.uint64) >> np.uint64(16)).astype(np.int64), "doc": ids[f["text"]],
                            "first": f["first"] - begins[f["text"]] + starts[f["text"]], "lead": f["lead"], "n": f["n"],
                        }
                    )
                    size += len(buf)
                    if size >= most:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(find, _ROW)


def _matched(rows: DataFrame, width: int, hot: int) -> DataFrame:
    """Reduce side: kind 0 as before; kind 2, fragments that share an anchor with different ones (``lead`` -1 - lead if there are more than ``hot``)."""

    def match(batches):
        held, now = [], None

        def close():
            t = {k: np.concatenate([h[k] for h in held]) for k, _ in _ENTRY}
            order, new = _classes(t)
            if not new.all():
                yield _removed(_spans(t, order[~new], width))
            heads = order[new]
            anchor = t["anchor"][heads]
            group = np.cumsum(np.diff(anchor, prepend=-1) != 0) - 1
            many = np.bincount(group)[group]
            at, lead = heads[many > 1], t["lead"][heads]
            lead = np.where(many > hot, -1 - lead, lead)[many > 1]
            if len(at):
                yield _rows(len(at), kind=np.full(len(at), 2, np.int32), doc=t["doc"][at], begin=t["first"][at], end=t["first"][at] + t["n"][at] + width, key=t["anchor"][at] | (np.int64(now % (1 << 23)) << 40), lead=lead)

        for batch in batches:
            local = batch.filter(pc.equal(batch.column("kind"), 0))
            if local.num_rows:
                yield local
            for key, raw, kind in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(), batch.column("kind").to_pylist()):
                if kind != 1:
                    continue
                if key != now and held:
                    yield from close()
                    held = []
                now = key
                held.append(_unpacked(raw))
        if held:
            yield from close()

    # A local span is only passed on, so it may go anywhere: it is spread by its document.
    return rows.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(match, _ROW)


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``texts`` in order (places in their concatenation with a zero byte after each), by two-stage sorting; and that concatenation.

    A suffix ends with its text; equal suffixes are in the order of their places.
    """
    joined = b"\0".join(texts) + b"\0"
    size = len(joined)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    stop = np.repeat(ends, np.diff(ends, prepend=-1))
    codes = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    codes[ends] = 0
    after = np.concatenate((codes[1:], [0]))
    # The next place with another code decides whether a suffix is smaller than its successor.
    differs = np.flatnonzero(codes != after)
    nxt = np.minimum(np.searchsorted(differs, np.arange(size)), max(0, len(differs) - 1))
    smaller = codes[differs[nxt]] < after[differs[nxt]] if len(differs) else np.zeros(size, bool)
    smaller[ends] = True
    stops = stop.tolist()
    direct = np.flatnonzero(smaller & (codes > 0)).tolist()
    direct.sort(key=lambda i: joined[i : stops[i]])
    # Equal suffixes of different texts sort as they stand; separators are the least suffixes of all.
    counts = np.bincount(codes, minlength=258)
    heads = (np.cumsum(counts) - counts).tolist()
    order = [-1] * size
    order[: len(ends)] = ends.tolist()
    in_bucket = np.bincount(codes[direct], minlength=258) if direct else np.zeros(258, np.int64)
    begin = 0
    for c in np.flatnonzero(in_bucket).tolist():
        k, tail = int(in_bucket[c]), heads[c] + int(counts[c])
        order[tail - k : tail] = direct[begin : begin + k]
        begin += k
    kind, code = smaller.tolist(), codes.tolist()
    for j in range(size):
        i = order[j] - 1
        if i >= 0 and not kind[i]:
            c = code[i]
            order[heads[c]] = i
            heads[c] += 1
    return np.array(order), np.frombuffer(joined, np.uint8)


def common_prefixes(order: np.ndarray, buf: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in ``order`` its common prefix with the one before it, at most ``most``; ``left``: bytes until the text ends."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate((buf, np.zeros(most, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, most)
    for a in range(1, len(order), 100_000):
        i, j = order[a : a + 100_000], order[a - 1 : min(len(order), a + 100_000) - 1]
        same = windows[i] == windows[j]
        run = np.where(same.all(1), most, same.argmin(1))
        out[a : a + 100_000] = np.minimum(run, np.minimum(left[i], left[j]))
    return out


def repeated_windows(texts: list[bytes], docs: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``doc, begin`` of every window of ``texts`` that also begins earlier, by document and place."""
    order, buf = suffix_array(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=-1))
    left = ends[text] - np.arange(len(buf))
    long = order[left[order] >= width]
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Suffixes shorter than a window fall between longer ones only where those differ.
    group = np.cumsum(common_prefixes(long, buf, left, width) < width)
    place = begins[text[long]] + long - (ends[text[long]] - np.array([len(t) for t in texts])[text[long]])
    doc = docs[text[long]]
    by = np.lexsort((place, doc, group))
    later = np.concatenate(([False], group[by][1:] == group[by][:-1]))
    return doc[by[later]], place[by[later]]


def _texts(asked: DataFrame, docs: DataFrame, width: int, step: int) -> DataFrame:
    """``key, piece, doc, begin, lead``: the texts of the fragments asked for, and where their anchor is. Fragments of hot anchors are cut into ranges of
    ``step`` windows; windows of one range can only be equal if the bytes common to all of them are, so these go into the key (and ``lead`` is -1)."""
    lists = asked.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("begin", "end", "key", "lead")).alias("asked"))

    def fetch(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text, parts in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist()):
                for p in parts:
                    begin, end, key, lead = p["begin"], p["end"], p["key"], p["lead"]
                    if lead >= 0:
                        out.append((key, text[begin:end], doc, begin, lead))
                        continue
                    anchor, last = begin - 1 - lead, end - width
                    # Ranges are counted from the anchor, so they are the same in every fragment.
                    for r in range((anchor - last) // step, (anchor - begin) // step + 1):
                        low, high = max(begin, anchor - r * step - step + 1), min(last, anchor - r * step)
                        core = text[anchor - r * step : anchor - r * step - step + 1 + width]
                        at = int.from_bytes(hashlib.blake2b(core + r.to_bytes(2, "little") + key.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                        out.append((at, text[low : high + width], doc, low, -1))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "piece", "doc", "begin", "lead"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "asked").mapInArrow(fetch, "key long, piece binary, doc long, begin long, lead int")


def shared_parts(group: list[tuple[bytes, int, int, int]], width: int, step: int = 8) -> list[tuple[bytes, int, int]]:
    """``text, doc, begin`` of the parts of different fragments of one anchor that may hold a repeated window.

    ``group`` has ``text, doc, begin, lead``. Equal windows hold the anchor at the same place, so they fall into one range of ``step`` places,
    and the bytes common to all windows of that range are equal as well: a range whose common bytes no other fragment has holds none.
    A fragment with ``lead`` -1 was cut to one such range before and is taken whole.
    """
    if len(group) < 2:
        return []
    seen: dict[tuple[int, bytes], int] = {}
    cores: list[list[tuple[int, bytes]]] = []
    for text, _, _, lead in group:
        if lead < 0:
            cores.append([])
            continue
        cores.append([(r, text[lead - r * step : lead - r * step - step + 1 + width]) for r in range((lead - len(text) + width) // step, lead // step + 1)])
        for core in cores[-1]:
            seen[core] = seen.get(core, 0) + 1
    out = []
    for (text, doc, begin, lead), own in zip(group, cores):
        if lead < 0:
            out.append((text, doc, begin))
            continue
        run: list[int] = []
        for r in (*(r for r, c in own if seen[r, c] > 1), None):
            if run and (r is None or r > run[-1] + 1):
                low, high = max(0, lead - run[-1] * step - step + 1), min(len(text), lead - run[0] * step + width)
                out.append((text[low:high], doc, begin + low))
                run = []
            run.append(r)
    return out


def _sorted_shards(pieces: DataFrame, width: int, most: int = 1 << 17) -> DataFrame:
    """Repeated windows of each key as spans, from suffix arrays over about ``most`` bytes of whole keys; equal pieces of a key count once there, and only what may repeat goes there."""

    def spans(batches):
        fresh_worker()
        texts, docs, begins, held = [], [], [], 0
        key = piece = None
        group: list[tuple] = []

        def found(d, b):
            if len(d):
                yield _removed(_spans({"doc": d, "first": b, "n": np.zeros(len(d), np.int64)}, np.arange(len(d)), width))

        def sort():
            if texts:
                yield from found(*repeated_windows(texts, np.array(docs, np.int64), np.array(begins, np.int64), width))

        for batch in batches:
            copies: list[tuple] = []
            for k, p, d, b, lead in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "doc", "begin", "lead"))):
                if k == key and p == piece:
                    copies.append((d, b, len(p) - width))
                    continue
                if k != key:
                    for g in shared_parts(group, width):
                        texts.append(g[0]), docs.append(g[1]), begins.append(g[2])
                        held += len(g[0])
                    group, key = [], k
                    if held >= most:
                        yield from sort()
                        texts, docs, begins, held = [], [], [], 0
                piece = p
                group.append((p, d, b, lead))
            if copies:
                d, b, n = (np.array(x, np.int64) for x in zip(*copies))
                yield _removed(_spans({"doc": d, "first": b, "n": n}, np.arange(len(d)), width))
        for g in shared_parts(group, width):
            texts.append(g[0]), docs.append(g[1]), begins.append(g[2])
        yield from sort()

    return pieces.repartition("key").sortWithinPartitions("key", "piece", "doc", "begin").mapInArrow(spans, _ROW)


def _rewritten(docs: DataFrame, spans: DataFrame, texts: bool, more: tuple[str, ...] = ()) -> DataFrame:
    lists = spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                at = removed = runs = 0
                last, kept = -1, []
                for a, b in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if a > last:
                        runs += 1
                    if b > at:
                        a = max(a, at)
                        kept.append(raw[at:a])
                        removed += b - a
                        at = b
                    last = max(last, b)
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if texts else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + texts)
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds)), *(batch.column(c) for c in more)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if texts else []), *more]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "spans", *more).mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = False, hot: int = 2048, step: int = 4, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``; with ``texts`` also what is left, as ``text``; and its columns in ``more``.

    A byte goes if a ``width``-byte string over it also starts earlier, in a row of a smaller ``doc_id`` or before it in the
    same text. Null texts are empty. Where ids are null or repeat, rows are documents of their own in the order of ``doc_id`` (nulls
    first) and text. In ``text``, a character that a cut runs through is left out. Other columns are ignored. An empty table gives an empty one.
    ``hot``: fragments of one anchor beyond which its windows are keyed by ``step`` places; results don't depend on either.
    """
    docs = texts_of(docs, *more)
    total = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id"), F.sum(F.octet_length("text"))).first()
    told = docs
    plain = total[0] == total[1] == total[2] and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int")
    if not plain:
        ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        told = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "rows")
        docs = told.select(F.col("_row").alias("doc_id"), "text", *more)
    buckets = max(8, int((total[3] or 0) // (16 << 20)))
    matched = written(_matched(_anchors(docs, buckets, width), width, hot), "anchors")
    pieces = _texts(matched.where("kind = 2"), docs, width, step)
    spans = written(_sorted_shards(pieces, width).select("doc", "begin", "end"), "spans").unionByName(matched.where("kind = 0").select("doc", "begin", "end"))
    out = _rewritten(docs, spans, texts, more)
    if not plain:
        out = out.withColumnRenamed("doc_id", "_row").join(told.select("_row", "doc_id"), "_row").select("doc_id", *out.columns[1:])
    return out
