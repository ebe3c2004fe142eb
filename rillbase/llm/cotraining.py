"""A quality classifier by co-training (operator 3).

Two views of a document, the words of its text and its page metadata (language, source, length, and
figures of how the page is written), each have a logistic model for low quality and one for
toxicity. In each round every view scores all documents without labels, and those it is most
sure of are labelled for the other view. On labelled rows that neither has seen each view is
calibrated by itself, the calibrated views are combined, and the combination scores every document.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillbase.llm.common import by_chars, fresh_worker, shared_place, written
from rillbase.llm.shingles import distinct, joined, mix

#: Labelled rows that the models are fitted on at most. Everything else covers all documents.
LABELLED_ROWS = 12_000
#: Rounds, documents of each value that a view labels for the other in a round, and how sure of them it is at least.
ROUNDS, GIVE, CONFIDENT = 3, 400, 0.97
WORD_SLOTS, META_SLOTS = 1 << 20, 1 << 13
HEADS = ("low", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_BINS = 32
_SYMBOLS, _DIGITS = "#*$%&|<>", "0123456789"
#: Kinds of code points.
_SPACE, _UPPER, _NO_UPPER = 1, 2, 4
_MARKS = ((8, _SYMBOLS), (16, "!"), (32, _DIGITS), (64, ".,"))
#: Bytes of a word up to which many are hashed at once, a byte of each at a time.
_LONG = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS


def _shares(chars: int, words: int, raw: int, letters: int, distinct: int, symbols: int, upper: int, shouts: int, digits: int, stops: int, lines: int, kinds: int) -> list[float]:
    n, chars = max(1, words), max(1, chars)
    return [
        symbols / chars, upper / max(1, raw), shouts / n, digits / chars, distinct / n, 1 - kinds / max(1, lines), stops / n,
        letters / n / 20, math.log1p(raw) / 12, raw / n / 4,
    ]


def figures(text: str, words: list[str], distinct: int) -> list[float]:
    """How a page is written, in numbers that mean as much at any length; most are shares. ``described`` has the same of many texts at once."""
    raw = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    count = lambda marks: sum(map(text.count, marks))
    return _shares(
        len(text), len(words), len(raw), sum(map(len, words)), distinct, count(_SYMBOLS), sum(map(str.isupper, raw)), count("!"), count(_DIGITS), count(".,"), len(lines), len(set(lines))
    )


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is in words, and its kinds: a bit each for white space, capitals, what no word in capitals has, and the marks that are counted."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    letter, kind = np.zeros(len(every), bool), np.zeros(len(every), np.uint8)
    for found in _WORD.finditer(every):
        letter[found.start() : found.end()] = True
    upper, small, title, space = (np.fromiter(map(f, every), bool, len(every)) for f in (str.isupper, str.islower, str.istitle, str.isspace))
    kind[space], kind[upper], kind[small | title & ~upper] = _SPACE, _UPPER, _NO_UPPER
    for bit, marks in _MARKS:
        kind[[ord(x) for x in marks]] |= bit
    return letter, kind


def _of_bytes(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 what ``table`` has of its character."""
    out = table[:256][buf]
    leads = np.flatnonzero(buf >= 0xC0)
    first = buf[leads]
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = leads[(first >= low) & (first < high)]
        if len(at):
            point = buf[at].astype(np.int64) - low
            for k in range(1, size):
                point = point << 6 | buf[at + k] & 0x3F
            for k in range(size):
                out[at + k] = table[point]
    return out


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and end; the last value is false."""
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    return edge[0::2], edge[1::2]


def _crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The crc32 of each word, and another 64-bit hash."""
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, _LONG + 1).astype(np.uint8), kind="stable")
    first, size = starts[order], sizes[order]
    crc, other = np.full(len(order), 0xFFFFFFFF, np.uint32), np.zeros(len(order), np.uint64)
    end = int(np.searchsorted(size, _LONG, side="right"))
    begins = np.searchsorted(size[:end], np.arange(_LONG), side="right")
    with np.errstate(over="ignore"):
        for i, a in enumerate(begins.tolist()):
            if a == end:
                break
            byte, old = buf[first[a:end] + i], crc[a:end]
            crc[a:end] = _CRC[(old ^ byte) & np.uint32(0xFF)] ^ old >> np.uint32(8)
            other[a:end] = (other[a:end] + byte + np.uint64(1)) * _FACTOR
    crc = ~crc
    for k in range(end, len(order)):
        word = buf[first[k] : first[k] + size[k]].tobytes()
        crc[k], other[k] = zlib.crc32(word), int.from_bytes(hashlib.blake2b(word, digest_size=8).digest())
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return crc[back], mix(other)[back]


def described(texts: list[str]) -> tuple[list[bytes], list[list[float]]]:
    """The word slots (sorted 32-bit numbers, packed) and ``figures`` of at most 1,024 texts. Words of a text are told apart by 54 bits of two hashes."""
    letter, kind = _kinds()
    n = len(texts)
    buf, begins = joined([t.lower() for t in texts])
    inside = _of_bytes(buf, letter)
    starts, ends = _runs(inside)
    words = np.diff(np.searchsorted(starts, begins))
    letters = np.add.reduceat(inside & (buf & 0xC0 != 0x80), begins[:-1], dtype=np.int64)
    crc, other = _crcs(buf, starts, ends)
    keys = np.repeat(np.arange(n, dtype=np.uint64), words) << np.uint64(54) | (crc & np.uint32(WORD_SLOTS - 1)).astype(np.uint64) << np.uint64(34) | other >> np.uint64(30)
    keys = distinct(keys)
    several = np.bincount((keys >> np.uint64(54)).astype(np.int64), minlength=n)
    pairs = distinct(keys >> np.uint64(34))
    edges = 4 * np.searchsorted(pairs, np.arange(n + 1, dtype=np.uint64) << np.uint64(20))
    packed = (pairs & np.uint64(WORD_SLOTS - 1)).astype(np.uint32).tobytes()
    slots = [packed[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    buf, begins = joined(texts)
    kinds = _of_bytes(buf, kind)
    starts, ends = _runs(kinds & _SPACE == 0)
    firsts = np.searchsorted(starts, begins)
    capital = np.zeros(len(starts), bool)
    capital[np.searchsorted(starts, np.flatnonzero(kinds & _UPPER), side="right") - 1] = True
    against = np.concatenate(([0], np.cumsum(kinds & _NO_UPPER != 0)))
    capital &= against[starts] == against[ends]
    upper = np.diff(np.concatenate(([0], np.cumsum(capital)))[firsts])
    marks = np.flatnonzero(kinds & sum(bit for bit, _ in _MARKS))
    of, which = np.searchsorted(begins, marks, side="right") - 1, kinds[marks]
    counts = [np.bincount(of[which & bit != 0], minlength=n).tolist() for bit, _ in _MARKS]
    symbols, shouts, digits, stops = counts
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    columns = (
        map(len, texts), words.tolist(), np.diff(firsts).tolist(), letters.tolist(), several.tolist(), symbols, upper.tolist(), shouts, digits, stops, map(len, lines), (len(set(x)) for x in lines)
    )
    return slots, [_shares(*row) for row in zip(*columns)]


def metadata(lang: str | None, source: str | None, n_chars: int | None, numbers: list[float]) -> list[int]:
    """Slots of the metadata view: one for each figure's bin, and those of the columns and of language with length."""
    size = -1 if n_chars is None else int(2 * math.log2(max(1, n_chars)))
    bins = [k * _BINS + min(_BINS - 1, int(_BINS * math.sqrt(max(0.0, x)))) for k, x in enumerate(numbers)]
    room, base = META_SLOTS - len(numbers) * _BINS, len(numbers) * _BINS
    return bins + [base + zlib.crc32(x.encode("utf-8", "surrogatepass")) % room for x in (f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang} size={size}")]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0, z) - y * z))


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, steps: int = 150, decay: float = 1e-2) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model over sets of features, by full-batch Adam. Without rows of both values it says the only one, or 0."""
    n = len(rows)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not n or labels.min() == labels.max():
        w[-1] = -20 if not n else (4 if labels[0] else -4)
        return w
    at, cols = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(at, w[cols], n) + w[-1])
        d = weight * (p - labels) / n
        g = np.append(np.bincount(cols, d[at], size) + decay * w[:-1] / n, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def select(rows: list[np.ndarray], labels: np.ndarray, size: int, least: int = 4, sure: float = 4.0) -> np.ndarray:
    """The slots whose share of the positive rows differs clearly from their share of the others."""
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(0, np.int64)
    pos, neg = (np.bincount(np.concatenate([s for s, y in zip(rows, labels) if (y > 0) == k]), minlength=size) for k in (True, False))
    a, b = labels.sum(), len(labels) - labels.sum()
    share = (pos + neg) / (a + b)
    z = (pos / a - neg / b) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / a + 1 / b))
    return np.flatnonzero((np.abs(z) > sure) & (pos + neg >= least))


def fit_words(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """A model of the text view. Its vocabulary is drawn from all rows at hand, those that the other view labelled included."""
    chosen = select(rows, labels, WORD_SLOTS)
    place = np.full(WORD_SLOTS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    small = fit([place[r][place[r] >= 0] for r in rows], labels, len(chosen))
    w = np.zeros(WORD_SLOTS + 1)
    w[chosen], w[-1] = small[:-1], small[-1]
    return w


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float) -> np.ndarray:
    """The logistic fit of ``y`` (0 to 1) on the columns of ``x``, with a pull towards ``start``: Newton steps, each halved until the loss falls."""
    c = start.copy()
    loss = lambda c: _loss(x @ c, y) + pull * float(((c - start) ** 2).sum()) / 2
    now = loss(c)
    for _ in range(50):
        p = _sigmoid(x @ c)
        g = x.T @ (p - y) + pull * (c - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (pull + 1e-9) * np.eye(len(c)), g)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        c = c - size * step
        last, now = now, loss(c)
        if last - now < 1e-9:
            break
    return c


def calibrated(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and bias of Platt's calibration of the scores ``x``; his targets keep it finite where a view makes no mistakes."""
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())
    y = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = _newton(np.stack([x, np.ones(len(x))], 1), y, np.array([0.0, math.log((pos + 1) / (neg + 1))]), 1e-3)
    return (float(a), float(b)) if a > 0 else (0.0, math.log((pos + 1) / (neg + 1)))


@dataclass
class Head:
    """One question (low quality, or toxicity): a model of each view (the last weight is the bias), and their calibration and combination."""

    words: np.ndarray
    meta: np.ndarray
    #: Slope and bias of each view, and the views' weights and the bias of the combination of calibrated logits.
    scales: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combine: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def logits(self, words: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """From sums of weights, bias included."""
        (a, b), (c, d) = self.scales
        u, v, w = self.combine
        return u * (a * words + b) + v * (c * meta + d) + w


@dataclass
class Sent:
    """A head as tasks get it: the few weights that are not 0, which go with the task's code, so nothing large stays in workers."""

    head: Head

    def __getstate__(self):
        packed = [(len(w), np.flatnonzero(w).astype(np.int32), w[w != 0]) for w in (self.head.words, self.head.meta)]
        return packed, self.head.scales, self.head.combine

    def __setstate__(self, state):
        packed, scales, combine = state
        weights = []
        for size, at, values in packed:
            weights.append(np.zeros(size))
            weights[-1][at] = values
        self.head = Head(*weights, scales, combine)


def calibrate(head: Head, words: np.ndarray, meta: np.ndarray, labels: np.ndarray) -> Head:
    """``head`` with each view calibrated and the two combined on rows that neither has seen; a view that would count against itself is left out."""
    if not len(labels) or labels.min() == labels.max():
        return head
    scales = calibrated(words, labels), calibrated(meta, labels)
    z = np.stack([a * x + b for (a, b), x in zip(scales, (words, meta))], 1)
    used = [k for k in (0, 1) if scales[k][0] > 0]
    weights = np.zeros(3)
    while used:
        start = np.append(np.full(len(used), 1 / len(used)), 0.0)
        c = _newton(np.column_stack([z[:, used], np.ones(len(z))]), labels.astype(float), start, 1.0)
        if (c[:-1] >= 0).all():
            weights[used], weights[2] = c[:-1], c[-1]
            break
        used = [used[int(np.argmax(c[:-1]))]] if len(used) > 1 else []
    if not used:
        weights = np.array([0.0, 0.0, scales[0][1] if scales[0][0] == 0 else calibrated(words * 0, labels)[1]])
    return Head(head.words, head.meta, scales, tuple(float(x) for x in weights))


def sums(raws: list[bytes], w: np.ndarray) -> np.ndarray:
    """The weights of each row's slots (packed 32-bit numbers) and the bias together."""
    ends = np.cumsum([len(r) // 4 for r in raws])
    total = np.concatenate(([0.0], np.cumsum(w[np.frombuffer(b"".join(raws), np.uint32)])))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))] + w[-1] if raws else np.zeros(0)


def features(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Both views of every document as sets of slots, and a number for each row; and the document's columns in ``more``."""

    def describe(batches):
        fresh_worker()
        row = TaskContext.get().partitionId() << _PART
        for whole in batches:
            for batch in (part.slice(i, 1024) for part in by_chars(whole, "text", 250_000) for i in range(0, part.num_rows, 1024)):
                texts, *columns = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
                words, numbers = described([t or "" for t in texts])
                meta = [np.array(sorted(set(metadata(*x))), np.uint32).tobytes() for x in zip(*columns, numbers)]
                columns = [pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), pa.array(words, pa.binary()), pa.array(meta, pa.binary()), *map(batch.column, more)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "words", "meta", *more])
                row += batch.num_rows

    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kinds = [*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)]
    return docs.mapInArrow(describe, ", ".join([f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary, meta binary", *kinds]))


def labels_of(labels: DataFrame) -> DataFrame:
    """``doc_id, low, toxic`` (1, 0 or null), once for each document: repeated labels count as the worst."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    return marks.where("low is not null or toxic is not null")


_PART = 40


def _labelled(place: str, numbers: np.ndarray, seen: dict[int, np.ndarray]) -> np.ndarray:
    """Which of these rows have a label, by the lists at ``place``: one for each task that numbered rows, read when its rows come by."""
    fs, base = pafs.FileSystem.from_uri(place) if "://" in place else (pafs.LocalFileSystem(), place)
    out = np.zeros(len(numbers), bool)
    for part in np.unique(numbers >> _PART).tolist():
        if part not in seen:
            seen.clear()
            there = fs.get_file_info(f"{base}/part={part}").type == pafs.FileType.Directory
            seen[part] = pads.dataset(f"{base}/part={part}", filesystem=fs, format="parquet").to_table(columns=["row"]).column("row").to_numpy() if there else np.zeros(0, np.int64)
        out |= np.isin(numbers, seen[part])
    return out


def confident(rows: DataFrame, heads: dict[str, Head], give: int, sure: float, labelled: str | None = None) -> DataFrame:
    """``head, view, value, row``: of the ``rows`` without a label (lists of those with one are at ``labelled``) the ``give`` that each view is surest
    of, for each head and value, if at least ``sure``.

    Every row is scored; a task passes on its own surest only, and of these the surest of all are taken.
    """
    told = {h: Sent(head) for h, head in heads.items()}

    def score(batches):
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            if labelled:
                batch = batch.filter(pa.array(~_labelled(labelled, batch.column("row").to_numpy(), seen)))
            number = batch.column("row").to_numpy()
            for name, sent in told.items():
                for view, (column, w) in enumerate((("words", sent.head.words), ("meta", sent.head.meta))):
                    p = _sigmoid(sums(batch.column(column).to_pylist(), w))
                    for value in (0, 1):
                        how = p if value else 1 - p
                        at = np.flatnonzero(how >= sure)
                        old = best.get((name, view, value), (np.zeros(0), np.zeros(0, np.int64)))
                        how, who = np.concatenate((old[0], how[at])), np.concatenate((old[1], number[at]))
                        top = np.lexsort((who, -how))[:give]
                        best[name, view, value] = how[top], who[top]
        for (name, view, value), (how, who) in best.items():
            n = len(who)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([view] * n, pa.int32()), pa.array([value] * n, pa.int32()), pa.array(how), pa.array(who)], ["head", "view", "value", "sure", "row"])

    found = rows.select("row", "words", "meta").mapInArrow(score, "head string, view int, value int, sure double, row long")
    rank = F.row_number().over(Window.partitionBy("head", "view", "value").orderBy(F.desc("sure"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= give).select("head", "view", "value", "row")


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS, rounds: int = ROUNDS, give: int = GIVE, sure: float = CONFIDENT) -> dict[str, Head]:
    """The heads, fitted on the driver on at most ``labelled`` labelled rows of ``rows`` (``features``) and what the views gave each other."""
    spark = rows.sparkSession
    # Only ids and numbers of rows are exchanged to find out which rows have labels; the views stay where they are.
    known = written(rows.select("row", "doc_id").join(labels_of(labels), "doc_id").select("row", "low", "toxic"), "labelled")
    listed = shared_place(spark, "labelled-rows")
    known.select(F.shiftright("row", _PART).alias("part"), "row").repartition("part").write.partitionBy("part").parquet(listed)
    n = known.count()
    if n > labelled:
        # A share by hash, and no more than the bound.
        known = known.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(labelled / n * (1 << 30))).limit(labelled)
    known = spark.createDataFrame([tuple(r) for r in known.collect()], "row long, low int, toxic int")  # at most ``labelled`` rows of three numbers
    table = rows.join(F.broadcast(known), "row").select("row", "words", "meta", "low", "toxic").toArrow()
    order = np.argsort(table.column("row").to_numpy(), kind="stable")
    views = [[np.frombuffer(table.column(c)[i].as_py(), np.uint32) for i in order.tolist()] for c in ("words", "meta")]
    truth = {h: np.array([-1 if x is None else int(x > 0) for x in table.column(h).to_pylist()], int)[order] for h in HEADS}
    held = np.arange(len(order)) % 4 == 3  # for calibration
    given: dict[tuple, dict[int, int]] = {(h, v): {} for h in HEADS for v in (0, 1)}
    extra: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fitted(h: str, v: int) -> np.ndarray:
        own = np.flatnonzero((truth[h] >= 0) & ~held)
        more = given[h, v]
        told = np.concatenate((truth[h][own], np.array(list(more.values()), int))).astype(float)
        known = [views[v][i] for i in own] + [extra[r][v] for r in more]
        return fit_words(known, told) if v == 0 else fit(known, told, META_SLOTS)

    heads = {h: Head(fitted(h, 0), fitted(h, 1)) for h in HEADS}
    for _ in range(rounds):
        chosen = confident(rows, heads, give, sure, listed).collect()  # at most 8 * give rows
        new = 0
        for r in sorted(chosen, key=lambda r: (r.head, r.view, r.value, r.row)):
            mine = given[r.head, 1 - r.view]
            new += r.row not in mine
            mine.setdefault(r.row, r.value)
        wanted = sorted({x for told in given.values() for x in told} - extra.keys())
        if not new:
            break
        if wanted:
            ids = spark.createDataFrame([(x,) for x in wanted], "row long")
            for r in rows.join(F.broadcast(ids), "row").select("row", "words", "meta").collect():
                extra[r.row] = np.frombuffer(r.words, np.uint32), np.frombuffer(r.meta, np.uint32)
        heads = {h: Head(fitted(h, 0), fitted(h, 1)) for h in HEADS}
    for h in HEADS:
        at = np.flatnonzero((truth[h] >= 0) & held)
        x, y = (np.array([w[views[v][i]].sum() + w[-1] for i in at]) for v, w in enumerate((heads[h].words, heads[h].meta)))
        heads[h] = calibrate(heads[h], x, y, truth[h][at])
    return heads


def score_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS, cut: float = 0.5, toxic_cut: float = 0.4, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, low_quality, toxicity, kept`` for every row of ``docs`` (``doc_id, text, lang, source, n_chars``), and its columns of these in ``more``.

    ``low_quality`` and ``toxicity`` are calibrated probabilities; a document is kept unless they are above ``cut`` and ``toxic_cut``.
    The models are fitted on at most ``labelled`` rows that ``labels`` (``doc_id, quality, toxic``) has a label of; repeated labels of a
    document count as its worst, and a label without its document, or with a null id, is not used. The views exchange labels over all other rows.
    Without labels of both values a head says its only value, without any nothing (0, not rejected). A null text is empty, null
    metadata a value of its own; rows with null or repeated ids are scored each, and rows alike get the same scores. A very long text is read whole. Empty tables
    give an empty one; other columns are ignored, whatever their names. Both views of each row are written to the shared folder once; every round, and
    the scoring, is a scan of them without an exchange of rows.
    """
    rows = written(features(docs, more), "views")
    told = {h: Sent(head) for h, head in train(rows, labels, labelled).items()}

    def score(batches):
        for batch in batches:
            raws = [batch.column(c).to_pylist() for c in ("words", "meta")]
            out = [_sigmoid(h.logits(sums(raws[0], h.words), sums(raws[1], h.meta))) for h in (told[x].head for x in HEADS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out), *map(batch.column, more)], ["doc_id", "low_quality", "toxicity", *more])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more)]
    out = rows.select("doc_id", "words", "meta", *more).mapInArrow(score, ", ".join([kinds[0], "low_quality double, toxicity double", *kinds[1:]]))
    return out.withColumn("kept", ~((F.col("low_quality") > cut) | (F.col("toxicity") > toxic_cut)))
