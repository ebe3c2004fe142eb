"""Near-duplicate classes by bit-sampling over SimHash (operator 7).

Every distinct set of five-word shingles has a 256-bit SimHash. Several tables each group the
sets by a few sampled coordinates; a bucket above the cap is split by additional sampled
coordinates, in several draws so that a pair at the threshold stays together in one of them;
candidates within the Hamming bound are verified by the Jaccard similarity of their shingles.
Verified links become classes. Sets of a few shingles, whose SimHashes differ most, are linked exactly, by what is left of them
without one or two shingles. Where a group is large, a member names only its nearest
candidates at first, and all its candidates of other classes in a second round.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.llm.common import by_chars, fresh_worker, texts_of, written
from rillbase.llm.components import components
from rillbase.llm.shingles import distinct, mix, text_shingles

BITS, TABLES, SAMPLED, CAP, NEAREST = 256, 32, 10, 512, 4
#: Bits that two sets may differ in: a pair at similarity 0.8 differs in 38.8 on average, with deviation 5.7.
DISTANCE = 60
#: The chance that a bit of two sets at similarity 0.8 agrees.
AGREE = 0.8485
#: Shingles of a set that is linked exactly as well, at most. The smaller of two linked sets has nine at least where the larger has more.
SHORT = 11

_WORDS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes as ``BITS`` zeros and ones.

    The votes are added up eight in a 64-bit number, 255 hashes at most at a time.
    """
    with np.errstate(over="ignore"):
        wide = mix(shingles[:, None] + _WORDS).view(np.uint8).reshape(len(shingles), -1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(wide), 255):
        ones += np.add.reduce(np.unpackbits(wide[i : i + 255], axis=1, bitorder="little").view(np.uint64), axis=0).view(np.uint8)
    return (2 * ones > len(shingles)).astype(np.uint8)


def _coordinates(tables: int, sampled: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.stack([rng.choice(BITS, sampled, replace=False) for _ in range(tables)])


def _names(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit halves of a name of each set of hashes, none of them empty; names of sets without common elements add up."""
    if not sets:
        return [], []
    values, edges = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(mix(x), edges).astype(np.int64).tolist() for x in (values, values ^ _WORDS[1]))


def _rests(s: np.ndarray) -> bytes:
    """For a set of 4 to ``SHORT`` hashes the names of what is left of it without none, one or two of them, and how many: 64-bit numbers, packed."""
    n = len(s)
    if not 4 <= n <= SHORT:
        return b""
    with np.errstate(over="ignore"):
        one, two = mix(s), mix(s ^ _WORDS[1])
        a, b = one.sum(), two.sum()
        out = [(a, b, 0)]
        out += [(a - one[i], b - two[i], 1) for i in range(n) if n > 4]
        # Two sets at 0.8 of which one has two more have 8 and 10 at least.
        out += [(a - one[i] - one[j], b - two[i] - two[j], 2) for i in range(n) for j in range(i) if n > 9]
    return np.array(out, np.uint64).tobytes()


def short_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that join all sets of at most ``SHORT`` shingles that are similar enough (0.8 at least), exactly.

    Sets that share a rest have that in common and differ in what was taken away, so what each lost tells whether they are similar. The set that
    lost least is linked with the others: if any two are similar, so is each with it.
    """

    def rests(batches):
        for batch in batches:
            raws = batch.column("rests").to_pylist()
            table = np.frombuffer(b"".join(raws), np.uint64).reshape(-1, 3).astype(np.int64)
            times = np.array([len(r) // 24 for r in raws], np.int64)
            columns = [table[:, 0], table[:, 1], table[:, 2], *(np.repeat(batch.column(c).to_numpy(), times) for c in ("id", "n"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "lost", "id", "n"])

    keyed = sets.where(f"n between 4 and {SHORT}").select("id", "n", "rests").mapInArrow(rests, "one long, two long, lost long, id long, n long")
    least = keyed.groupBy("one", "two").agg(F.min(F.struct("lost", "id")).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    rest = F.col("n") - F.col("lost")
    alike = rest >= similarity * (rest + F.col("lost") + F.col("least.lost")) - 1e-9
    return keyed.join(least, ["one", "two"]).where(alike & (F.col("id") != F.col("least.id"))).select(F.least("id", "least.id").alias("a"), F.greatest("id", "least.id").alias("b")).distinct()


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set1, set2, bits, rests``: size, 128-bit name of the shingle set, packed SimHash, and of a small set its rests; no row for a text without words."""

    def describe(batches):
        fresh_worker()
        for whole in batches:
            for batch in by_chars(whole, "text", 500_000):
                ids, sets = batch.column("doc_id").to_pylist(), text_shingles(batch.column("text").to_pylist())
                kept = [i for i, s in zip(ids, sets) if len(s)]
                sets = [s for s in sets if len(s)]
                columns = [len(s) for s in sets], *_names(sets), [np.packbits(simhash(s)).tobytes() for s in sets], [_rests(s) for s in sets]
                kinds = [pa.int64()] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n", "set1", "set2", "bits", "rests"])

    return texts_of(docs).where("doc_id is not null").mapInArrow(describe, "doc_id long, n long, set1 long, set2 long, bits binary, rests binary")


def _bits_of(batch: pa.RecordBatch) -> np.ndarray:
    """The packed SimHashes of a batch, a row each."""
    column = batch.column("bits")
    width = BITS // 8
    return np.frombuffer(column.buffers()[2], np.uint8)[width * column.offset :][: width * len(column)].reshape(-1, width)


def bucket_rows(sets: DataFrame, tables: int = TABLES, sampled: int = SAMPLED) -> DataFrame:
    """``key, id, bits`` for each set and table; the key holds the table and its sampled coordinates."""
    at = _coordinates(tables, sampled)
    weights = (1 << np.arange(sampled)).astype(np.int64)
    offsets = (np.arange(tables) << sampled).astype(np.int64)

    def keys(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                bits = np.unpackbits(_bits_of(part), axis=1)
                key = bits[:, at].astype(np.int64) @ weights + offsets
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), pa.array(np.repeat(part.column("id").to_numpy(), tables)), part.column("bits").take(pa.array(np.repeat(np.arange(part.num_rows), tables)))], ["key", "id", "bits"]
                )

    return sets.select("id", "bits").mapInArrow(keys, "key long, id long, bits binary")


def _near(bits: np.ndarray, block: int = 256):
    """Blocks ``(rows, first column, distance)`` of the Hamming distances, of ``bits`` (n, 4 words) against those before."""
    words = np.ascontiguousarray(bits.T)
    for i in range(0, len(bits), block):
        for j in range(0, i + 1, block):
            a, b, c, d = (np.bitwise_count(w[i : i + block, None] ^ w[j : j + block]) for w in words)
            yield i, j, np.add(a + b, c + d, dtype=np.int16)  # two words differ in 128 bits at most


def candidates(ids: np.ndarray, words: np.ndarray, labels: np.ndarray | None, distance: int = DISTANCE, nearest: int = NEAREST):
    """Pairs within ``distance`` with their distance, and whether some were left for later: in a group of more than 8 * ``nearest`` each
    member names its ``nearest`` earlier ones. With ``labels`` all pairs of different labels are named."""
    pairs, left = [], False
    few = labels is None and len(ids) > 8 * nearest
    best, now = [], 0

    def nearest_of(rows, columns, apart):
        nonlocal left
        order = np.lexsort((columns, apart, rows))
        rows, columns, apart = rows[order], columns[order], apart[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        left |= bool((rank >= nearest).any())
        return rows[rank < nearest], columns[rank < nearest], apart[rank < nearest]

    def named(rows, columns, apart):
        pairs.append(np.stack([np.minimum(ids[rows], ids[columns]), np.maximum(ids[rows], ids[columns]), apart], 1))

    for i, j, d in _near(words):
        if best and i != now:
            named(*nearest_of(*(np.concatenate(x) for x in zip(*best))))
            best = []
        now = i
        close = d <= distance
        if i == j:
            close &= np.tri(*d.shape, -1, bool)
        if not close.any():
            continue
        rows, columns = np.divmod(np.flatnonzero(close), close.shape[1])
        apart = d[rows, columns].astype(np.int64)
        rows, columns = rows + i, columns + j
        if few:
            best.append(nearest_of(rows, columns, apart))
            continue
        if labels is not None:
            other = labels[rows] != labels[columns]
            rows, columns, apart = rows[other], columns[other], apart[other]
        named(rows, columns, apart)
    if best:
        named(*nearest_of(*(np.concatenate(x) for x in zip(*best))))
    return (np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)), left


def _groups(bits: np.ndarray, key: int, cap: int):
    """The bucket itself, or if it is above the cap its parts by additional sampled coordinates, in several draws; but the bucket itself too where
    its pairs take about as long as those of all draws, with what each part takes besides, or less."""
    n = len(bits)
    extra = min(40, ceil(log2(max(1, n / cap))) + 1)
    draws = ceil(log(0.01) / log(1 - AGREE**extra))
    if n <= cap or 2**extra <= 3 * draws:
        yield np.arange(n)
        return
    rng = np.random.default_rng(key)
    plain = np.unpackbits(bits, axis=1)
    for _ in range(draws):
        code = plain[:, rng.choice(BITS, extra, replace=False)].astype(np.int64) @ (1 << np.arange(extra, dtype=np.int64))
        order = np.argsort(code, kind="stable")
        yield from (g for g in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(g) > 1)


def bucket_pairs(rows: DataFrame, cap: int = CAP, distance: int = DISTANCE, nearest: int = NEAREST) -> DataFrame:
    """``kind, a, b, apart, bits`` over ``key, id, bits[, label]``: kind 0 has candidate pairs; kind 1 members (``a``) of groups (``b``) in which some were left for later."""
    labelled = "label" in rows.columns

    def pair(batches):
        fresh_worker()
        held: list[tuple] = []
        group_no = 0

        def close():
            nonlocal group_no
            ids, bits = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            labels = np.concatenate([h[2] for h in held]) if labelled else None
            out, rest = [], []
            for g in _groups(bits, key_now, cap):
                words = np.ascontiguousarray(bits[g]).view(np.uint64)
                pairs, left = candidates(ids[g], words, None if labels is None else labels[g], distance, nearest)
                out.append(pairs)
                if left:
                    rest.append((np.full(len(g), (key_now << 20) + group_no), g))
                    group_no += 1
            pairs = np.unique(np.concatenate(out or [np.zeros((0, 3), np.int64)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2]), pa.nulls(len(pairs), pa.binary())], ["kind", "a", "b", "apart", "bits"])
            for numbers, g in rest:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(g), np.int32)), pa.array(ids[g]), pa.array(numbers), pa.nulls(len(g), pa.int64()), pa.array([x.tobytes() for x in bits[g]], pa.binary())], ["kind", "a", "b", "apart", "bits"])

        key_now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            bits = _bits_of(batch)
            labels = batch.column("label").to_numpy() if labelled else ids
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if held and keys[a] != key_now:
                    if sum(len(h[0]) for h in held) > 1:
                        yield from close()
                    held = []
                key_now = int(keys[a])
                held.append((ids[a:b], bits[a:b], labels[a:b]))
        if held and sum(len(h[0]) for h in held) > 1:
            yield from close()

    ordered = rows.repartition("key").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(pair, "kind int, a long, b long, apart long, bits binary")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, block: int = 1024) -> DataFrame:
    """Links ``a, b`` that join what the pairs (``a, b, apart``) of at least this Jaccard similarity join.

    Pairs meet the sets of their members in groups: a connected group of candidates, or a pair of its blocks where it has more than
    about ``block`` members. So a set is sent once for each group, not for each pair, and a group is bounded. In a group, nearer pairs come
    first, and a pair whose ends are already joined is not looked at.
    """
    pairs = written(pairs.groupBy("a", "b").agg(F.min("apart").alias("apart")), "pairs")
    members = written(components(pairs.select("a", "b")), "members")
    large = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    placed = members.join(large, "component", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)), F.lit(0)))
    one = placed.select(F.col("id").alias("a"), "component", F.col("block").alias("block_a"))
    two = placed.select(F.col("id").alias("b"), F.col("block").alias("block_b"))
    keyed = pairs.join(one, "a").join(two, "b")
    keyed = written(keyed.select(F.xxhash64("component", F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("key"), "a", "b", "apart"), "keyed")
    wanted = keyed.select("key", F.col("a").alias("doc_id")).unionByName(keyed.select("key", F.col("b").alias("doc_id"))).distinct()

    def sets(batches):
        for whole in batches:
            for batch in by_chars(whole, "text", 500_000):
                found = [distinct((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in text_shingles(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "s"])

    # A document of several rows is described by each; any of them may be compared.
    described = texts_of(docs).join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary").dropDuplicates(["doc_id"])

    def compare(batches):
        now, held, parent = None, {}, {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for batch in batches:
            links = []
            for key, kind, a, b, s in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "a", "b", "s"))):
                if key != now:
                    now, held, parent = key, {}, {}
                if kind == 0:
                    held[a] = np.frombuffer(s, np.uint32)
                    continue
                p, q = root(a), root(b)
                x, y = held[a], held[b]
                if p == q or min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    parent[max(p, q)] = min(p, q)
                    links.append((a, b))
            columns = list(zip(*links)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], ["a", "b"])

    none = F.lit(None).cast("long")
    rows = wanted.join(described, "doc_id").select("key", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), none.alias("b"), none.alias("apart"), "s")
    rows = rows.unionByName(keyed.select("key", F.lit(1).alias("kind"), "a", "b", "apart", F.lit(None).cast("binary").alias("s")))
    return rows.repartition("key").sortWithinPartitions("key", "kind", "apart", "a", "b").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, tables: int = TABLES, sampled: int = SAMPLED, cap: int = CAP, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, class_id, class_docs, kept`` for every row of ``docs`` (``doc_id`` long, ``text``).

    A class is a connected group of texts linked at a Jaccard similarity of at least ``similarity`` over their
    sets of five-word shingles (a text of one to four words is one shingle); its id is its least ``doc_id``, whose
    document is kept. Texts without words, null texts and rows with a null id are classes of their own. Rows that
    share a ``doc_id`` are one document if their texts have the same shingles, and are linked if not; all their rows are kept
    or dropped together. Equal sets are one representative from the start, so copies are never compared with each other.
    """
    facts = written(features(docs), "simhash")
    sets = facts.groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("id"), F.min("bits").alias("bits"), F.min("rests").alias("rests"))
    sets = written(sets.select("id", "set1", "set2", "n", "bits", "rests"), "simhash-sets")
    found = written(bucket_pairs(bucket_rows(sets, tables, sampled), cap, distance), "simhash-pairs")
    links = verified(found.where("kind = 0").select("a", "b", "apart"), docs, similarity)
    links = written(links.unionByName(short_links(sets, similarity)), "links")
    rest = found.where("kind = 1").select(F.col("b").alias("key"), F.col("a").alias("id"), "bits")
    if not rest.isEmpty():
        # What large groups left for later: all candidates whose ends are in different classes.
        labels = components(links)
        labelled = rest.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        more = written(bucket_pairs(labelled.select("key", "id", "bits", "label"), 1 << 62, distance).where("kind = 0").select("a", "b", "apart"), "later")
        if not more.isEmpty():
            links = written(links.unionByName(verified(more, docs, similarity)), "links")
    same = facts.join(sets.select("set1", "set2", "n", "id"), ["set1", "set2", "n"]).select("doc_id", "id")
    twice = same.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("a", "b")
    labels = components(links.unionByName(twice))
    of_doc = same.groupBy("doc_id").agg(F.min("id").alias("id")).join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("class_id"))
    of_doc = written(of_doc, "classes")
    sizes = of_doc.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_docs"))
    classed = of_doc.join(sizes.where("class_docs > 1"), "class_id", "left").select("doc_id", "class_id", F.coalesce("class_docs", F.lit(1)).alias("class_docs"))
    out = docs.select("doc_id").join(classed, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_docs", F.lit(1)).cast("long").alias("class_docs"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
