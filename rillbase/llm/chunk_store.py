"""A content-addressed store of token ids (operator 4).

A rolling hash over the ids cuts each document's stream into chunks; equal chunks are stored
once. A store is a folder:

* ``packs/``: files of chunks, each chunk the little-endian ids compressed with zstd;
* ``recipes/``: Parquet in ascending ``doc_id``: ``doc_id, start, n_tokens, root, part`` and for each chunk
  of the document its pack, offset, stored bytes and digest;
* ``manifest/``: Parquet, ``level, part, n, root``: on level 0 a row for each part of the recipes with its documents, on the
  levels above one for each ``FAN`` nodes of the level below, up to the single root of the store.

A document's root is the Merkle root of its chunk digests; a part's root is over its documents' roots, and so on upwards.
Reading checks every chunk against its digest, every document against its root and every node against the manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import zstandard
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillbase.llm.common import by_chars, shared_place, texts_of, written
from rillbase.llm.shingles import mix
from rillbase.llm.units import default_path, encoder

LEAST, MEAN, MOST, SPAN = 128, 512, 4096, 16
#: Documents of a part of the recipes, about; a part is read by one task.
PART_DOCS = 16_000
#: Nodes that a node of the manifest is over at most.
FAN = 4096
_GEAR = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def marks(ids: np.ndarray) -> np.ndarray:
    """The places after which the rolling hash of the last ``SPAN`` ids has its highest bits clear."""
    with np.errstate(over="ignore"):
        g = _GEAR[ids & ids.dtype.type(0xFFFF)] + (ids.astype(np.uint32) >> np.uint32(16)).astype(np.uint64)
        for step in (1, 2, 4, 8):  # SPAN of 16 by doubling
            g = np.concatenate((g[:step], g[step:] + (g[:-step] << np.uint64(step))))
    return np.flatnonzero(g >> np.uint64(64 - (MEAN - 1).bit_length()) == 0) + 1


def boundaries(begin: int, end: int, places: list[int]) -> list[int]:
    """Ends of the chunks of a document from ``begin`` to ``end`` of a stream with marks at ``places`` (those in the document), ``LEAST`` to
    ``MOST`` ids apart. A mark counts only where its whole span is in the document, since that is shorter than ``LEAST``."""
    ends, last = [], begin
    for m in [*places, end]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or (m == end and m > last):
            ends.append(m)
            last = m
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 hashes; an odd node moves up, no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


_STAGED = "doc_id long, n_tokens long, pack string, digests array<binary>, offsets array<long>, sizes array<int>"


def _staged(docs: DataFrame, path: str, end_id: int, packs: str) -> DataFrame:
    """Encode and chunk; chunks go into a pack of the task attempt, each once. Packs of lost attempts are named by no row."""

    def stage(batches):
        encode, compress = encoder(path), zstandard.ZstdCompressor(level=1).compress
        fs, base = _filesystem(packs)
        fs.create_dir(base, recursive=True)
        name, at, seen = f"{uuid.uuid4().hex}.pack", 0, {}
        with fs.open_output_stream(f"{base}/{name}") as out:
            for whole in batches:
                for batch in by_chars(whole, "text"):
                    rows = []
                    ids, edges = encode.ended(batch.column("text"), end_id)
                    stream, places, width = ids.tobytes(), marks(ids), ids.itemsize
                    cuts = np.searchsorted(places, edges, side="right").tolist()
                    places = places.tolist()
                    for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                        digests, offsets, sizes, last = [], [], [], edges[i]
                        for end in boundaries(edges[i], edges[i + 1], places[cuts[i] : cuts[i + 1]]):
                            plain = stream[last * width : end * width]
                            last = end
                            digest = hashlib.sha256(plain).digest()[:20]
                            if digest not in seen:
                                if len(seen) >= 1 << 18:  # bounds the task's memory; the index below unites what recurs
                                    seen.clear()
                                packed = compress(plain)
                                out.write(packed)
                                seen[digest] = (at, len(packed))
                                at += len(packed)
                            digests.append(digest), offsets.append(seen[digest][0]), sizes.append(seen[digest][1])
                        rows.append((doc, edges[i + 1] - edges[i], name, digests, offsets, sizes))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], ["doc_id", "n_tokens", "pack", "digests", "offsets", "sizes"])

    return docs.mapInArrow(stage, _STAGED)


def _compacted(owned: DataFrame, source: str, target: str) -> DataFrame:
    """Copy each chunk that has this place as its home into a pack of the final store: ``digest, pack, offset, size``."""

    def copy(batches):
        src, base = _filesystem(source)
        dst, to = _filesystem(target)
        dst.create_dir(to, recursive=True)
        name, at, opened, file = f"{uuid.uuid4().hex}.pack", 0, None, None
        with dst.open_output_stream(f"{to}/{name}") as out:
            for batch in batches:
                offsets = []
                for pack, offset, size in zip(*(batch.column(c).to_pylist() for c in ("pack", "offset", "size"))):
                    if pack != opened:
                        file, opened = src.open_input_file(f"{base}/{pack}"), pack
                    file.seek(offset)
                    out.write(file.read(size))
                    offsets.append(at)
                    at += size
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([name] * batch.num_rows), pa.array(offsets, pa.int64()), batch.column("size")], ["digest", "pack", "offset", "size"])

    ordered = owned.repartition("pack").sortWithinPartitions("pack", "offset")
    return ordered.select("digest", "pack", "offset", "size").mapInArrow(copy, "digest binary, pack string, offset long, size int")


def write_store(docs: DataFrame, place: str, path: str | None = None, end_id: int = 2) -> None:
    """Write the store of ``docs`` (``doc_id`` long, ``text``) at ``place``. Null texts are empty: one chunk with the end id.

    Rows that share a ``doc_id`` stay rows of their own, in the order of their chunk digests; null ids come first. An empty table gives an
    empty store. A very long text is many chunks; other columns are ignored, whatever their names. Chunks meet by digest only: no payload is
    exchanged, and a chunk of a third of all documents is one index row for each task before the exchange.
    """
    spark = docs.sparkSession
    staging = shared_place(spark, "packs")
    staged = written(_staged(texts_of(docs), path or default_path(), end_id, staging), "staged")
    places = staged.select(F.explode(F.arrays_zip("digests", "offsets", "sizes")).alias("c"), "pack")
    first = places.groupBy(F.col("c.digests").alias("digest")).agg(F.min(F.struct("pack", F.col("c.offsets").alias("offset"), F.col("c.sizes").alias("size"))).alias("at"))
    moved = written(_compacted(first.select("digest", "at.*"), staging, f"{place}/packs"), "chunks")
    _drop_packs(staging, set())
    _drop_packs(f"{place}/packs", {r.pack for r in moved.select("pack").distinct().collect()})  # a name for each task
    order = [F.col("doc_id").asc_nulls_first(), F.col("digests")]
    n = max(1, staged.count() // PART_DOCS)
    ranged = staged.select("doc_id", "n_tokens", "digests").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part of PART_DOCS documents.
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.join(sums, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    starts = written(starts.select("doc_id", "row", "part", "start", "n_tokens", "digests"), "starts")
    links = starts.select("row", F.posexplode("digests").alias("i", "digest")).join(moved, "digest")
    gathered = links.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "pack", "offset", "size", "digest"))).alias("chunks"))
    recipes = starts.drop("digests").join(gathered, "row")

    def rooted(batches):
        for batch in batches:
            roots = [merkle([c["digest"] for c in chunks]) for chunks in batch.column("chunks").to_pylist()]
            yield batch.append_column("root", pa.array(roots, pa.binary()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recipes.schema) + ", root binary"
    recipes.mapInArrow(rooted, schema).repartitionByRange(n, "row").sortWithinPartitions("row").write.option("compression", "zstd").parquet(f"{place}/recipes")
    _manifest(spark.read.parquet(f"{place}/recipes")).write.parquet(f"{place}/manifest")


def _drop_packs(place: str, kept: set[str]) -> None:
    """Delete the packs at ``place`` that are not ``kept``: those of a store being made, or of attempts that were lost."""
    fs, base = _filesystem(place)
    for file in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if file.base_name not in kept:
            fs.delete_file(file.path)


def _manifest(rows: DataFrame) -> DataFrame:
    """``level, part, n, root`` of rows with ``part, row, root``. A node is over a bounded number of others, so no task or driver has them all."""

    def root(batches):
        for batch in batches:
            roots = [merkle([leaf["root"] for leaf in leaves]) for leaves in batch.column("leaves").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("n"), pa.array(roots, pa.binary())], ["part", "n", "root"])

    def above(nodes: DataFrame, part: Column) -> DataFrame:
        leaves = F.sort_array(F.collect_list(F.struct("row", "root"))).alias("leaves")
        return nodes.groupBy(part.cast("long").alias("part")).agg(leaves, F.count(F.lit(1)).alias("n")).mapInArrow(root, "part long, n long, root binary")

    level = written(above(rows, F.col("part")), "manifest")
    out, k = level.select(F.lit(0).alias("level"), "part", "n", "root"), 0
    while level.count() > 1:
        k += 1
        level = written(above(level.withColumnRenamed("part", "row"), F.floor(F.col("row") / FAN)), "manifest")
        out = out.unionByName(level.select(F.lit(k).alias("level"), "part", "n", "root"))
    return out


def read_store(spark, place: str, ids: bool = False, wide: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` as little-endian 32-bit integers) of every document, each chunk and document verified.

    ``wide``: chunks hold 32-bit ids (tokenizers with more than 65,536), else 16-bit ones.
    """
    recipes = spark.read.parquet(f"{place}/recipes")
    dtype = "<u4" if wide else "<u2"

    def read(batches):
        fs, base = _filesystem(f"{place}/packs")
        files: dict[str, object] = {}
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            listed = batch.column("chunks")
            flat = listed.flatten()
            ends = np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False)).tolist()
            every = [dict(zip(("pack", "offset", "size", "digest"), x)) for x in zip(*(flat.field(c).to_pylist() for c in ("pack", "offset", "size", "digest")))]
            for i, (doc, row, part, start, n, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "part", "start", "n_tokens", "root")))):
                plain = []
                for c in every[ends[i - 1] if i else 0 : ends[i]]:
                    if c["pack"] not in files:
                        if len(files) >= 64:
                            files.clear()
                        files[c["pack"]] = fs.open_input_file(f"{base}/{c['pack']}")
                    file = files[c["pack"]]
                    file.seek(c["offset"])
                    plain.append(decompress(file.read(c["size"])))
                    if hashlib.sha256(plain[-1]).digest()[:20] != c["digest"]:
                        raise ValueError(f"a chunk of document {doc} isn't the one its recipe names")
                if merkle([c["digest"] for c in every[ends[i - 1] if i else 0 : ends[i]]]) != root:  # these are the plain chunks' own, as just seen
                    raise ValueError(f"document {doc} doesn't have the root that its recipe names")
                found = np.frombuffer(b"".join(plain), dtype).astype("<u4")
                if len(found) != n:
                    raise ValueError(f"document {doc} has {len(found)} ids, its recipe names {n}")
                raw = found.tobytes()
                rows.append((doc, row, part, root, start, n, zlib.crc32(raw), raw if ids else None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], ["doc_id", "row", "part", "root", "start", "n_tokens", "ids_crc32", "ids"])

    return recipes.mapInArrow(read, "doc_id long, row long, part int, root binary, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the store of ``docs``, read it back and check it against its manifest: ``doc_id, start, n_tokens, ids_crc32``."""
    spark, path = docs.sparkSession, path or default_path()
    place = shared_place(spark, "store")
    write_store(docs, place, path, end_id)
    read = written(read_store(spark, place, wide=encoder(path).dtype.itemsize == 4), "read")
    told = spark.read.parquet(f"{place}/manifest").withColumnRenamed("root", "told")
    odd = _manifest(read).join(told, ["level", "part", "n"], "full").where(~F.col("root").eqNullSafe(F.col("told")))
    if not odd.isEmpty():
        raise ValueError("the documents read aren't those of the manifest")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")
