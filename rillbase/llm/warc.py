"""WARC archives as a Spark data source (operator 9).

Writing gives one archive for each task, gzipped record by record, and sidecars of record offsets. Reading plans one
partition for each stretch of whole records, or where there are no sidecars for each file, takes equality predicates on
``record_type`` and on header columns from the planner, parses a record's headers first, and steps over the
payload of a record that the predicates refuse or whose payload isn't asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from rillbase.llm.common import shared_place

HEADERS = {"record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
READ_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
WRITE_SCHEMA = "record_id string, target_uri string, refers_to string, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
#: Holds a target URI that can't stand in a header as it is, in base64.
_RAW_URI = "X-Target-URI-Base64"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str = _DATE) -> bytes:
    """One record: a response, or a revisit without its payload if it refers to another record.

    Control characters of ``uri`` are percent-encoded; where that or white space at its ends changes it, a header of its own keeps the
    original. Ids may have none.
    """
    if any(_CONTROL.search(x) for x in (record_id, refers_to or "", date)):
        raise ValueError("a record's id and date may not have control characters")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    plain = None if uri is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri).strip()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {plain}"] if uri is not None else []),
        *([f"{_RAW_URI}: {base64.b64encode(uri.encode()).decode()}"] if plain != uri else []), f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class _Wrote(WriterCommitMessage):
    name: str
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.stretch, self.gzip = options["path"], int(options.get("stretchbytes", 16 << 20)), options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        """Attempts write under names of their own; ``commit`` lists those that count."""
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}", 0
        offsets, stretches = [], []
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in iterator:
                for rid, uri, ref, payload in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "refers_to", "payload"))):
                    raw = record(rid, uri, payload or b"", ref)
                    if self.gzip:
                        raw = gzip.compress(raw, 1, mtime=0)
                    if not stretches or at - offsets[stretches[-1]] >= self.stretch:
                        stretches.append(len(offsets))
                    offsets.append(at)
                    out.write(raw)
                    at += len(raw)
        for end, numbers in ((".offsets", [*offsets, at]), (".stretches", [*stretches, len(offsets)])):
            with fs.open_output_stream(f"{base}/{name}{end}") as out:
                out.write(struct.pack(f"<{len(numbers)}q", *numbers))
        return _Wrote(name, len(offsets))

    def commit(self, messages):
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest.json") as out:
            out.write(json.dumps({m.name: m.records for m in messages if m}).encode())

    def abort(self, messages):
        fs, base = _filesystem(self.path)
        for m in messages:
            if m:
                for end in ("", ".offsets", ".stretches"):
                    fs.delete_file(f"{base}/{m.name}{end}")


@dataclass
class _Stretch(InputPartition):
    name: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("record_type", *HEADERS) and isinstance(f, (EqualTo, In)) and None not in (values := {f.value} if isinstance(f, EqualTo) else set(f.value)):
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self):
        fs, base = _filesystem(self.path)
        if fs.get_file_info(f"{base}/manifest.json").type == pafs.FileType.NotFound:
            # Archives from elsewhere: a file is read from its begin.
            files = fs.get_file_info(pafs.FileSelector(base, recursive=True)) if fs.get_file_info(base).type == pafs.FileType.Directory else [fs.get_file_info(base)]
            names = sorted(f.path for f in files if f.path.endswith((".warc", ".warc.gz")))
            return [_Stretch(n, 0, -1) for n in names] or [_Stretch("", 0, 0)]
        with fs.open_input_stream(f"{base}/manifest.json") as file:
            names = [n for n, k in json.loads(file.read()).items() if k]
        parts = []
        for name in sorted(names):
            with fs.open_input_stream(f"{base}/{name}.stretches") as file:
                numbers = _numbers(file.read())
            parts += [_Stretch(name, a, b) for a, b in zip(numbers, numbers[1:])]
        return parts or [_Stretch("", 0, 0)]

    def read(self, part):
        if not part.name:
            return
        fs, base = _filesystem(self.path)
        offsets, name = None, part.name
        if part.end >= 0:
            name = f"{base}/{part.name}"
            with fs.open_input_file(f"{name}.offsets") as file:
                file.seek(part.begin * 8)
                offsets = _numbers(file.read((part.end - part.begin + 1) * 8))
        with fs.open_input_file(name) as file:
            rows, held = [], 0
            for take, at in _indexed(file, offsets, name.endswith(".gz")) if offsets else _walked(file, name.endswith(".gz")):
                row = self._record(take, at)
                if row is None:
                    continue
                rows.append(row)
                held += len(row[-1] or b"") + 300
                if held > 8 << 20 or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _record(self, take, at: int) -> tuple | None:
        """The row of a record, or None if the predicates refuse it; nothing beyond what that needs is taken."""
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            if not (more := take(1024)):
                raise ValueError(f"the record at {at} is cut short")
            head += more
        lines = head[:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        named = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        length = int(named["content-length"])
        take.length = cut + 4 + length
        values = {c: named.get(h.lower()) for c, h in HEADERS.items()}
        values = {c: v.strip("<>") if v and c in ("record_id", "refers_to") else v for c, v in values.items()}
        if raw := named.get(_RAW_URI.lower()):
            values["target_uri"] = base64.b64decode(raw).decode()
        told = values["payload_digest"] = (values["payload_digest"] or "").removeprefix("sha1:") or None
        kind = named["warc-type"]
        if any((kind if c == "record_type" else values[c]) not in v for c, v in self.wanted.items()):
            return None
        http = named.get("content-type", "").startswith("application/http")
        wanted = self.payloads and kind != "revisit"
        block, most = head[cut + 4 :][:length], length if wanted else min(length, 4096) if http else 0
        while len(block) < most:
            if not (more := take(most - len(block))):
                raise ValueError(f"the record at {at} is cut short")
            block += more
        inner, gap, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        sizes = [int(x.split(b":")[1]) for x in inner.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = sizes[0] if sizes else length - len(inner) - len(gap)
        if wanted and told and (len(payload) != size or digest(payload) != told):
            raise ValueError(f"the payload of {values['record_id']} isn't the one its headers name")
        return kind, values["record_id"], values["target_uri"], told, values["refers_to"], size, payload if wanted else None


def _numbers(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 8}q", raw)


class _Plain:
    """Gives the next bytes of a record, at most as many as asked; no more is read."""

    length = 0

    def __init__(self, file, at: int, end: int):
        file.seek(at)
        self.file, self.left = file, end - at

    def __call__(self, n: int) -> bytes:
        raw = self.file.read(min(n, self.left))
        self.left -= len(raw)
        return raw


class _Inflated(_Plain):
    """The same of a gzip member; no more is inflated."""

    def __init__(self, file, at: int, end: int):
        super().__init__(file, at, end)
        self.inflate, self.waiting = zlib.decompressobj(31), b""

    def __call__(self, n: int) -> bytes:
        while not self.inflate.eof:
            if not self.waiting and not (more := super().__call__(max(2048, n // 2))):
                return b""
            elif not self.waiting:
                self.waiting = more
            raw = self.inflate.decompress(self.waiting, n)
            self.waiting = self.inflate.unconsumed_tail
            if raw:
                return raw
        return b""


def _indexed(file, offsets: tuple[int, ...], packed: bool):
    """``taker, place`` of each record between neighbouring ``offsets``."""
    for at, end in zip(offsets, offsets[1:]):
        yield (_Inflated if packed else _Plain)(file, at, end), at


def _walked(file, packed: bool):
    """``taker, place`` of each record of a file whose offsets aren't known: what was not taken of a record is stepped over, or inflated and dropped."""
    at, end = 0, file.size()
    while at < end:
        take = (_Inflated if packed else _Plain)(file, at, end)
        yield take, at
        if packed:
            while take(1 << 16):
                pass
            at = end - take.left - len(take.inflate.unused_data)
        else:
            at += take.length
            file.seek(at)
            gap = file.read(64)
            at += len(gap) - len(gap.lstrip(b"\r\n"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options ``path``, ``payloads`` (read), ``stretchbytes`` and ``compression`` (write: gzip, one member for each record, or none)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


_PAGE = "urn:x-page:"


def _id(page_id, text: bool):
    """The record id of a page; what can't stand in a header of an id that is ``text`` is percent-encoded."""
    return F.concat(F.lit(_PAGE), F.url_encode(page_id) if text else page_id.cast("string"))


def archive_pages(pages: DataFrame, place: str, least_bytes: int = 0) -> None:
    """Write every row of ``pages`` (``page_id``, ``url``, ``html``) as a record of the archives at ``place``.

    Of the rows with equal payloads of at least ``least_bytes`` bytes that with the largest ``page_id`` is a
    response and the others are revisits of it. Rows that share both are responses each. A null html is an
    empty payload, a null url no header; a row with a null ``page_id`` is a response if no equal payload has an id. An empty table
    gives archives without records. Other columns are ignored, whatever their names. Equal payloads
    are found by SHA-256; the counts are combined before the exchange and hold an entry for a digest
    only if it recurs, and a hot digest is split by the adaptive join, whose other side has it once.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.unhex(F.sha2(payload, 256))
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), key.alias("key"))
    keys = pages.select("page_id", key.alias("key"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("n")).where(F.col("n") >= least_bytes)
    best = keys.groupBy("key").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1 and best is not null")
    told = rows.join(best.select("key", "best"), "key", "left")
    text = pages.schema["page_id"].dataType.simpleString() == "string"
    refers = F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), _id(F.col("best"), text))
    record_id = F.coalesce(_id(F.col("page_id"), text), F.lit(_PAGE))
    told.select(record_id.alias("record_id"), "target_uri", refers.alias("refers_to"), "payload").write.format("warc").mode("append").option("path", place).save()


def read_archives(spark, place: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``place`` (a folder, with sidecars or without, or a file); with ``payloads`` they are read and their digests verified."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", place).option("payloads", str(payloads).lower()).load()


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Responses are read with their payloads, which are verified; of revisits only the headers are parsed. Both are asked for by
    predicates on ``record_type`` that the source takes over.
    """
    spark = pages.sparkSession
    place = shared_place(spark, "warc")
    archive_pages(pages, place, least_bytes)
    kind = pages.schema["page_id"].dataType

    def page_id(column: str):
        plain = F.nullif(F.substring(F.col(column), len(_PAGE) + 1, 1 << 20), F.lit(""))
        return F.url_decode(plain) if kind.simpleString() == "string" else plain.cast(kind)

    read = read_archives(spark, place).where("record_type = 'response'").unionByName(read_archives(spark, place, payloads=False).where("record_type = 'revisit'"))
    return read.select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))
