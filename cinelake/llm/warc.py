"""WARC files as a PySpark Python data source, and deduplicated archives of a page table.

Writing: each task writes WARC/1.1 records, one gzip member each, to files of at most max_bytes; the driver commits by
writing a manifest for the job, so files of lost or repeated tasks are never read. Readers take the union of all manifests, so
that jobs add up; overwriting removes those of earlier jobs. Each member's gzip header carries the lengths of
its two further members (headers and payload are separate deflate blocks of one member), so that a reader can pass over
a payload without inflating it.

Reading: files are planned as partitions of split_bytes; a partition owns the members that begin in it. Predicates on
record type and other header columns are pushed down; a record's headers are inflated first, and its payload only if the
record passes and the payload column is asked for.

archive(): one response per distinct payload (the largest page_id), revisit records for the others. Only digests and ids are
dealt out to find repeated payloads. The list of repeated digests is written and counted: up to REPEATED of them go to all tasks, and
pages are written where they were read; a longer list is joined with the pages by digest, where adaptive execution splits a payload that many share.

Defined results: null html is the empty payload; a null page_id is a revisit of the largest page_id with the same
payload, or a response if there is none; rows that repeat the largest page_id are all responses; further columns are
ignored; a very long payload is one record, however long; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ._util import materialise, new_path

MAX_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
REPEATED = 500_000  # of some 60 bytes each
MANIFEST = "_manifest-"  # and the job

#: Column -> header field. Fixed values of the format.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "content_type": "Content-Type",
    "page_id": "X-Page-ID",
    "payload_bytes": "X-Payload-Length",
    "content_length": "Content-Length",
}
LONGS = ("page_id", "payload_bytes", "content_length")
SCHEMA = ", ".join(f"{c} {'long' if c in LONGS else 'string'}" for c in HEADERS) + ", headers map<string,string>, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Members: a gzip header whose extra field "sl" holds the bytes of the compressed header block, of the compressed rest
# and of the payload; then the deflate stream, flushed to a byte border between the two.


def member(head: bytes, payload: bytes, level: int = 3) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    first = squeeze.compress(head) + squeeze.flush(zlib.Z_FULL_FLUSH)
    rest = squeeze.compress(payload + b"\r\n\r\n") + squeeze.flush()
    extra = b"sl" + struct.pack("<HIII", 12, len(first), len(rest), len(payload))
    crc = zlib.crc32(b"\r\n\r\n", zlib.crc32(payload, zlib.crc32(head)))
    size = (len(head) + len(payload) + 4) & 0xFFFFFFFF
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + first + rest + struct.pack("<II", crc, size)


def record(fields: dict[str, object], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(payload)}"]
    return member(("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace"), payload)


def _line(value: object) -> str:
    """A header value never holds a line break."""
    return " ".join(str(value).split("\r\n")).replace("\r", " ").replace("\n", " ")


def parse_head(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last := last.strip()] = value.strip()
    return out


class _Source:
    """Buffered reading of a seekable file, which counts inflated bytes for the tests."""

    def __init__(self, handle):
        self.handle = handle

    def at(self, where: int, n: int) -> bytes:
        self.handle.seek(where)
        return self.handle.read(n)


@dataclass
class Member:
    fields: dict[str, str]
    end: int
    load: object  # () -> payload


def read_member(source: _Source, at: int) -> Member | None:
    """The member that begins at a place, or None if none does."""
    start = source.at(at, 4096)
    if len(start) < 18 or start[:3] != b"\x1f\x8b\x08":
        return None
    flags = start[3]
    if flags == 4 and start[12:14] == b"sl" and struct.unpack("<H", start[14:16])[0] == 12:
        extra = struct.unpack("<H", start[10:12])[0]
        first, rest, size = struct.unpack("<III", start[16:28])
        body = at + 12 + extra
        inflate = zlib.decompressobj(-15)
        try:
            head = inflate.decompress(start[12 + extra : 12 + extra + first] if 12 + extra + first <= len(start) else source.at(body, first))
        except zlib.error:
            return None
        fields = parse_head(head.partition(b"\r\n\r\n")[0])
        if fields is None:
            return None

        def load():
            return zlib.decompressobj(-15).decompress(source.at(body + first, rest))[:size]

        return Member(fields, body + first + rest + 8, load)
    # Other writers' members tell no lengths: they are inflated to their end.
    inflate, out, place = zlib.decompressobj(31), io.BytesIO(), at
    try:
        while not inflate.eof and (chunk := source.at(place, 1 << 16)):
            place += len(chunk)
            out.write(inflate.decompress(chunk))
            if out.tell() >= 5 and not out.getbuffer()[:5].tobytes() == b"WARC/":
                return None
    except zlib.error:
        return None
    if not inflate.eof:
        return None
    head, _, payload = out.getvalue().partition(b"\r\n\r\n")
    fields = parse_head(head)
    size = int(fields.get("Content-Length", len(payload))) if fields is not None else 0
    return None if fields is None else Member(fields, place - len(inflate.unused_data), lambda: payload[:size])


def members(source: _Source, start: int, end: int, size: int):
    """The members that begin in a range."""
    at = start
    while at < end:
        found = read_member(source, at)
        if found is not None:
            yield found
            at = found.end
            continue
        chunk = source.at(at + 1, 1 << 20)  # the range starts within a member: on to the next gzip header
        step = chunk.find(b"\x1f\x8b\x08")
        at = at + 1 + step if step >= 0 else max(at + 1, at + len(chunk) - 2)
        if at + 18 > size:
            return


def plain_records(source: _Source, size: int):
    """Records of a file that is not compressed. From headers to headers: payloads that nobody loads are not read.

    Where a record begins is only known from the lengths of all before it, so such a file is one partition."""
    at = 0
    while at < size:
        chunk = source.at(at, 1 << 16)
        begin = chunk.find(b"WARC/")
        if begin < 0:
            at += max(1, len(chunk) - 4)
            continue
        at, chunk = at + begin, chunk[begin:]
        while (stop := chunk.find(b"\r\n\r\n")) < 0:
            more = source.at(at + len(chunk), len(chunk) + 1024)
            if not more:
                return
            chunk += more
        fields = parse_head(chunk[:stop]) or {}
        length = fields.get("Content-Length", "0")
        length = int(length) if length.isdigit() else 0
        first = at + stop + 4
        yield Member(fields, first + length, lambda a=first, n=length: source.at(a, n))
        at = first + length


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int

    def __init__(self, path, start, end, size):
        super().__init__((path, start, end, size))
        self.path, self.start, self.end, self.size = path, start, end, size


def _test(kind: str, values: tuple):
    """A predicate on one header value, where null passes only as SQL has it."""
    if kind == "eq":
        return lambda v: v is not None and v == values[0]
    if kind == "same":
        return lambda v: v == values[0]
    if kind == "in":
        return lambda v: v is not None and v in values
    if kind == "prefix":
        return lambda v: v is not None and v.startswith(values[0])
    if kind == "null":
        return lambda v: v is None
    if kind == "some":
        return lambda v: v is not None
    compare = {"gt": lambda v: v > values[0], "ge": lambda v: v >= values[0], "lt": lambda v: v < values[0], "le": lambda v: v <= values[0]}[kind]
    return lambda v: v is not None and compare(v)


def _value(fields: dict[str, str], column: str):
    raw = fields.get(HEADERS[column])
    if column in LONGS:
        return int(raw) if raw is not None and raw.lstrip("-").isdigit() else None
    if raw is not None and column == "payload_digest":
        return raw.rpartition(":")[2]
    return raw


class WarcReader(DataSourceReader):
    _KINDS = {EqualTo: "eq", EqualNullSafe: "same", StringStartsWith: "prefix", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.types = [pa.int64() if c in LONGS else pa.map_(pa.string(), pa.string()) if c == "headers" else pa.binary() if c == "payload" else pa.string() for c in self.columns]
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.verify = options.get("verify", "false") == "true"
        self.pushed: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif type(f) in self._KINDS:
                self.pushed.append((column, self._KINDS[type(f)], (f.value,)))
            elif isinstance(f, In):
                self.pushed.append((column, "in", tuple(f.value)))
            elif isinstance(f, IsNull):
                self.pushed.append((column, "null", ()))
            elif isinstance(f, IsNotNull):
                self.pushed.append((column, "some", ()))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        infos = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        names = {i.base_name for i in infos}
        manifests = [n for n in names if n.startswith(MANIFEST)]
        if manifests:  # one of each job that wrote here
            names = set()
            for n in manifests:
                with fs.open_input_stream(f"{path}/{n}") as f:
                    names |= set(json.loads(f.read()))
        out = []
        for i in sorted(infos, key=lambda i: i.path):
            if i.base_name not in names or not i.base_name.endswith((".warc", ".warc.gz")):
                continue
            step = self.split if i.base_name.endswith(".gz") else max(i.size, 1)
            out += [Range(i.path, a, min(a + step, i.size), i.size) for a in range(0, i.size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        fs, _ = filesystem(self.path)
        tests = [(c, _test(k, v)) for c, k, v in self.pushed]
        rows: list[list] = [[] for _ in self.columns]
        held = 0
        with fs.open_input_file(part.path) as handle:
            found = members(_Source(handle), part.start, part.end, part.size) if part.path.endswith(".gz") else plain_records(_Source(handle), part.size)
            for m in found:
                if not all(test(_value(m.fields, c)) for c, test in tests):
                    continue
                payload = m.load() if "payload" in self.columns or self.verify else None
                if self.verify and m.fields.get("WARC-Type") == "response" and base32_sha1(payload) != _value(m.fields, "payload_digest"):
                    raise ValueError(f"{part.path}: the payload of {m.fields.get('WARC-Record-ID')} doesn't have its digest")
                for c, out in zip(self.columns, rows):
                    out.append(list(m.fields.items()) if c == "headers" else payload if c == "payload" else _value(m.fields, c))
                held += 500 + len(payload or b"")
                if held > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [[] for _ in self.columns], 0
        if rows and rows[0]:
            yield self._batch(rows)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, self.types)], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest, payload)."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex[:12], overwrite
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, batches):
        from pyspark import TaskContext

        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        files, handle, size = [], None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if handle is None or size >= self.max_bytes:
                        if handle is not None:
                            handle.close()
                        files.append(f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}.warc.gz")
                        handle, size = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                    data = self._record(row)
                    handle.write(data)
                    size += len(data)
        finally:
            if handle is not None:
                handle.close()
        return Written(files)

    def _record(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        revisit = row["record_type"] == "revisit"
        digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
        fields = {
            "WARC-Type": row["record_type"],
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row["page_id"]} {row["target_uri"]} {digest}')}>",
            "WARC-Date": self.date,
            "WARC-Target-URI": row["target_uri"],
            "WARC-Payload-Digest": f"sha1:{digest}",
            "WARC-Profile": REVISIT_PROFILE if revisit else None,
            "WARC-Refers-To": f"<urn:page:{row['refers_to']}>" if revisit else None,
            "X-Page-ID": row["page_id"],
            "X-Payload-Length": row["payload_bytes"],
            "Content-Type": "text/html; charset=utf-8",
        }
        return record(fields, b"" if revisit else payload)

    def commit(self, messages):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.base_name.startswith(MANIFEST)] if self.overwrite else []
        with fs.open_output_stream(f"{path}/{MANIFEST}{self.job}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        for old in before:
            fs.delete_file(old)

    def abort(self, messages):
        fs, path = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{path}/{x}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages(page_id, url, html); payloads of at least so many bytes are stored once."""
    register(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    largest = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    largest = materialise(largest, "repeated", share=8)
    if largest.count() <= REPEATED:
        largest = F.broadcast(largest)
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    out = base.join(largest, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        F.when(revisit, F.col("largest")).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).options(path=path, **options).load()


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives pages in the shared folder and reads the records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path, least)
    found = read(spark, path, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary", verify="true")
    full = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select("page_id", full.alias("payload_bytes"), "payload_digest", "record_type", F.regexp_extract("refers_to", r"(-?\d+)>$", 1).try_cast("long").alias("refers_to"))
