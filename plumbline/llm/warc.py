"""WARC archives as a PySpark data source, and revisit records for equal payloads.

``spark.read.format("warc")`` plans one or more partitions per file (files of many
independent gzip members are cut at member starts), parses a record's header first
and decides from it whether the record is wanted: equality and IN filters on
``record_type``, ``target_uri``, ``record_id``, ``refers_to`` and
``payload_digest`` are taken over by the reader.  The payload of an unwanted
record, or of every record if the requested schema has no ``payload`` column, is
skipped without being decoded: the writer notes a member's size in its gzip header,
so the reader seeks past the rest.

``df.write.format("warc")`` writes one file per task under a temporary name and
gives it its final name when the job commits, so a task that is repeated on
another executor leaves nothing behind.

Paths are URIs that ``pyarrow.fs`` understands (``file:``, ``hdfs:``, ``s3:`` ...);
use a folder that all executors share.  Null payload is written as empty.  A null in a
pushed filter equals nothing.  Null ids are kept: such a record is named like any other,
by an empty id.  Very long payloads are read in chunks.  Of equal payloads, ties and
repeated rows, the largest id stays a response.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, payload_digest string,"
    " payload_bytes bigint, payload binary"
)
#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
#: Compressed bytes per read partition that are aimed at.
SPLIT_BYTES = 64 << 20
#: Rows and payload bytes per Arrow batch that the reader hands to Spark.
READ_ROWS, READ_BYTES = 1000, 8 << 20
#: Compressed bytes that are read at once; a header is expected to inflate from the first of them.
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"

# Names of WARC header fields, with the column each is read into.
FIELDS = {
    "warc-type": "record_type",
    "warc-record-id": "record_id",
    "warc-refers-to": "refers_to",
    "warc-target-uri": "target_uri",
    "warc-payload-digest": "payload_digest",
}
# Fixed values of the gzip format: magic, deflate, extra field present, no time, unknown system.
MAGIC = b"\x1f\x8b\x08"
GZIP_START = MAGIC + b"\x04\0\0\0\0\0\xff"
#: Extra field of 12 bytes with one subfield of 8: the size of the whole member.
EXTRA_START = struct.pack("<H2sH", 12, b"ML", 8)
#: Bytes of the full payload; a revisit record carries none, so it is said here.
LENGTH_FIELD = "X-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def hex_digest(value: str) -> str:
    """SHA-1 of a header field as bare hexadecimal; other digests stay as they are."""
    name, _, digest = value.partition(":")
    return base64.b32decode(digest).hex() if name.lower() == "sha1" and len(digest) == 32 else value


def render(row: dict) -> bytes:
    """One gzip member: header, payload and the two line ends that close a record."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(row['target_uri'])}",
        f"WARC-Payload-Digest: {base32_digest(row['payload_digest'])}",
        f"{LENGTH_FIELD}: {row['payload_bytes']}",
        f"Content-Length: {len(payload)}",
    ]
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
    data = ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = len(GZIP_START) + len(EXTRA_START) + 8 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP_START + EXTRA_START + struct.pack("<Q", size) + body + tail


def _one_line(text: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in text or "")


def parse_header(block: bytes) -> tuple[dict, int]:
    """Columns of a record and its content length, from its header block."""
    row: dict = dict.fromkeys(FIELDS.values())
    length, full = 0, None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name in FIELDS:
            row[FIELDS[name]] = value
        elif name == "content-length":
            length = int(value)
        elif name == LENGTH_FIELD.lower():
            full = int(value)
    if row["payload_digest"]:
        row["payload_digest"] = hex_digest(row["payload_digest"])
    row["payload_bytes"] = length if full is None else full
    return row, length


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class _Stream:
    """Sequential bytes of a file with a little look-ahead."""

    def __init__(self, source, start: int):
        source.seek(start)
        self.source, self.buffer, self.at = source, b"", start

    def fill(self, n: int = 1) -> bool:
        """Hold ``n`` bytes; false if the file ends before."""
        while len(self.buffer) < n:
            chunk = self.source.read(CHUNK)
            if not chunk:
                return False
            self.buffer += chunk
        return True

    def to(self, position: int) -> None:
        """Go on from a later position, by seeking if it is not held."""
        ahead = position - self.at
        if ahead <= len(self.buffer):
            self.buffer = self.buffer[ahead:]
        else:
            self.source.seek(position)
            self.buffer = b""
        self.at = position

    def to_member(self, end: int) -> bool:
        """Go to the first record that starts before ``end``."""
        while self.at < end and self.fill(len(MAGIC)):
            found = self.buffer.find(MAGIC)
            if found < 0:
                self.to(self.at + len(self.buffer) - len(MAGIC) + 1)
                if not self.fill(len(MAGIC)):
                    return False
                continue
            self.to(self.at + found)
            self.fill(512)
            try:
                if zlib.decompressobj(31).decompress(self.buffer[:512], 5) == b"WARC/":
                    return self.at < end
            except zlib.error:
                pass
            self.to(self.at + 1)
        return False

    def member_size(self) -> int | None:
        """Size of the member that starts here, if its writer has noted it."""
        head = len(GZIP_START)
        self.fill(head + len(EXTRA_START) + 8)
        if self.buffer[:4] == GZIP_START[:4] and self.buffer[head : head + len(EXTRA_START)] == EXTRA_START:
            return struct.unpack_from("<Q", self.buffer, head + len(EXTRA_START))[0]
        return None


def read_members(source, start: int, end: int, want) -> Iterator[dict]:
    """Records whose gzip member starts in ``[start, end)`` of a file.

    ``want(row)`` says from the header whether the record is wanted, and whether
    with its payload.  If not, and the member's size is noted in front of it, the
    rest is skipped; otherwise it is inflated in small pieces and thrown away.
    """
    stream = _Stream(source, start)
    while stream.to_member(end):
        begin, size = stream.at, stream.member_size()
        inflate, head = zlib.decompressobj(31), b""

        def step(limit: int) -> bytes:
            if not stream.fill():
                raise ValueError("the archive ends within a record")
            out = inflate.decompress(stream.buffer, limit)
            left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            stream.to(stream.at + len(stream.buffer) - len(left))
            return out

        while b"\r\n\r\n" not in head and not inflate.eof:
            head += step(4096)
        block, _, rest = head.partition(b"\r\n\r\n")
        row, length = parse_header(block)
        wanted, with_payload = want(row)
        decode = wanted and with_payload
        if not decode and size:
            stream.to(begin + size)
        else:
            parts = [rest]
            while not inflate.eof:
                out = step(CHUNK)
                if decode:
                    parts.append(out)
        if wanted:
            yield row | {"payload": b"".join(parts)[:length] if decode else None}


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in self.PUSHED:
                # Nothing equals a null, so it is no value to look for.
                values = f.value if isinstance(f, In) else [f.value]
                self.tests.append((name, frozenset(v for v in values if v is not None)))
            else:
                yield f

    def partitions(self) -> list[Split]:
        files, root = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.is_file and f.path.endswith(".warc.gz"):
                out += [Split(prefix + f.path, k, min(k + SPLIT_BYTES, f.size)) for k in range(0, f.size, SPLIT_BYTES)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        with_payload = "payload" in arrow.names

        def want(row: dict) -> tuple[bool, bool]:
            return all(row[name] in values for name, values in self.tests), with_payload

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names} for r in rows], schema=arrow)

        if not partition.path:
            return
        files, path = _filesystem(partition.path)
        rows, held = [], 0
        with files.open_input_file(path) as source:
            for row in read_members(source, partition.start, partition.end, want):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= READ_ROWS or held >= READ_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _filesystem(self.path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        name, stream = f"{root}/_temporary/{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in iterator:
                if stream is None and batch.num_rows:
                    stream = files.open_output_stream(name, compression=None)
                for i in range(batch.num_rows):
                    stream.write(render(batch.slice(i, 1).to_pylist()[0]))
        finally:
            if stream is not None:
                stream.close()
        return Written(name if stream is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        for k, m in enumerate(m for m in messages if m and m.temporary):
            files.move(m.temporary, f"{root}/part-{k:06d}.warc.gz")
        if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for m in messages:
            if m and m.temporary and files.get_file_info(m.temporary).type == fs.FileType.File:
                files.delete_file(m.temporary)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session; filters reach it only with the second setting."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_of(uri) -> F.Column:
    """The page id in a record id."""
    return F.regexp_extract(uri, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """WARC records of ``page_id, url, html``.

    Of equal payloads of ``revisit_from`` bytes or more the largest page id is the
    response and the others revisit it.  Digests are counted before they are
    joined, so a payload shared by very many pages is one row on one side of the
    join and plain rows, which can be split, on the other.
    """
    rows = pages.select(
        F.col("page_id"),
        F.col("url").alias("target_uri"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = (
        rows.where(F.col("payload_bytes") >= revisit_from)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    rows = rows.join(shared, same, "left")
    revisit = F.col("_kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_kept"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, record_id(F.col("_kept"))).alias("refers_to"),
        "target_uri",
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(df: DataFrame, path: str) -> None:
    """Write records as an archive folder."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive folder; without ``payload`` no payload is kept in memory."""
    register(spark)
    reader = spark.read.format("warc")
    return (reader if payload else reader.schema(SCHEMA.rsplit(",", 1)[0])).load(path)
