"""WARC archives: a writer for tasks and a Python data source.

Each record is a gzip member of its own with its length in the member's extra field, so the reader
inflates the first bytes, parses the headers, and seeks past a record that the pushed predicates
do not want. Members of other writers don't tell their length: they are inflated to find their end. Revisit records carry the headers of the response they repeat, without its payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from logsluice.llm.common import column, new_path

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Header of each text column; these can be pushed down.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
FIXED = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length (subfield `sl`)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(FIXED) + 2 + 12 + len(body) + 8
    return FIXED + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes) -> bytes:
    """A response, or a revisit (HTTP headers only) of a payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_records(rows: DataFrame, path: str) -> None:
    """Writes (record_type, record_id, url, refers_to, payload) as archives, one per task.

    A task writes beside its archive and renames it at its end: a repeated attempt replaces it.
    """
    target, folder = file_system(path)
    target.create_dir(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, root = file_system(path)
        context, n = TaskContext.get(), 0
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        own = f"{root}/.{context.taskAttemptId()}-{context.partitionId()}"
        with here.open_output_stream(own) as out:
            out.write(member(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
            for batch in batches:
                for kind, key, url, refers, payload in zip(*(column(batch, c) for c in ("record_type", "record_id", "url", "refers_to", "payload")), strict=True):
                    out.write(member(record(kind, key, url, refers, digest_of(payload), payload)))
                    n += 1
        here.move(own, name)
        yield pa.RecordBatch.from_pydict({"records": pa.array([n], pa.int64())})

    rows.select("record_type", "record_id", "url", "refers_to", "payload").mapInArrow(task, "records long").agg(F.sum("records")).collect()


def headers_of(lines: bytes) -> dict[str, str]:
    """Header fields by their names in lower case; the first line and lines without a colon are left out."""
    fields = (x.split(":", 1) for x in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields}


def whole_member(source, at: int) -> tuple[bytes, int]:
    """The inflated bytes of the gzip member at a place, and its length in the file."""
    unpack, out, read = zlib.decompressobj(31), [], 0
    source.seek(at)
    while not unpack.eof:
        data = source.read(1 << 16)
        if not data:
            raise ValueError(f"the record at byte {at} has no end")
        out.append(unpack.decompress(data))
        read += len(data)
    return b"".join(out), read - len(unpack.unused_data)


def members(source, size: int) -> Iterator[tuple[dict[str, str], bytes, Callable[[], bytes]]]:
    """(WARC headers, first bytes of the block with its HTTP headers, load): load() gives the whole block."""
    at, first = 0, 1 << 14
    while at < size:
        source.seek(at)
        start = source.read(first)
        if start[:2] != FIXED[:2]:
            raise ValueError(f"no gzip member at byte {at}")
        if start[:4] == FIXED[:4] and start[12:14] == b"sl":
            extra, _, _, length, _ = struct.unpack_from("<H2sHII", start, 10)
            head = zlib.decompressobj(-15).decompress(start[12 + extra : length - 8], 1 << 14)

            def load(at=at, extra=extra, length=length, start=start) -> bytes:
                if length <= first:
                    body = start[12 + extra : length - 8]
                else:
                    source.seek(at + 12 + extra)
                    body = source.read(length - 20 - extra)
                return zlib.decompress(body, -15)
        else:
            head, length = whole_member(source, at)
            load = lambda head=head: head
        end = head.find(b"\r\n\r\n")
        if end < 0 or head.find(b"\r\n\r\n", end + 4) < 0:  # headers longer than the first bytes
            head = load()
            end = head.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError(f"the record at byte {at} has no headers")
        fields = headers_of(head[:end])
        to = end + 4 + int(fields["content-length"])
        yield fields, head[end + 4 : to], lambda load=load, end=end, to=to: load()[end + 4 : to]
        at += length


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.split = int(options.get("split", 32 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):
        """Takes = and IN on header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and name in HEADERS and len(f.attribute) == 1:
                self.wanted[name] = self.wanted.get(name, {f.value}) & {f.value}
            elif isinstance(f, In) and name in HEADERS and len(f.attribute) == 1:
                self.wanted[name] = self.wanted.get(name, set(f.value)) & set(f.value)
            elif not (isinstance(f, IsNotNull) and name in self.wanted):
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole archives, small ones together."""
        here, root = file_system(self.path)
        files = sorted((x.path, x.size) for x in here.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.endswith(".warc.gz"))
        out: list[list] = []
        held = self.split
        for name, size in files:
            if held + size > self.split:
                out.append([])
                held = 0
            out[-1].append((name, size))
            held += size
        return [InputPartition(x) for x in out] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        here, _ = file_system(self.path)
        names = [*HEADERS, "payload_bytes", "payload"]
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for name, size in partition.value:
            with here.open_input_file(name) as source:
                for head, block, load in members(source, size):
                    if head.get("warc-type") == "warcinfo":
                        continue
                    row = {k: head.get(h.lower()) for k, h in HEADERS.items()}
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    if any(row[k] not in v for k, v in self.wanted.items()):
                        continue
                    payload = None
                    http = head.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block
                    told = headers_of(block.split(b"\r\n\r\n", 1)[0]).get("content-length", "") if http else head["content-length"]
                    length = int(told) if told.isdecimal() else None
                    if self.payload and row["warc_type"] != "revisit":
                        payload = load().split(b"\r\n\r\n", 1)[1] if http else load()
                        if length is None:
                            length = len(payload)
                        if self.verify and (row["payload_digest"] not in (None, digest_of(payload)) or len(payload) != length):
                            raise ValueError(f"{name}: digest of {row['record_id']} differs")
                    rows.append((*row.values(), length, payload))
                    held += len(payload or b"") + 200
                    if held > 4 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder). Options: payload (false leaves payloads undecoded),
    verify (compares digests), split (bytes of archives per partition)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_type, record_id, url, refers_to, payload): of equal payloads of at least
    `least_bytes` bytes the row with the smallest page_id is the response, others revisit it.

    Equal means equal SHA-1. Of rows with the same smallest id one is the response; null ids come
    last; null html is empty. Payloads that occur once are not in the joined table, and a hot
    payload is pre-aggregated; Spark can split its side of the join.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    out = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return out.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), "url", F.when(again, name("first.page_id")).alias("refers_to"), "payload",
    )


def page_number(name: str):
    return F.expr(f"try_cast(regexp_extract({name}, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")


def archived(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages as archives and reads them back: a row per page, digests verified."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_records(with_revisits(pages, least_bytes), path)
    register(spark)
    rows = spark.read.format("warc").option("verify", "true").load(path)
    return rows.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page_number("refers_to").alias("refers_to"))


#: The same rows by SQL: a base32 character is five bits of the hexadecimal SHA-1.
SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM rows)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
