"""Byte-bounded objects written by a data source, with the manifest in a ledger.

``df.write.format("logobjects")`` and ``writeStream.format("logobjects")`` take rows (shard, csv_line).
A task writes lines to staged objects and closes one with the line that brings it to the buffer
size, or at the end of its shard; the object is named by the MD5 of its bytes. Tasks send what they
staged to the driver. Only the commit moves objects to their place, below the folders of the upload
time, and writes the delivery's rows to the ledger; an abort removes what was staged.

The plan of the moves goes to the ledger before the first move. A commit that was cut short is
carried on from that plan, with its upload time, and a finished delivery is not repeated: every
object has one copy and one manifest row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logsluice.operators.delivery import Greedy
from logsluice.operators.records import encode_csv
from logsluice.sinks.ledger import LEDGER, Ledger, batch_name, open_folder, present
from logsluice.spec import DEFAULT_FORMAT, LineKey, RecordFormat

FORMAT = "logobjects"
BUFFER_BYTES = 64 << 20
STAGING = "_staging"
MANIFEST_SCHEMA = (
    "delivery string, uploaded string, fullpath string, table_name string, ddl_version string, record_count bigint, bytes bigint"
)
# Moves that the driver has under way at once.
MOVERS = 32


@dataclass
class Staged(WriterCommitMessage):
    """What one task staged: (path, digest, records, bytes) of each object, in order."""

    objects: list[tuple[str, str, int, int]] = field(default_factory=list)


class _Hashed(io.RawIOBase):
    """Passes bytes on to a file and to a hash."""

    def __init__(self, out):
        self.out, self.md5, self.size = out, hashlib.md5(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        self.md5.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)


class _OpenObject:
    """An object that is being written. Its bytes are not held in memory."""

    def __init__(self, system, path: str, packed: bool):
        self.path, self.file, self.records = path, system.open_output_stream(path), 0
        self.bytes = _Hashed(self.file)
        # Neither time nor name in the header: equal records give equal bytes.
        self.target = gzip.GzipFile("", "wb", fileobj=self.bytes, mtime=0) if packed else self.bytes

    def add(self, lines: list[bytes]) -> None:
        self.target.write(b"\n".join(lines) + b"\n")
        self.records += len(lines)

    def close(self) -> tuple[str, str, int, int]:
        if self.target is not self.bytes:
            self.target.close()
        self.file.close()
        return self.path, self.bytes.md5.hexdigest(), self.records, self.bytes.size


def given_name(batch: str | None) -> str | None:
    """Name of a delivery from the option ``batchId``."""
    return batch_name(int(batch) if str(batch).isdigit() else batch) if batch is not None else None


class _Delivery:
    """The part that batch and stream writers share."""

    def __init__(self, options: dict):
        def option(name: str, default=""):
            return options.get(name, options.get(name.lower(), default))

        self.path = str(option("path")).rstrip("/")
        if not self.path:
            raise ValueError("objects need a path")
        self.table, self.prefix = str(option("table")), str(option("prefix")).strip("/")
        self.ddl_version = str(option("ddlVersion"))
        self.buffer_bytes = int(option("bufferSize", BUFFER_BYTES))
        self.max_records = int(option("maxRecords", 0)) or None
        self.packed = str(option("compression")).lower() == "gzip"
        self.ledger_path = str(option("ledger")) or f"{self.path}/{LEDGER}"
        self.uploaded = str(option("uploaded"))
        # Writer and committer may be made apart, so a name that both know comes as an option. A
        # name that outlives a run lets the next attempt clear what a killed one left.
        known = options.get("batchId", options.get("batchid"))
        self.staging = f"{self.path}/{STAGING}/{option('staging') or (given_name(known) or uuid.uuid4().hex)}"

    # -- on executors

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, folder = open_folder(f"{self.staging}/{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        cut, out = Greedy(self.max_records, self.buffer_bytes - 1), Staged()
        now: _OpenObject | None = None
        place: tuple[int, int] | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lines = batch.column("csv_line").cast(pa.binary())
            sizes = pc.add(pc.binary_length(lines).cast(pa.int64()), 1).to_numpy(zero_copy_only=False)
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            numbers = cut.number(shards, sizes)
            new = (shards[1:] != shards[:-1]) | (numbers[1:] != numbers[:-1])
            borders = [0, *(new.nonzero()[0] + 1).tolist(), batch.num_rows]
            for first, stop in zip(borders, borders[1:]):
                own = (int(shards[first]), int(numbers[first]))
                if now is None or own != place:
                    if now is not None:
                        out.objects.append(now.close())
                    now, place = _OpenObject(system, f"{folder}/{len(out.objects):08d}", self.packed), own
                now.add(lines.slice(first, stop - first).to_pylist())
        if now is not None:
            out.objects.append(now.close())
        return out

    # -- on the driver

    def plan(self, name: str, messages: Sequence[Staged | None]) -> list[dict]:
        """Rows of the delivery with the staged place of each object."""
        moment = datetime.fromisoformat(self.uploaded) if self.uploaded else datetime.now(timezone.utc)
        own = {"delivery": name, "uploaded": moment.isoformat()}
        folders, rows, seen = moment.strftime("%Y/%m/%d/%H/%M"), [], {}
        for staged, digest, records, size in (o for m in messages if m is not None for o in m.objects):
            key = "/".join(p for p in (self.prefix, self.table, folders, digest) if p)
            # Objects with equal bytes are told apart by a number, so that none replaces another.
            seen[key] = seen.get(key, 0) + 1
            key += (f"-{seen[key] - 1}" if seen[key] > 1 else "") + (".gz" if self.packed else "")
            rows.append(own | {"staged": staged, "fullpath": key, "table_name": self.table, "ddl_version": self.ddl_version, "record_count": records, "bytes": size})
        return rows or [own | {"staged": None}]

    def finish(self, name: str, messages: Sequence[Staged | None]) -> None:
        ledger = Ledger(self.ledger_path)
        if ledger.rows(name) is None:
            rows = ledger.rows(f".{name}")
            if rows is None:
                rows = self.plan(name, messages)
                ledger.put(f".{name}", rows)
            self.move(rows)
            ledger.put(name, [{k: v for k, v in r.items() if k != "staged"} for r in rows])
            ledger.drop(f".{name}")
        self.clear()

    def move(self, rows: Sequence[dict]) -> None:
        system, root = open_folder(self.path)
        moves = [(r["staged"], f"{root}/{r['fullpath']}") for r in rows if r["staged"]]
        for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
            system.create_dir(folder, recursive=True)

        def one(pair: tuple[str, str]) -> None:
            staged, to = pair
            if present(system, staged):
                system.move(staged, to)
            elif not present(system, to):
                raise FileNotFoundError(f"{staged}: neither staged nor delivered as {to}")

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(one, moves))

    def clear(self) -> None:
        """Remove what this delivery's attempts staged, those of killed ones too."""
        system, folder = open_folder(self.staging)
        if present(system, folder):
            system.delete_dir(folder)


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.delivery = _Delivery(options)
        known = options.get("batchId", options.get("batchid"))
        self.name = given_name(known) or f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.delivery.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.delivery.finish(self.name, messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self.delivery.clear()


class ObjectStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.delivery = _Delivery(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.delivery.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.delivery.finish(batch_name(batchId), messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.delivery.clear()


class ObjectSink(DataSource):
    """Data source registered as "logobjects"."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "shard bigint, csv_line string"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are only added; use mode append")
        return ObjectWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> ObjectStreamWriter:
        return ObjectStreamWriter(dict(self.options))


def _options(**named) -> dict[str, str]:
    return {k: str(v) for k, v in named.items() if v not in (None, "", 0)}


def register(rows: DataFrame) -> None:
    """Make the format known to the session of the rows and to the active one: inside a micro-batch
    that is the stream's own copy of the session."""
    rows.sparkSession.dataSource.register(ObjectSink)
    active = SparkSession.getActiveSession()
    if active is not None:
        active.dataSource.register(ObjectSink)


def write_objects(
    records: DataFrame,
    path: str,
    table: str,
    fmt: RecordFormat = DEFAULT_FORMAT,
    key: LineKey = LineKey(),
    prefix: str = "",
    ddl_version: str = "",
    buffer_bytes: int = BUFFER_BYTES,
    max_records: int = 0,
    gzip: bool = False,
    uploaded: datetime | None = None,
    batch_id: int | str | None = None,
    ledger: str = "",
) -> None:
    """Records as CSV objects below ``path``, in line order inside each slice of ``key``.

    A ``batch_id`` that is in the ledger is not delivered again, nor are its records computed.
    """
    lines = records.select(*key.columns, encode_csv(fmt).alias("csv_line"))
    write_encoded(
        lines, path, table, key.slice, [key.pos], prefix, ddl_version, buffer_bytes, max_records, gzip, uploaded, batch_id, ledger
    )


def write_encoded(
    encoded: DataFrame,
    path: str,
    table: str,
    shard_by: Sequence[str],
    order_by: Sequence[str],
    prefix: str = "",
    ddl_version: str = "",
    buffer_bytes: int = BUFFER_BYTES,
    max_records: int = 0,
    gzip: bool = False,
    uploaded: datetime | None = None,
    batch_id: int | str | None = None,
    ledger: str = "",
) -> None:
    """The same for rows that hold their ``csv_line`` already, shuffled once, by shard."""
    if batch_id is not None and Ledger(ledger or f"{path.rstrip('/')}/{LEDGER}").rows(batch_name(batch_id)) is not None:
        return
    ordered = encoded.repartition(*shard_by).sortWithinPartitions(*shard_by, *order_by)
    rows = ordered.select(F.xxhash64(*shard_by).alias("shard"), "csv_line")
    register(rows)
    options = _options(
        path=path, table=table, prefix=prefix, ddlVersion=ddl_version, bufferSize=buffer_bytes, maxRecords=max_records,
        compression="gzip" if gzip else "", uploaded=uploaded.isoformat() if uploaded else "", ledger=ledger,
    )
    if batch_id is not None:
        options["batchId"] = str(batch_id)
    rows.write.format(FORMAT).options(**options).mode("append").save()


def stream_objects(
    records: DataFrame,
    path: str,
    table: str,
    checkpoint: str,
    fmt: RecordFormat = DEFAULT_FORMAT,
    key: LineKey = LineKey("file", "block_start", "byte_pos"),
    prefix: str = "",
    ddl_version: str = "",
    buffer_bytes: int = BUFFER_BYTES,
    gzip: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Deliver a stream without a shuffle: the lines of a byte range come to one task, in order.

    Objects end with the micro-batch; ``every`` is the flush interval, None takes what is there and stops.
    """
    records.sparkSession.dataSource.register(ObjectSink)
    rows = records.select(F.xxhash64(*key.slice).alias("shard"), encode_csv(fmt).alias("csv_line"))
    options = _options(
        path=path, table=table, prefix=prefix, ddlVersion=ddl_version, bufferSize=buffer_bytes,
        compression="gzip" if gzip else "", staging=f"query-{hashlib.md5(checkpoint.encode()).hexdigest()}",
    )
    writer = rows.writeStream.format(FORMAT).options(**options).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_manifest(spark: SparkSession, path: str, ledger: str = "") -> DataFrame:
    """One row per delivered object, from the ledger: no object is read."""
    folder = ledger or f"{path.rstrip('/')}/{LEDGER}"
    if not Ledger(folder).names():
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).json(folder, pathGlobFilter="*.json").filter(F.col("fullpath").isNotNull())
