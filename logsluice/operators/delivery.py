"""Delivery: oversize records, greedy batches, event batches, object keys and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.scalars import NULL_MARK, content_hash, object_key
from logsluice.operators.flow import bounded_broadcast, running_count
from logsluice.spec import LineKey

# Delivery limits and the salt of the transaction id.
MAX_RECORD_BYTES = 1_000_000
BATCH_RECORDS = 500
BATCH_BYTES = 2_000_000
EVENT_BATCH = 125_000
TRANSACTION_SALT = "20160727"
_NO_LIMIT = 1 << 62
NOT_SENT = ("log_line", "ingest_datetime", "event_datetime")


def encoded_size(csv_line: Column) -> Column:
    """Bytes of an encoded record with its line end."""
    return F.octet_length(csv_line) + 1


def drop_oversize(
    encoded: DataFrame, csv_line: str = "csv_line", limit: int = MAX_RECORD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(records within the limit, records over it with a reason)."""
    small = encoded_size(F.col(csv_line)) <= limit
    return encoded.filter(small), encoded.filter(~small).withColumn("reason", F.lit("record too large"))


class Greedy:
    """Cuts a stream of (shard, size) rows, ordered by shard, into batches.

    A batch closes when it has ``max_records`` rows, or with the row that brings its size over
    ``over`` bytes, and at the end of its shard.
    """

    def __init__(self, max_records: int | None, over: int | None):
        self.max_records = max_records or _NO_LIMIT
        self.over = over if over is not None else _NO_LIMIT
        self.shard: object = None
        self.batch = self.rows = self.bytes = 0

    def number(self, shards: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes), dtype=np.int64)
        ends = np.cumsum(sizes)
        borders = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(sizes)]
        for first, stop in zip(borders, borders[1:]):
            if shards[first] != self.shard:
                self.shard, self.batch, self.rows, self.bytes = shards[first], 0, 0, 0
            i = first
            while i < stop:
                before = int(ends[i - 1]) if i else 0
                room = before + self.over - self.bytes
                # The first row whose running size is over the limit is the last of the batch.
                by_size = i + int(np.searchsorted(ends[i:stop], room, side="right")) + 1
                by_rows = i + self.max_records - self.rows
                end = min(stop, by_size, by_rows)
                out[i:end] = self.batch
                if end == min(by_size, by_rows):
                    self.batch, self.rows, self.bytes = self.batch + 1, 0, 0
                else:
                    self.rows += end - i
                    self.bytes += int(ends[end - 1]) - before
                i = end
        return out


def assign_batches(
    records: DataFrame,
    size: Column,
    shard_by: Sequence[str],
    order_by: Sequence[str],
    max_records: int | None = BATCH_RECORDS,
    over_bytes: int | None = BATCH_BYTES,
    name: str = "batch",
) -> DataFrame:
    """Number the delivery batches 0, 1, ... of each shard, in order.

    Batches are cut one after the other, so a shard must be a bounded slice, such as the (file,
    block) of the line key; the end of a shard closes its last batch, as a flush timer
    does every few seconds. Rows go through Arrow unchanged and only a small carry is kept
    between them, so a shard need not fit in memory.
    """
    sized = records.withColumn("_size", size.cast("bigint")).withColumn("_shard", F.xxhash64(*shard_by))
    sorted_rows = sized.repartition(*shard_by).sortWithinPartitions(*shard_by, *order_by)
    schema = T.StructType([*records.schema.fields, T.StructField(name, T.LongType(), False)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy = Greedy(max_records, over_bytes)
        for rows in batches:
            if rows.num_rows == 0:
                continue
            at = rows.schema.get_field_index("_size")
            sizes = rows.column(at).to_numpy(zero_copy_only=False)
            shards = rows.column(rows.schema.get_field_index("_shard")).to_numpy(zero_copy_only=False)
            numbers = pa.array(greedy.number(shards, sizes))
            kept = [i for i, f in enumerate(rows.schema) if f.name not in ("_size", "_shard")]
            columns = [rows.column(i) for i in kept] + [numbers]
            fields = [rows.schema.field(i) for i in kept] + [pa.field(name, pa.int64(), False)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return sorted_rows.mapInArrow(cut, schema)


def collect_batches(
    batched: DataFrame, batch_by: Sequence[str], order_by: Sequence[str], csv_line: str = "csv_line"
) -> DataFrame:
    """One row per delivery batch: ``records`` in order, ``record_count``, ``batch_bytes``."""
    rows = F.array_sort(F.collect_list(F.struct(*order_by, F.col(csv_line).alias("_line"))))
    return batched.groupBy(*batch_by).agg(
        F.transform(rows, lambda r: r["_line"]).alias("records"),
        F.count(F.lit(1)).alias("record_count"),
        F.sum(encoded_size(F.col(csv_line))).alias("batch_bytes"),
    )


# -- JSON event batches -------------------------------------------------------------


def event_map(attributes: Sequence[str]) -> Column:
    """Attributes of an event as map<string,string>, NULL as \\N, without the times and the line."""
    pairs: list[Column] = []
    for name in sorted(a for a in attributes if a not in NOT_SENT):
        pairs += [F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit(NULL_MARK))]
    return F.create_map(*pairs)


def transaction_id(line_hashes: Column) -> Column:
    """Hex MD5 over the MD5 bytes of the batch's lines, in order, and the salt."""
    digest = F.unhex(F.array_join(line_hashes, ""))
    return F.md5(F.concat(digest, F.lit(TRANSACTION_SALT).cast("binary")))


def event_batches(
    parsed: DataFrame,
    attributes: Sequence[str],
    api_key: str = "",
    key: LineKey = LineKey(),
    line: str = "line",
    batch_events: int = EVENT_BATCH,
) -> DataFrame:
    """Batches of ``batch_events`` events of a source: source, batch, event_count, transaction_id, payload.

    The running number comes from slice counts, so a large source is numbered by many tasks; a
    task only ever gathers one batch.
    """
    events = parsed.select(
        *key.columns, F.md5(F.col(line).cast("binary")).alias("_hash"), event_map(attributes).alias("_event")
    )
    numbered = running_count(events, F.lit(1), "_n", key)
    batch = F.floor((F.col("_n") - 1) / batch_events).alias("batch")
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_hash", F.to_json("_event").alias("_event"))))
    grouped = numbered.groupBy(key.source, batch).agg(ordered.alias("_rows"))
    grouped = grouped.select(
        key.source,
        "batch",
        F.size("_rows").cast("bigint").alias("event_count"),
        transaction_id(F.transform("_rows", lambda r: r["_hash"])).alias("transaction_id"),
        "_rows",
    )
    body = F.concat(
        F.lit('{"api_key":'),
        F.lit(json.dumps(api_key)),
        F.lit(',"transaction_id":"'),
        F.col("transaction_id"),
        F.lit('","events":['),
        F.array_join(F.transform("_rows", lambda r: r["_event"]), ","),
        F.lit("]}"),
    )
    return grouped.withColumn("payload", body).drop("_rows")


def dedup_batches(batches: DataFrame, delivered: DataFrame | None = None, txid: str = "transaction_id") -> DataFrame:
    """Leave out batches whose transaction id occurs twice or was delivered before."""
    once = batches.dropDuplicates([txid])
    if delivered is None:
        return once
    return once.join(bounded_broadcast(delivered.select(txid)), txid, "left_anti")


def dedup_stream(batches: DataFrame, time: str, delay: str, txid: str = "transaction_id") -> DataFrame:
    """The same on a stream, remembering ids for ``delay``."""
    return batches.withWatermark(time, delay).dropDuplicatesWithinWatermark([txid])


# -- objects and manifest -----------------------------------------------------------


def time_folders(when: Column) -> Column:
    """YYYY/MM/DD/HH/mm of the upload time in UTC."""
    return F.date_format(when, "yyyy/MM/dd/HH/mm")


def object_manifest(
    encoded: DataFrame,
    table: str,
    uploaded: Column,
    shard_by: Sequence[str],
    order_by: Sequence[str],
    buffer_size: int,
    prefix: str = "",
    ddl_version: str = "",
    csv_line: str = "csv_line",
) -> DataFrame:
    """Objects of at least ``buffer_size`` bytes and their load manifest.

    Columns: fullpath, table_name, ddl_version, record_count, body. An object is closed by the
    record that fills the buffer, or by the end of its shard; its name is the MD5 of its body.
    """
    batched = assign_batches(
        encoded.select(*shard_by, *order_by, csv_line),
        encoded_size(F.col(csv_line)),
        shard_by,
        order_by,
        max_records=None,
        over_bytes=buffer_size - 1,
    )
    objects = collect_batches(batched, [*shard_by, "batch"], order_by, csv_line)
    body = F.concat(F.array_join("records", "\n"), F.lit("\n"))
    return objects.select(
        object_key(F.lit(prefix), F.lit(table), time_folders(uploaded), content_hash(body)).alias("fullpath"),
        F.lit(table).alias("table_name"),
        F.lit(ddl_version).alias("ddl_version"),
        "record_count",
        body.alias("body"),
    )
