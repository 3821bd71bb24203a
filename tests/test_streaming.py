"""Streams give what the batch operators give, whatever way the bytes arrive."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from logsluice.operators.delivery import dedup_stream
from logsluice.operators.flow import fold_continuations, split_records
from logsluice.operators.parsers import parse_regex
from logsluice.sinks.files import write_partitioned
from logsluice.sources.logtail import stream_lines
from logsluice.spec import Attribute, LineKey
from logsluice.streaming.delivery import deliver, fan_out
from logsluice.streaming.stateful import fold_continuations_stream, split_records_stream

BYTE_KEY = LineKey("file", "block_start", "byte_pos")
REGEX = r"^OK (?P<log_level>\w+)"


def log_text(seed, n=300):
    rnd = random.Random(seed)
    return "".join(("OK info" if rnd.random() < 0.4 else "trace ü") + f" {i}\n" for i in range(n))


def feed(spark, tmp_path, build, schema, text, complete, steps=3):
    """Append the text piece by piece while the stream runs; stop once the output is complete.

    A query with timeouts never runs out of work, so the output is watched instead.
    """
    folder = tmp_path / "in"
    folder.mkdir()
    data, out = text.encode(), str(tmp_path / "out")
    query = (
        build(stream_lines(spark, str(folder), "log", range_bytes=700))
        .writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        for i in range(steps):
            with open(folder / "a.log", "ab") as f:
                f.write(data[len(data) * i // steps : len(data) * (i + 1) // steps])
            time.sleep(2)
        rows, end = [], time.time() + 40
        while time.time() < end and query.isActive and len(rows) < complete:
            time.sleep(1)
            if os.path.isdir(os.path.join(out, "_spark_metadata")):
                rows = spark.read.schema(schema).parquet(out).collect()
        assert query.exception() is None
        return rows
    finally:
        query.stop()


def as_batch(spark, text):
    rows, at = [], 0
    for line in text.splitlines():
        rows.append(("a.log", 0, at, line))
        at += len(line.encode()) + 1
    return spark.createDataFrame(rows, "file string, block_start bigint, byte_pos bigint, line string")


def test_fold_stream_equals_batch(spark, tmp_path):
    text = log_text(1)
    parsed = parse_regex(as_batch(spark, text), REGEX, fmt=(), residual=False)
    want = sorted((r.byte_pos, r.log_line, r.lines, r.bytes) for r in fold_continuations(parsed, BYTE_KEY, limit=40).collect())

    def build(lines):
        return fold_continuations_stream(parse_regex(lines, REGEX, fmt=(), residual=False), 40, idle_ms=10_000)

    schema = "file string, byte_pos bigint, log_line string, lines bigint, bytes bigint"
    got = feed(spark, tmp_path, build, schema, text, len(want))
    assert sorted((r.byte_pos, r.log_line, r.lines, r.bytes) for r in got) == want


def test_split_stream_equals_batch(spark, tmp_path):
    text = log_text(2)
    want = sorted((r.byte_pos, r.part, r.line) for r in split_records(as_batch(spark, text), "^OK", BYTE_KEY).collect())
    schema = "file string, byte_pos bigint, part bigint, line string"
    got = feed(
        spark, tmp_path, lambda lines: split_records_stream(lines, "^OK", idle_ms=10_000), schema, text, len(want)
    )
    assert sorted((r.byte_pos, r.part, r.line) for r in got) == want


def test_fan_out_computes_once_and_replays_safely(spark, tmp_path):
    fmt = (Attribute("n", "integer"),)
    src = str(tmp_path / "src")
    spark.range(10).selectExpr("id as n").write.parquet(src)
    seen = []

    def files(batch, batch_id):
        write_partitioned(batch, str(tmp_path / "lake"), "t", fmt, uploaded=None, batch_id=batch_id)

    def count(batch, batch_id):
        seen.append((batch_id, batch.count()))

    stream = spark.readStream.schema("n bigint").parquet(src)
    query = deliver(stream, {"files": files, "count": count}, "fan", str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert seen == [(0, 10)]
    # The same batch again, minutes later by the clock of the attempt.
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(minutes=5)
    again = lambda b, i: write_partitioned(b, str(tmp_path / "lake"), "t", fmt, uploaded=later, batch_id=i)
    fan_out({"files": again})(spark.read.parquet(src), 0)
    found = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "lake") for f in names if f.startswith("part-")]
    lines = sum((open(f).read().split() for f in found), [])
    assert sorted(map(int, lines)) == list(range(10)) and len({os.path.dirname(f) for f in found}) == 1


def test_dedup_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.range(6).select(
        (F.col("id") % 3).cast("string").alias("transaction_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"),
    )
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    query = (
        dedup_stream(stream, "at", "1 hour").writeStream.format("memory").queryName("dedup_out")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert spark.table("dedup_out").count() == 3


def one_shot(spark, tmp_path, build, schema, name="out"):
    """Run what is there and stop; all rows delivered so far."""
    out = str(tmp_path / name)
    query = (
        build(stream_lines(spark, str(tmp_path / "in"), "log", range_bytes=300, drain=True))
        .writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(90)
    assert not query.isActive
    return spark.read.schema(schema).parquet(out).collect()


def test_one_shot_runs_give_out_the_last_buffer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = log_text(3, 120) + "trace at the end\n"
    (tmp_path / "in" / "a.log").write_text(text)
    parsed = parse_regex(as_batch(spark, text), REGEX, fmt=(), residual=False)
    want = sorted((r.byte_pos, r.log_line) for r in fold_continuations(parsed, BYTE_KEY, limit=40).collect())
    fold = lambda lines: fold_continuations_stream(parse_regex(lines, REGEX, fmt=(), residual=False), 40)
    schema = "file string, byte_pos bigint, log_line string, lines bigint, bytes bigint"
    assert sorted((r.byte_pos, r.log_line) for r in one_shot(spark, tmp_path, fold, schema, "fold")) == want
    records = sorted((r.byte_pos, r.line) for r in split_records(as_batch(spark, text), "^OK", BYTE_KEY).collect())
    split = lambda lines: split_records_stream(lines, "^OK")
    schema = "file string, byte_pos bigint, part bigint, line string"
    assert sorted((r.byte_pos, r.line) for r in one_shot(spark, tmp_path, split, schema, "split")) == records
    # A second run gives the new lines only, in a buffer of their own.
    with open(tmp_path / "in" / "a.log", "a") as f:
        f.write("more trace\n")
    again = one_shot(spark, tmp_path, fold, "file string, byte_pos bigint, log_line string, lines bigint, bytes bigint", "fold")
    assert len(again) == len(want) + 1 and max((r.byte_pos, r.log_line) for r in again)[1] == "more trace\\n"
