import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from logsluice.operators.delivery import (
    TRANSACTION_SALT,
    Greedy,
    assign_batches,
    collect_batches,
    dedup_batches,
    drop_oversize,
    encoded_size,
    event_batches,
    object_manifest,
)
from logsluice.operators.records import encode_csv
from logsluice.spec import Attribute, LineKey

KEY = LineKey("file", "block", "pos")


def by_hand(rows, max_records, over):
    """rows: (shard, pos, size), ordered."""
    out, shard, batch, n, size = {}, None, 0, 0, 0
    for s, p, z in rows:
        if s != shard:
            shard, batch, n, size = s, 0, 0, 0
        out[s, p] = batch
        n, size = n + 1, size + z
        if n == max_records or (over is not None and size > over):
            batch, n, size = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("max_records, over, seed", [(500, 2_000_000, 1), (7, 300, 2), (None, 150, 3), (5, None, 4), (1, 1, 5)])
def test_greedy_batches(spark, max_records, over, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("aaab"), i, rnd.choice([1, 20, 90, 400])) for i in range(1500)]
    df = spark.createDataFrame(rows, "shard string, pos bigint, size bigint").withColumn("text", F.lit("kept"))
    # Small Arrow batches, so that a delivery batch spans several of them.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = assign_batches(df, F.col("size"), ["shard"], ["pos"], max_records, over).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.shard, r.pos): r.batch for r in got} == by_hand(sorted(rows), max_records, over)
    assert all(r.text == "kept" for r in got) and len(got) == len(rows)


def test_greedy_needs_no_spark():
    import numpy as np

    cut = Greedy(None, 10)
    assert cut.number(np.array([1, 1, 1, 2]), np.array([6, 6, 1, 50])).tolist() == [0, 0, 1, 0]
    assert cut.number(np.array([2, 2]), np.array([1, 1])).tolist() == [1, 1]


def test_batches_collect_in_order_and_oversize(spark):
    rows = [("f", 0, i, "r" * (i % 5) + str(i)) for i in range(40)] + [("f", 0, 40, "z" * 100)]
    df = spark.createDataFrame(rows, "file string, block bigint, pos bigint, csv_line string")
    small, large = drop_oversize(df, limit=50)
    assert [r.pos for r in large.collect()] == [40]
    batched = assign_batches(small, encoded_size(F.col("csv_line")), KEY.slice, [KEY.pos], 16, 10_000)
    got = collect_batches(batched, [*KEY.slice, "batch"], [KEY.pos]).orderBy("batch").collect()
    assert [r.record_count for r in got] == [16, 16, 8]
    assert sum((r.records for r in got), []) == [r[3] for r in rows[:40]]
    assert got[0].batch_bytes == sum(len(t) + 1 for t in got[0].records)


def test_csv_text_quotes_only_where_needed(spark):
    texts = ["plain", "a,b", 'q"q', " lead", "two\nlines", "", "\\.", "\\N", "tail ", "\ttab", "cr\r", None, "\xa0nb"]
    fmt = (Attribute("a"), Attribute("b"))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, a string, b string")
    got = [r[1] for r in df.select("i", encode_csv(fmt)).orderBy("i").collect()]
    quoted = {"a,b": '"a,b"', 'q"q': '"q""q"', " lead": '" lead"', "two\nlines": '"two\nlines"', "\\.": '"\\."',
              "\ttab": '"\ttab"', "cr\r": '"cr\r"', "\xa0nb": '"\xa0nb"', None: "\\N"}
    assert got == [quoted.get(t, t) + ",x" for t in texts]
    for line, text in zip(got, texts):
        assert next(csv.reader(io.StringIO(line, newline="")))[0] == ("\\N" if text is None else text)


def test_event_batches(spark):
    rows = [("hot", i // 10, i % 10, f"line {i}", None if i % 3 else str(i)) for i in range(57)]
    df = spark.createDataFrame(rows, "file string, block bigint, pos bigint, line string, user_tag string")
    df = df.withColumn("log_line", F.lit("not sent")).withColumn("ingest_datetime", F.lit("not sent"))
    got = event_batches(df, ["user_tag", "log_line", "ingest_datetime"], 'k"1', KEY, batch_events=20).orderBy("batch")
    got = got.collect()
    assert [r.event_count for r in got] == [20, 20, 17]
    for b, r in enumerate(got):
        part = rows[b * 20 : b * 20 + 20]
        digest = hashlib.md5(b"".join(hashlib.md5(x[3].encode()).digest() for x in part) + TRANSACTION_SALT.encode())
        assert r.transaction_id == digest.hexdigest()
        body = json.loads(r.payload)
        assert list(body) == ["api_key", "transaction_id", "events"] and body["api_key"] == 'k"1'
        assert body["events"] == [{"user_tag": "\\N" if x[4] is None else x[4]} for x in part]
    again = dedup_batches(spark.createDataFrame(got + got), spark.createDataFrame(got[:1]))
    assert sorted(r.batch for r in again.collect()) == [1, 2]
    assert dedup_batches(spark.createDataFrame(got + got)).count() == 3


def test_manifest(spark):
    rows = [("s", i, f"rec{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "shard string, pos bigint, csv_line string")
    when = F.lit("2024-02-03 04:05:06").cast("timestamp")
    got = object_manifest(df, "tab", when, ["shard"], ["pos"], 15, "", "v1").orderBy("body").collect()
    assert [r.record_count for r in got] == [3, 3, 3, 1]
    body = "rec0\nrec1\nrec2\n"
    assert got[0].body == body
    assert got[0].fullpath == "tab/2024/02/03/04/05/" + hashlib.md5(body.encode()).hexdigest()
