"""Objects on disk, their manifest, and repeated, cut-short and failed deliveries."""

import datetime as dt
import glob
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from logsluice.operators.delivery import object_manifest
from logsluice.sinks import objects
from logsluice.sinks.ledger import LEDGER, Ledger, batch_name, first_upload
from logsluice.sinks.objects import ObjectWriter, Staged, read_manifest, stream_objects, write_encoded, write_objects
from logsluice.spec import Attribute, LineKey

WHEN = dt.datetime(2031, 4, 5, 6, 7, tzinfo=dt.timezone.utc)
KEY = LineKey("file", "block", "pos")


@pytest.fixture
def lines(spark):
    rows = [(f"f{i % 3}", i % 2, i, f"line {i} " + "é" * (i % 11)) for i in range(500)]
    return spark.createDataFrame(rows, "file string, block bigint, pos bigint, csv_line string").repartition(5)


def stored(folder):
    """Path below the folder -> bytes, without ledger and staging."""
    found = {}
    for path in glob.glob(f"{folder}/**/*", recursive=True):
        if os.path.isfile(path) and f"/{LEDGER}/" not in path:
            found[os.path.relpath(path, folder)] = open(path, "rb").read()
    return found


def staged_left(folder):
    return [f for _, _, names in os.walk(f"{folder}/{objects.STAGING}") for f in names]


def test_objects_equal_the_manifest_operator(spark, lines, tmp_path):
    store = str(tmp_path / "store")
    write_encoded(lines, store, "tab", KEY.slice, [KEY.pos], "pre", "v3", 300, uploaded=WHEN)
    when = F.lit("2031-04-05 06:07:00").cast("timestamp")
    expected = object_manifest(lines, "tab", when, KEY.slice, [KEY.pos], 300, "pre", "v3").collect()
    found = stored(store)
    assert found == {r.fullpath: r.body.encode() for r in expected} and len(found) > 20
    listed = read_manifest(spark, store).collect()
    want = sorted((r.fullpath, r.table_name, r.ddl_version, r.record_count, len(r.body.encode())) for r in expected)
    assert sorted((r.fullpath, r.table_name, r.ddl_version, r.record_count, r.bytes) for r in listed) == want
    assert all(path.endswith(hashlib.md5(body).hexdigest()) for path, body in found.items())
    assert not staged_left(store)


def test_records_and_gzip(spark, tmp_path):
    fmt = (Attribute("n", "integer"), Attribute("word"))
    rows = spark.range(40).selectExpr("'f' as file", "0L as block", "id as pos", "id as n", "concat('w', id) as word")
    store = str(tmp_path / "store")
    write_objects(rows, store, "t", fmt, KEY, max_records=16, gzip=True, uploaded=WHEN)
    found = stored(store)
    assert sorted(len(gzip.decompress(b).splitlines()) for b in found.values()) == [8, 16, 16]
    assert all(p == f"t/2031/04/05/06/07/{hashlib.md5(b).hexdigest()}.gz" for p, b in found.items())
    assert [r.record_count for r in read_manifest(spark, store).orderBy("record_count").collect()] == [8, 16, 16]


def test_equal_objects_all_stay(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", 0, 0, "same") for i in range(6)], "file string, block bigint, pos bigint, csv_line string")
    store = str(tmp_path / "store")
    write_encoded(rows, store, "t", KEY.slice, [KEY.pos], uploaded=WHEN)
    assert len(stored(store)) == 6 == read_manifest(spark, store).select("fullpath").distinct().count()


def test_a_repeated_batch_is_delivered_once(spark, lines, tmp_path):
    store = str(tmp_path / "store")
    for minute in (7, 8, 9):
        write_encoded(lines, store, "t", KEY.slice, [KEY.pos], buffer_bytes=900, uploaded=WHEN.replace(minute=minute), batch_id=4)
    listed = read_manifest(spark, store).collect()
    assert {p.split("/")[5] for p in stored(store)} == {"07"}
    assert sum(r.record_count for r in listed) == 500 and len(listed) == len(stored(store))
    assert {r.delivery for r in listed} == {batch_name(4)}
    write_encoded(lines, store, "t", KEY.slice, [KEY.pos], buffer_bytes=900, uploaded=WHEN, batch_id=5)
    assert read_manifest(spark, store).groupBy().sum("record_count").first()[0] == 1000


def test_a_commit_cut_short_is_carried_on(spark, tmp_path, monkeypatch):
    """The driver dies after some moves; the next attempt, a minute later, ends the first one's delivery."""
    import pyarrow as pa

    def attempt(minute, texts):
        writer = ObjectWriter({"path": str(tmp_path), "table": "t", "bufferSize": "10", "batchId": "1", "uploaded": WHEN.replace(minute=minute).isoformat()})
        batch = pa.RecordBatch.from_pydict({"shard": pa.array([1] * len(texts), pa.int64()), "csv_line": texts})
        return writer, writer.write(iter([batch]))

    first, message = attempt(7, ["a" * 20, "b" * 20, "c" * 20])
    real, calls = objects._Delivery.move, []

    def dies(self, rows):
        real(self, rows[:1])
        raise KeyboardInterrupt

    monkeypatch.setattr(objects._Delivery, "move", dies)
    with pytest.raises(KeyboardInterrupt):
        first.commit([message])
    monkeypatch.setattr(objects._Delivery, "move", real)
    assert Ledger(f"{tmp_path}/{LEDGER}").names() == [] and read_manifest(spark, str(tmp_path)).count() == 0
    second, again = attempt(8, ["a" * 20, "b" * 20, "c" * 20])
    second.commit([again])
    second.commit([again])
    found = {p: b for p, b in stored(tmp_path).items() if objects.STAGING not in p}
    assert sorted(found.values()) == [x * 20 + b"\n" for x in (b"a", b"b", b"c")]
    assert all(p.startswith("t/2031/04/05/06/07/") for p in found)
    assert len(Ledger(f"{tmp_path}/{LEDGER}").rows(batch_name(1))) == 3


def test_an_aborted_write_leaves_nothing(spark, lines, tmp_path):
    store = str(tmp_path / "store")
    bad = lines.withColumn("csv_line", F.when(F.col("pos") == 499, F.raise_error(F.lit("broken"))).otherwise(F.col("csv_line")))
    with pytest.raises(Exception, match="broken"):
        write_encoded(bad, store, "t", KEY.slice, [KEY.pos], buffer_bytes=300)
    assert stored(store) == {} and not staged_left(store)
    assert read_manifest(spark, store).count() == 0


def test_an_empty_delivery_is_in_the_ledger(spark, lines, tmp_path):
    store = str(tmp_path / "store")
    write_encoded(lines.limit(0), store, "t", KEY.slice, [KEY.pos], batch_id=0)
    assert Ledger(f"{store}/{LEDGER}").names() == [batch_name(0)] and read_manifest(spark, store).count() == 0


def test_the_driver_sends_only_what_was_staged():
    assert Staged().objects == []


def test_stream_delivers_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.range(300).selectExpr("concat('f', id % 4) as file", "0L as block_start", "id as byte_pos", "concat('w', id) as word")
    for part in range(3):
        rows.filter(F.col("byte_pos") % 3 == part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store = str(tmp_path / "store")
    for _ in range(2):
        query = stream_objects(stream, store, "t", str(tmp_path / "cp"), (Attribute("word"),), buffer_bytes=100)
        query.awaitTermination(60)
        listed = read_manifest(spark, store).collect()
        assert len({r.delivery for r in listed}) == 3 and sum(r.record_count for r in listed) == 300
        found = stored(store)
        assert sorted(found) == sorted(r.fullpath for r in listed) and not os.listdir(f"{store}/{objects.STAGING}")
        assert sorted(b"".join(found.values()).split()) == sorted(b"w%d" % i for i in range(300))
    # The last commit of the checkpoint is lost: the batch runs again and finds itself in the ledger.
    last = max(glob.glob(str(tmp_path / "cp" / "commits" / "[0-9]*")))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    killed = os.path.join(store, objects.STAGING, f"query-{hashlib.md5(str(tmp_path / 'cp').encode()).hexdigest()}", "attempt")
    os.makedirs(killed)
    open(os.path.join(killed, "00000000"), "w").close()
    stream_objects(stream, store, "t", str(tmp_path / "cp"), (Attribute("word"),), buffer_bytes=100).awaitTermination(60)
    assert stored(store) == found and read_manifest(spark, store).count() == len(listed)
    assert not staged_left(store)


def test_upload_time_of_a_batch_is_its_first(tmp_path):
    one = first_upload(str(tmp_path), 3, WHEN)
    assert first_upload(str(tmp_path), 3) == one == WHEN and first_upload(str(tmp_path), 4) != WHEN
