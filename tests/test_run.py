import csv
import datetime as dt
import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from logsluice import SinkSpec, SourceSpec
from logsluice.operators.records import to_record
from logsluice.plans.catalog import ACCESS_LAYOUT, ACCESS_REGEX
from logsluice.plans.run import plan_source, run_sources
from logsluice.session import checkpoint_dir
from logsluice.sinks.files import upload_folder, write_csv
from logsluice.sinks.objects import read_manifest
from logsluice.spec import DEFAULT_FORMAT, Attribute, SpecError

INGEST = dt.datetime(2024, 1, 1)


def access(i, ip="10.0.0.1"):
    return f'{ip} - - [05/Jun/2020:01:02:{i % 60:02d} +0000] "GET /{i} HTTP/1.1" 200 {i} "-" "ELB-HealthChecker/1.0" 0.5'


@pytest.fixture
def logs(tmp_path):
    web = tmp_path / "web"
    web.mkdir()
    (web / "a.log").write_text("header\n" + "".join(access(i) + "\n" for i in range(20)) + "Traceback\n  line 1\n" + access(20) + "\n")
    (web / "b.log").write_text("header\n" + access(30) + "\nend of it\n")
    (tmp_path / "app.json").write_text('{"timestamp":"2020-01-01T00:00:00.5Z","severity":"WARN","x":1}\nnot json\n')
    return tmp_path


def specs(logs, sink, **more):
    web = SourceSpec("web", str(logs / "web"), sink, "regex", ACCESS_LAYOUT, "log", ACCESS_REGEX, skip_header_line=True,
                     hostname="h1", app="shop", app_ver="1", **more)
    app = SourceSpec("app", str(logs / "app.json"), sink, "json", "2006-01-02T15:04:05.999Z", app="shop",
                     field_mappings={"log_level": "severity", "event_datetime": "timestamp"})
    return [web, app]


def read_csv(folder):
    rows = []
    for path in glob.glob(f"{folder}/**/part-*", recursive=True):
        with (gzip.open if path.endswith(".gz") else open)(path, "rt", newline="") as f:
            rows += list(csv.reader(f))
    return rows


def test_csv_run_with_rejects(spark, logs):
    sink = SinkSpec("lake", "csv", DEFAULT_FORMAT, str(logs / "out"))
    run_sources(spark, specs(logs, "lake"), [sink], rejects_path=str(logs / "rejects"), ingest=INGEST)
    rows = read_csv(logs / "out")
    assert len(rows) == 23 and {len(r) for r in rows} == {20}
    app = next(r for r in rows if r[6] == "WARN")
    assert app[3] == "2020-01-01T00:00:00.5Z" and app[19] == '{"x":1}' and app[4] == "\\N"
    web = next(r for r in rows if r[10] == "30")
    assert web[11] == "500" and web[13:17] == ["aws-elb", "1.0", "aws-elb", "1.0"] and web[5].endswith("b.log")
    rejects = {(r.file.rsplit("/", 1)[1], r.line) for r in spark.read.parquet(str(logs / "rejects")).collect()}
    assert rejects == {("a.log", "Traceback"), ("a.log", "  line 1"), ("b.log", "end of it"), ("app.json", "not json")}
    # A second run replaces the files.
    run_sources(spark, specs(logs, "lake"), [sink], ingest=INGEST)
    assert len(read_csv(logs / "out")) == 23


def test_multi_line_run(spark, logs):
    web = specs(logs, "lake", buffer_multi_lines=True)[0]
    plan = plan_source(spark, web, DEFAULT_FORMAT, ingest=INGEST)
    rows = plan.records.orderBy("file", "block_start", "mid").collect()
    assert plan.rejects.count() == 0
    lines = [(r.log_line, r.response_bytes) for r in rows]
    assert lines[20] == ("Traceback\\n  line 1\\n", None) and lines[21][1] == 20 and lines[-1] == ("end of it\\n", None)
    assert rows[20].event_datetime == INGEST and rows[20].app == "shop" and rows[20].hostname == "h1"


def test_front_split_run(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("2020-01-01 one\n more\n2020-01-02 two\n")
    spec = SourceSpec("s", str(path), "lake", "regex", "2006-01-02", front_split_regex=r"^\d{4}-",
                      line_regex=r"^(?P<event_datetime>\S+) (?P<user_tag>.*)$")
    rows = plan_source(spark, spec, DEFAULT_FORMAT, ingest=INGEST).records.orderBy("mid").collect()
    assert [(r.user_tag, r.event_datetime.day) for r in rows] == [("one more", 1), ("two", 2)]


def test_resume_age_and_version_run(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("---- app_ver: 7\n" + "".join(f"2020-01-0{i} e{i}\n" for i in range(1, 8)))
    spec = SourceSpec("s", str(path), "lake", "regex", "2006-01-02", app_ver="1",
                      line_regex=r"^(?P<event_datetime>\d\S+) (?P<user_tag>.*)$")
    name = plan_source(spark, spec, DEFAULT_FORMAT, ingest=INGEST).timed.first().file
    cursors = spark.createDataFrame([(name, dt.datetime(2020, 1, 3), "1")], "file string, last_event_ts timestamp, app_ver string")
    plan = plan_source(spark, spec, DEFAULT_FORMAT, ingest=INGEST, cursors=cursors, follow_version=True,
                       cutoff=F.lit("2020-01-05").cast("timestamp"))
    assert [(r.user_tag, r.app_ver) for r in plan.records.orderBy("mid").collect()] == [("e5", "7"), ("e6", "7"), ("e7", "7")]


def test_object_run_with_manifest(spark, logs):
    options = {"prefix": "pre", "compression": "gzip", "max_records_per_file": 10, "manifest": str(logs / "manifest"),
               "ddl_version": "v2", "buffer_size": 2000}
    sink = SinkSpec("tab", "s3", DEFAULT_FORMAT, str(logs / "store"), options)
    when = dt.datetime(2024, 5, 6, 7, 8)
    run_sources(spark, specs(logs, "tab"), [sink], uploaded=when, ingest=INGEST)
    folder = upload_folder(str(logs / "store"), "pre", "tab", when)
    assert folder.endswith("/store/pre/tab/2024/05/06/07/08")
    bodies = {p: gzip.decompress(open(p, "rb").read()) for p in glob.glob(f"{folder}/*.gz")}
    assert sum(len(list(csv.reader(b.decode().splitlines()))) for b in bodies.values()) == 23
    listed = read_manifest(spark, "", str(logs / "manifest")).collect()
    assert sum(r.record_count for r in listed) == 23 and {r.ddl_version for r in listed} == {"v2"}
    assert {str(logs / "store" / r.fullpath) for r in listed} == set(bodies)
    assert all("/2024/05/06/07/08/" in r.fullpath and r.record_count <= 10 for r in listed)
    # Each object but the last of a file is closed by the record that brings it to 2000 bytes or 10 records.
    assert all(len(b[: b[:-1].rfind(b"\n") + 1]) < 2000 for b in bodies.values())


def test_batch_and_event_runs(spark, logs):
    fire = SinkSpec("fire", "firehose", DEFAULT_FORMAT, str(logs / "fire"))
    run_sources(spark, specs(logs, "fire"), [fire], ingest=INGEST)
    batches = spark.read.parquet(str(logs / "fire" / "batches")).collect()
    assert sum(r.record_count for r in batches) == 23 and all(r.batch == 0 for r in batches)
    assert spark.read.parquet(str(logs / "fire" / "oversize")).count() == 0
    http = SinkSpec("post", "http", DEFAULT_FORMAT, str(logs / "post"), {"api_key": "k"})
    run_sources(spark, specs(logs, "post"), [http], ingest=INGEST)
    posts = [json.loads(r.payload) for r in spark.read.parquet(str(logs / "post")).collect()]
    events = sum((p["events"] for p in posts), [])
    assert len(events) == 23 and all("log_line" not in e and "line" not in e for e in events)
    assert {e["app"] for e in events} == {"shop"} and any(e.get("response_s") == "0.5" for e in events)


def test_newlines_inside_records_survive(spark, tmp_path):
    fmt = (Attribute("a"), Attribute("b"))
    df = spark.createDataFrame([("two\nlines", "x"), ('q"', None)], "a string, b string")
    write_csv(to_record(df, fmt), str(tmp_path / "o"), fmt)
    assert sorted(read_csv(tmp_path / "o")) == [['q"', "\\N"], ["two\nlines", "x"]]


def test_declarations_are_checked(spark, logs):
    with pytest.raises(SpecError):
        run_sources(spark, specs(logs, "none"), [SinkSpec("lake")])
    with pytest.raises(SpecError):
        run_sources(spark, specs(logs, "lake"), [SinkSpec("lake", "ftp")])


def test_checkpoint_folder_is_the_clusters(spark, tmp_path):
    known = checkpoint_dir(spark)
    assert known and checkpoint_dir(spark) == known
