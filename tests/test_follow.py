"""A streaming run gives what a batch run gives, each line once, and goes on from its cursors."""

import csv
import datetime as dt
import glob
import os
import shutil
import time

import pytest

from logsluice import SinkSpec, SourceSpec
from logsluice.operators.quality import file_cursors
from logsluice.plans import follow
from logsluice.plans.follow import IngestCounters, follow_sources
from logsluice.plans.run import plan_source, run_sources
from logsluice.sinks.files import load_cursors
from logsluice.sinks.objects import read_manifest
from logsluice.spec import DEFAULT_FORMAT

INGEST = dt.datetime(2024, 1, 1)
LAYOUT = "2006-01-02 15:04:05"
REGEX = r"^(?P<event_datetime>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (?P<log_level>\w+) (?P<user_tag>.*)$"


def stamp(i):
    return (dt.datetime(2030, 1, 1) + dt.timedelta(seconds=i)).strftime("%Y-%m-%d %H:%M:%S")


def log_lines(n, start=0):
    out = []
    for i in range(start, start + n):
        out.append(f"{stamp(i)} INFO event {i}")
        if i % 4 == 0:
            out += [f"  at frame {k} of {i}" for k in range(i % 3 + 1)]
    return out


def put(path, lines, mode="w"):
    with open(path, mode) as f:
        f.write("".join(line + "\n" for line in lines))


def spec(folder, sink="lake", **more):
    return SourceSpec("app", str(folder), sink, "regex", LAYOUT, "log", REGEX, app="shop", app_ver="1", **more)


def follow_all(spark, source, sink, root, **more):
    options = {"age_days": None, "ingest": INGEST, "rejects_path": str(root / "rejects")} | more
    run = follow_sources(spark, [source], [sink], str(root / "state"), **options)[0]
    run.wait()
    return run


def records(folder):
    rows = []
    for path in glob.glob(f"{folder}/**/part-*", recursive=True):
        with open(path, newline="") as f:
            rows += list(csv.reader(f))
    return sorted(tuple(r[:5] + r[6:]) for r in rows)  # all but the file name


def reject_rows(spark, folder, pattern="*"):
    return sorted((os.path.basename(r.file), r.line) for r in spark.read.parquet(f"{folder}/{pattern}").collect())


@pytest.mark.parametrize("more", [{}, {"skip_header_line": True}, {"buffer_multi_lines": True}, {"front_split_regex": r"^\d{4}-"}])
def test_equal_to_a_batch_run_in_any_pieces(spark, tmp_path, more):
    logs = tmp_path / "in"
    logs.mkdir()
    lines = {"a.log": log_lines(30), "b.log": log_lines(11, 100) + ["  tail"]}
    for step in range(3):  # each file arrives in three pieces, cut anywhere between lines
        for name, own in lines.items():
            put(logs / name, own[len(own) * step // 3 : len(own) * (step + 1) // 3], "a")
        source = spec(logs, **more)
        if step == 2:
            run = follow_all(spark, source, SinkSpec("lake", path=str(tmp_path / "out")), tmp_path, max_bytes_per_trigger=None)
        else:
            options = {"age_days": None, "ingest": INGEST, "rejects_path": str(tmp_path / "rejects")}
            run = follow_sources(spark, [source], [SinkSpec("lake", path=str(tmp_path / "out"))], str(tmp_path / "state"), **options)[0]
            run.query.awaitTermination(60)  # not flushed: the open end goes on in the next piece
            assert run.query.exception() is None
    run_sources(spark, [source], [SinkSpec("lake", path=str(tmp_path / "batch"))], rejects_path=str(tmp_path / "batch-rejects"), ingest=INGEST)
    assert records(tmp_path / "out") == records(tmp_path / "batch") and len(records(tmp_path / "out")) >= 39
    assert reject_rows(spark, tmp_path / "rejects") == reject_rows(spark, tmp_path / "batch-rejects", "")
    plan = plan_source(spark, source, DEFAULT_FORMAT, ingest=INGEST)
    want = sorted((os.path.basename(r.file), r.last_event_ts) for r in file_cursors(plan.timed).collect())
    assert sorted((os.path.basename(r.file), r.last_event_ts) for r in run.cursors().collect()) == want
    # A further run reads nothing.
    before = run.counters()
    again = follow_all(spark, source, SinkSpec("lake", path=str(tmp_path / "out")), tmp_path)
    assert again.counters() == before and records(tmp_path / "out") == records(tmp_path / "batch")


def test_a_repeated_step_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.log", log_lines(12))
    sink = SinkSpec("tab", "s3", DEFAULT_FORMAT, str(tmp_path / "store"), {"buffer_size": 300})
    run = follow_all(spark, spec(tmp_path / "in", "tab"), sink, tmp_path)
    listed = {(r.fullpath, r.record_count) for r in read_manifest(spark, str(tmp_path / "store")).collect()}
    assert sum(n for _, n in listed) == 12 and len(listed) > 1
    # The query lost its last commit, the run lost the row that ends the step.
    for path in glob.glob(str(tmp_path / "state/app/checkpoint/commits/*")) + glob.glob(str(tmp_path / "state/app/checkpoint/commits/.*.crc")):
        os.remove(path)
    run.ledger.drop(run.ledger.names("step-")[-1])
    run = follow_all(spark, spec(tmp_path / "in", "tab"), sink, tmp_path)
    assert {(r.fullpath, r.record_count) for r in read_manifest(spark, str(tmp_path / "store")).collect()} == listed
    assert run.counters()["lines_parsed"] == 12


def test_without_its_checkpoint_a_run_goes_on_from_the_cursors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.log", log_lines(10) + ["  open end"])
    sink = SinkSpec("lake", path=str(tmp_path / "out"))
    source = spec(tmp_path / "in", buffer_multi_lines=True)
    follow_all(spark, source, sink, tmp_path)
    first = records(tmp_path / "out")
    shutil.rmtree(tmp_path / "state/app/checkpoint")
    put(tmp_path / "in" / "a.log", [f"{stamp(5)} INFO late but new"], "a")
    put(tmp_path / "in" / "a.log", log_lines(3, 50), "a")
    run = follow_all(spark, source, sink, tmp_path)
    new = [r for r in records(tmp_path / "out") if r not in first]
    # From the first later line on; the line with an earlier time before it was passed over.
    assert sum("event" in r[7] for r in new) == 3 and not any("late" in r[7] for r in new)
    assert run.last().waiting == 0


def test_skip_to_end_and_age(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.log", log_lines(5))
    sink = SinkSpec("lake", path=str(tmp_path / "out"))
    source = spec(tmp_path / "in", skip_to_end=True)
    follow_all(spark, source, sink, tmp_path)
    put(tmp_path / "in" / "a.log", [f"{stamp(60)} INFO fresh", "2001-01-01 00:00:00 INFO too old"], "a")
    follow_all(spark, source, sink, tmp_path, age_days=10)
    assert [r[7] for r in records(tmp_path / "out")] == ["fresh"]


def test_versions_go_on_over_steps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sink = SinkSpec("lake", path=str(tmp_path / "out"))
    for piece in ([f"{stamp(1)} INFO one", "---- app_ver: 7", f"{stamp(2)} INFO two"], [f"{stamp(3)} INFO three"]):
        put(tmp_path / "in" / "a.log", piece, "a")
        run = follow_all(spark, spec(tmp_path / "in"), sink, tmp_path, follow_version=True)
    assert [(r[1], r[7]) for r in records(tmp_path / "out")] == [("1", "one"), ("7", "two"), ("7", "three")]
    assert [(r.app_ver, r.last_event_ts.second) for r in run.cursors().collect()] == [("7", 3)]


def test_a_running_source_closes_what_is_idle_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    counters = IngestCounters()
    spark.streams.addListener(counters)
    sink = SinkSpec("lake", path=str(tmp_path / "out"))
    options = {"every": "300 milliseconds", "age_days": None, "ingest": INGEST}
    put(tmp_path / "in" / "a.log", log_lines(4) + [f"{stamp(9)} INFO last", "  one", "  two"])
    run = follow_sources(spark, [spec(tmp_path / "in", buffer_multi_lines=True)], [sink], str(tmp_path / "state"), **options)[0]
    try:
        end = time.time() + 60
        while time.time() < end and run.last().open_lines != 2:
            time.sleep(0.2)
        assert run.last().open_lines == 2
        run.wait(8, idle_ms=1500)
        assert run.last().open_lines == 0
        assert any("  one\\n  two\\n" in r[-1] for r in records(tmp_path / "out"))
    finally:
        run.stop()
        spark.streams.removeListener(counters)
    assert counters.totals["follow-app"]["lines"] == 8 and counters.totals["follow-app"]["batches"] >= 1
    logged = spark.read.parquet(str(tmp_path / "state/app/log/*")).collect()
    assert {r.stream for r in logged} == {"lake"} and any(r.message == "streamed 5 lines of 8" for r in logged)


def test_batch_runs_save_and_load_cursors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.log", log_lines(6))
    sink = SinkSpec("lake", path=str(tmp_path / "out"))
    for n, piece in enumerate(([], log_lines(4, 20), [])):
        put(tmp_path / "in" / "a.log", piece, "a")
        run_sources(spark, [spec(tmp_path / "in")], [sink], cursors_path=str(tmp_path / "cursors"), ingest=INGEST)
        assert len(records(tmp_path / "out")) == (6, 4, 0)[n]
    assert [(r.app_ver, r.last_event_ts.second) for r in load_cursors(spark, str(tmp_path / "cursors")).collect()] == [("1", 23)]
    run_sources(spark, [spec(tmp_path / "in")], [sink], age_days=10, ingest=INGEST)
    assert len(records(tmp_path / "out")) == 10


def test_open_record_leaves_the_last_of_each_file(spark):
    rows = [("a", 0, 0, "x"), ("a", 0, 1, "S1"), ("a", 5, 6, "y"), ("a", 9, 9, "S2"), ("a", 9, 10, "z"), ("b", 0, 0, "no start")]
    lines = spark.createDataFrame(rows, follow.LINE_SCHEMA)
    closed, held = follow.open_record(lines, "^S")
    assert sorted(r.line for r in closed.collect()) == ["S1", "x", "y"]
    assert sorted(r.line for r in held.collect()) == ["S2", "no start", "z"]
