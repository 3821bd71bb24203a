"""Ordered operators against plain Python over the same lines, with a source that holds most of them."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from logsluice.operators.flow import (
    age_cutoff,
    bounded_broadcast,
    carry_app_ver,
    counts_before,
    fold_continuations,
    limit_age,
    number_lines,
    resume_from,
    running_count,
    split_records,
    split_rejects,
)
from logsluice.operators.merge import list_sources, merge_hosts, number_merged, tail_view
from logsluice.operators.parsers import OK
from logsluice.operators.quality import file_cursors, ingest_log, ingest_report, observe_ingest
from logsluice.spec import LineKey, SourceSpec

KEY = LineKey("file", "block", "pos")


def make_lines(seed, n=600, block=37, bad=0.6):
    """(file, block, pos, line, parse_ok); file "hot" has about two thirds of the lines."""
    rnd = random.Random(seed)
    counts, rows = {}, []
    for i in range(n):
        file = rnd.choice(["hot", "hot", "hot", "hot", "b", "c"])
        at = counts.get(file, 0)
        counts[file] = at + 1
        ok = rnd.random() > bad
        line = ("S" if rnd.random() < 0.25 else "x") + "ä" * rnd.randrange(0, 9) + str(i)
        rows.append((file, at // block, at % block, line, ok))
    rnd.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame(rows, f"file string, block bigint, pos bigint, line string, {OK} boolean")

    return make


def by_file(rows):
    files = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        files.setdefault(r[0], []).append(r)
    return files


def fold_by_hand(rows, limit):
    out = []
    for file, lines in by_file(rows).items():
        chunk = None
        for _, block, pos, line, ok in lines:
            if ok:
                if chunk:
                    out.append(tuple(chunk))
                chunk = None
                continue
            if chunk and chunk[5] >= limit:
                out.append(tuple(chunk))
                chunk = None
            chunk = chunk or [file, block, pos, "", 0, 0]
            chunk[3] += line + "\\n"
            chunk[4] += 1
            chunk[5] += len(line.encode()) + 2
        if chunk:
            out.append(tuple(chunk))
    return sorted(out)


@pytest.mark.parametrize("seed, limit, bad", [(1, 65_535, 0.6), (2, 60, 0.9), (3, 25, 1.0), (4, 200, 0.05)])
def test_fold(frame, seed, limit, bad):
    rows = make_lines(seed, bad=bad)
    got = fold_continuations(frame(rows), KEY, limit=limit)
    assert sorted(map(tuple, got.collect())) == fold_by_hand(rows, limit)


def test_fold_keeps_all_text_of_an_endless_run(frame):
    rows = make_lines(5, bad=1.0)
    got = fold_continuations(frame(rows), KEY, limit=50, flush_bytes=300).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.file, r.block, r.pos)):
        text[r.file] = text.get(r.file, "") + r.log_line
    assert text == {f: "".join(x[3] + "\\n" for x in lines) for f, lines in by_file(rows).items()}
    assert max(r.bytes for r in got) < 50 + 40


def test_fold_does_not_depend_on_slices(frame):
    rows = make_lines(6, bad=0.8)
    flat = [(f, 0, b * 37 + p, line, ok) for f, b, p, line, ok in rows]
    texts = [
        sorted((r.file, r.log_line) for r in fold_continuations(frame(x), KEY, limit=70).collect()) for x in (rows, flat)
    ]
    assert texts[0] == texts[1]


def test_fold_of_a_long_run_is_not_cut_at_4_mib(frame):
    rows = [("f", i // 500, i % 500, "x" * 998, False) for i in range(9_000)]
    got = fold_continuations(frame(rows), KEY)
    assert sorted(map(tuple, got.collect())) == fold_by_hand(rows, 65_535)


def split_by_hand(rows):
    out = []
    for file, lines in by_file(rows).items():
        record = None
        for _, block, pos, line, _ in lines:
            if record is None or re.match("^S", line):
                if record:
                    out.append(tuple(record))
                record = [file, block, pos, 0, ""]
            record[4] += line
        out.append(tuple(record))
    return sorted(out)


@pytest.mark.parametrize("seed, block", [(1, 37), (2, 3), (3, 1), (4, 10_000)])
def test_split_records(frame, seed, block):
    rows = make_lines(seed, block=block)
    assert sorted(map(tuple, split_records(frame(rows), "^S", KEY).collect())) == split_by_hand(rows)


def test_split_without_any_start_goes_on_in_parts(frame):
    rows = [("f", i // 5, i % 5, f"line {i};", True) for i in range(100)]
    got = split_records(frame(rows), "^never", KEY, part_bytes=100).orderBy("part").collect()
    assert [r.part for r in got] == list(range(len(got))) and len(got) > 3
    assert "".join(r.line for r in got) == "".join(r[3] for r in rows)
    assert len(split_records(frame(rows), "^never", KEY).collect()) == 1


def test_split_joins_a_record_over_64_mib(spark, frame):
    rows = [("f", i, 0, i % 20 == 0) for i in range(20)]
    lines = spark.createDataFrame(rows, "file string, block long, pos long, begins boolean").repartition(4)
    text = F.concat(F.when(F.col("begins"), "S").otherwise("x"), F.repeat(F.lit("y"), (4 << 20) - 1))
    out = split_records(lines.withColumn("line", text), "^S", KEY)
    assert [tuple(r) for r in out.select("block", "part", F.length("line")).collect()] == [(0, 0, 80 << 20)]


def test_fold_shuffles_lines_once(frame, spark, tmp_path):
    # Both readers of the sliced lines share one shuffle.
    frame(make_lines(1)).write.parquet(str(tmp_path / "t"))
    for result in (
        fold_continuations(spark.read.parquet(str(tmp_path / "t")), KEY),
        split_records(spark.read.parquet(str(tmp_path / "t")), "^S", KEY),
    ):
        result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in plan
        assert plan.count("FileScan") == 1


def test_running_count_and_numbers(frame):
    rows = make_lines(8)
    got = {tuple(r)[:3]: r.n for r in running_count(frame(rows), F.col(OK), "n", KEY).select("file", "block", "pos", "n").collect()}
    for lines in by_file(rows).values():
        n = 0
        for r in lines:
            n += r[4]
            assert got[r[:3]] == n
    ids = {tuple(r)[:3]: r.line_id for r in number_lines(frame(rows), ["block", "file"], ["pos"]).select("file", "block", "pos", "line_id").collect()}
    ordered = sorted(ids, key=lambda k: (k[1], k[0], k[2]))
    assert [ids[k] for k in ordered] == list(range(1, len(rows) + 1))


def test_carry_version(frame):
    rows = [(f, b, p, f"---- app_ver: {b}.{p}" if (b * 7 + p) % 40 == 11 else line, ok) for f, b, p, line, ok in make_lines(9)]
    got = {tuple(r)[:3]: r.app_ver for r in carry_app_ver(frame(rows), "none", KEY).select("file", "block", "pos", "app_ver").collect()}
    for lines in by_file(rows).values():
        now = "none"
        for r in lines:
            m = re.match(r"^---- app_ver: (.*)$", r[3])
            now = m.group(1) if m else now
            assert got[r[:3]] == now


def test_versions_leave_the_lines_where_they_are(frame):
    rows = [(f, b, p, f"---- app_ver: {b}.{p}" if p == 3 else line, ok) for f, b, p, line, ok in make_lines(10)]
    lines = frame(rows)
    looked_up, by_slice = carry_app_ver(lines, "none", KEY), carry_app_ver(lines, "none", KEY, max_markers=1)
    assert sorted(map(str, looked_up.collect())) == sorted(map(str, by_slice.select(*looked_up.columns).collect()))
    plan = looked_up._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan
    # Only the markers of each source are exchanged.
    assert "Exchange hashpartitioning(_source" in plan and "hashpartitioning(file" not in plan


def test_counts_before_need_no_single_task(spark):
    rnd = random.Random(12)
    numbers = {rnd.choice([rnd.randrange(50), rnd.randrange(10**5), rnd.randrange(2**62)]): rnd.randint(0, 9) for _ in range(700)}
    counts = spark.createDataFrame(list(numbers.items()), "b bigint, n bigint")
    got = {r.b: r.before for r in counts_before(counts, "b", "n", "before").collect()}
    total = 0
    for b in sorted(numbers):
        assert got[b] == total
        total += numbers[b]


def test_merged_numbers_use_no_single_partition(frame):
    merged = merge_hosts({"a": frame(make_lines(11)), "b": frame(make_lines(12))})
    plan = number_merged(merged, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.fixture
def timed(spark):
    def make(seed, n=400):
        rnd = random.Random(seed)
        base = dt.datetime(2024, 1, 1)
        rows = []
        for file, share in (("hot", n), ("b", n // 10), ("new", n // 10), ("old", 20)):
            for i in range(share):
                t = None if rnd.random() < 0.2 else base + dt.timedelta(minutes=i + rnd.randrange(-5, 5))
                rows.append((file, i // 33, i % 33, t))
        return rows, spark.createDataFrame(rows, "file string, block bigint, pos bigint, event_ts timestamp")

    return make


@pytest.mark.parametrize("equal", [False, True])
def test_resume(spark, timed, equal):
    rows, df = timed(3)
    some = next(r[3] for r in rows[150:] if r[3])
    marks = {"hot": some, "b": dt.datetime(2024, 1, 1, 0, 10), "old": dt.datetime(2030, 1, 1)}
    cursors = spark.createDataFrame([(k, v) for k, v in marks.items()], "file string, last_event_ts timestamp")
    expected, open_files = [], set()
    for r in rows:  # already in line order by file
        file, t = r[0], r[3]
        if file in marks and file not in open_files:
            if t is None or t < marks[file] or (t == marks[file] and not equal):
                continue
            open_files.add(file)
        expected.append(r)
    got = resume_from(df, cursors, KEY, equal_times=equal)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    # A side too large for a broadcast gives the same rows through a shuffle join.
    import logsluice.operators.flow as flow

    limit, flow.MAX_BROADCAST_ROWS = flow.MAX_BROADCAST_ROWS, 0
    try:
        again = resume_from(df, cursors, KEY, equal_times=equal)
        assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, expected))
    finally:
        flow.MAX_BROADCAST_ROWS = limit


def test_broadcast_is_checked(spark):
    small = spark.range(10)
    assert "broadcast" in bounded_broadcast(small, max_rows=10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in bounded_broadcast(small, max_rows=9)._jdf.queryExecution().logical().toString().lower()


def test_age_and_cursors(timed):
    rows, df = timed(4)
    cutoff = dt.datetime(2024, 1, 1, 3)
    kept = limit_age(df, age_cutoff(10, cutoff + dt.timedelta(days=10))).count()
    assert kept == sum(1 for r in rows if r[3] is None or r[3] >= cutoff)
    last = {}
    for r in rows:
        if r[3]:
            last[r[0]] = r[3]
    assert {r.file: r.last_event_ts for r in file_cursors(df, KEY).collect()} == last


def test_reports(frame, spark):
    from pyspark.sql import Observation

    rows = make_lines(10)
    df = frame(rows)
    report = {r.file: (r.lines_read, r.lines_parsed, r.lines_rejected) for r in ingest_report(df).collect()}
    for file, lines in by_file(rows).items():
        ok = sum(r[4] for r in lines)
        assert report[file] == (len(lines), ok, len(lines) - ok)
    seen = Observation("ingest")
    observe_ingest(df, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["lines_read"] == len(rows)
    good, bad = split_rejects(df, key=KEY)
    assert good.count() + bad.count() == len(rows) and bad.columns == ["file", "block", "pos", "line", "reason"]
    log = ingest_log(df, "lake", "web", F.lit("t")).filter("file = 'hot'").first()
    assert log.level == "warning" and log.message == f"streamed {report['hot'][1]} lines of {report['hot'][0]}"


def test_merge_view_catalogue(frame, spark):
    a, b = frame(make_lines(11)), frame(make_lines(12))
    merged = merge_hosts({"a": a, "b": b})
    ids = sorted(r.line_id for r in number_merged(merged, KEY).select("line_id").collect())
    assert ids == list(range(1, 1201))
    assert tail_view(merged, "hot").filter("file <> 'hot'").count() == 0
    specs = [SourceSpec("h", "hot", "s", "csv"), SourceSpec("n", "ho", "s", "csv")]
    listed = {r.name: (r.file, r.lines) for r in list_sources(spark, specs, a).collect()}
    assert listed["n"] == (None, 0) and listed["h"] == ("hot", a.filter("file = 'hot'").count())
