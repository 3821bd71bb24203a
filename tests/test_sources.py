import os
import re

import pytest
from pyspark.sql import functions as F

from logsluice.sinks.files import write_cursors
from logsluice.sources.logtail import LogTailReader
from logsluice.operators.merge import glob_regex, list_sources
from logsluice.sources.text import normal_path, number_in_batch, read_cursors, read_lines, skip_header, skip_header_stream, stream_directory
from logsluice.sources.logtail import stream_lines
from logsluice.spec import SourceSpec


def put(path, data, mode="wb"):
    with open(path, mode) as f:
        f.write(data)
    return str(path)


def test_lines_of_a_file(spark, tmp_path):
    path = put(tmp_path / "a.log", b"one\r\n\ntwo\nbad \xff byte\nlast")
    rows = read_lines(spark, path).orderBy("file", "block_start", "mid").collect()
    assert [r.line for r in rows] == ["one\r", "", "two", "bad � byte", "last"]
    assert rows[0].file.endswith("a.log")


def test_plain_paths_and_pruned_files(spark, tmp_path):
    folder = tmp_path / "logs a+b%20"
    folder.mkdir()
    paths = [put(folder / f"x{i} é.log", f"l{i}\n".encode()) for i in range(4)]
    lines = read_lines(spark, str(folder))
    assert sorted((r.file, r.line) for r in lines.collect()) == [(p, f"l{i}") for i, p in enumerate(paths)]
    some = read_lines(spark, str(folder), only=[paths[2], "file://" + paths[3]])
    assert sorted(r.line for r in some.collect()) == ["l2", "l3"]
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.inputRDD().getNumPartitions() > 0 and scan.metrics().apply("numFiles").value() == 2
    specs = [SourceSpec("all", str(folder) + "/", "s", "csv"), SourceSpec("one", paths[1], "s", "csv"), SourceSpec("like", str(tmp_path / "logs"), "s", "csv")]
    listed = sorted((r.name, r.file or "", r.lines) for r in list_sources(spark, specs, lines).collect())
    assert listed == sorted([("all", p, 1) for p in paths] + [("one", paths[1], 1), ("like", "", 0)])
    assert normal_path("s3://bucket//a//b/") == "s3://bucket/a/b" and normal_path("/") == "/"


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("/a/*.log", "/a/x.log", "/a/b/x.log"),
        ("/a/[!b-d]?", "/a/ez", "/a/bz"),
        ("/{a,b c}/x+", "/b c/x+", "/c/xx"),
        ("/a.b/*", "/a.b/", "/aXb/c"),
    ],
)
def test_globs(glob, yes, no):
    regex = glob_regex(glob).replace(r"\z", r"\Z")
    assert re.match(regex, yes) and not re.match(regex, no)


def test_order_over_many_splits(spark, tmp_path):
    path = put(tmp_path / "big.log", "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = read_lines(spark, path).orderBy("block_start", "mid").collect()
        kept = skip_header(read_lines(spark, path)).orderBy("block_start", "mid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block_start for r in rows}) > 5
    assert [r.line.split()[1] for r in rows] == [str(i) for i in range(5000)]
    assert [r.line.split()[1] for r in kept] == [str(i) for i in range(1, 5000)]


def test_directory_and_header(spark, tmp_path):
    put(tmp_path / "a.log", b"h\na1\n")
    put(tmp_path / "b.log", b"h\nb1\nb2\n")
    put(tmp_path / "c.txt", b"no\n")
    put(tmp_path / "plain", b"no\n")
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub" / "d.log", b"no\n")
    lines = skip_header(read_lines(spark, str(tmp_path), "log"))
    assert sorted(r.line for r in lines.collect()) == ["a1", "b1", "b2"]


def test_directory_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.log", b"a1\na2\n")
    put(tmp_path / "in" / "b.txt", b"no\n")
    got = []

    def take(batch, _):
        got.extend((os.path.basename(r.file), r.line) for r in number_in_batch(batch).orderBy("file", "mid").collect())

    for step in range(2):
        stream = stream_directory(spark, str(tmp_path / "in"), "log", 1)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(60)
        put(tmp_path / "in" / "c.log", b"c1\n")
    assert got == [("a.log", "a1"), ("a.log", "a2"), ("c.log", "c1")]


def test_cursors(spark, tmp_path):
    path = str(tmp_path / "state")
    assert read_cursors(spark, path).count() == 0
    os.mkdir(path)
    put(tmp_path / "state" / "s.csv", b'/a,2024-01-02T03:04:05.5Z,1.0\n/b,nonsense,1.0\n/c,2024-01-02T03:04:05Z\n"/d,x",2024-01-01T00:00:00Z,\n')
    rows = read_cursors(spark, path).orderBy("file").collect()
    assert [(r.file, str(r.last_event_ts)) for r in rows] == [
        ("/a", "2024-01-02 03:04:05.500000"), ("/d,x", "2024-01-01 00:00:00"),
    ]
    out = str(tmp_path / "out")
    write_cursors(read_cursors(spark, path), out)
    assert sorted(map(str, read_cursors(spark, out).collect())) == sorted(map(str, rows))


# -- growing files ------------------------------------------------------------------


def reader(path, **options):
    return LogTailReader({"path": str(path), **{k: str(v) for k, v in options.items()}})


def take(source, start, end):
    rows = []
    for part in source.partitions(start, end):
        for batch in source.read(part):
            rows += batch.to_pylist()
    return sorted(rows, key=lambda r: (r["file"], r["byte_pos"]))


def test_tail_takes_whole_lines_and_appends(tmp_path):
    path = put(tmp_path / "a.log", b"one\ntwo\npart")
    source = reader(path)
    first = source.initialOffset()
    second = source.latestOffset()
    rows = take(source, first, second)
    assert [(r["byte_pos"], r["next_pos"], r["line"]) for r in rows] == [(0, 4, "one"), (4, 8, "two")]
    put(path, b"ial\n\nbad\xff\r\n", "ab")
    third = source.latestOffset()
    assert [r["line"] for r in take(source, second, third)] == ["partial", "", "bad�\r"]
    assert source.latestOffset() == third


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1000])
def test_ranges_cut_a_backlog_without_loss(tmp_path, range_bytes):
    lines = [f"line {i} " + "é" * (i % 13) for i in range(200)]
    path = put(tmp_path / "a.log", ("\n".join(lines) + "\n").encode())
    source = reader(path, rangeBytes=range_bytes)
    assert [r["line"] for r in take(source, source.initialOffset(), source.latestOffset())] == lines


def test_rename_keeps_the_first_name(tmp_path):
    path = put(tmp_path / "a.log", b"1\n")
    source = reader(tmp_path / "a.log")
    a = source.initialOffset()
    b = source.latestOffset()
    take(source, a, b)
    put(path, b"2\n", "ab")
    os.rename(path, tmp_path / "a.log.1")
    put(path, b"new\n")
    c = source.latestOffset()
    assert sorted((r["line"], r["file"]) for r in take(source, b, c)) == [("2", path), ("new", path)]
    # A batch planned before a rename is still readable after it.
    os.rename(tmp_path / "a.log.1", tmp_path / "a.log.2")
    assert sorted(r["line"] for r in take(source, b, c)) == ["2", "new"]


def test_truncation_starts_over(tmp_path):
    path = put(tmp_path / "a.log", b"1\n2\n3\n")
    source = reader(path)
    a = source.initialOffset()
    b = source.latestOffset()
    take(source, a, b)
    put(path, b"9\n")
    assert [r["line"] for r in take(source, b, source.latestOffset())] == ["9"]


def test_skip_to_end_extension_and_limit(tmp_path):
    path = put(tmp_path / "a.log", b"old\n")
    put(tmp_path / "b.txt", b"other\n")
    source = reader(tmp_path, extension="log", skipToEnd=True)
    a = source.initialOffset()
    put(path, b"new\n", "ab")
    put(tmp_path / "c.log", b"c\n")
    assert sorted(r["line"] for r in take(source, a, source.latestOffset())) == ["c", "new"]
    slow = reader(path, maxBytesPerTrigger=5)
    got, at = [], slow.initialOffset()
    for _ in range(5):
        to = slow.latestOffset()
        got.append([r["line"] for r in take(slow, at, to)])
        at = to
    assert [g for g in got if g] == [["old"], ["new"]]
    put(path, b"a line longer than the limit\n", "ab")
    assert [r["line"] for r in take(slow, at, slow.latestOffset())] == ["a line longer than the limit"]


def test_restart_neither_repeats_nor_skips(tmp_path):
    path = put(tmp_path / "a.log", b"1\n2\n")
    first = reader(tmp_path / "a.log", maxBytesPerTrigger=100)
    a = first.initialOffset()
    b = first.latestOffset()
    take(first, a, b)
    put(tmp_path / "unrelated", b"x\n")
    put(path, b"3\n", "ab")
    os.rename(path, tmp_path / "a.log.1")
    again = reader(tmp_path / "a.log", maxBytesPerTrigger=100)  # a new process knows nothing yet
    c = again.latestOffset()
    assert [(r["line"], r["file"]) for r in take(again, b, c)] == [("3", path)]
    assert len(again.known) == 1


def test_truncation_past_the_old_position(tmp_path):
    path = put(tmp_path / "a.log", b"1\n2\n3\n")
    source = reader(path)
    a = source.initialOffset()
    b = source.latestOffset()
    take(source, a, b)
    put(path, b"n1xx\nn2\nn3\n")  # truncated and grown beyond byte 6 between two looks
    c = source.latestOffset()
    assert [r["line"] for r in take(source, b, c)] == ["n1xx", "n2", "n3"]
    put(path, b"n1xx\nn2\nnew tail\n")  # the same begin, another line before the position
    assert [r["line"] for r in take(source, c, source.latestOffset())] == ["n1xx", "n2", "new tail"]


def test_reused_inode_is_another_file(tmp_path):
    first = put(tmp_path / "a.log", b"old 1\nold 2\n")
    source = reader(tmp_path, extension="log")
    a = source.initialOffset()
    b = source.latestOffset()
    take(source, a, b)
    os.rename(first, tmp_path / "b.log")  # the inode of a.log under another name and with other content
    put(tmp_path / "b.log", b"fresh line that is longer\n")
    c = source.latestOffset()
    assert [(r["file"], r["line"]) for r in take(source, b, c)] == [(str(tmp_path / "b.log"), "fresh line that is longer")]


def test_reused_inode_after_a_restart(tmp_path):
    path = put(tmp_path / "a.log", b"old 1\nold 2\n")
    first = reader(path)
    a = first.initialOffset()
    b = first.latestOffset()
    take(first, a, b)
    put(path, b"new content, longer than before\nx\n")
    again = reader(path)
    c = again.latestOffset()
    assert [r["line"] for r in take(again, b, c)] == ["new content, longer than before", "x"]
    put(path, b"y\n", "ab")
    assert [r["line"] for r in take(again, c, again.latestOffset())] == ["y"]


def test_file_removed_between_offset_and_read(tmp_path):
    put(tmp_path / "a.log", b"a1\n")
    put(tmp_path / "b.log", b"b1\n")
    source = reader(tmp_path, extension="log")
    a = source.initialOffset()
    b = source.latestOffset()
    os.remove(tmp_path / "a.log")
    assert [r["line"] for r in take(source, a, b)] == ["b1"]
    with pytest.raises(FileNotFoundError):
        take(reader(tmp_path, extension="log", failOnLoss=True), a, b)
    put(tmp_path / "b.log", b"b2\n", "ab")
    c = source.latestOffset()
    assert [r["line"] for r in take(source, b, c)] == ["b2"]
    assert source.latestOffset() == c  # the removed file stays in the ledger and makes no new batches


def test_removed_file_goes_on_when_it_comes_back(tmp_path):
    (tmp_path / "in").mkdir()
    path = put(tmp_path / "in" / "a.log", b"1\n")
    source = reader(tmp_path / "in")
    a = source.initialOffset()
    b = source.latestOffset()
    take(source, a, b)
    os.rename(path, tmp_path / "away")
    c = source.latestOffset()
    assert take(source, b, c) == [] and [e["gone"] for e in c.values()] == [True]
    put(tmp_path / "away", b"2\n", "ab")
    os.rename(tmp_path / "away", path)
    assert [r["line"] for r in take(source, c, source.latestOffset())] == ["2"]


def test_shrunk_while_it_is_read(tmp_path):
    path = put(tmp_path / "a.log", b"one\ntwo\nthree\n")
    source = reader(path)
    a = source.initialOffset()
    b = source.latestOffset()
    with open(path, "r+b") as f:
        f.truncate(4)
    assert take(source, a, b) in ([], [r for r in take(source, a, b) if r["line"] == "one"])


def test_busy_first_file_leaves_room_for_the_others(tmp_path):
    put(tmp_path / "a.log", b"a" * 9 + b"\n")
    put(tmp_path / "b.log", b"b1\nb2\n")
    put(tmp_path / "c.log", b"c1\n" * 4)
    put(tmp_path / "a.log", b"a" * 9 + b"\n" + b"a23456789\n" * 1000)
    source = reader(tmp_path, extension="log", maxBytesPerTrigger=60)
    at, got = source.initialOffset(), []
    for _ in range(3):
        to = source.latestOffset()
        rows = take(source, at, to)
        got.append([r["line"][0] for r in rows])
        assert sum(r["next_pos"] - r["byte_pos"] for r in rows) <= 60
        at = to
        put(tmp_path / "a.log", b"a23456789\n" * 100, "ab")
    assert got[0].count("b") == 2 and got[0].count("c") == 4 and "a" in got[0]
    assert got[1] == ["a"] * 6
    assert LogTailReader._shares({"x": 1000, "y": 5, "z": 0, "w": 1000}, 105) == {"x": 50, "y": 5, "z": 0, "w": 50}


def test_drain_closes_each_file_once_a_run(tmp_path):
    put(tmp_path / "a.log", b"1\n2\n")
    first = reader(tmp_path, drain=True, maxBytesPerTrigger=1)
    a = first.initialOffset()
    b = first.latestOffset()
    assert [r["line"] for r in take(first, a, b)] == ["1", "2", None]
    assert first.latestOffset() == b
    again = reader(tmp_path, drain=True)
    c = again.latestOffset()
    assert [(r["line"], r["byte_pos"]) for r in take(again, b, c)] == [(None, 4)]


def test_tail_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = put(tmp_path / "in" / "a.log", b"head\n1\n2\npar")
    out = str(tmp_path / "out")
    stream = skip_header_stream(stream_lines(spark, str(tmp_path / "in"), "log", range_bytes=3))

    def run():
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.start()
        query.processAllAvailable()
        query.stop()
        return [r.line for r in spark.read.parquet(out).orderBy("byte_pos").collect()]

    assert run() == ["1", "2"]
    put(path, b"t\n3\n", "ab")
    assert run() == ["1", "2", "part", "3"]
    assert spark.read.parquet(out).filter(F.col("next_pos") <= F.col("byte_pos")).count() == 0
