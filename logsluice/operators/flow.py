"""Row flow: rejects, age limit, resume, continuation lines, record split, version marker.

Operators that depend on line order work on slices: (source, block) groups are bounded
by the input split, so a source that holds a third of all lines is still spread over
many tasks. What one slice needs to know of the ones before it is summed up in one row
per slice, and only those rows are brought together by source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logsluice.functions.regexes import to_java
from logsluice.functions.scalars import regex_get
from logsluice.operators.parsers import OK
from logsluice.operators.records import EVENT_TIME
from logsluice.spec import LineKey

# Multi-line buffer limit, version marker.
MAX_BUFFERED_BYTES = 65_535
VERSION_MARKER = r"^----\sapp_ver:\s(?P<app_ver>.*)$"
DEFAULT_AGE_DAYS = 10

# More rows than this are not broadcast.
MAX_BROADCAST_ROWS = 500_000


def bounded_broadcast(small: DataFrame, bound: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Hint a broadcast when ``bound`` (default: the table itself) has at most ``max_rows`` rows.

    ``bound`` is a table known to have at least as many rows, and cheap to count. A larger table
    is left to a shuffle join, where adaptive execution splits skewed keys.
    """
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    counted = (small if bound is None else bound).limit(max_rows + 1).count()
    return F.broadcast(small) if counted <= max_rows else small


def split_rejects(parsed: DataFrame, line: str = "line", key: LineKey = LineKey()) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, reject table). Rejects keep place and text of the line and the reason."""
    good = parsed.filter(F.col(OK))
    bad = parsed.filter(~F.col(OK)).select(*key.columns, F.col(line), F.lit("not parsed").alias("reason"))
    return good, bad


def age_cutoff(days: int = DEFAULT_AGE_DAYS, now: datetime | None = None) -> Column:
    moment = F.current_timestamp() if now is None else F.lit(now.isoformat(sep=" ")).cast("timestamp")
    return moment - F.expr(f"INTERVAL {int(days)} DAYS")


def limit_age(timed: DataFrame, cutoff: Column, time: str = EVENT_TIME) -> DataFrame:
    """Drop events before the cutoff; lines without a time stay."""
    return timed.filter(F.col(time).isNull() | (F.col(time) >= cutoff))


def first_places(lines: DataFrame, key: LineKey) -> DataFrame:
    """First line of every source: source, _block, _pos.

    Two steps with plain numbers, which hash-aggregate; a minimum of structs would sort all lines.
    """
    by_slice = lines.groupBy(*key.slice).agg(F.min(key.pos).alias("_pos"))
    return by_slice.groupBy(key.source).agg(
        F.min(key.block).alias("_block"), F.min_by("_pos", key.block).alias("_pos")
    )


def last_places(lines: DataFrame, key: LineKey) -> DataFrame:
    """Last line of every source: source, _block, _pos."""
    by_slice = lines.groupBy(*key.slice).agg(F.max(key.pos).alias("_pos"))
    return by_slice.groupBy(key.source).agg(
        F.max(key.block).alias("_block"), F.max_by("_pos", key.block).alias("_pos")
    )


def resume_from(
    timed: DataFrame,
    cursors: DataFrame,
    key: LineKey = LineKey(),
    time: str = EVENT_TIME,
    cutoff: Column | None = None,
    equal_times: bool = False,
) -> DataFrame:
    """Lines of every source from the first one later than its cursor on.

    After that line everything passes, earlier times too. Sources without a cursor pass whole.
    ``equal_times`` also resumes at a line with the cursor's own time. ``cursors`` has columns
    (source, last_event_ts). The first lines have at most one row per cursor, so the size of both
    broadcasts is checked on the cursor table itself.
    """
    marks = cursors.select(F.col(cursors.columns[0]).alias(key.source), F.col("last_event_ts").alias("_cursor"))
    late = F.col(time) >= F.col("_cursor") if equal_times else F.col(time) > F.col("_cursor")
    if cutoff is not None:
        late = late & (F.col(time) >= cutoff)
    known = timed.select(*key.columns, time).join(bounded_broadcast(marks, marks), key.source)
    first = first_places(known.filter(late), key)
    plan = marks.select(key.source).distinct().join(first, key.source, "left").withColumn("_held", F.lit(True))
    joined = timed.join(bounded_broadcast(plan, marks), key.source, "left")
    block = F.col(key.block)
    reached = (block > F.col("_block")) | ((block == F.col("_block")) & (F.col(key.pos) >= F.col("_pos")))
    return joined.filter(F.col("_held").isNull() | F.coalesce(reached, F.lit(False))).drop("_block", "_pos", "_held")


# -- prefix scans -----------------------------------------------------------------


def _inside(key: LineKey) -> Window:
    return Window.partitionBy(*key.slice).orderBy(key.pos).rowsBetween(Window.unboundedPreceding, 0)


def _before(key: LineKey) -> Window:
    """Slices of the same source before this one. One row per slice, so the window stays small."""
    return Window.partitionBy(key.source).orderBy(key.block).rowsBetween(Window.unboundedPreceding, -1)


def _by_slice(rows: DataFrame, key: LineKey) -> DataFrame:
    """Rows shuffled by slice, once for all readers of this table.

    Keys are never NULL. Saying so here keeps the join with the slice summary from adding the
    condition to one reader only, which would make the shuffles differ and run twice.
    """
    known = F.col(key.source).isNotNull() & F.col(key.block).isNotNull()
    return rows.filter(known).repartition(*key.slice)


def running_count(df: DataFrame, flag: Column, name: str, key: LineKey = LineKey()) -> DataFrame:
    """Number of lines with ``flag`` up to and including each line, per source."""
    counted = flag.cast("bigint")
    inner = df.withColumn("_in", F.sum(counted).over(_inside(key)))
    base = df.groupBy(*key.slice).agg(F.sum(counted).alias("_total"))
    base = base.select(*key.slice, F.coalesce(F.sum("_total").over(_before(key)), F.lit(0)).alias("_base"))
    return inner.join(base, key.slice).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in")


# Digits of a slice number in the tree of counts, of 8 bits each.
TREE_LEVELS = 8


def counts_before(counts: DataFrame, number: str, count: str, name: str) -> DataFrame:
    """counts (one row per ``number``, a whole number from 0) with the sum of the counts of smaller numbers.

    The numbers are leaves of a tree by their digits. A node's count goes to its siblings to the
    right, at most 255, and what lies before a number is the sum of that along its path. So no
    task sees all rows, whatever the numbers are.
    """
    levels = F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(number, 8 * k).alias("_node")) for k in range(TREE_LEVELS)))
    paths = counts.select(number, count, F.explode(levels).alias("_at")).select(number, count, "_at.*")
    nodes = paths.groupBy("_level", "_node").agg(F.sum(count).alias("_n"))
    siblings = Window.partitionBy("_level", F.shiftright("_node", 8)).orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.select("_level", "_node", F.coalesce(F.sum("_n").over(siblings), F.lit(0)).alias("_left"))
    before = paths.join(nodes, ["_level", "_node"]).groupBy(number).agg(F.sum("_left").alias(name))
    return counts.join(before, number)


def number_lines(df: DataFrame, slice_by: Sequence[str], order_by: Sequence[str], name: str = "line_id") -> DataFrame:
    """Number rows 1, 2, ... over all slices in order, and inside a slice by ``order_by``.

    ``slice_by`` begins with a whole number from 0, such as a block. Rows are only gathered by slice.
    Start numbers come in three levels: inside a slice, over the slices of a block, over blocks.
    """
    block = slice_by[0]
    inner = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*slice_by).orderBy(*order_by)))
    slices = df.groupBy(*slice_by).agg(F.count(F.lit(1)).alias("_n"))
    blocks = slices.groupBy(block).agg(F.sum("_n").alias("_n"))
    blocks = counts_before(blocks.select(F.col(block).cast("long").alias("_block"), "_n"), "_block", "_n", "_blocks")
    inside = Window.partitionBy(block).orderBy(*slice_by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_base", F.coalesce(F.sum("_n").over(inside), F.lit(0))) if len(slice_by) > 1 else slices.withColumn("_base", F.lit(0))
    base = slices.join(blocks.select(F.col("_block").alias(block), "_blocks"), block)
    base = base.select(*slice_by, (F.col("_base") + F.col("_blocks")).alias("_base"))
    return inner.join(base, list(slice_by)).withColumn(name, F.col("_base") + F.col("_rn")).drop("_base", "_rn")


def last_before(marks: Column, place: Column) -> Column:
    """Number of elements of a sorted array of structs that are not after ``place``, by halving steps."""
    doublings = F.ceil(F.log2(F.size(marks) + 1)).cast("int")
    steps = F.transform(F.sequence(doublings, F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def step(found: Column, width: Column) -> Column:
        at = found + width
        return F.when((at <= F.size(marks)) & (F.get(marks, at - 1)["at"] <= place), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def carry_app_ver(
    lines: DataFrame,
    configured: Column | str = "",
    key: LineKey = LineKey(),
    line: str = "line",
    name: str = "app_ver",
    max_markers: int | None = None,
) -> DataFrame:
    """Version announced by the last marker line at or before each line; before any, the configured one.

    Markers are rare: a sorted array of them for each source goes to the lines, which stay where
    they are, and each line looks up the last one before it. With more than ``max_markers``
    (counted) the lines are brought together by slice instead.
    """
    default = F.lit(configured) if isinstance(configured, str) else configured
    found = regex_get(F.col(line), to_java(VERSION_MARKER))
    markers = lines.filter(F.col(line).rlike(to_java(VERSION_MARKER)))
    most = MAX_BROADCAST_ROWS if max_markers is None else max_markers
    if markers.limit(most + 1).count() > most:
        return _carry_by_slice(lines.withColumn("_ver", found), default, key, name)
    place = F.struct(F.col(key.block).cast("long").alias("block"), F.col(key.pos).cast("long").alias("pos"))
    marks = markers.select(F.col(key.source).alias("_source"), F.struct(place.alias("at"), found.alias("ver")).alias("_mark"))
    marks = marks.groupBy("_source").agg(F.array_sort(F.collect_list("_mark")).alias("_marks"))
    joined = lines.join(F.broadcast(marks), F.col(key.source).eqNullSafe(F.col("_source")), "left")
    version = F.when(F.col("_marks").isNotNull(), F.get("_marks", last_before(F.col("_marks"), place) - 1)["ver"])
    return joined.withColumn(name, F.coalesce(version, default)).drop("_source", "_marks")


def _carry_by_slice(marked: DataFrame, default: Column, key: LineKey, name: str) -> DataFrame:
    """The marker is copied to the lines of its slice by a window; across slices the last marker of
    each slice (one row) is carried by a window over slices."""
    inner = marked.withColumn("_in", F.last("_ver", ignorenulls=True).over(_inside(key)))
    marker = F.when(F.col("_ver").isNotNull(), F.struct(key.pos, "_ver"))
    last = marked.groupBy(*key.slice).agg(F.array_max(F.collect_list(marker))["_ver"].alias("_last"))
    carried = last.select(*key.slice, F.last("_last", ignorenulls=True).over(_before(key)).alias("_base"))
    version = F.coalesce(F.col("_in"), F.col("_base"), default)
    return inner.join(carried, key.slice).withColumn(name, version).drop("_ver", "_in", "_base")


# -- continuation lines -----------------------------------------------------------


def chunk_starts(pieces: DataFrame, key: LineKey, limit: int) -> DataFrame:
    """Key columns of each line and ``_chunk``, its chunk of the run: a chunk takes lines while its size is below ``limit``.

    pieces: key columns, ``_run``, ``_seg``, ``size``; no text. A run is read in order by one task
    that holds two numbers, so chunks do not depend on slices or on the length of the run.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, chunk = None, 0, 0
        for batch in batches:
            source, run, seg, size = (batch.column(c).to_pylist() for c in (key.source, "_run", "_seg", "size"))
            out = []
            for own, n in zip(zip(source, run, seg), size):
                if own != last:
                    chunk = chunk + 1 if last and own[:2] == last[:2] else 0
                    last, held = own, 0
                elif held >= limit:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            kept = [batch.column(c) for c in key.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.int64())], names=[*key.columns, "_chunk"])

    schema = StructType([*(pieces.schema[c] for c in key.columns), StructField("_chunk", LongType())])
    ordered = pieces.repartition(key.source, "_run").sortWithinPartitions(key.source, "_run", key.block, key.pos)
    return ordered.mapInArrow(task, schema)


def fold_continuations(
    parsed: DataFrame,
    key: LineKey = LineKey(),
    line: str = "line",
    limit: int = MAX_BUFFERED_BYTES,
    flush_bytes: int | None = None,
) -> DataFrame:
    """Consecutive unparseable lines of a source joined to one ``log_line``, each ended by a literal ``\\n``.

    Result: key columns of the first line, ``log_line``, ``lines``, ``bytes``. In line order the
    row stands before the next parsed line. A chunk is closed once it has ``limit`` bytes, and, if
    given, every ``flush_bytes`` of a run (in place of a flush by the clock).

    Parsed lines take part with their key only, so the shuffle by slice carries the text of
    unparseable lines and nothing else of size. A run is named by the bytes of unparseable
    text before it; the slice summary reads the same shuffle.
    """
    ok = F.coalesce(F.col(OK), F.lit(False))
    text = F.when(~ok, F.concat(F.col(line), F.lit("\\n")))
    rows = _by_slice(parsed.select(*key.columns, text.alias("_text")), key)
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("bigint")
    inner = rows.withColumn("_sum", F.sum(size).over(_inside(key))).withColumn(
        "_mark", F.max(F.when(F.col("_text").isNull(), F.col("_sum"))).over(_inside(key))
    )
    summary = inner.groupBy(*key.slice).agg(F.max("_sum").alias("_total"), F.max("_mark").alias("_slice_mark"))
    base = summary.withColumn("_base", F.coalesce(F.sum("_total").over(_before(key)), F.lit(0)))
    base = base.select(
        *key.slice, "_base", F.max(F.col("_base") + F.col("_slice_mark")).over(_before(key)).alias("_base_mark")
    )
    unparsed = inner.filter(F.col("_text").isNotNull()).join(base, key.slice)
    run = F.coalesce(F.col("_base") + F.col("_mark"), F.col("_base_mark"), F.lit(0))
    at = F.col("_base") + F.col("_sum") - size
    seg = F.lit(0) if flush_bytes is None else F.floor((at - run) / flush_bytes)
    unparsed = unparsed.select(
        *key.columns, run.alias("_run"), seg.cast("bigint").alias("_seg"), size.alias("size"), "_text"
    )
    chunks = chunk_starts(unparsed.drop("_text"), key, limit)
    piece = F.struct(*key.columns[1:], "size", F.col("_text").alias("text"))
    groups = unparsed.join(chunks, list(key.columns)).groupBy(key.source, "_run", "_chunk")
    groups = groups.agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    first = F.col("_pieces")[0]
    return groups.select(
        key.source,
        first[key.block].alias(key.block),
        first[key.pos].alias(key.pos),
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("log_line"),
        F.size("_pieces").cast("bigint").alias("lines"),
        F.aggregate("_pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["size"]).alias("bytes"),
    )


# -- records that span lines --------------------------------------------------------


def split_records(
    lines: DataFrame,
    start: str,
    key: LineKey = LineKey(),
    line: str = "line",
    part_bytes: int | None = None,
) -> DataFrame:
    """Records that begin where a line matches ``start``; the lines of a record are joined without line ends.

    Result: key columns of the first line, ``part``, the record text in ``line``. Lines before the
    first start are a record too. Records are whole (part 0); only with ``part_bytes`` a record that
    goes on through whole slices is handed on in numbered parts, each put together in one task.

    Lines are shuffled once, by slice. Records inside a slice are finished there; only the first
    and the last fragment of each slice meet their other halves in a second, small shuffle.
    """
    rows = _by_slice(lines.select(*key.columns, F.col(line).alias("_text")), key)
    begins = F.col("_text").rlike(to_java(start)).cast("bigint")
    inner = rows.withColumn("_in", F.sum(begins).over(_inside(key)))
    piece = F.struct(key.pos, F.col("_text").alias("text"))
    fragments = inner.groupBy(*key.slice, "_in").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    fragments = fragments.select(
        *key.slice,
        "_in",
        F.col("_pieces")[0][key.pos].alias(key.pos),
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("_text"),
    )
    summary = inner.groupBy(*key.slice).agg(
        F.max("_in").alias("_starts"), F.sum(F.octet_length("_text")).alias("_bytes")
    )
    idle = F.when(F.col("_starts") == 0, F.col("_bytes")).otherwise(0)
    parts = F.lit(0) if part_bytes is None else F.floor((F.col("_idle") - F.col("_since")) / part_bytes)
    base = (
        summary.withColumn("_base", F.coalesce(F.sum("_starts").over(_before(key)), F.lit(0)))
        .withColumn("_idle", F.coalesce(F.sum(idle).over(_before(key)), F.lit(0)))
        .withColumn(
            "_since", F.coalesce(F.max(F.when(F.col("_starts") > 0, F.col("_idle"))).over(_before(key)), F.lit(0))
        )
        .select(*key.slice, "_starts", "_base", parts.alias("_part"))
    )
    placed = fragments.join(base, key.slice)
    inside = (F.col("_in") > 0) & (F.col("_in") < F.col("_starts"))
    whole = placed.filter(inside).select(
        *key.columns, F.lit(0).cast("bigint").alias("part"), F.col("_text").alias(line)
    )
    # A fragment that begins in its slice opens part 0; one that goes on has the part of its slice.
    part = F.when(F.col("_in") > 0, F.lit(0)).otherwise(F.col("_part")).cast("bigint")
    edge = F.struct(*key.columns[1:], F.col("_text").alias("text"))
    stitched = (
        placed.filter(~inside)
        .groupBy(key.source, (F.col("_base") + F.col("_in")).alias("_record"), part.alias("part"))
        .agg(F.array_sort(F.collect_list(edge)).alias("_edges"))
        .select(
            key.source,
            F.col("_edges")[0][key.block].alias(key.block),
            F.col("_edges")[0][key.pos].alias(key.pos),
            "part",
            F.array_join(F.transform("_edges", lambda e: e["text"]), "").alias(line),
        )
    )
    return whole.unionByName(stitched)
