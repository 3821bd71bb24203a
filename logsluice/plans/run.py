"""Runs declared sources into declared sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.operators.delivery import (
    assign_batches,
    collect_batches,
    drop_oversize,
    encoded_size,
    event_batches,
)
from logsluice.operators.flow import (
    age_cutoff,
    carry_app_ver,
    fold_continuations,
    last_places,
    limit_age,
    resume_from,
    split_records,
    split_rejects,
)
from logsluice.operators.parsers import OK, parse_lines, with_defaults
from logsluice.operators.quality import file_cursors
from logsluice.operators.records import EVENT_TIME, encode_csv, process, to_record, union_all
from logsluice.session import configure
from logsluice.sinks.files import load_cursors, save_cursors, write_csv
from logsluice.sinks.ledger import batch_name
from logsluice.sinks.objects import BUFFER_BYTES, write_objects
from logsluice.sources.text import read_lines, skip_header, skip_header_stream
from logsluice.spec import Identity, LineKey, RecordFormat, SinkSpec, SourceSpec, SpecError, validate_format

RAW_LINE = "raw_line"
MARKED = "_marked_version"
SINK_TYPES = ("csv", "s3", "firehose", "http")


@dataclass(frozen=True)
class SourcePlan:
    """What comes out of one source, all in line order of ``key``."""

    records: DataFrame  # key columns, raw_line, typed record
    events: DataFrame  # key columns, line, attributes as text
    rejects: DataFrame  # key columns, line, reason
    timed: DataFrame  # every line with its attributes, parse_ok and event_ts
    tail: DataFrame | None = None  # lines of buffers that are still open, as they came


def plan_lines(
    lines: DataFrame,
    spec: SourceSpec,
    fmt: RecordFormat,
    key: LineKey = LineKey(),
    ingest: datetime | Column | None = None,
    cutoff: Column | None = None,
    cursors: DataFrame | None = None,
    follow_version: bool = False,
    files: int | None = None,
    growing: bool = False,
    hold_open: bool = False,
    known_version: str = "",
) -> SourcePlan:
    """Lines of a source -> records, in the order of gates: header, parse, resume, age, rejects.

    ``files`` is the number of files behind the lines, where known. Lines of ``growing`` files are a
    part of them: the header is the line at byte 0 of ``key.pos``. With ``hold_open`` the buffer of a
    file that ends in unparseable lines stays open, in ``tail``. ``known_version`` names a column
    with the version before these lines.
    """
    columns = lines.columns
    if spec.front_split_regex:
        lines = split_records(lines, spec.front_split_regex, key).drop("part")
    if spec.skip_header_line:
        lines = skip_header_stream(lines, key.pos) if growing else skip_header(lines, key, files)
    version: str | Column = spec.app_ver
    if follow_version:
        configured = F.coalesce(F.col(known_version), F.lit(spec.app_ver)) if known_version else spec.app_ver
        lines = carry_app_ver(lines, configured, key, name=MARKED).drop(known_version)
        version = F.col(MARKED)
    identity = Identity(spec.app, version, spec.hostname, F.col(key.source), ingest)
    timed = process(parse_lines(lines, spec, fmt, identity), spec.time_format)
    if cursors is not None:
        timed = resume_from(timed, cursors, key, cutoff=cutoff)
    if cutoff is not None:
        timed = limit_age(timed, cutoff)
    good, rejects = split_rejects(timed, key=key)
    tail = None
    if spec.buffer_multi_lines:
        folded = fold_continuations(timed, key)
        if hold_open:
            folded, tail = hold_open_buffers(timed, folded, columns, key)
        folded = folded.withColumnRenamed("log_line", "_text").drop("lines", "bytes")
        filled = with_defaults(folded, fmt, Identity(spec.app, spec.app_ver, spec.hostname, F.col(key.source), ingest))
        filled = filled.withColumn("log_line", F.col("_text")).withColumnRenamed("_text", "line")
        good = good.unionByName(filled.withColumn(OK, F.lit(True)), allowMissingColumns=True)
        rejects = rejects.limit(0)
    records = to_record(good.withColumn(RAW_LINE, F.col("line")), fmt, keep=(*key.columns, RAW_LINE))
    return SourcePlan(records, good.drop(OK, EVENT_TIME), rejects, timed, tail)


def hold_open_buffers(
    timed: DataFrame, folded: DataFrame, columns: Sequence[str], key: LineKey
) -> tuple[DataFrame, DataFrame]:
    """(closed buffers, lines of the open ones). The last buffer of a file is open when no parsed line follows it.

    Both tables that are broadcast have a row for each file of these lines, which the driver has listed.
    """
    parsed = last_places(timed.filter(F.coalesce(F.col(OK), F.lit(False))), key)
    parsed = parsed.select(key.source, F.struct("_block", "_pos").alias("_parsed"))
    last = last_places(folded, key).select(key.source, F.struct("_block", "_pos").alias("_open"))
    opened = last.join(F.broadcast(parsed), key.source, "left").filter(F.col("_parsed").isNull() | (F.col("_open") > F.col("_parsed")))
    opened = F.broadcast(opened.select(key.source, "_open"))
    place = F.struct(F.col(key.block).alias("_block"), F.col(key.pos).alias("_pos"))
    later = F.coalesce(place >= F.col("_open"), F.lit(False))
    closed = folded.join(opened, key.source, "left").filter(~later).drop("_open")
    tail = timed.filter(~F.coalesce(F.col(OK), F.lit(False))).join(opened, key.source, "left").filter(later)
    have = [c for c in columns if c in tail.columns]
    return closed, tail.select(*have)


def plan_source(spark: SparkSession, spec: SourceSpec, fmt: RecordFormat, **options) -> SourcePlan:
    """The same for the files a source names."""
    lines = read_lines(spark, spec.path, spec.extension)
    files = len(lines.inputFiles()) if spec.skip_header_line else None
    return plan_lines(lines, spec, fmt, files=files, **options)


def check_specs(sources: Sequence[SourceSpec], sinks: Mapping[str, SinkSpec]) -> None:
    for sink in sinks.values():
        if sink.type not in SINK_TYPES:
            raise SpecError(f"sink type {sink.type!r} is not known")
        validate_format(sink.record_format)
    for source in sources:
        if source.sink not in sinks:
            raise SpecError(f"{source.name}: sink {source.sink!r} is not declared")


def route(plans: Sequence[tuple[SourceSpec, SourcePlan]]) -> dict[str, DataFrame]:
    """One record table per sink: the union of its sources."""
    by_sink: dict[str, list[DataFrame]] = {}
    for spec, plan in plans:
        by_sink.setdefault(spec.sink, []).append(plan.records)
    return {sink: union_all(frames) for sink, frames in by_sink.items()}


def write_sink(
    spark: SparkSession,
    sink: SinkSpec,
    records: DataFrame,
    events: Sequence[DataFrame] = (),
    key: LineKey = LineKey(),
    uploaded: datetime | None = None,
    batch_id: int | str | None = None,
) -> None:
    """Deliver the records of a sink: CSV files, objects with manifest, record batches or event batches.

    What a ``batch_id`` has delivered is replaced, or left as it is, when it is delivered again.
    """
    fmt, options = sink.record_format, sink.options
    suffix = "" if batch_id is None else f"/{batch_name(batch_id)}"
    if sink.type == "csv":
        write_csv(records, f"{sink.path}{suffix}", fmt)
    elif sink.type == "s3":
        write_objects(
            records,
            sink.path,
            sink.name,
            fmt,
            key,
            prefix=str(options.get("prefix", "")),
            ddl_version=str(options.get("ddl_version", "")),
            buffer_bytes=int(options.get("buffer_size", BUFFER_BYTES)),
            max_records=int(options.get("max_records_per_file", 0)),
            gzip=str(options.get("compression", "")).lower() == "gzip",
            uploaded=uploaded,
            batch_id=batch_id,
            ledger=str(options.get("manifest", "")),
        )
    elif sink.type == "firehose":
        encoded = records.select(*key.columns, encode_csv(fmt).alias("csv_line"))
        small, large = drop_oversize(encoded)
        batched = assign_batches(small, encoded_size(F.col("csv_line")), key.slice, [key.pos])
        batches = collect_batches(batched, [*key.slice, "batch"], [key.pos])
        batches.write.mode("overwrite").parquet(f"{sink.path}/batches{suffix}")
        large.write.mode("overwrite").parquet(f"{sink.path}/oversize{suffix}")
    else:
        plain = {*key.columns, "line", RAW_LINE, MARKED}
        api_key = str(options.get("api_key", ""))
        posts = [event_batches(e, [c for c in e.columns if c not in plain], api_key, key) for e in events]
        union_all(posts).write.mode("overwrite").parquet(f"{sink.path}{suffix}")


def merged_cursors(new: DataFrame, old: DataFrame) -> DataFrame:
    """Cursors after a run: the new ones, and the old ones of files without lines in it."""
    columns = ["file", "last_event_ts", "app_ver"]
    return new.select(*columns).unionByName(old.select(*columns).join(new.select("file"), "file", "left_anti"))


def run_sources(
    spark: SparkSession,
    sources: Sequence[SourceSpec],
    sinks: Sequence[SinkSpec],
    key: LineKey = LineKey(),
    rejects_path: str = "",
    uploaded: datetime | None = None,
    cursors_path: str = "",
    age_days: int | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Read, parse and deliver everything once. Gives the record table of every sink.

    With ``cursors_path`` each file goes on after the last time that the cursors there tell, and
    new ones are saved behind the delivery. ``age_days`` leaves out older events.
    """
    configure(spark)
    by_name = {s.name: s for s in sinks}
    check_specs(sources, by_name)
    known = load_cursors(spark, cursors_path) if cursors_path else None
    if known is not None:
        options["cursors"] = known
    if age_days is not None:
        options["cutoff"] = age_cutoff(age_days)
    plans = [(s, plan_source(spark, s, by_name[s.sink].record_format, key=key, **options)) for s in sources]
    routed = route(plans)
    for name, records in routed.items():
        events = [p.events for s, p in plans if s.sink == name]
        write_sink(spark, by_name[name], records, events, key, uploaded)
    if rejects_path:
        union_all([p.rejects for _, p in plans]).write.mode("overwrite").parquet(rejects_path)
    if known is not None:
        seen = [file_cursors(p.timed, key, app_ver=s.app_ver).withColumnRenamed(key.source, "file") for s, p in plans]
        save_cursors(merged_cursors(union_all(seen), known), cursors_path)
    return routed
