"""Cursors, counters and the ingest log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logsluice.operators.parsers import OK
from logsluice.operators.records import EVENT_TIME
from logsluice.spec import LineKey


def file_cursors(
    timed: DataFrame, key: LineKey = LineKey(), time: str = EVENT_TIME, app_ver: Column | str = ""
) -> DataFrame:
    """Last seen (not latest) event time of every source: source, last_event_ts, app_ver.

    Lines without a time do not count. One row per slice leaves each task.
    """
    seen = timed.filter(F.col(time).isNotNull())
    version = F.lit(app_ver) if isinstance(app_ver, str) else app_ver
    # Last line of each slice, then of each source: plain numbers hash-aggregate, structs would sort.
    by_slice = seen.groupBy(*key.slice).agg(F.max_by(time, key.pos).alias("_ts"))
    return (
        by_slice.groupBy(key.source).agg(F.max_by("_ts", key.block).alias("last_event_ts")).withColumn("app_ver", version)
    )


def ingest_report(parsed: DataFrame, source: str = "file") -> DataFrame:
    """Lines read, parsed and rejected per source."""
    ok = F.coalesce(F.col(OK), F.lit(False))
    return parsed.groupBy(source).agg(
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if(ok).alias("lines_parsed"),
        F.count_if(~ok).alias("lines_rejected"),
    )


def observe_ingest(parsed: DataFrame, name: str | Observation) -> DataFrame:
    """The same totals as live metrics of whatever action or stream the lines go through."""
    ok = F.coalesce(F.col(OK), F.lit(False))
    return parsed.observe(
        name,
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if(ok).alias("lines_parsed"),
        F.count_if(~ok).alias("lines_rejected"),
    )


def ingest_log(parsed: DataFrame, stream: str, logfile: str, at: Column, source: str = "file") -> DataFrame:
    """Log rows of a batch: time, level, logfile_name, file, stream, message."""
    report = ingest_report(parsed, source)
    return report.select(
        at.alias("time"),
        F.when(F.col("lines_rejected") > 0, "warning").otherwise("info").alias("level"),
        F.lit(logfile).alias("logfile_name"),
        F.col(source).alias("file"),
        F.lit(stream).alias("stream"),
        F.format_string("streamed %d lines of %d", "lines_parsed", "lines_read").alias("message"),
    )
