"""Batch and directory line scans, header removal and the cursor table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logsluice.functions.layouts import ISO_8601, parse_ts
from logsluice.operators.flow import first_places
from logsluice.spec import LineKey

# First lines of more files than this are not broadcast.
MAX_BROADCAST_FILES = 100_000

CURSOR_SCHEMA = "file string, last_event_ts timestamp, app_ver string"


def normal_path(path: str) -> str:
    """A declared path in the form of ``plain_path``: no scheme of local files, no doubled or closing slash."""
    path = re.sub(r"\Afile:/+", "/", path)
    scheme, border, rest = path.rpartition("://")
    rest = re.sub("/{2,}", "/", rest)
    return scheme + border + (rest.rstrip("/") or rest)


def _text_options(reader, extension: str):
    # Only "\n" ends a line: a "\r" stays on it and blank lines are kept.
    reader = reader.option("lineSep", "\n").option("recursiveFileLookup", "false")
    if extension:
        reader = reader.option("pathGlobFilter", "*." + extension.lstrip("."))
    return reader


def plain_path(uri: Column) -> Column:
    """Path of a file as it was declared, from a URI: characters as they are, and without the scheme
    of local files."""
    # A plus sign is itself in a path; to the decoder it is a blank.
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"\Afile:/+", "/")


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], extension: str = "", only: Sequence[str] | None = None
) -> DataFrame:
    """Lines of files or of the files directly in a directory: file, block_start, mid, line.

    Large files are cut into input splits; (file, block_start, mid) is the line order.
    With ``extension`` only names with that ending are read. ``only`` some files: the others are left
    out when files are listed, before lines are numbered.
    """
    lines = _text_options(spark.read, extension).text(paths)
    if only is not None:
        lines = lines.filter(plain_path(F.col("_metadata.file_path")).isin(*map(normal_path, only)))
    return lines.select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("mid"),
        F.make_valid_utf8("value").alias("line"),
    )


def stream_directory(
    spark: SparkSession, path: str, extension: str = "", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the lines of finished files that appear in a directory: file, line.

    Lines of one file come in one micro-batch; use ``number_in_batch`` inside
    foreachBatch where the order matters. Growing files need ``stream_lines``.
    """
    reader = _text_options(spark.readStream, extension).option("ignoreMissingFiles", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.make_valid_utf8("value").alias("line"),
    )


def number_in_batch(batch: DataFrame) -> DataFrame:
    """Add ``mid`` to a micro-batch of the directory stream (scan order inside each split)."""
    return batch.withColumn("mid", F.monotonically_increasing_id())


def skip_header(lines: DataFrame, key: LineKey = LineKey(), sources: int | None = None) -> DataFrame:
    """Drop the first line of every file.

    A map-side combined minimum finds the first lines, one row per file. With the number of
    ``sources`` known to be small they are broadcast; otherwise the join is by (file, block,
    position), where no key is frequent.
    """
    first = first_places(lines, key).select(
        key.source, F.col("_block").alias(key.block), F.col("_pos").alias(key.pos)
    )
    if sources is not None and sources <= MAX_BROADCAST_FILES:
        first = F.broadcast(first)
    return lines.join(first, key.columns, "left_anti")


def skip_header_stream(lines: DataFrame, pos: str = "byte_pos") -> DataFrame:
    """Drop the line at byte 0 of every file of a growing-file stream."""
    return lines.filter(F.col(pos) != 0)


def read_cursors(spark: SparkSession, path: str) -> DataFrame:
    """Cursor table from CSV ``file,last_event_ts,app_ver``.

    Lines that do not have three fields or a readable time are left out; an
    absent file gives an empty table.
    """
    schema = "file string, ts string, app_ver string, _bad string"
    try:
        raw = spark.read.option("escape", '"').option("columnNameOfCorruptRecord", "_bad").csv(path, schema=schema)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CURSOR_SCHEMA)
    return (
        raw.select("file", parse_ts(F.col("ts"), ISO_8601).alias("last_event_ts"), "app_ver", "_bad")
        .filter(F.col("_bad").isNull() & F.col("last_event_ts").isNotNull())
        .drop("_bad")
    )
