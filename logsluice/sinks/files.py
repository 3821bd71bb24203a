"""CSV and object files, and the manifest of what was written."""

from __future__ import annotations

from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.operators.records import encode_csv
from logsluice.sinks.ledger import first_upload, open_folder, present
from logsluice.sources.text import CURSOR_SCHEMA, read_cursors
from logsluice.spec import DEFAULT_FORMAT, RecordFormat

MANIFEST_SCHEMA = "fullpath string, table_name string, ddl_version string, record_count bigint"


def write_csv(
    records: DataFrame, path: str, fmt: RecordFormat = DEFAULT_FORMAT, mode: str = "overwrite", gzip: bool = False
) -> None:
    """Records as CSV lines without header, NULL as \\N. Files already there are replaced."""
    writer = records.select(encode_csv(fmt).alias("value")).write.mode(mode).option("lineSep", "\n")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.text(path)


def upload_folder(path: str, prefix: str, table: str, uploaded: datetime | None = None) -> str:
    """path/prefix/table/YYYY/MM/DD/HH/mm of the upload time in UTC; empty parts are left out."""
    moment = uploaded or datetime.now(timezone.utc)
    parts = [path.rstrip("/"), prefix.strip("/"), table, moment.strftime("%Y/%m/%d/%H/%M")]
    return "/".join(p for p in parts if p)


def write_partitioned(
    records: DataFrame,
    path: str,
    table: str,
    fmt: RecordFormat = DEFAULT_FORMAT,
    prefix: str = "",
    uploaded: datetime | None = None,
    gzip: bool = False,
    max_records_per_file: int = 0,
    batch_id: int | None = None,
) -> str:
    """Write the objects of one upload below its time folder and give the folder.

    With ``batch_id`` the objects go to a folder of that micro-batch below the time of its first
    attempt, which a repeated attempt replaces: every batch arrives once, whenever it is repeated.
    """
    if batch_id is not None:
        uploaded = first_upload(path, batch_id, uploaded)
    folder = upload_folder(path, prefix, table, uploaded)
    if batch_id is not None:
        folder = f"{folder}/batch-{batch_id:012d}"
    # Without a batch id, runs of the same minute share the folder and must not replace each other.
    mode = "append" if batch_id is None else "overwrite"
    writer = records.select(encode_csv(fmt).alias("value")).write.mode(mode).option("lineSep", "\n")
    if gzip:
        writer = writer.option("compression", "gzip")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.text(folder)
    return folder


def written_manifest(
    spark: SparkSession, folder: str, table: str, fmt: RecordFormat = DEFAULT_FORMAT, ddl_version: str = ""
) -> DataFrame:
    """One row per object of a folder: fullpath, table_name, ddl_version, record_count."""
    schema = ", ".join(f"`{a.key}` string" for a in fmt)
    # Quoted fields may hold line ends, so records are counted, not lines.
    rows = spark.read.option("multiLine", "true").option("escape", '"').schema(schema).csv(folder)
    return rows.groupBy(F.col("_metadata.file_path").alias("fullpath")).agg(
        F.lit(table).alias("table_name"), F.lit(ddl_version).alias("ddl_version"), F.count(F.lit(1)).alias("record_count")
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Append to the manifest table."""
    manifest.select("fullpath", "table_name", "ddl_version", "record_count").write.mode("append").parquet(path)


def write_cursors(cursors: DataFrame, path: str) -> None:
    """Cursor table as CSV ``file,last_event_ts,app_ver``, replacing the one before."""
    # All digits of the time, so that a run does not meet the cursor's own line again.
    when = F.concat(F.translate(F.col("last_event_ts").cast("string"), " ", "T"), F.lit("Z"))
    shown = cursors.select(cursors.columns[0], when.alias("last_event_ts"), "app_ver")
    shown.write.mode("overwrite").option("escape", '"').csv(path)


CURSORS = "cursors-"


def _saved_cursors(path: str) -> list[str]:
    """Names of the complete cursor tables below a folder, oldest first."""
    system, root = open_folder(path.rstrip("/"))
    if not present(system, root):
        return []
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(CURSORS))
    return [n for n in names if present(system, f"{root}/{n}/_SUCCESS")]


def load_cursors(spark: SparkSession, path: str) -> DataFrame:
    """The last cursor table that was saved whole below ``path``; empty before the first."""
    names = _saved_cursors(path)
    return read_cursors(spark, f"{path.rstrip('/')}/{names[-1]}") if names else spark.createDataFrame([], CURSOR_SCHEMA)


def save_cursors(cursors: DataFrame, path: str) -> None:
    """Save a cursor table beside the one before, which the rows may still come from; older ones go."""
    names = _saved_cursors(path)
    number = int(names[-1][len(CURSORS) :]) + 1 if names else 0
    write_cursors(cursors.coalesce(1), f"{path.rstrip('/')}/{CURSORS}{number:012d}")
    system, root = open_folder(path.rstrip("/"))
    for name in names[:-1]:
        system.delete_dir(f"{root}/{name}")
