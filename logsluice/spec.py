"""Declarations: record formats, sources, sinks and the line order key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.layouts import Layout

STRING, TIMESTAMP, INTEGER, FLOAT32, BOOL = "string", "timestamp", "integer", "float32", "bool"
DOUBLES = ("float64", "double")
UUID_KEY = "_uuid"


@dataclass(frozen=True)
class Attribute:
    """One column of a record format. ``length`` 0 means unlimited."""

    key: str
    type: str = STRING
    length: int = 0
    source_ts_fmt: str = ""
    destination_ts_fmt: str = ""

    @property
    def reformats(self) -> bool:
        return self.type == TIMESTAMP and self.source_ts_fmt != ""


RecordFormat = Sequence[Attribute]

# The default 20-column record format.
DEFAULT_FORMAT: tuple[Attribute, ...] = (
    Attribute("app", STRING, 16),
    Attribute("app_ver", STRING, 16),
    Attribute("ingest_datetime", TIMESTAMP),
    Attribute("event_datetime", TIMESTAMP),
    Attribute("hostname", STRING, 64),
    Attribute("filename", STRING, 256),
    Attribute("log_level", STRING, 16),
    Attribute("device_tag", STRING, 64),
    Attribute("user_tag", STRING, 64),
    Attribute("remote_address", STRING, 64),
    Attribute("response_bytes", INTEGER),
    Attribute("response_ms", "double"),
    Attribute("device_type", STRING, 32),
    Attribute("os", STRING, 16),
    Attribute("os_ver", STRING, 16),
    Attribute("browser", STRING, 32),
    Attribute("browser_ver", STRING, 16),
    Attribute("country", STRING, 64),
    Attribute("language", STRING, 16),
    Attribute("log_line", STRING),
)


@dataclass(frozen=True)
class LineKey:
    """Names of the columns that order the lines of one source.

    ``source`` names a file or stream, ``block`` a bounded slice of it (an input
    split, a byte range, a range of ids) and ``pos`` the place inside the slice.
    Ordered operators spread work by (source, block), so that a source holding a
    large share of all lines is still handled by many tasks.
    """

    source: str = "file"
    block: str = "block_start"
    pos: str = "mid"

    @property
    def slice(self) -> list[str]:
        return [self.source, self.block]

    @property
    def columns(self) -> list[str]:
        return [self.source, self.block, self.pos]


@dataclass(frozen=True)
class Identity:
    """Values every record gets before parsing. ``ingest`` None means the current time."""

    app: str = ""
    app_ver: str = ""
    hostname: str = ""
    filename: str | Column = ""
    ingest: datetime | Column | None = None

    def ingest_time(self) -> Column:
        if self.ingest is None:
            return F.current_timestamp()
        if isinstance(self.ingest, Column):
            return self.ingest
        return F.lit(self.ingest.isoformat(sep=" ")).cast("timestamp")

    def text(self, name: str) -> Column:
        value = getattr(self, name)
        return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class SourceSpec:
    """How to read and parse one group of log files."""

    name: str
    path: str
    sink: str
    parse_mode: str
    time_format: str = ""
    extension: str = ""
    line_regex: str = ""
    kv_regex: str = ""
    front_split_regex: str = ""
    field_mappings: dict[str, str] = field(default_factory=dict)
    fields_order: Sequence[str] = ()
    parser_options: dict[str, object] = field(default_factory=dict)
    buffer_multi_lines: bool = False
    skip_header_line: bool = False
    skip_to_end: bool = False
    hostname: str = ""
    app: str = ""
    app_ver: str = ""


@dataclass(frozen=True)
class SinkSpec:
    """Where the records of one or several sources go."""

    name: str
    type: str = "csv"
    record_format: tuple[Attribute, ...] = DEFAULT_FORMAT
    path: str = ""
    options: dict[str, object] = field(default_factory=dict)


class SpecError(ValueError):
    """A declaration that cannot be carried out."""


KNOWN_TYPES = {STRING, TIMESTAMP, INTEGER, FLOAT32, BOOL, *DOUBLES}

# A day with distinct fields, to see which of them a layout keeps.
_PROBE = datetime(2008, 3, 15, 1, 2, 3)


def check_layout(layout: str) -> bool:
    """True when a time printed with ``layout`` reads back as the same second or the same day."""
    parsed = Layout(layout)
    if not parsed.tokens or not parsed.can_parse:
        return False
    again = parsed.read(parsed.write(_PROBE))
    return again in (_PROBE, _PROBE.replace(hour=0, minute=0, second=0))


def check_attribute(attr: Attribute) -> None:
    """Raise SpecError for an attribute that cannot be produced."""
    if attr.key != UUID_KEY and attr.type not in KNOWN_TYPES:
        raise SpecError(f"{attr.key}: unknown type {attr.type!r}")
    if attr.type != TIMESTAMP:
        return
    if bool(attr.source_ts_fmt) != bool(attr.destination_ts_fmt):
        raise SpecError(f"{attr.key}: source and destination time layouts go together")
    for layout in (attr.source_ts_fmt, attr.destination_ts_fmt):
        if layout and not check_layout(layout):
            raise SpecError(f"{attr.key}: layout {layout!r} does not keep the date")


def validate_format(fmt: RecordFormat) -> None:
    """Check every attribute of a record format."""
    seen: set[str] = set()
    for attr in fmt:
        if attr.key in seen:
            raise SpecError(f"{attr.key}: declared twice")
        seen.add(attr.key)
        check_attribute(attr)


def record_schema(fmt: RecordFormat) -> T.StructType:
    """Spark schema of the record table; lengths and layouts travel as field metadata."""

    def spark_type(attr: Attribute) -> T.DataType:
        if attr.key == UUID_KEY:
            return T.StringType()
        if attr.type == TIMESTAMP:
            return T.StringType() if attr.reformats else T.TimestampType()
        if attr.type == INTEGER:
            return T.LongType()
        if attr.type == FLOAT32:
            return T.FloatType()
        if attr.type in DOUBLES:
            return T.DoubleType()
        if attr.type == BOOL:
            return T.BooleanType()
        return T.StringType()

    return T.StructType(
        [
            T.StructField(
                a.key,
                spark_type(a),
                True,
                {
                    "length": a.length,
                    "source_ts_fmt": a.source_ts_fmt,
                    "destination_ts_fmt": a.destination_ts_fmt,
                },
            )
            for a in fmt
        ]
    )


def format_ddl(fmt: RecordFormat, table: str) -> str:
    """CREATE TABLE text of the load target for a record format."""

    def sql_type(attr: Attribute) -> str:
        if attr.key == UUID_KEY:
            return "VARCHAR(36)"
        if attr.type == TIMESTAMP:
            return "TIMESTAMP"
        if attr.type == INTEGER:
            return "INTEGER"
        if attr.type == FLOAT32:
            return "REAL"
        if attr.type in DOUBLES:
            return "DOUBLE PRECISION"
        if attr.type == BOOL:
            return "BOOLEAN"
        return f"VARCHAR({attr.length or 'MAX'})"

    body = ",\n".join(f"    {a.key} {sql_type(a)}" for a in fmt)
    return f"CREATE TABLE {table} (\n{body}\n)"
