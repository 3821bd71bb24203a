"""From attributes to typed records and their CSV text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.layouts import ISO_8601, iso_ts, parse_ts, reformat_ts
from logsluice.functions.scalars import (
    NULL_MARK,
    NULL_TOKENS,
    fit_text,
    null_token,
    plain_number,
    seconds_to_ms,
    to_bool,
    to_double,
    to_float,
    to_integer,
)
from logsluice.functions.useragent import ua_browser, ua_os
from logsluice.spec import (
    BOOL,
    DEFAULT_FORMAT,
    DOUBLES,
    FLOAT32,
    INTEGER,
    TIMESTAMP,
    UUID_KEY,
    Attribute,
    RecordFormat,
    check_attribute,
)

EVENT_TIME = "event_ts"


def response_millis(parsed: DataFrame) -> DataFrame:
    """``response_ms`` from ``response_s`` where that is a number."""
    if "response_s" not in parsed.columns:
        return parsed
    millis = seconds_to_ms(F.col("response_s"))
    if "response_ms" in parsed.columns:
        millis = F.coalesce(millis, F.col("response_ms"))
    return parsed.withColumn("response_ms", millis)


def enrich_ua(parsed: DataFrame) -> DataFrame:
    """Browser and system columns from ``user_agent``, where the parser left them empty."""
    columns = set(parsed.columns)
    wanted = [
        (name, version, of)
        for name, version, of in (("browser", "browser_ver", ua_browser), ("os", "os_ver", ua_os))
        if name in columns and "user_agent" in columns
    ]
    if not wanted:
        return parsed
    found = parsed.withColumns({f"_{n}": F.when(F.col(n).isNull(), of(F.col("user_agent"))) for n, _, of in wanted})
    changes: dict[str, Column] = {}
    for name, version, _ in wanted:
        kept = F.col(version) if version in columns else F.lit(None).cast("string")
        changes[version] = F.when(F.col(name).isNull(), F.col(f"_{name}")["version"]).otherwise(kept)
        changes[name] = F.coalesce(F.col(name), F.col(f"_{name}")["family"])
    return found.withColumns(changes).drop(*(f"_{n}" for n, _, _ in wanted))


def resolve_time(parsed: DataFrame, layout: str) -> DataFrame:
    """Add ``event_ts``, the event time read from the line (NULL when unreadable).

    ``event_datetime`` becomes its ISO text and falls back to the ingest time. Age limit and
    resume use ``event_ts``, which has no fallback.
    """
    text = F.col("event_datetime") if "event_datetime" in parsed.columns else F.lit(None).cast("string")
    timed = parsed.withColumn(EVENT_TIME, parse_ts(text, layout))
    fallback = F.col("ingest_datetime") if "ingest_datetime" in parsed.columns else F.lit(None).cast("string")
    return timed.withColumn("event_datetime", F.coalesce(iso_ts(F.col(EVENT_TIME)), fallback))


def process(parsed: DataFrame, layout: str) -> DataFrame:
    """The steps between parser and record: response time, user agent, event time."""
    return resolve_time(enrich_ua(response_millis(parsed)), layout)


def typed(attr: Attribute, text: Column, strict: bool = False) -> Column:
    """Attribute text as its declared type; unreadable values are NULL.

    ``strict`` gives "" for a time that does not fit its source layout.
    """
    if attr.key == UUID_KEY:
        return F.uuid()
    if attr.type == INTEGER:
        return to_integer(text)
    if attr.type == FLOAT32:
        return to_float(text)
    if attr.type in DOUBLES:
        return to_double(text)
    if attr.type == BOOL:
        return to_bool(text)
    fitted = F.when(~text.isin(*NULL_TOKENS), fit_text(text, attr.length))
    if attr.type != TIMESTAMP:
        return fitted
    if not attr.reformats:
        return parse_ts(fitted, ISO_8601)
    moved = reformat_ts(fitted, attr.source_ts_fmt, attr.destination_ts_fmt)
    return F.when(fitted.isNotNull(), F.coalesce(moved, F.lit(""))) if strict else moved


def to_record(
    parsed: DataFrame, fmt: RecordFormat = DEFAULT_FORMAT, keep: tuple[str, ...] = (), strict: bool = False
) -> DataFrame:
    """Typed columns of the record format in its order, after the ``keep`` columns. Other columns go."""
    have = set(parsed.columns)
    columns = [F.col(k) for k in keep]
    for attr in fmt:
        check_attribute(attr)
        text = F.col(attr.key) if attr.key in have else F.lit(None).cast("string")
        value = typed(attr, text, strict)
        if attr.key == "event_datetime" and attr.type == TIMESTAMP and not attr.reformats and EVENT_TIME in have:
            # Already read: the text is only read again where it is the fallback.
            value = F.coalesce(F.date_trunc("millisecond", F.col(EVENT_TIME)), value)
        columns.append(value.alias(attr.key))
    return parsed.select(*columns)


def attribute_text(attr: Attribute, value: Column) -> Column:
    """Text of a typed value in the CSV output; NULL stays NULL."""
    if attr.key == UUID_KEY:
        return value
    if attr.type == TIMESTAMP and not attr.reformats:
        return iso_ts(value)
    if attr.type == FLOAT32 or attr.type in DOUBLES:
        return plain_number(value)
    if attr.type in (INTEGER, BOOL):
        return value.cast("string")
    return value


def csv_field(text: Column) -> Column:
    """One CSV field, quoted only where needed; NULL is \\N."""
    needs = text.rlike(r'[,"\r\n]|\A[\s\x85\xa0]|\A\\\.\z')
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), NULL_MARK).when(needs, quoted).otherwise(text)


def encode_csv(fmt: RecordFormat = DEFAULT_FORMAT) -> Column:
    """A typed record as one CSV line, without the line end."""
    return F.concat_ws(",", *(csv_field(attribute_text(a, F.col(a.key))) for a in fmt))


def coercion_report(parsed: DataFrame, fmt: RecordFormat = DEFAULT_FORMAT) -> DataFrame:
    """Per attribute: values given, values that could not be converted.

    One partial aggregate over the lines; a single row leaves each task.
    """
    have = set(parsed.columns)
    checked = [a for a in fmt if a.key in have and a.key != UUID_KEY]
    counts = []
    for a in checked:
        text = F.col(a.key)
        if a.type in ("string", TIMESTAMP):
            text = null_token(text)
        counts.append(F.count(text).alias(f"given_{a.key}"))
        counts.append(F.count_if(text.isNotNull() & typed(a, F.col(a.key)).isNull()).alias(f"failed_{a.key}"))
    rows = [
        F.struct(
            F.lit(a.key).alias("attribute"),
            F.lit(a.type).alias("declared_type"),
            F.col(f"given_{a.key}").alias("given"),
            F.col(f"failed_{a.key}").alias("failed"),
        )
        for a in checked
    ]
    return parsed.agg(*counts).select(F.inline(F.array(*rows)))


def format_conformance(parsed: DataFrame, fmt: RecordFormat) -> DataFrame:
    """Per timestamp attribute with a source layout: values, values that fit, and their share."""
    checked = [a for a in fmt if a.reformats and a.key in parsed.columns]
    counts = []
    for a in checked:
        text = null_token(F.col(a.key))
        counts.append(F.count(text).alias(f"n_{a.key}"))
        counts.append(F.count(parse_ts(text, a.source_ts_fmt)).alias(f"fit_{a.key}"))
    rows = [
        F.struct(
            F.lit(a.key).alias("attribute"),
            F.lit(a.source_ts_fmt).alias("layout"),
            F.col(f"n_{a.key}").alias("values"),
            F.col(f"fit_{a.key}").alias("fitting"),
            (F.try_divide(F.col(f"fit_{a.key}"), F.col(f"n_{a.key}"))).alias("share"),
        )
        for a in checked
    ]
    return parsed.agg(*counts).select(F.inline(F.array(*rows)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
