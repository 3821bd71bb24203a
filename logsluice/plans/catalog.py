"""Registered queries: every operator over whole test tables.

The tables hold no logs, so each query first writes log lines from columns and then
runs the operators on them. Line order comes from real keys; a slice is a fixed range
of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.layouts import EPOCH_MILLIS, ISO_8601, iso_ts, parse_ts, reformat_ts
from logsluice.functions.scalars import (
    content_hash,
    fit_bytes,
    fit_text,
    line_hash,
    null_token,
    object_key,
    plain_number,
    regex_get,
    to_bool,
    to_double,
    to_float,
    to_integer,
)
from logsluice.functions.useragent import ua_browser, ua_os
from logsluice.operators.delivery import (
    assign_batches,
    collect_batches,
    dedup_batches,
    drop_oversize,
    encoded_size,
    event_batches,
    object_manifest,
    time_folders,
)
from logsluice.operators.flow import (
    carry_app_ver,
    fold_continuations,
    limit_age,
    resume_from,
    split_records,
    split_rejects,
)
from logsluice.operators.merge import list_sources, merge_hosts, number_merged, tail_view
from logsluice.operators.parsers import (
    OK,
    parse_csv,
    parse_json,
    parse_json_raw,
    parse_kv,
    parse_regex,
    parse_variadic_json,
    parse_variadic_kv,
    with_defaults,
)
from logsluice.operators.quality import file_cursors, ingest_log, ingest_report
from logsluice.operators.records import (
    coercion_report,
    encode_csv,
    enrich_ua,
    format_conformance,
    process,
    to_record,
)
from logsluice.plans.run import plan_lines, route
from logsluice.session import checkpoint_dir, configure
from logsluice.sinks.objects import read_manifest, write_encoded
from logsluice.spec import Attribute, Identity, LineKey, SourceSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

INGEST = datetime(2024, 2, 1, 12, 30, 45)
IDENTITY = Identity("shop", "2.4", "web-1", "access.log", INGEST)
SLICE_ROWS = 8192
EVENT_KEY = LineKey("event_type", "slice", "event_id")
DOC_KEY = LineKey("source", "doc_id", "pos")

ACCESS_REGEX = (
    r'^(?P<remote_address>\S+) - (?P<remote_user>\S+) \[(?P<event_datetime>\d\d/\w{3}/\d{4}(?::\d\d){3} [-+]\d{4})\] '
    r'"[A-Z]+ \S+ HTTP/\d\.\d" (?P<log_level>\d{3}) (?P<response_bytes>\d+|-) '
    r'"(?P<http_referer>[^"]*)" "(?P<user_agent>[^"]*)" ?(?P<response_s>[\d.]*)$'
)
ACCESS_LAYOUT = "02/Jan/2006:15:04:05 +0000"

USER_AGENTS = (
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_14_0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/80.0.1 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 13_3 like Mac OS X) AppleWebKit/605.1 (KHTML, like Gecko) CriOS/79.0.3 Mobile",
    "Mozilla/5.0 (X11; Linux x86_64; rv:72.0) Gecko/20100101 Firefox/72.0",
    "ShopKiosk/3 (Linux; Android 12.1; counter tablet) Version/7.5 Embedded",
    "LabelPrinter/9 (Windows NT 10.0; Trident/8.0; roll; rv:14.2)",
    "Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 5.1)",
    "ELB-HealthChecker/2.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_2) AppleWebKit/605.1.15 Version/13.0.4 Safari/605.1.15",
    "Mozilla/5.0 (iPad; CPU OS 12_4) AppleWebKit/605.1.15",
    "curl/7.68.0",
)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


# -- lines from tables --------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*pieces: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("slice", F.floor(F.col("event_id") / SLICE_ROWS))


def user_agent() -> Column:
    chosen = F.array(*map(F.lit, USER_AGENTS))
    return F.element_at(chosen, (F.col("user_id") % len(USER_AGENTS)).cast("int") + 1)


def access_line() -> Column:
    eid = F.col("event_id")
    return text(
        "10.0.0.", F.col("user_id"), " - ", F.when(eid % 3 == 0, "-").otherwise(text("u", F.col("user_id"))), " [",
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', F.col("event_type"), "?id=", eid,
        ' HTTP/1.1" ', F.when(F.col("event_type") == "error", "500").otherwise("200"), " ",
        F.when(eid % 7 == 0, "-").otherwise((eid * 3).cast("string")), ' "http://r/', F.col("event_type"), '" "',
        user_agent(), '"', F.when(eid % 5 == 0, "").otherwise(text(" ", eid % 60, ".", F.lpad(eid % 1000, 3, "0"))),
    )


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log lines; each 97th is not one."""
    bad = text("-- stray output of worker ", F.col("user_id"))
    line = F.when(F.col("event_id") % 97 == 0, bad).otherwise(access_line())
    return events(spark, sf_dir).select("event_type", "slice", "event_id", line.alias("line"))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time is out of order by up to six minutes, and missing on each 11th."""
    rows = events(spark, sf_dir)
    shifted = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))
    return rows.select(
        "event_type", "slice", "event_id", F.when(F.col("event_id") % 11 != 0, shifted).alias("event_ts")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents; a source is a log, a document a slice of it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def shown(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text."""
    return df.select(*(iso_ts(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


# -- regex parsing ------------------------------------------------------------------


@query
def access_log_regex(spark, sf_dir):
    parsed = parse_regex(access_lines(spark, sf_dir), ACCESS_REGEX, identity=IDENTITY)
    good, _ = split_rejects(process(parsed, ACCESS_LAYOUT), key=EVENT_KEY)
    return to_record(good, keep=("event_id",))


@query
def regex_residual(spark, sf_dir):
    parsed = parse_regex(access_lines(spark, sf_dir), ACCESS_REGEX, identity=IDENTITY)
    return parsed.filter(F.col(OK)).select("event_id", "log_line")


@query
def regex_attributes(spark, sf_dir):
    parsed = parse_regex(access_lines(spark, sf_dir), ACCESS_REGEX, identity=IDENTITY, residual=False)
    return parsed.select(
        "event_id", "remote_address", "remote_user", "log_level", "response_bytes", "http_referer", "response_s", OK
    )


URL_REGEX = (
    r"^(?P<scheme>https?)://(?P<host>[^/:?#]+)(?::\d+)?(?P<path>/[^?#]*)?"
    r"(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?$"
)


@query
def url_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("line"))
    parsed = parse_regex(pages, URL_REGEX, fmt=(), residual=False)
    page = regex_get(F.col("line"), r"[?&]page=(\d*)")
    return parsed.select("page_id", "scheme", "host", "path", "query", "fragment", page.alias("page"), OK)


@query
def nested_residual(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("line"))
    return parse_regex(pages, URL_REGEX, fmt=()).select("page_id", "log_line")


@query
def ua_families(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", user_agent().alias("user_agent"))
    parsed = rows.withColumns({c: F.lit(None).cast("string") for c in ("browser", "browser_ver", "os", "os_ver")})
    # A system already known from the line is kept.
    known = F.when(F.col("event_id") % 13 == 0, "plan9")
    return enrich_ua(parsed.withColumn("os", known)).drop("user_agent")


@query
def ua_functions(spark, sf_dir):
    ua = user_agent()
    return events(spark, sf_dir).select(
        "event_id",
        ua_browser(ua)["family"].alias("browser"),
        ua_browser(ua)["version"].alias("browser_ver"),
        ua_os(ua)["family"].alias("os"),
        ua_os(ua)["version"].alias("os_ver"),
    )


# -- JSON ---------------------------------------------------------------------------

JSON_FIELDS = {
    "event_datetime": "timestamp",
    "log_level": "kind",
    "user_tag": "who",
    "remote_address": "addr",
    "device_tag": "device",
    "response_bytes": "bytes",
    "country": "country",
    "os": "os_name",
}


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines; each 89th is cut off, each 83rd has text after the object."""
    eid = F.col("event_id")
    line = text(
        '{"timestamp":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '","kind":"', F.col("event_type"),
        '","who":', F.col("user_id"), ',"addr":"10.0.0.', F.col("user_id"), '","device":',
        F.when(eid % 4 == 0, "null").otherwise(text('"d-', eid, '"')), ',"bytes":', F.col("value"),
        ',"country":"', F.when(eid % 3 == 0, "none").otherwise("mx"), '","zeta":', eid % 2 == 0,
        ',"message":"m ', eid, '","alpha":', eid, ',"props":', F.col("props"), "}",
    )
    broken = F.when(eid % 89 == 0, F.substring(line, 1, 40)).when(eid % 83 == 0, text(line, " {}")).otherwise(line)
    return events(spark, sf_dir).select("event_type", "slice", "event_id", broken.alias("line"))


@query
def json_mapped(spark, sf_dir):
    parsed = parse_json(json_lines(spark, sf_dir), JSON_FIELDS, identity=IDENTITY, residual=False)
    good = process(parsed, "2006-01-02T15:04:05.000Z").filter(F.col(OK))
    return shown(to_record(good, keep=("event_id",)).drop("log_line"))


@query
def json_residual(spark, sf_dir):
    parsed = parse_json(json_lines(spark, sf_dir), JSON_FIELDS, identity=IDENTITY)
    return parsed.filter(F.col(OK)).select("event_id", "log_line")


@query
def json_raw(spark, sf_dir):
    fmt = [Attribute(k) for k in ("event_datetime", "kind", "who", "device", "country", "log_line")]
    return parse_json_raw(json_lines(spark, sf_dir), fmt).select("event_id", *(a.key for a in fmt), OK)


@query
def variadic_json(spark, sf_dir):
    parsed = parse_variadic_json(json_lines(spark, sf_dir), IDENTITY)
    return parsed.select("event_id", "app", "app_ver", "hostname", "filename", "event", "meta", "log_line", OK)


# -- CSV ----------------------------------------------------------------------------

LINEITEM_FIELDS = [
    "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    "note", "l_shipdate",
]
LINEITEM_FORMAT = (
    Attribute("l_orderkey", "integer"),
    Attribute("l_partkey", "integer"),
    Attribute("l_linenumber", "integer"),
    Attribute("l_quantity", "float32"),
    Attribute("l_extendedprice", "double"),
    Attribute("l_discount", "double"),
    Attribute("l_returnflag", "string", 1),
    Attribute("note", "string", 12),
    Attribute("l_shipdate", "timestamp", 0, "2006/01/02 15:04:05", "Mon Jan _2 15:04:05 2006"),
)


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines. By part key some have a field too many, a stray quote, or an unclosed quote."""
    key = F.col("l_partkey")
    note = (
        F.when(key % 4 == 0, text('"say ""', key, '"", now"'))
        .when(key % 4 == 1, " padded")
        .when(key % 4 == 2, "none")
        .otherwise("")
    )
    line = text(
        F.col("l_orderkey"), ",", key, ",", F.col("l_linenumber"), ",", F.col("l_quantity"), ",",
        F.col("l_extendedprice"), ",", F.col("l_discount"), ",", F.col("l_returnflag"), ",", note, ",",
        F.date_format("l_shipdate", "yyyy/MM/dd HH:mm:ss"),
    )
    line = (
        F.when(key % 101 == 0, text(line, ",extra"))
        .when(key % 101 == 1, text('7 "', line))
        .when(key % 101 == 2, text('"', F.regexp_replace(line, '"', "")))
        .otherwise(line)
    )
    keys = ("l_orderkey", "l_linenumber", "l_suppkey", "l_tax", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*(F.col(c).alias("k" + c[1:]) for c in keys), line.alias("line"))


@query
def csv_lines(spark, sf_dir):
    lines = lineitem_lines(spark, sf_dir).select("k_orderkey", "k_linenumber", "line")
    parsed = parse_csv(lines, LINEITEM_FIELDS, LINEITEM_FORMAT, IDENTITY, residual=False)
    good = parsed.filter(F.col(OK))
    return to_record(good, LINEITEM_FORMAT)


@query
def csv_rejects(spark, sf_dir):
    parsed = parse_csv(lineitem_lines(spark, sf_dir), LINEITEM_FIELDS, LINEITEM_FORMAT, IDENTITY)
    return parsed.filter(~F.col(OK)).select("k_orderkey", "k_linenumber", "line")


def order_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text(
        F.col("o_orderkey"), ";[] ", F.col("o_orderstatus"), ";", F.col("o_orderpriority"), ";done (ms) in  ",
        F.col("o_custkey"), ";", F.when(F.col("o_custkey") % 2 == 0, "-").otherwise("vip  ()"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query
def csv_residual(spark, sf_dir):
    fields = ["user_tag", "", "log_level", "unlisted", ""]
    parsed = parse_csv(order_csv_lines(spark, sf_dir), fields, identity=IDENTITY, delimiter=";")
    return parsed.select("o_orderkey", "user_tag", "log_level", "unlisted", "log_line", OK)


# -- key=value ----------------------------------------------------------------------


def order_kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 bytes of date, then pairs; each 71st is too short, and a key may be repeated."""
    key = F.col("o_orderkey")
    line = text(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), 'status="', F.col("o_orderstatus"),
        '" user_id="', F.col("o_custkey"), '" prio="', F.col("o_orderpriority"), '" note="',
        F.when(key % 5 == 0, "-").otherwise("ok"), '" order.total-sum="', F.col("o_totalprice"), '"',
        F.when(key % 3 == 0, ' prio="again"').otherwise(""),
    )
    line = F.when(key % 71 == 0, "too short").otherwise(line)
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


KV_FIELDS = {"log_level": "status", "user_tag": "user_id", "device_tag": "note"}


@query
def kv_lines(spark, sf_dir):
    parsed = parse_kv(order_kv_lines(spark, sf_dir), KV_FIELDS, identity=IDENTITY)
    return parsed.select("o_orderkey", "log_level", "user_tag", "device_tag", "log_line", OK)


@query
def kv_json_residual(spark, sf_dir):
    parsed = parse_kv(order_kv_lines(spark, sf_dir), KV_FIELDS, identity=IDENTITY, log_line_format="json")
    return parsed.filter(F.col(OK)).select("o_orderkey", "log_line")


@query
def kv_custom_regex(spark, sf_dir):
    """Three groups: a quoted or a bare value, whichever is not blank."""
    key = F.col("o_orderkey")
    line = text(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "a=", key, ' b="q ', F.col("o_custkey"), '" c=""'
    )
    lines = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    regex = r'(\w+)=(?:"([^"]*)"|(\S+))\s?'
    parsed = parse_kv(lines, {"user_tag": "a", "device_tag": "b"}, identity=IDENTITY, kv_regex=regex)
    return parsed.select("o_orderkey", "user_tag", "device_tag", "log_line")


@query
def variadic_kv(spark, sf_dir):
    parsed = parse_variadic_kv(order_kv_lines(spark, sf_dir), IDENTITY, clean_keys=True)
    return parsed.select("o_orderkey", "app", "event", "meta", "log_line", OK)


# -- times --------------------------------------------------------------------------


@query
def ts_layouts(spark, sf_dir):
    """Event time read from four layouts in turn, with the ingest time as fallback."""
    ts, eid = F.col("ts"), F.col("event_id")
    styles = [
        ("02/Jan/2006:15:04:05 +0000", F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss '+0000'")),
        ("2006/01/02 15:04:05", F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSS")),
        ("2006-01-02T15:04:05.000Z", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        ("Mon Jan 2 15:04:05 -0700 2006", F.date_format(ts, "EEE MMM dd HH:mm:ss '-0500' yyyy")),
        ("Jan _2, 2006 at 3:04pm (MST)", text(F.date_format(ts, "MMM dd, yyyy 'at' h:mm"), F.lower(F.date_format(ts, "a")), " (UTC)")),
    ]
    chosen = F
    for i, (layout, written) in enumerate(styles):
        chosen = chosen.when(eid % len(styles) == i, parse_ts(written, layout))
    rows = events(spark, sf_dir).select("event_id", chosen.alias("event_ts"))
    ingest = F.lit(INGEST.isoformat(sep=" ")).cast("timestamp")
    return rows.select(
        "event_id",
        iso_ts(F.col("event_ts")).alias("event_ts"),
        F.coalesce(iso_ts(F.col("event_ts")), iso_ts(ingest)).alias("event_datetime"),
    )


@query
def ts_reformat(spark, sf_dir):
    """Wall clock kept when a time text is written in another layout."""
    slash = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")
    ruby = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss '-0500' yyyy")
    wrong = F.when(F.col("o_orderkey") % 9 == 0, "week 7 of 2031").otherwise(slash)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        reformat_ts(slash, "2006/01/02 15:04:05", ISO_8601).alias("iso"),
        reformat_ts(slash, "2006/01/02 15:04:05", "Mon Jan _2 15:04:05 2006").alias("ansi"),
        reformat_ts(slash, "2006/01/02 15:04:05", "2006/01/02").alias("day"),
        reformat_ts(ruby, "Mon Jan 02 15:04:05 -0700 2006", ISO_8601).alias("ruby"),
        reformat_ts(wrong, "2006/01/02 15:04:05", ISO_8601).alias("wrong"),
        reformat_ts(wrong, "", "").alias("same"),
    )


@query
def epoch_ms(spark, sf_dir):
    millis = F.unix_millis("ts").cast("string")
    written = F.when(F.col("event_id") % 17 == 0, "17x").otherwise(millis)
    return events(spark, sf_dir).select("event_id", iso_ts(parse_ts(written, EPOCH_MILLIS)).alias("event_ts"))


CONFORMANCE_FORMAT = (
    Attribute("created", "timestamp", 0, "2006-01-02 15:04:05", ISO_8601),
    Attribute("seen", "timestamp", 0, "2006/01/02", ISO_8601),
)


def planted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id",
        F.when(eid % 19 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created"),
        F.when(eid % 23 == 0, "2024/02/30").when(eid % 29 == 0, "-").otherwise(F.date_format("ts", "yyyy/MM/dd"))
        .alias("seen"),
    )


@query
def format_conformance_report(spark, sf_dir):
    return format_conformance(planted_times(spark, sf_dir), CONFORMANCE_FORMAT)


# -- types --------------------------------------------------------------------------


def planted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column texts with values that do not convert, chosen by part key."""
    key = F.col("l_partkey")
    words = F.array(*map(F.lit, ["t", "TRUE", "1", "False", "f", "0", "yes", "tRUE"]))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(key % 10 == 0, " 12").when(key % 10 == 1, "1.0").when(key % 10 == 2, text("+", key))
        .otherwise(F.col("l_orderkey").cast("string")).alias("whole"),
        F.when(key % 10 == 3, "1d").when(key % 10 == 4, "1e999").otherwise(F.col("l_extendedprice").cast("string"))
        .alias("price"),
        F.when(key % 10 == 5, "").when(key % 10 == 6, "0x1p").otherwise(F.col("l_discount").cast("string"))
        .alias("rate"),
        F.element_at(words, (key % 8).cast("int") + 1).alias("flag"),
        F.when(key % 10 == 7, "null").otherwise(F.col("l_linestatus")).alias("label"),
    )


@query
def coerce_types(spark, sf_dir):
    return planted_values(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        to_integer(F.col("whole")).alias("whole"),
        to_double(F.col("price")).alias("price"),
        to_float(F.col("rate")).alias("rate"),
        to_bool(F.col("flag")).alias("flag"),
        null_token(F.col("label")).alias("label"),
    )


@query
def coercion_counts(spark, sf_dir):
    fmt = (
        Attribute("whole", "integer"),
        Attribute("price", "double"),
        Attribute("rate", "float32"),
        Attribute("flag", "bool"),
        Attribute("label", "string"),
    )
    return coercion_report(planted_values(spark, sf_dir), fmt)


@query
def plain_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    big, small = F.col("l_quantity") * 1e9, F.col("l_quantity") / 1048576
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        plain_number(F.col("l_quantity")).alias("quantity"),
        plain_number(F.col("l_extendedprice")).alias("price"),
        plain_number(-big).alias("big"),
        plain_number(small).alias("small"),
    )


@query
def fit_text_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    planted = F.concat(F.lit("\x00"), F.col("text"), F.lit("\x00"))
    return docs.select(
        "doc_id", fit_text(F.col("text"), 64).alias("short"), F.md5(fit_text(planted).cast("binary")).alias("clean_md5")
    )


@query
def fit_bytes_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    return docs.select(
        "doc_id",
        fit_bytes(ascii_only, 100).alias("head"),
        F.octet_length(fit_bytes(F.col("text"), 1 << 20)).alias("whole_bytes"),
    )


@query
def line_hashes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", line_hash(F.col("text")).alias("line_md5"),
        content_hash(F.concat_ws("\n", "role", "text")).alias("content_md5"),
    )


# -- row flow -----------------------------------------------------------------------

WORD_REGEX = r"^(?P<log_level>[A-M][a-z]+) (?P<user_tag>[a-z]+)"


@query
def rejects(spark, sf_dir):
    parsed = parse_regex(document_lines(spark, sf_dir), WORD_REGEX, fmt=(), residual=False)
    _, bad = split_rejects(parsed, key=DOC_KEY)
    return bad


@query
def ingest_counts(spark, sf_dir):
    parsed = parse_regex(document_lines(spark, sf_dir), WORD_REGEX, fmt=(), residual=False)
    return ingest_report(parsed, "source")


@query
def ingest_log_rows(spark, sf_dir):
    parsed = parse_regex(access_lines(spark, sf_dir), ACCESS_REGEX, fmt=(), residual=False)
    return ingest_log(parsed, "web", "nginx", F.lit("2024-02-01T12:30:45Z"), "event_type")


@query
def age_limit(spark, sf_dir):
    cutoff = F.lit("2024-01-20 06:00:00").cast("timestamp")
    return shown(limit_age(timed_events(spark, sf_dir), cutoff))


def half_month_cursors(timed: DataFrame) -> DataFrame:
    """Cursors of an earlier run up to the middle of the month; "view" was not read then."""
    earlier = timed.filter((F.col("event_ts") < "2024-01-16") & (F.col("event_type") != "view"))
    return file_cursors(earlier, EVENT_KEY, app_ver="2.4")


@query
def cursors(spark, sf_dir):
    return shown(half_month_cursors(timed_events(spark, sf_dir)))


@query
def resume(spark, sf_dir):
    timed = timed_events(spark, sf_dir)
    return shown(resume_from(timed, half_month_cursors(timed), EVENT_KEY))


@query
def continuations(spark, sf_dir):
    parsed = parse_regex(document_lines(spark, sf_dir), WORD_REGEX, fmt=(), residual=False)
    return fold_continuations(parsed, DOC_KEY)


@query
def record_split(spark, sf_dir):
    return split_records(document_lines(spark, sf_dir), "^[A-M]", DOC_KEY)


@query
def app_versions(spark, sf_dir):
    marker = text("---- app_ver: 3.", F.floor(F.col("event_id") / 50))
    line = F.when((F.col("event_id") % 50 == 7), marker).otherwise(F.col("props"))
    lines = events(spark, sf_dir).select("event_type", "slice", "event_id", line.alias("line"))
    return carry_app_ver(lines, "2.4", EVENT_KEY)


@query
def defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    filled = with_defaults(rows, identity=Identity("shop", "2.4", "web-1", text("orders-", F.col("o_orderkey")), INGEST))
    return shown(to_record(filled, keep=("o_orderkey",)))


# -- delivery -----------------------------------------------------------------------

ORDER_FORMAT = (
    Attribute("o_orderkey", "integer"),
    Attribute("o_orderstatus", "string"),
    Attribute("o_totalprice", "double"),
    Attribute("o_orderpriority", "string"),
    Attribute("o_orderdate", "timestamp"),
    Attribute("comment", "string"),
)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    comment = (
        F.when(key % 6 == 0, "a, b")
        .when(key % 6 == 1, 'he said "no"')
        .when(key % 6 == 2, " lead")
        .when(key % 6 == 3, F.lit("two\nlines"))
        .when(key % 6 == 4, F.lit("\\."))
    )
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return rows.withColumn("comment", comment).withColumn("slice", F.floor(key / SLICE_ROWS))


@query
def csv_encode(spark, sf_dir):
    return order_records(spark, sf_dir).select("o_orderkey", encode_csv(ORDER_FORMAT).alias("csv_line"))


@query
def batches(spark, sf_dir):
    """Delivery batches of the order records, 500 to a batch at the default limits."""
    encoded = order_records(spark, sf_dir).select("slice", "o_orderkey", encode_csv(ORDER_FORMAT).alias("csv_line"))
    small, _ = drop_oversize(encoded)
    batched = assign_batches(small, encoded_size(F.col("csv_line")), ["slice"], ["o_orderkey"])
    return batched.select("slice", "o_orderkey", "batch")


def document_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.floor(F.col("doc_id") / 256).alias("shard"), "doc_id", F.col("text").alias("csv_line"))


@query
def batches_by_size(spark, sf_dir):
    """Whole documents as records, a batch closing with the one that brings it over 100,000 bytes."""
    docs = document_shards(spark, sf_dir)
    batched = assign_batches(docs, encoded_size(F.col("csv_line")), ["shard"], ["doc_id"], over_bytes=100_000)
    return batched.select("shard", "doc_id", "batch")


@query
def delivery_batches(spark, sf_dir):
    docs = document_shards(spark, sf_dir)
    batched = assign_batches(docs, encoded_size(F.col("csv_line")), ["shard"], ["doc_id"], over_bytes=100_000)
    grouped = collect_batches(batched, ["shard", "batch"], ["doc_id"])
    body = F.array_join("records", "\n")
    return grouped.select("shard", "batch", "record_count", "batch_bytes", content_hash(body).alias("body_md5"))


@query
def oversize(spark, sf_dir):
    _, large = drop_oversize(document_shards(spark, sf_dir), limit=10_000)
    return large.select("doc_id", F.octet_length("csv_line").alias("bytes"), "reason")


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_regex(access_lines(spark, sf_dir), ACCESS_REGEX, fmt=(), residual=False)
    good = parsed.filter(F.col(OK))
    attributes = ["remote_address", "remote_user", "log_level", "response_bytes", "http_referer", "event_datetime"]
    return event_batches(good, attributes, "key-1", EVENT_KEY, batch_events=1000)


@query
def event_batch_payloads(spark, sf_dir):
    return event_posts(spark, sf_dir).select("event_type", "batch", "event_count", "payload")


@query
def transaction_ids(spark, sf_dir):
    return event_posts(spark, sf_dir).select("event_type", "batch", "transaction_id")


@query
def dedup(spark, sf_dir):
    """Batches sent twice, less those delivered before."""
    posts = event_posts(spark, sf_dir).select("event_type", "batch", "transaction_id")
    return dedup_batches(posts.unionByName(posts), posts.filter(F.col("batch") == 0))


@query
def object_keys(spark, sf_dir):
    prefix = F.when(F.col("o_custkey") % 2 == 0, "logs").otherwise("")
    key = object_key(prefix, F.col("o_orderstatus"), time_folders(F.col("o_orderdate")), F.md5(F.col("o_orderpriority").cast("binary")))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("fullpath"))


@query
def manifest(spark, sf_dir):
    uploaded = F.lit(INGEST.isoformat(sep=" ")).cast("timestamp")
    listed = object_manifest(
        document_shards(spark, sf_dir), "doc_log", uploaded, ["shard"], ["doc_id"], 200_000, "logs", "v7"
    )
    return listed.drop("body")


@query
def delivered_objects(spark, sf_dir):
    """Objects written through the data source; the manifest comes from its ledger."""
    store = f"{checkpoint_dir(spark)}/objects-{uuid.uuid4().hex}"
    shards = document_shards(spark, sf_dir)
    write_encoded(shards, store, "doc_log", ["shard"], ["doc_id"], "logs", "v7", 200_000, uploaded=INGEST)
    return read_manifest(spark, store).select("fullpath", "table_name", "ddl_version", "record_count")


# -- merging ------------------------------------------------------------------------

HOST_KEY = LineKey("event_type", "slice", "event_id")


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "slice", "event_id", "user_id", F.col("props").alias("line"))
    parts = {f"host-{h}": rows.filter(F.col("user_id") % 4 == h).drop("user_id") for h in range(4)}
    return merge_hosts(parts)


@query
def merged_hosts(spark, sf_dir):
    return number_merged(host_lines(spark, sf_dir), HOST_KEY)


@query
def tail_of_source(spark, sf_dir):
    return tail_view(access_lines(spark, sf_dir), "purchase", "event_type").drop("slice")


@query
def sources(spark, sf_dir):
    """Declared files, folders and globs; a folder doesn't own another that begins like it."""
    specs = [
        SourceSpec("clicks", "/logs/click", "web", "regex"),
        SourceSpec("trade", "/logs/p*", "web", "json"),
        SourceSpec("one-file", "file:///logs//view/1.log", "audit", "csv"),
        SourceSpec("some", "/logs/{view,click}/[02].log", "audit", "csv"),
        SourceSpec("absent", "/logs/cli", "audit", "csv"),
    ]
    file = text("/logs/", F.col("event_type"), "/", F.col("user_id") % 3, ".log")
    return list_sources(spark, specs, events(spark, sf_dir).select(file.alias("file")))


@query
def routed_sources(spark, sf_dir):
    """Two sources with different parsers into one sink."""
    fmt = (
        Attribute("app", "string", 16),
        Attribute("event_datetime", "timestamp"),
        Attribute("hostname", "string", 64),
        Attribute("filename", "string", 256),
        Attribute("log_level", "string", 16),
        Attribute("remote_address", "string", 64),
    )
    web = SourceSpec("web", "", "lake", "regex", ACCESS_LAYOUT, line_regex=ACCESS_REGEX, hostname="web-1", app="shop")
    app = SourceSpec(
        "app", "", "lake", "json", "2006-01-02T15:04:05.000Z", field_mappings=JSON_FIELDS, hostname="app-1", app="shop"
    )
    plans = [
        (web, plan_lines(access_lines(spark, sf_dir), web, fmt, EVENT_KEY, INGEST)),
        (app, plan_lines(json_lines(spark, sf_dir), app, fmt, EVENT_KEY, INGEST)),
    ]
    return shown(route(plans)["lake"].drop("raw_line", "slice", "event_type"))

