import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsluice.functions.regexes import SEP, RegexError, compile_regex
from logsluice.operators.parsers import (
    OK,
    pair_map,
    parse_csv,
    parse_json,
    parse_json_raw,
    parse_kv,
    parse_lines,
    parse_regex,
    parse_variadic_json,
    parse_variadic_kv,
    register_parser,
)
from logsluice.operators.records import EVENT_TIME, encode_csv, process, to_record
from logsluice.plans.catalog import ACCESS_LAYOUT, ACCESS_REGEX
from logsluice.spec import DEFAULT_FORMAT, Attribute, Identity, SourceSpec, SpecError

WHO = Identity("depot", "8.3", "rack-17", "/var/log/depot/gate.log", dt.datetime(2023, 2, 14, 6, 0, 9))


@pytest.fixture
def lines(spark):
    return lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")


def golden(parsed, layout):
    row = to_record(process(parsed, layout), keep=(EVENT_TIME,)).first().asDict()
    return row.pop(EVENT_TIME), {k: v for k, v in row.items() if v is not None}


def test_golden_regex(lines):
    line = (
        'fd00::7c - clerk9 [28/Feb/2023:23:59:58 +0000] "PUT /pallets/8812/weight HTTP/2.0" 204 77 "http://gate.local/" '
        '"ScaleTerminal/4 (X11; kiosk) Firefox/110.0" 0.0625'
    )
    when, row = golden(parse_regex(lines(line), ACCESS_REGEX, identity=WHO), ACCESS_LAYOUT)
    assert when == dt.datetime(2023, 2, 28, 23, 59, 58)
    assert row == {
        "app": "depot", "app_ver": "8.3", "hostname": "rack-17", "filename": "/var/log/depot/gate.log",
        "ingest_datetime": dt.datetime(2023, 2, 14, 6, 0, 9), "event_datetime": dt.datetime(2023, 2, 28, 23, 59, 58),
        "log_level": "204", "remote_address": "fd00::7c", "response_bytes": 77, "response_ms": 62.5,
        "os": "unix", "browser": "firefox", "browser_ver": "110.0",
        "log_line": '- "PUT /pallets/8812/weight HTTP/2.0"',
    }


def test_golden_csv(lines):
    fields = ["log_level", "event_datetime", "remote_address", "country", "os", "browser", ""]
    line = 'NOTICE,1669803630007,192.168.7.9,none,"plan9, 4th",-,[7] job 31: done'
    when, row = golden(parse_csv(lines(line), fields, identity=WHO), "epochmillisecs")
    assert when == dt.datetime(2022, 11, 30, 10, 20, 30, 7000)
    assert row["app"] == "depot" and row["os"] == "plan9, 4th" and row["log_level"] == "NOTICE"
    assert row["log_line"] == "[7] job 31: done"
    assert "browser" not in row and "country" not in row


def test_golden_json(lines):
    line = (
        '{"at":"2023-02-14T05:59:07.125Z","grade":"ALERT","belt":{"no":4,"stop":true},"operator":null,"gate":"G-3",'
        '"note":"  two  boxes","weights":[12.5,1e3],"lang":"fi","retry":0,"retry":3,"zulu":true}'
    )
    mapping = {
        "event_datetime": "at", "log_level": "grade", "device_tag": "gate", "user_tag": "operator",
        "language": "lang", "country": "nowhere",
    }
    when, row = golden(parse_json(lines(line), mapping, identity=WHO), "2006-01-02T15:04:05.000Z")
    assert when == dt.datetime(2023, 2, 14, 5, 59, 7, 125000)
    assert (row["log_level"], row["device_tag"], row["language"]) == ("ALERT", "G-3", "fi")
    assert "user_tag" not in row and "country" not in row
    assert row["log_line"] == '{"belt":{"no":4,"stop":true},"note":"  two  boxes","retry":3,"weights":[12.5,1000.0],"zulu":true}'


def test_regex_rejects_and_leftmost(lines):
    parsed = parse_regex(lines("xx a=1 a=2", "none", "a=-"), r"a=(?P<log_level>\S+)", fmt=())
    rows = parsed.orderBy("i").select("log_level", "log_line", OK).collect()
    assert [tuple(r) for r in rows] == [("1", "xx a=a=2", True), (None, None, False), (None, "a=", True)]
    no_groups = parse_regex(lines("abc"), "abc", fmt=())
    assert no_groups.select(OK).first()[0] is False


def test_regex_separator_in_line(lines):
    text = f"k{SEP}1 v{SEP}{SEP}2 tail"
    parsed = parse_regex(lines(text, SEP), r"^(?P<a>\S+) (?P<b>\S+)", fmt=())
    rows = parsed.orderBy("i").select("a", "b", "log_line", OK).collect()
    assert tuple(rows[0]) == (f"k{SEP}1", f"v{SEP}{SEP}2", "tail", True)
    assert rows[1][OK] is False


def test_regex_dialect(lines):
    # "." takes a carriage return, "$" is the very end, "[" inside a class is plain, groups may be quantified.
    parsed = parse_regex(lines("ab\rc", "x[y"), r"^(?P<a>a)?(?P<rest>.*)$", fmt=(), residual=False)
    assert [r.rest for r in parsed.orderBy("i").collect()] == ["b\rc", "x[y"]
    assert parse_regex(lines("q[]"), r"^q(?P<a>[[&&\]]+)$", fmt=()).first().a == "[]"
    assert compile_regex(r"u(?P<a>x(?P<b>y))v").kinds == ("plain", "capture", "inner", "plain")
    for bad in (r"(?=x)(?P<a>y)", r"(?P<a>x)\1", r"(?U)(?P<a>x+)"):
        with pytest.raises(RegexError):
            compile_regex(bad)


def test_nested_groups_residual(lines):
    parsed = parse_regex(lines("at 10:20 done"), r"(?P<time>(?P<hour>\d+):(?P<minute>\d+))", fmt=())
    row = parsed.first()
    assert (row.time, row.hour, row.minute, row.log_line) == ("10:20", "10", "20", "atdone")



def blanked(regex, line):
    """What the captures of the first match leave of a line, before tidying."""
    m = re.search(regex, line)
    if m is None:
        return None
    out = list(line)
    for g in range(1, m.re.groups + 1):
        for i in range(*m.span(g)):
            out[i] = " "
    text = re.sub(" {2,}", "", "".join(out))
    for empty in ("[]", "()", "- ", '""', "(ms)", "\\N"):
        text = text.replace(empty, "")
    return text.strip()


NESTED = [
    r"(?P<t>(?P<h>\d+):(?P<m>\d*))",
    r"(?P<a>\d+)(?:-(?P<b>[a-c]+))? (?P<c>[a-c])",
    r"(?:k(?P<x>\d)|j(?P<y>[a-c]))z?",
    r"^(?:(?P<w>[a-c]+)[ :])+(?P<n>\d)",
    r"(?P<r>\d)+[a-c]",
    r"(?P<r>[a-c]){2,3}(?:x(?P<d>\d)?)*",
    r"(?i)(?P<u>A(?P<v>b)?)c|(?P<z>\d+)x",
    r"(?P<outer>(?:(?P<inner>\d)[a-c])+)(?: x)?$",
    r"^(?P<o>-)?(?P<p>[a-c]*?)(?P<q>\d*)x",
]


@pytest.mark.parametrize("regex", NESTED)
def test_residual_of_captures_at_any_depth(lines, regex):
    rnd = random.Random(len(regex))
    texts = ["".join(rnd.choice(["a", "b", "c", "1", "2", ":", " ", "-", "x", "k", "j", "z", "A"]) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    parsed = parse_regex(lines(*texts), regex, fmt=())
    rows = {r.i: r for r in parsed.collect()}
    hits = 0
    for i, text in enumerate(texts):
        m = re.search(regex, text)
        assert rows[i][OK] == (m is not None)
        if m is not None:
            hits += 1
            for name, value in m.groupdict().items():
                # Tokens that stand for nothing are NULL.
                assert rows[i][name] == (value if value and value != "-" else None), (text, name)
            assert rows[i].log_line == blanked(regex, text), text
    assert hits > 10
    assert "Python" not in parsed._jdf.queryExecution().executedPlan().toString()


def test_residual_with_classes_of_the_dialect(lines):
    parsed = parse_regex(lines("ab12 rest", "12 rest"), r"^((?P<a>[[:alpha:]]+)\d+)", fmt=())
    assert [(r.a, r.log_line) for r in parsed.orderBy("i").collect()] == [("ab", "rest"), (None, None)]
    parsed = parse_regex(lines("x=1 y=22", "x=1 y=22 "), r"(?P<k>\w=(?P<v>\d+))\z", fmt=())
    assert [(r.k, r.v, r.log_line) for r in parsed.orderBy("i").collect()] == [("y=22", "22", "x=1"), (None, None, None)]

def test_long_lines_match(lines):
    long = "x" * 200_000
    row = parse_regex(lines(f"a={long} b=1"), r"a=(?P<a>[^ ]*) b=(?P<b>\d)", fmt=()).first()
    assert row.a == long and row.b == "1"


def test_csv_edges(lines):
    cases = [
        'a,"b ""q"" c",d',
        'a,b "q",d',
        'a,"b"x,d',
        "a,b",
        "a,b,c,d",
        " a,-,\r",
        'a,"unclosed,d',
        "",
        '"","x, y",null',
    ]
    parsed = parse_csv(lines(*cases), ["log_level", "other", ""], identity=WHO).orderBy("i")
    rows = [(r.log_level, r.other, r.log_line, r[OK]) for r in parsed.collect()]
    gone = (None, None, None, False)
    assert rows == [
        ("a", 'b "q" c', 'b "q" c d', True), gone, gone, gone, gone,
        (" a", None, "", True), gone, gone, (None, "x, y", "x, y null", True),
    ]


def test_csv_tab_delimiter(lines):
    row = parse_csv(lines("a\tb,c"), ["log_level", "os"], delimiter="\t").first()
    assert (row.log_level, row.os) == ("a", "b,c")


def test_json_edges(lines):
    cases = ["[1]", "null", "3", '{"a":1} x', '{"a":1},{"a":2}', '{"a":', ' {"a": 1e3} ', '{"a":1.50}', '{"a":null}',
             '{"a":{"b":[1]}}', '{"a":"none"}', '{"a":12345678901234567890}', '{"a":true}', "{}"]
    parsed = parse_json(lines(*cases), {"log_level": "a"}, identity=WHO, residual=False).orderBy("i")
    rows = [(r.log_level, r[OK]) for r in parsed.collect()]
    assert rows == [(None, False)] * 6 + [
        ("1000", True), ("1.5", True), (None, True), ('{"b":[1]}', True), (None, True),
        ("12345678901234567890", True), ("true", True), (None, True),
    ]


def test_json_raw_only_strings(lines):
    fmt = [Attribute("a"), Attribute("b"), Attribute("event_datetime"), Attribute("log_line")]
    row = parse_json_raw(lines(' {"a":"none","b":1,"timestamp":"t"} '), fmt).first()
    assert (row.a, row.b, row.event_datetime, row.log_line) == ("none", None, "t", '{"a":"none","b":1,"timestamp":"t"}')


def test_kv(lines):
    prefix = "2020-01-01T00:00:00.000Z"
    cases = [prefix + 'a="1" b="" c="x y" a="2"', "short", prefix]
    parsed = parse_kv(lines(*cases), {"log_level": "a", "os": "b"}, identity=WHO).orderBy("i")
    rows = [(r.log_level, r.os, r.log_line, r[OK]) for r in parsed.collect()]
    assert rows == [("2", None, "c=x y", True), (None, None, None, False), (None, None, "", True)]


def test_pair_map_keeps_last_filled(column):
    regex = r'(\w+)=(?:"([^"]*)"|(\S*))'
    got = column(['a=1 a="" b="" b=" " c=x c=y'], lambda c: pair_map(c, regex))[0]
    assert got == {"a": "1", "b": "", "c": "y"}


def test_variadic(lines):
    line = '2020-01-01T00:00:00.000Zuser_id="7" z="<&>" a="q"'
    row = parse_variadic_kv(lines(line), WHO, clean_keys=True, as_map=True).first()
    assert row.event == '{"a":"q","userId":"7","z":"<&>"}' and row.log_line == line
    assert row.event_pairs == {"a": "q", "userId": "7", "z": "<&>"}
    over = parse_variadic_kv(lines(line), WHO, date_prefix_length=500).first()
    assert over.event == "{}"
    raw = parse_variadic_json(lines("{not json"), WHO).first()
    assert (raw.event, raw[OK]) == ("{not json", True)


def test_variadic_raw_line_limit(lines):
    long = '2020-01-01T00:00:00.000Z a="' + "q" * 17_000_000 + '"'
    both = lines(long, '2020-01-01T00:00:00.000Z a="b"')
    whole = parse_variadic_kv(both, WHO, raw_bytes=None, raw_cut="cut")
    assert whole.select(F.length("log_line"), "cut").orderBy("i").collect() == [(len(long), False), (30, False)]
    cut = parse_variadic_kv(both, WHO, raw_cut="cut")
    assert cut.select(F.length("log_line"), "cut").orderBy("i").collect() == [(16_777_216, True), (30, False)]


def test_user_parser_and_dispatch(lines):
    def shout(frame, spec, fmt, identity):
        def up(batches):
            for pdf in batches:
                yield pd.DataFrame({"i": pdf["i"], "line": pdf["line"], "log_level": pdf["line"].str.upper()})

        return frame.mapInPandas(up, "i int, line string, log_level string").withColumn(OK, F.lit(True))

    register_parser("shout", shout)
    spec = SourceSpec("s", "", "sink", "shout")
    assert parse_lines(lines("abc"), spec).first().log_level == "ABC"
    with pytest.raises(SpecError):
        parse_lines(lines("abc"), SourceSpec("s", "", "sink", "unknown"))
    with pytest.raises(SpecError):
        register_parser("json", shout)
    by_mode = SourceSpec("s", "", "sink", "csv", fields_order=("os", "log_level"), parser_options={"delimiter": ";"})
    assert parse_lines(lines("a;b"), by_mode).first().log_level == "b"


def test_record_types_and_strict_times(spark):
    fmt = (
        Attribute("n", "integer"), Attribute("f", "float32"), Attribute("d", "double"), Attribute("b", "bool"),
        Attribute("t", "timestamp", 0, "2006/01/02", "02.01.2006"), Attribute("s", "string", 2), Attribute("gone"),
    )
    rows = spark.createDataFrame([("7", "0.1", "1e3", "T", "2020/02/03", "äöü"), ("x", "x", "x", "x", "x", "-")],
                                 "n string, f string, d string, b string, t string, s string")
    record = to_record(rows, fmt)
    assert record.dtypes[:4] == [("n", "bigint"), ("f", "float"), ("d", "double"), ("b", "boolean")]
    good, bad = record.collect()
    assert (good.n, round(good.f, 6), good.d, good.b, good.t, good.s) == (7, 0.1, 1000.0, True, "03.02.2020", "äö")
    assert tuple(bad) == (None,) * 7
    assert to_record(rows, fmt, strict=True).collect()[1].t == ""
    assert record.select(encode_csv(fmt)).first()[0] == "7,0.1,1000,true,03.02.2020,äö,\\N"
    with_id = to_record(rows, (Attribute("_uuid"), Attribute("n", "integer"))).collect()
    assert len({r["_uuid"] for r in with_id}) == 2 and with_id[0]["_uuid"][14] == "4"


def test_attribute_may_not_hide_input(lines):
    with pytest.raises(SpecError):
        parse_regex(lines("a"), r"(?P<line>a)", fmt=DEFAULT_FORMAT)
