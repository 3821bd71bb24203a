import datetime as dt

import pytest
from pyspark.sql import functions as F

from logsluice.functions.layouts import ISO_8601, iso_ts, parse_ts, reformat_ts
from logsluice.spec import DEFAULT_FORMAT, Attribute, SpecError, check_layout, format_ddl, record_schema, validate_format

RUBY = "Mon Jan 02 15:04:05 -0700 2006"


@pytest.mark.parametrize(
    "source, destination, given, expected",
    [
        ("2006-01-02 15:04", ISO_8601, "2023-08-31 23:59", "2023-08-31T23:59:00Z"),
        ("02 Jan 2006 15:04", "2006-01-02", "29 Feb 2024 00:10", "2024-02-29"),
        ("2006.01.02", "Jan _2", "1999.12.07", "Dec  7"),
        ("2006.01.02", "Jan _2", "1999.12.17", "Dec 17"),
        ("", "", "any text", "any text"),
        ("2006.01.02", ISO_8601, "1999-12-07", None),
        ("2006.01.02", ISO_8601, "", None),
        (RUBY, ISO_8601, "Sat Dec 31 9:30:00 -0930 1994", "1994-12-31T09:30:00Z"),
        (RUBY, RUBY, "Sat Dec 31 09:30:00 +0545 1994", "Sat Dec 31 09:30:00 +0545 1994"),
        ("2006-01-02T15:04:05Z07:00", "2006-01-02T15:04:05Z07:00", "2031-01-09T18:30:59-03:30", "2031-01-09T18:30:59-03:30"),
        ("2006-01-02T15:04:05Z07:00", "02/Jan/2006:15:04:05 -0700", "2031-01-09T18:30:59Z", "09/Jan/2031:18:30:59 +0000"),
        ("January 2, 2006 3:04PM", "2006-01-02 15:04:05.000", "July 14, 2009 12:45AM", "2009-07-14 00:45:00.000"),
        ("02.01.06 15:04", "2006-01-02", "11.10.69 20:20", "1969-10-11"),
        ("15:04:05.999 2006", "15:04:05.999 2006", "21:22:23.4500 1988", "21:22:23.45 1988"),
    ],
)
def test_reformat(column, source, destination, given, expected):
    assert column([given], lambda c: reformat_ts(c, source, destination)) == [expected]


@pytest.mark.parametrize(
    "layout, given, expected",
    [
        ("02/Jan/2006:15:04:05 +0000", "30/Nov/2022:00:00:59 +0000", "2022-11-30 00:00:59"),
        ("02/Jan/2006:15:04:05 +0000", "30/nov/2022:00:00:59 +0000", "2022-11-30 00:00:59"),
        ("02/Jan/2006:15:04:05 +0000", "3/Nov/2022:00:00:59 +0000", None),
        ("02/Jan/2006:15:04:05 +0000", "30/Nov/2022:00:00:59 -0800", None),
        ("2006-01-02T15:04:05.000Z", "2022-11-30T10:20:30.007Z", "2022-11-30 10:20:30.007"),
        ("2006-01-02T15:04:05.000Z", "2022-11-30T10:20:30.07Z", None),
        ("2006-01-02T15:04:05Z", "2022-11-30T10:20:30.7654321Z", "2022-11-30 10:20:30.765432"),
        ("2006-01-02", "2023-02-29", None),
        ("2006-01-02 15:04:05", "2022-11-30 24:00:00", None),
        ("2006-01-02 15:04:05", " 2022-11-30 10:20:30", None),
        ("2006-01-02 15:04:05", "2022-11-30  10:20:30", "2022-11-30 10:20:30"),
        (RUBY, "Sat Dec 31 9:30:00 -0930 1994", "1994-12-31 19:00:00"),
        ("2006-01-02 15:04:05 MST", "2022-11-30 10:20:30 CET", "2022-11-30 10:20:30"),
        ("epochmillisecs", "1669803630007", "2022-11-30 10:20:30.007"),
        ("epochmillisecs", "16a", None),
        ("epochmillisecs", "99999999999999", "5138-11-16 09:46:39.999"),
        ("epochmillisecs", "100000000000000", "5138-11-16 09:46:40"),
        ("epochmillisecs", "99999999999999999", None),
    ],
)
def test_parse_to_utc(column, layout, given, expected):
    got = column([given], lambda c: parse_ts(c, layout).cast("string"))
    assert got == [expected]


def test_iso_trims_zeros(column):
    texts = ["2020-01-01 00:00:21", "2020-01-01 00:00:30.1", "2020-01-01 00:00:30.120999", "1960-01-01 00:00:00.001"]
    assert column(texts, lambda c: iso_ts(c.cast("timestamp"))) == [
        "2020-01-01T00:00:21Z", "2020-01-01T00:00:30.1Z", "2020-01-01T00:00:30.12Z", "1960-01-01T00:00:00.001Z",
    ]


@pytest.mark.parametrize(
    "source, destination, valid",
    [
        ("", "", True),
        ("02 Jan 2006 15:04:05", ISO_8601, True),
        ("02 Jan 2006 15:04", ISO_8601, False),
        (ISO_8601, "Jan _2 2006", True),
        (ISO_8601, "", False),
        ("", "2006.01.02", False),
        ("dd.MM.yyyy", ISO_8601, False),
    ],
)
def test_format_check(source, destination, valid):
    # Every timestamp attribute is checked, not only the first.
    fmt = [Attribute("first", "timestamp"), Attribute("second", "timestamp", 0, source, destination)]
    if valid:
        validate_format(fmt)
    else:
        with pytest.raises(SpecError):
            validate_format(fmt)


def test_other_spec_errors():
    with pytest.raises(SpecError):
        validate_format([Attribute("a", "decimal")])
    with pytest.raises(SpecError):
        validate_format([Attribute("a"), Attribute("a")])
    assert check_layout("January _2, 2006 3:04:05 PM")
    validate_format(DEFAULT_FORMAT)


def test_schema_and_ddl():
    schema = record_schema([*DEFAULT_FORMAT, Attribute("_uuid"), Attribute("ok", "bool"), Attribute("f", "float32")])
    assert schema["app"].metadata["length"] == 16
    assert schema["response_bytes"].dataType.simpleString() == "bigint"
    assert schema["f"].dataType.simpleString() == "float"
    ddl = format_ddl(DEFAULT_FORMAT, "app_log")
    assert ddl.startswith("CREATE TABLE app_log (\n    app VARCHAR(16),")
    assert "response_ms DOUBLE PRECISION," in ddl and ddl.endswith("log_line VARCHAR(MAX)\n)")


def test_layout_survives_python_round_trip(spark):
    when = dt.datetime(2021, 7, 9, 13, 5, 6)
    from logsluice.functions.layouts import Layout

    for text in ("2006-01-02T15:04:05Z07:00", "Monday, 02-Jan-06 15:04:05 MST", "Jan _2 2006 3:04:05.000 pm"):
        layout = Layout(text)
        assert layout.read(layout.write(when)) == when
        shown = spark.range(1).select(layout.to_text(F.lit(when)).alias("t")).first().t
        assert shown == layout.write(when)
