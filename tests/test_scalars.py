import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsluice.functions import scalars as S


def test_null_tokens(column):
    texts = [" ", "null", "none", "-", "empty", "", "Null", "  ", "x", None]
    assert column(texts, S.null_token) == [None] * 6 + ["Null", "  ", "x", None]


def test_regex_get_tells_empty_from_absent(column):
    assert column(["a=1 a=2", "a= b", "b"], lambda c: S.regex_get(c, r"a=(\d*)")) == ["1", "", None]


def test_integer(column):
    texts = ["12", "+12", "-7", " 12", "12 ", "1.0", "", "9223372036854775807", "9223372036854775808", "1_0", "12\n"]
    assert column(texts, S.to_integer) == [12, 12, -7, None, None, None, None, 2**63 - 1, None, None, None]


def test_double(column):
    texts = ["1.5", ".5", "5.", "-1e3", "1E400", "1d", "1.5f", " 1.5", "inf", "-Infinity", "nan", "+nan", "1e", "0x1p2"]
    got = column(texts, S.to_double)
    assert got[:5] == [1.5, 0.5, 5.0, -1000.0, None]
    assert got[5:8] == [None, None, None]
    assert got[8:10] == [math.inf, -math.inf] and math.isnan(got[10])
    assert got[11:] == [None, None, None]


def test_bool(column):
    texts = ["1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False", "yes", "tRUE", ""]
    assert column(texts, S.to_bool) == [True] * 6 + [False] * 6 + [None] * 3


def _plain(x, kind):
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return np.format_float_positional(kind(x), unique=True, trim="-")


@pytest.mark.parametrize("kind, cast", [(np.float64, "double"), (np.float32, "float")])
def test_plain_number(column, kind, cast):
    rng = np.random.default_rng(5)
    values = [0.0, 1.0, -1.0, 0.1, 123456789.0, 1e7, 1.5e10, -2.5e-7, 1e30, math.inf, -math.inf, math.nan, 1234.5678]
    values += list(rng.normal(size=50) * 10.0 ** rng.integers(-20, 20, size=50))
    got = column([repr(float(v)) for v in values], lambda c: S.plain_number(c.cast(cast)))
    for v, g in zip(values, got):
        if math.isfinite(v):
            # The JVM may print a digit more than needed; the value is the same.
            assert "E" not in g and "e" not in g and kind(float(g)) == kind(v)
        else:
            assert g == _plain(v, kind)
    assert got[:4] == ["0", "1", "-1", "0.1"]
    assert cast == "float" or got[4:7] == ["123456789", "10000000", "15000000000"]


def test_fit(column):
    assert column(["abcdef", "äöüß", "a\x00b"], lambda c: S.fit_text(c, 3)) == ["abc", "äöü", "ab"]
    assert column(["abcdef", "äöü", "ab"], lambda c: S.fit_bytes(c, 3)) == ["abc", "ä�", "ab"]


def test_invalid_utf8(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary")
    assert rows.select(S.fit_text(F.col("b").cast("string")).alias("t")).first().t == "a�b"


def test_seconds_to_ms(column):
    assert column(["0.123", "2", "x", "-"], S.seconds_to_ms) == ["123.00", "2000.00", None, None]


def test_hashes_and_keys(column, spark):
    assert column(["line"], S.line_hash) == [hashlib.md5(b"line").hexdigest()]
    row = spark.range(1).select(S.object_key(F.lit(""), F.lit("a"), F.lit(""), F.lit("b")).alias("k"))
    assert row.first().k == "a/b"


def test_lower_camel(column):
    texts = ["user_id", "User-Name", "order.total sum", "already", "a__b", "HTTP_code"]
    assert column(texts, S.lower_camel) == ["userId", "userName", "orderTotalSum", "already", "aB", "hTTPCode"]
