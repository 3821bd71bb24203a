"""Text, number and hash functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value".
NULL_TOKENS = (" ", "null", "none", "-", "empty", "")
# Accepted spellings of booleans.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")
# The null mark of the CSV output, and what is cleaned out of a residual line.
NULL_MARK = "\\N"
EMPTY_PAIRS = r'\[\]|\(\)|- |""|\(ms\)|\\N'
SPACE_RUNS = r" {2,}"
# White space removed at both ends of a residual.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"
_ENDLESS = r"^(?i:[+-]?inf(?:inity)?|nan)\z"


def null_token(text: Column) -> Column:
    """NULL for the texts that stand for no value; exact match, no trimming."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def regex_get(text: Column, pattern: str) -> Column:
    """First group of the first match; NULL without a match, "" when the group is empty."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def trim_white(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def drop_space_runs(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUNS, "")


def drop_empty_pairs(text: Column) -> Column:
    return F.regexp_replace(text, EMPTY_PAIRS, "")


def seconds_to_ms(seconds: Column) -> Column:
    """Milliseconds with two decimals as text; NULL unless the input is a number."""
    millis = to_double(seconds) * 1000
    return F.when(millis.isNotNull(), F.format_string("%.2f", millis))


def fit_text(text: Column, length: int = 0) -> Column:
    """Valid UTF-8 without NUL characters, at most ``length`` characters when length > 0."""
    whole = F.make_valid_utf8(text)
    if length > 0:
        whole = F.substring(whole, 1, length)
    return F.when(F.contains(text, F.lit("\x00")), F.translate(whole, "\x00", "")).otherwise(whole)


def fit_bytes(text: Column, size: int) -> Column:
    """First ``size`` bytes of the text, as text; a character cut in half becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, size).cast("string"))
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)


def to_integer(text: Column) -> Column:
    """64-bit integer from optional sign and digits; anything else is NULL."""
    return F.when(text.rlike(r"^[+-]?\d+\z"), text.try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Double from decimal text, inf or nan; out of range is NULL."""
    finite = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    finite = F.when(F.abs(finite) != float("inf"), finite)
    return F.coalesce(finite, F.when(text.rlike(_ENDLESS), text.try_cast("double")))


def to_float(text: Column) -> Column:
    """Single precision number, rounded from the double."""
    return to_double(text).cast("float")


def to_bool(text: Column) -> Column:
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def plain_number(number: Column) -> Column:
    """Decimal text of a float or double that reads back the same, never with an exponent.

    It is the shortest one where the JVM prints the shortest digits (Java 19 and later).
    """
    text = number.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    power = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    whole = F.ltrim(F.substring_index(mantissa, ".", 1), F.lit("-"))
    decimals = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, decimals)
    size = F.length(digits)
    large = F.when(
        size - 1 > power,
        F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, size)),
    ).otherwise(F.rpad(digits, power + 1, F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return (
        F.when(F.isnan(number), "NaN")
        .when(number == float("inf"), "+Inf")
        .when(number == float("-inf"), "-Inf")
        .when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", ""))
        .otherwise(F.concat(sign, F.when(power >= 0, large).otherwise(small)))
    )


def line_hash(line: Column) -> Column:
    """Hex MD5 of the raw line."""
    return F.md5(line.cast("binary"))


def content_hash(data: Column) -> Column:
    """Hex MD5 of a buffer."""
    return F.md5(data.cast("binary"))


def object_key(*parts: Column) -> Column:
    """Path of the non-empty parts joined with "/"."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def lower_camel(key: Column) -> Column:
    """Key in lowerCamel: words end at ``_``, space, ``.`` or ``-``."""
    words = F.filter(F.split(key, r"[_ .\-]+"), lambda w: w != "")

    def first(word: Column, turn) -> Column:
        return F.concat(turn(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))

    return F.array_join(
        F.transform(words, lambda w, i: F.when(i == 0, first(w, F.lower)).otherwise(first(w, F.upper))), ""
    )
