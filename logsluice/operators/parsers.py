"""Line parsers: lines -> attribute columns.

Every parser keeps the columns of its input, adds one text column per attribute
of the record format (plus the attributes found on the line) and a boolean
``parse_ok``. Nothing here shuffles: a parser is one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.layouts import iso_ts
from logsluice.functions.regexes import CAPTURE, PLAIN, RegexError, compile_regex, to_java
from logsluice.functions.scalars import (
    drop_empty_pairs,
    drop_space_runs,
    fit_bytes,
    lower_camel,
    null_token,
    trim_white,
)
from logsluice.spec import DEFAULT_FORMAT, Identity, RecordFormat, SpecError

OK = "parse_ok"
# Limits and the default pair pattern of the key=value formats.
DATE_PREFIX = 24
MAX_RAW_BYTES = 16_777_216
PAIR_REGEX = r'([^=]*)="([^"]*)"\s?'


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of computing it again.

    A filter on a plain projected column is pushed below the projection together with the
    expression, which would then run twice for every line. It is not pushed through ``stack``.
    """
    return df.select("*", F.stack(F.lit(1), value).alias(name))


def default_values(fmt: RecordFormat, identity: Identity, event_time: bool = True) -> dict[str, Column]:
    """Attribute values every record starts from."""
    values: dict[str, Column] = {a.key: F.lit(None).cast("string") for a in fmt}
    ingest = iso_ts(identity.ingest_time())
    for name in ("app", "app_ver", "filename", "hostname"):
        values[name] = identity.text(name)
    values["ingest_datetime"] = ingest
    if event_time:
        values["event_datetime"] = ingest
    return values


def with_defaults(
    lines: DataFrame, fmt: RecordFormat = DEFAULT_FORMAT, identity: Identity = Identity(), event_time: bool = True
) -> DataFrame:
    """Add the default attributes to lines."""
    return attach(lines, default_values(fmt, identity, event_time))


def attach(df: DataFrame, values: Mapping[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """Input columns followed by attribute columns; an attribute may not hide an input column."""
    kept = [c for c in df.columns if c not in drop]
    clash = sorted(set(kept) & set(values))
    if clash:
        raise SpecError(f"attributes {clash} have the names of input columns")
    return df.select(*kept, *(v.alias(k) for k, v in values.items()))


# -- regex ------------------------------------------------------------------------


def regex_residual_of(parts: Column, kinds: Sequence[str]) -> Column:
    """Line text outside the captures, tidied, from the parts of a cut line.

    Captures inside of others are blanked with them.
    """
    blanked = [F.get(parts, F.lit(0))]
    for i, kind in enumerate(kinds, 1):
        part = F.get(parts, F.lit(i))
        if kind == PLAIN:
            blanked.append(part)
        elif kind == CAPTURE:
            # Blanks stand for bytes; runs of two or more vanish later.
            blanked.append(F.repeat(F.lit(" "), F.octet_length(part)))
    blanked.append(F.get(parts, F.lit(len(kinds) + 1)))
    return trim_white(drop_empty_pairs(drop_space_runs(F.concat(*blanked))))


def parse_regex(
    lines: DataFrame,
    pattern: str,
    fmt: RecordFormat = DEFAULT_FORMAT,
    identity: Identity = Identity(),
    line: str = "line",
    residual: bool = True,
) -> DataFrame:
    """Named groups of the leftmost match become attributes; ``log_line`` is what is left of the line.

    The regex runs once per line. Without a match, or without any group, the line is a reject.
    """
    regex = compile_regex(pattern)
    values = default_values(fmt, identity)
    groups = len(regex.names)
    if groups == 0:
        return attach(lines, {**values, OK: F.lit(False)})
    text = F.col(line)
    cut = compute_once(lines, "_cut", regex.parts(text) if residual else regex.captures(text))
    parts = F.col("_cut")
    ok = F.size(parts) > 1
    for i, name in enumerate(regex.names):
        at = regex.places[i] if residual else i + 1
        values[name] = null_token(F.get(parts, F.lit(at)))  # NULL beyond the one part of a reject
    if residual:
        values["log_line"] = F.when(ok, regex_residual_of(parts, regex.kinds))
    values.pop("", None)
    return attach(cut, {**values, OK: F.coalesce(ok, F.lit(False))}, drop=["_cut"])


# -- JSON -------------------------------------------------------------------------


def with_object(lines: DataFrame, line: str) -> DataFrame:
    """Add ``_object``, the top-level JSON object as map<string,variant>; NULL for anything else.

    The text is read as the only element of an array, so that text after the object is an error.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit("]")))
    read = compute_once(lines, "_array", F.try_variant_get(whole, "$", "array<variant>"))
    only = F.when(F.size("_array") == 1, F.try_variant_get(F.col("_array")[0], "$", "map<string,variant>"))
    return compute_once(read, "_object", only).drop("_array")


def variant_text(value: Column, text: Column) -> Column:
    """Attribute text of a JSON value, given the value and its string cast.

    null and null tokens are NULL, numbers have no exponent or ".0".
    """
    number = F.when(
        F.contains(text, F.lit("E")),
        F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", ""),
    ).otherwise(F.regexp_replace(text, r"\.0$", ""))
    # Only texts that might be such a number are asked for their type.
    maybe = F.endswith(text, F.lit(".0")) | F.contains(text, F.lit("E"))
    kind = F.schema_of_variant(value)
    is_number = kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(F.when(maybe, is_number).otherwise(F.lit(False)), number).otherwise(null_token(text))


def parse_json(
    lines: DataFrame,
    mappings: Mapping[str, str],
    fmt: RecordFormat = DEFAULT_FORMAT,
    identity: Identity = Identity(),
    line: str = "line",
    residual: bool = True,
) -> DataFrame:
    """``mappings`` says which JSON key feeds which attribute; the other keys stay as JSON in ``log_line``."""
    cut = with_object(lines, line)
    obj = F.col("_object")
    # Values and their texts are columns of their own, so that each is computed once.
    places = {source: i for i, source in enumerate(dict.fromkeys(mappings.values()))}
    cut = cut.withColumns({f"_v{i}": F.try_element_at(obj, F.lit(source)) for source, i in places.items()})
    cut = cut.withColumns({f"_t{i}": F.col(f"_v{i}").cast("string") for i in places.values()})
    values = default_values(fmt, identity)
    for target, source in mappings.items():
        value, text = F.col(f"_v{places[source]}"), F.col(f"_t{places[source]}")
        found = variant_text(value, text)
        # A JSON null is a value here, an absent key is not.
        values[target] = F.when(value.isNotNull(), found).otherwise(values[target]) if target in values else found
    if residual:
        values["log_line"] = json_residual(obj, mappings)
    helpers = [f"_{kind}{i}" for i in places.values() for kind in "vt"]
    return attach(cut, {**values, OK: obj.isNotNull()}, drop=["_object", *helpers])


def json_residual(obj: Column, mappings: Mapping[str, str]) -> Column:
    """JSON text of the keys no attribute took, in key order."""
    used = list(dict.fromkeys(mappings.values()))
    rest = F.map_filter(obj, lambda k, _: ~k.isin(*used)) if used else obj
    return F.to_json(rest, {"ignoreNullFields": "false"})


def parse_json_raw(lines: DataFrame, fmt: RecordFormat = DEFAULT_FORMAT, line: str = "line") -> DataFrame:
    """Top-level string values become attributes, without defaults; ``log_line`` is the whole line."""
    cut = with_object(lines, line)

    def string_value(key: str) -> Column:
        value = F.try_element_at(F.col("_object"), F.lit(key))
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

    values = {a.key: string_value(a.key) for a in fmt}
    values["event_datetime"] = string_value("timestamp")
    values["log_line"] = trim_white(F.col(line))
    return attach(cut, {**values, OK: F.col("_object").isNotNull()}, drop=["_object"])


def parse_variadic_json(
    lines: DataFrame, identity: Identity = Identity(), line: str = "line", as_variant: bool = False
) -> DataFrame:
    """The whole line goes to ``event``; no line is a reject. ``as_variant`` parses it as well."""
    values = default_values((), identity, event_time=False)
    values |= {"event": F.col(line), "meta": F.lit(""), "log_line": F.lit("")}
    if as_variant:
        values["event_value"] = F.try_parse_json(F.col(line))
    return attach(lines, {**values, OK: F.lit(True)})


# -- CSV --------------------------------------------------------------------------


def _well_formed(text: Column, delimiter: str) -> Column:
    """Every field is quoted from end to end with doubled quotes inside, or has no quote at all."""
    d = "\\" + delimiter if not delimiter.isalnum() else delimiter
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}]*+)'
    return text.rlike(rf"\A{field}(?:{d}{field})*+\z")


def parse_csv(
    lines: DataFrame,
    fields_order: Sequence[str],
    fmt: RecordFormat = DEFAULT_FORMAT,
    identity: Identity = Identity(),
    line: str = "line",
    delimiter: str = ",",
    residual: bool = True,
) -> DataFrame:
    """Positional fields; "" in ``fields_order`` leaves a field unnamed.

    A wrong number of fields or a stray quote makes a reject. Unnamed fields, and fields that are
    not in the record format, are joined to ``log_line``.
    """
    n = len(fields_order)
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    schema = ", ".join(f"f{i} string" for i in range(n)) + ", _bad string"
    options = {
        "sep": delimiter, "escape": '"', "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE",
        "maxCharsPerColumn": "-1", "nullValue": "\x00", "emptyValue": "",
    }
    usable = (text != "") & _well_formed(text, delimiter)
    cut = compute_once(lines, "_fields", F.when(usable, F.from_csv(text, F.lit(schema), options)))
    fields = F.col("_fields")
    ok = fields.isNotNull() & fields["_bad"].isNull()
    values = default_values(fmt, identity)
    known = set(values)
    left: list[Column] = []
    for i, name in enumerate(fields_order):
        value = F.coalesce(fields[f"f{i}"], F.lit(""))
        if name == "" or name not in known:
            left += [value, F.lit(" ")]
        if name:
            known.add(name)
            values[name] = F.when(ok, null_token(value))
    if residual:
        values["log_line"] = F.when(ok, csv_residual(left))
    return attach(cut, {**values, OK: ok}, drop=["_fields"])


def csv_residual(pieces: Sequence[Column]) -> Column:
    """Leftover fields as text. Pairs go before space runs here, the other way round than for regexes."""
    joined = F.concat(*pieces) if pieces else F.lit("")
    return trim_white(drop_space_runs(drop_empty_pairs(joined)))


# -- key=value --------------------------------------------------------------------


def pair_map(text: Column, pattern: str = "", clean_keys: bool = False) -> Column:
    """All pairs of a text as map<string,string>; the last value of a key stays.

    Group 1 is the key. With one more group that is the value, even if empty; with several the
    last one that is not blank, and a pair of blanks only fills a key that has no other value.
    """
    regex = to_java(pattern or PAIR_REGEX)
    groups = len(compile_regex(pattern or PAIR_REGEX).names)
    if groups == 0:
        raise RegexError("a key=value regex needs a group for the key")
    found = [F.regexp_extract_all(text, F.lit(regex), F.lit(g)) for g in range(1, groups + 1)]
    keys = F.transform(found[0], lower_camel) if clean_keys else found[0]
    if groups == 2:
        return F.map_from_arrays(keys, found[1])

    def value(pair: Column) -> Column:
        taken = [F.when(~pair[f"g{g}"].isin("", " "), pair[f"g{g}"]) for g in range(groups, 1, -1)]
        return F.coalesce(*taken) if taken else F.lit(None).cast("string")

    zipped = F.arrays_zip(keys.alias("k"), *(f.alias(f"g{g + 2}") for g, f in enumerate(found[1:])))
    pairs = F.transform(zipped, lambda p: F.struct(p["k"].alias("k"), value(p).alias("v")))
    blank = F.transform(
        F.filter(pairs, lambda p: p["v"].isNull()), lambda p: F.struct(p["k"].alias("k"), F.lit("").alias("v"))
    )
    filled = F.filter(pairs, lambda p: p["v"].isNotNull())
    return F.map_from_entries(F.concat(blank, filled))


def sorted_json(pairs: Column) -> Column:
    """JSON object of a map in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def parse_kv(
    lines: DataFrame,
    mappings: Mapping[str, str],
    fmt: RecordFormat = DEFAULT_FORMAT,
    identity: Identity = Identity(),
    line: str = "line",
    kv_regex: str = "",
    log_line_format: str = "kv",
) -> DataFrame:
    """Key=value pairs after a 24 byte date prefix. Pairs no attribute took stay in ``log_line``."""
    text = F.col(line)
    ok = F.octet_length(text) >= DATE_PREFIX
    cut = compute_once(
        lines, "_pairs", F.when(ok, pair_map(text.substr(F.lit(DATE_PREFIX + 1), F.length(text)), kv_regex))
    )
    pairs = F.col("_pairs")
    values = default_values(fmt, identity, event_time=False)
    for target, source in mappings.items():
        found = null_token(F.try_element_at(pairs, F.lit(source)))
        if target in values:
            found = F.when(F.map_contains_key(pairs, F.lit(source)), found).otherwise(values[target])
        values[target] = found
    values["log_line"] = kv_residual(pairs, mappings, log_line_format)
    return attach(cut, {**values, OK: pairs.isNotNull()}, drop=["_pairs"])


def kv_residual(pairs: Column, mappings: Mapping[str, str], log_line_format: str = "kv") -> Column:
    """Remaining pairs in key order, as "k=v k=v" or as JSON."""
    used = list(dict.fromkeys(mappings.values()))
    rest = F.map_filter(pairs, lambda k, _: ~k.isin(*used)) if used else pairs
    if log_line_format == "json":
        return sorted_json(rest)
    entries = F.array_sort(F.map_entries(rest))
    return trim_white(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "))


def parse_variadic_kv(
    lines: DataFrame,
    identity: Identity = Identity(),
    line: str = "line",
    kv_regex: str = "",
    date_prefix_length: int = DATE_PREFIX,
    clean_keys: bool = False,
    as_map: bool = False,
    raw_bytes: int | None = MAX_RAW_BYTES,
    raw_cut: str = "",
) -> DataFrame:
    """All pairs as JSON in ``event``, the raw line in ``log_line``: its first ``raw_bytes``, or all if None.

    ``raw_cut`` names a boolean column that marks the lines with a cut ``log_line``, to count them.
    ``as_map`` adds the pairs as a map column ``event_pairs``.
    """
    text = F.col(line)
    ok = F.octet_length(text) >= DATE_PREFIX
    pairs = pair_map(text.substr(F.lit(date_prefix_length + 1), F.length(text)), kv_regex, clean_keys)
    cut = compute_once(lines, "_pairs", F.when(ok, pairs))
    values = default_values((), identity, event_time=False)
    values |= {
        "event": sorted_json(F.col("_pairs")),
        "meta": F.lit(""),
        "log_line": F.when(ok, text if raw_bytes is None else fit_bytes(text, raw_bytes)),
    }
    if raw_cut:
        values[raw_cut] = F.lit(False) if raw_bytes is None else F.coalesce(ok & (F.octet_length(text) > raw_bytes), F.lit(False))
    if as_map:
        values["event_pairs"] = F.col("_pairs")
    return attach(cut, {**values, OK: F.col("_pairs").isNotNull()}, drop=["_pairs"])


# -- choice -----------------------------------------------------------------------

ParserFn = Callable[..., DataFrame]
_REGISTERED: dict[str, ParserFn] = {}
BUILT_IN = ("regex", "json", "csv", "json_raw", "date_keyvalue", "variadic_kv", "variadic_json")


def register_parser(name: str, parser: ParserFn) -> None:
    """Make a user function a parse mode.

    It is called as ``parser(lines, spec, fmt, identity)`` and returns the lines with attribute
    columns and ``parse_ok``; any DataFrame operation, UDF, pandas UDF or mapInPandas may be used.
    """
    if name in BUILT_IN:
        raise SpecError(f"{name} is a built-in parse mode")
    _REGISTERED[name] = parser


def parse_lines(lines: DataFrame, spec, fmt: RecordFormat = DEFAULT_FORMAT, identity: Identity = Identity()):
    """Parse lines as their source declares."""
    options = dict(spec.parser_options)
    mode = spec.parse_mode
    if mode == "regex":
        return parse_regex(lines, spec.line_regex, fmt, identity, **options)
    if mode == "json":
        return parse_json(lines, spec.field_mappings, fmt, identity, **options)
    if mode == "csv":
        return parse_csv(lines, spec.fields_order, fmt, identity, **options)
    if mode == "json_raw":
        return parse_json_raw(lines, fmt, **options)
    if mode == "date_keyvalue":
        return parse_kv(lines, spec.field_mappings, fmt, identity, kv_regex=spec.kv_regex, **options)
    if mode == "variadic_kv":
        return parse_variadic_kv(lines, identity, kv_regex=spec.kv_regex, **options)
    if mode == "variadic_json":
        return parse_variadic_json(lines, identity, **options)
    if mode in _REGISTERED:
        return _REGISTERED[mode](lines, spec, fmt, identity)
    raise SpecError(f"parse mode {mode!r} is not known")
