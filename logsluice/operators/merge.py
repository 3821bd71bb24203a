"""Merging hosts, views of one source, catalogue of sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.operators.flow import number_lines
from logsluice.operators.records import union_all
from logsluice.sources.text import normal_path
from logsluice.spec import LineKey, SourceSpec


def merge_hosts(hosts: Mapping[str, DataFrame]) -> DataFrame:
    """Lines of several hosts with a ``host`` column."""
    return union_all([df.withColumn("host", F.lit(name)) for name, df in hosts.items()])


def number_merged(merged: DataFrame, key: LineKey = LineKey(), host: str = "host") -> DataFrame:
    """Running ``line_id`` over all hosts: hosts take turns slice by slice, each in its own order."""
    return number_lines(merged, [key.block, host, key.source], [key.pos])


def tail_view(rows: DataFrame, source: str, column: str = "file") -> DataFrame:
    """Lines or records of one source."""
    return rows.filter(F.col(column) == source)


def is_glob(path: str) -> bool:
    return any(c in path for c in "*?[{")


def glob_regex(path: str) -> str:
    """Regex of a path with ``*``, ``?``, ``[...]`` and ``{a,b}``, which all stay inside of a folder."""
    out, braces, i = [], 0, 0
    while i < len(path):
        c = path[i]
        if c == "[" and "]" in path[i + 2 :]:
            end = path.index("]", i + 2)
            body = path[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c in ",}" and braces:
            braces -= c == "}"
            out.append("|" if c == "," else ")")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.sub(r"\W", lambda m: "\\" + m.group(), c))
        i += 1
    return r"\A" + "".join(out) + r"\z"


def list_sources(spark: SparkSession, specs: Sequence[SourceSpec], lines: DataFrame, column: str = "file") -> DataFrame:
    """Configured sources with the files found for each: name, path, stream, parse_mode, file, lines.

    A file belongs to the sources that declare it or a folder above it, by their path or a glob. A
    file looks its folders up among the declared paths; only globs are compared one by one.
    """
    declared = spark.createDataFrame(
        [(s.name, s.path, s.sink, s.parse_mode) for s in specs],
        "name string, path string, stream string, parse_mode string",
    )
    found = lines.groupBy(column).agg(F.count(F.lit(1)).alias("lines"))
    # "/a/b/c" -> "/a", "/a/b", "/a/b/c"; a scheme and its host stay together.
    names = F.split(F.col(column), "(?<![:/])/(?!/)")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    files = found.select(F.col(column).alias("file"), "lines", F.array_distinct(above).alias("_above"))
    plain = spark.createDataFrame([(s.name, normal_path(s.path)) for s in specs if not is_glob(s.path)], "name string, _above string")
    owned = files.withColumn("_above", F.explode("_above")).join(F.broadcast(plain), "_above").select("name", "file", "lines")
    for spec in specs:
        if is_glob(spec.path):
            regex = F.lit(glob_regex(normal_path(spec.path)))
            matched = files.filter(F.exists("_above", lambda p: F.rlike(p, regex)))
            owned = owned.unionByName(matched.select(F.lit(spec.name).alias("name"), "file", "lines"))
    return declared.join(owned, "name", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
