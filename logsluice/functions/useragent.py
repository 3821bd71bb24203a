"""Browser and operating system from a user agent text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsluice.functions.scalars import regex_get


@dataclass(frozen=True)
class Family:
    """A family is taken when all ``marks`` occur; ``version`` captures its version."""

    name: str
    marks: tuple[str, ...]
    version: str = ""
    underscores: bool = False
    drop_zero: bool = False


# Browser families in order of precedence.
BROWSERS = (
    Family("chrome", ("Chrome",), r"Chrome/([^ ;)]*)"),
    Family("chrome", ("CriOS",), r"CriOS/([^ ;)]*)"),
    Family("firefox", ("Firefox",), r"Firefox/([^ ;)]*)"),
    Family("android", ("Android",), r"Version/([^ ;)]*)"),
    Family("safari", ("Safari",), r"Version/([^ ;)]*)"),
    Family("ie", ("Trident",), r"rv:([^ ;)]*)"),
    Family("ie", ("MSIE",), r"MSIE ([^ ;)]*)"),
    Family("aws-elb", ("ELB-HealthChecker",), r"ELB-HealthChecker/([^ ;)]*)"),
    Family("ios_cna", ("Mozilla", "AppleWebKit")),
)

# Operating systems in order of precedence.
SYSTEMS = (
    Family("windows", ("Win",), r"Windows NT ([^ ;)]*)"),
    Family("ios", ("iPhone OS",), r"iPhone OS ([^ ;)]*)", underscores=True),
    Family("mac", ("Mac OS X",), r"Mac OS X ([^ ;)]*)", underscores=True, drop_zero=True),
    Family("android", ("Android",), r"Android ([^ ;)]*)", underscores=True),
    Family("unix", ("X11",)),
    Family("linux", ("Linux",)),
    Family("aws-elb", ("ELB-HealthChecker",), r"ELB-HealthChecker/([^ ;)]*)"),
)


def _version(ua: Column, family: Family) -> Column:
    if not family.version:
        return F.lit(None).cast("string")
    found = regex_get(ua, family.version)
    if family.underscores:
        found = F.translate(found, "_", ".")
    if family.drop_zero:
        found = F.regexp_replace(found, r"\.0\z", "")
    return found


def _first_match(ua: Column, families: tuple[Family, ...]) -> Column:
    chain = F
    for family in families:
        test = F.contains(ua, F.lit(family.marks[0]))
        for mark in family.marks[1:]:
            test = test & F.contains(ua, F.lit(mark))
        chain = chain.when(test, F.struct(F.lit(family.name).alias("family"), _version(ua, family).alias("version")))
    return chain


def ua_browser(ua: Column) -> Column:
    """struct<family, version> of the browser; NULL when none is known."""
    return _first_match(ua, BROWSERS)


def ua_os(ua: Column) -> Column:
    """struct<family, version> of the operating system; NULL when none is known."""
    return _first_match(ua, SYSTEMS)
