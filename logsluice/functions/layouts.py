"""Reference-date time layouts compiled to Spark expressions.

A layout shows how the moment Mon Jan 2 15:04:05 2006 -0700 would be written.
Reading works on one regular expression: it accepts exactly the texts the layout
allows and rewrites them to the ISO order that Spark casts directly, so no
per-row formatter is built. Writing joins ``date_format`` pieces.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout names and printed forms.
ISO_8601 = "2006-01-02T15:04:05.999Z"
EPOCH_MILLIS = "epochmillisecs"

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_TOKEN = re.compile(
    r"January|Jan(?![a-z])|Monday|Mon(?![a-z])|MST"
    r"|Z07:00|Z0700|-07:00|-0700|-07"
    r"|2006|_2(?!006)|0[1-6]|15|[.,](?:0+|9+)(?!\d)|PM|pm|[1-5]"
)

# token: field it sets, text it accepts (one group), date_format letters it prints
_FIELDS = {
    "2006": ("year", r"(\d{4})", "yyyy"),
    "06": ("yy", r"(\d{2})", "yy"),
    "01": ("month", r"(\d{2})", "MM"),
    "1": ("month", r"(\d{1,2})", "M"),
    "Jan": ("name", r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))", "MMM"),
    "January": (
        "name",
        r"(?i:(jan(?=uary)|feb(?=ruary)|mar(?=ch)|apr(?=il)|may|jun(?=e)|jul(?=y)|aug(?=ust)"
        r"|sep(?=tember)|oct(?=ober)|nov(?=ember)|dec(?=ember))"
        r"(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember|))",
        "MMMM",
    ),
    "Mon": ("", r"(?i:mon|tue|wed|thu|fri|sat|sun)", "EEE"),
    "Monday": ("", r"(?i:mon|tues|wednes|thurs|fri|satur|sun)(?i:day)", "EEEE"),
    "02": ("day", r"(\d{2})", "dd"),
    "_2": ("day", r" ?(\d{1,2})", "d"),
    "2": ("day", r"(\d{1,2})", "d"),
    "15": ("hour", r"(\d{1,2})", "HH"),
    "03": ("hour", r"(\d{2})", "hh"),
    "3": ("hour", r"(\d{1,2})", "h"),
    "04": ("minute", r"(\d{2})", "mm"),
    "4": ("minute", r"(\d{1,2})", "m"),
    "05": ("second", r"(\d{2})", "ss"),
    "5": ("second", r"(\d{1,2})", "s"),
    "PM": ("half", r"(AM|PM)", "a"),
    "pm": ("half", r"(am|pm)", "a"),
    "-0700": ("zone", r"([+-]\d{4})", ""),
    "-07:00": ("zone", r"([+-]\d{2}:\d{2})", ""),
    "-07": ("zone", r"([+-]\d{2})", ""),
    "Z0700": ("zone", r"(Z|[+-]\d{4})", ""),
    "Z07:00": ("zone", r"(Z|[+-]\d{2}:\d{2})", ""),
    "MST": ("", r"[A-Z]{3,5}", ""),
}

# Up to six digits are kept, further ones are read over.
_OPEN_FRACTION = r"((?:\.\d{1,6})?)(?:(?<=\.\d{6})\d+)?"
_DEFAULT = {"year": "0000", "month": "01", "day": "01", "hour": "0", "minute": "0", "second": "0"}


def _literal(text: str) -> str:
    """Regex for layout text between tokens: a run of blanks stands for one or more blanks."""
    pieces = re.split(r"( +)", text)
    return "".join(" +" if p.startswith(" ") else re.escape(p) for p in pieces if p)


class Layout:
    """One compiled time layout."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[str] = []
        self.pieces: list[tuple[bool, str]] = []  # (is token, text)
        last = 0
        for m in _TOKEN.finditer(text):
            if m.start() > last:
                self.pieces.append((False, text[last : m.start()]))
            self.pieces.append((True, m.group()))
            self.tokens.append(m.group())
            last = m.end()
        if last < len(text):
            self.pieces.append((False, text[last:]))
        self.groups: dict[str, int] = {}
        self.comma = ""  # put before a fraction that the layout sets off by a comma
        self.regex = self._build_regex()

    @property
    def can_parse(self) -> bool:
        return "year" in self.groups or "yy" in self.groups

    def _build_regex(self) -> str:
        out, count = [], 0
        for i, (is_token, piece) in enumerate(self.pieces):
            if not is_token:
                out.append(_literal(piece))
                continue
            if piece[0] in ".,":
                dot, digits = piece[0] == ".", len(piece) - 1
                if piece[1] == "9":  # optional, any number of digits
                    out.append(_OPEN_FRACTION if dot else r"(?:,(\d{1,6})\d*)?")
                else:
                    kept, more = min(digits, 6), max(digits - 6, 0)
                    tail = rf"\d{{{more}}}" if more else ""
                    out.append((rf"(\.\d{{{kept}}})" if dot else rf",(\d{{{kept}}})") + tail)
                if not dot:
                    self.comma = "."
                name = "fraction"
            else:
                name, accepts, _ = _FIELDS[piece]
                out.append(accepts)
            if name:
                count += 1
                self.groups[name] = count
            if name == "second" and not any(t and p[0] in ".," for t, p in self.pieces[i + 1 :]):
                # A fraction may follow the seconds even where the layout shows none.
                out.append(_OPEN_FRACTION)
                count += 1
                self.groups["fraction"] = count
        return "".join(out)

    # -- Python side, for checking declarations ---------------------------------

    def write(self, when: datetime) -> str:
        """Print a Python time (UTC)."""
        name = MONTHS.split()[when.month - 1].capitalize()
        day = ["Mon", "Tues", "Wednes", "Thurs", "Fri", "Satur", "Sun"][when.weekday()]
        half = "PM" if when.hour >= 12 else "AM"
        shown = {
            "2006": f"{when.year:04d}", "06": f"{when.year % 100:02d}",
            "01": f"{when.month:02d}", "1": str(when.month),
            "Jan": name, "January": when.strftime("%B"), "Mon": day[:3], "Monday": day + "day",
            "02": f"{when.day:02d}", "_2": f"{when.day:2d}", "2": str(when.day),
            "15": f"{when.hour:02d}", "03": f"{(when.hour + 11) % 12 + 1:02d}", "3": str((when.hour + 11) % 12 + 1),
            "04": f"{when.minute:02d}", "4": str(when.minute), "05": f"{when.second:02d}", "5": str(when.second),
            "PM": half, "pm": half.lower(), "MST": "UTC",
            "-0700": "+0000", "-07:00": "+00:00", "-07": "+00", "Z0700": "Z", "Z07:00": "Z",
        }
        out = []
        for is_token, piece in self.pieces:
            if is_token and piece[0] in ".,":
                digits = f"{when.microsecond:06d}000"[: len(piece) - 1]
                digits = digits.rstrip("0") if piece[1] == "9" else digits
                out.append(piece[0] + digits if digits else "")
            else:
                out.append(shown[piece] if is_token else piece)
        return "".join(out)

    def read(self, text: str) -> datetime | None:
        """Read a Python time; None when the text does not fit."""
        m = re.fullmatch(self.regex, text)
        if not m:
            return None
        got = {k: m.group(i) for k, i in self.groups.items()}
        year = int(got["year"]) if "year" in got else self._century(int(got.get("yy", 0)))
        month = int(got.get("month", 1))
        if "name" in got:
            month = MONTHS.split().index(got["name"].lower()) + 1
        hour = int(got.get("hour", 0))
        if "half" in got:
            hour = hour % 12 + (12 if got["half"].upper() == "PM" else 0)
        try:
            read = datetime(
                year, month, int(got.get("day", 1)), hour, int(got.get("minute", 0)), int(got.get("second", 0))
            )
        except ValueError:
            return None
        zone = got.get("zone", "Z").replace(":", "")
        if zone != "Z":
            minutes = int(zone[1:3]) * 60 + int(zone[3:5] or 0)
            read -= timedelta(minutes=minutes if zone[0] == "+" else -minutes)
        return read

    @staticmethod
    def _century(yy: int) -> int:
        return 2000 + yy if yy < 69 else 1900 + yy

    # -- Spark side --------------------------------------------------------------

    def _rewrite(self, text: Column, template: str) -> Column:
        """Template filled from the groups; an unfit text fills nothing."""
        return F.regexp_replace(text, rf"^(?:{self.regex}|(?s:.*))\z", template)

    def _ref(self, name: str) -> str:
        return f"${self.groups[name]}" if name in self.groups else _DEFAULT.get(name, "")

    def to_time(self, text: Column, wall_clock: bool = False) -> Column:
        """Timestamp column; NULL when unfit. ``wall_clock`` ignores the offset and gives TIMESTAMP_NTZ."""
        kind = "timestamp_ntz" if wall_clock else "timestamp"
        zone = "" if wall_clock else self._ref("zone")
        if zone and "-07" in self.tokens:
            zone += ":00"
        year, month = self._ref("year"), self._ref("month")
        clock = f"{self._ref('hour')}:{self._ref('minute')}:{self._ref('second')}{self.comma}{self._ref('fraction')}"
        half = f" {self._ref('half')}" if "half" in self.groups else ""
        rest = f"{self._ref('day')} {clock}{half}{zone}"
        if "yy" in self.groups or "name" in self.groups:
            parts = self._rewrite(text, f"{self._ref('yy') if 'yy' in self.groups else year}/"
                                        f"{self._ref('name') if 'name' in self.groups else month}/{rest}")
            year_col = F.substring_index(parts, "/", 1)
            if "yy" in self.groups:
                year_col = F.concat(F.when(year_col < "69", "20").otherwise("19"), year_col)
            month_col = F.substring_index(F.substring_index(parts, "/", 2), "/", -1)
            if "name" in self.groups:
                at = F.instr(F.lit(MONTHS), F.lower(month_col))
                month_col = ((at + F.lit(3)) / F.lit(4)).cast("int").cast("string")
            canon = F.concat(year_col, F.lit("-"), month_col, F.lit("-"), F.substring_index(parts, "/", -1))
        else:
            canon = self._rewrite(text, f"{year}-{month}-{rest}")
        if half:
            pattern = "y-M-d h:m:s[.SSSSSS] a" + ("[XXX][XX][X]" if zone else "")
            return F.try_to_timestamp(F.upper(canon), F.lit(pattern)).cast(kind)
        return canon.try_cast(kind)

    def offset_text(self, text: Column) -> Column | None:
        """UTC offset written in the text, as +hhmm; None when the layout has none."""
        if "zone" not in self.groups:
            return None
        raw = F.regexp_replace(self._rewrite(text, f"${self.groups['zone']}"), ":", "")
        return F.when(raw == "Z", "+0000").otherwise(F.rpad(raw, 5, "0"))

    def to_text(self, when: Column, offset: Column | None = None) -> Column:
        """Print a timestamp; ``offset`` (+hhmm) is shown where the layout asks for one."""
        offset = F.lit("+0000") if offset is None else offset
        colon = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
        out: list[Column] = []
        pattern = ""

        def flush() -> None:
            nonlocal pattern
            if pattern:
                out.append(F.date_format(when, pattern))
            pattern = ""

        def literal(shown: str) -> None:
            nonlocal pattern
            quoted = shown.replace("'", "''") + "'"
            # Two quotes in a row would stand for a quote, so neighbouring literals are merged.
            pattern = pattern[:-1] + quoted if pattern.endswith("'") else pattern + "'" + quoted

        for is_token, piece in self.pieces:
            if not is_token:
                literal(piece)
                continue
            if piece[0] in ".,":
                letters = "S" * min(len(piece) - 1, 6)
                if piece[1] == "0":
                    literal(piece[0])
                    pattern += letters
                    if len(piece) - 1 > len(letters):
                        literal("0" * (len(piece) - 1 - len(letters)))
                    continue
                flush()
                out.append(F.rtrim(F.rtrim(F.concat(F.lit(piece[0]), F.date_format(when, letters)), F.lit("0")),
                                   F.lit(piece[0])))
            elif piece == "_2":
                flush()
                out.append(F.lpad(F.date_format(when, "d"), 2, " "))
            elif piece == "pm":
                flush()
                out.append(F.lower(F.date_format(when, "a")))
            elif piece == "MST":
                literal("UTC")
            elif _FIELDS[piece][0] == "zone":
                flush()
                shown = colon if ":" in piece else (F.substring(offset, 1, 3) if piece == "-07" else offset)
                if piece[0] == "Z":
                    shown = F.when(offset == "+0000", "Z").otherwise(shown)
                out.append(shown)
            else:
                pattern += _FIELDS[piece][2]
        flush()
        if not out:
            return F.when(when.isNotNull(), F.lit(""))
        return out[0] if len(out) == 1 else F.concat(*out)


@lru_cache(maxsize=256)
def compile_layout(text: str) -> Layout:
    return Layout(text)


#: What a timestamp of microseconds can hold.
MOST_MILLIS = (1 << 63) // 1000 - 1


def parse_ts(text: Column, layout: str) -> Column:
    """Instant written in ``text``; NULL when it does not fit the layout."""
    if layout == EPOCH_MILLIS:
        millis = text.try_cast("bigint")
        fits = text.rlike(r"^[+-]?\d+\z") & millis.between(-MOST_MILLIS, MOST_MILLIS)
        return F.timestamp_millis(F.when(fits, millis))
    return compile_layout(layout).to_time(text)


def iso_ts(when: Column) -> Column:
    """ISO-8601 text in UTC, milliseconds without trailing zeros."""
    return F.concat(F.translate(F.date_trunc("millisecond", when).cast("string"), " ", "T"), F.lit("Z"))


def reformat_ts(text: Column, source: str, destination: str) -> Column:
    """Time text in another layout, on the same wall clock. NULL when it does not fit.

    An empty source layout passes the text through.
    """
    if source == "":
        return text
    read = compile_layout(source)
    wall = read.to_time(text, wall_clock=True)
    if destination == ISO_8601:
        return iso_ts(wall)
    return compile_layout(destination).to_text(wall, read.offset_text(text))
