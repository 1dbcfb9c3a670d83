"""Event times: parsing to, and formatting as, ``YYYY-MM-DD HH:MM:SS.mmm+HH:MM`` text.

A time keeps the offset it was written with, so it is carried as that text; ``instant_of``
gives the point in time. Texts without an offset are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolog.functions.fixed import (
    DAY_FIRST_TIME,
    LINE_START_TIME,
    SPACE,
    WS,
    YEAR_FIRST_TIME,
)
from chronolog.functions.text import let, strip

UTC = "+00:00"
OFFSET = r"([+-](?:[01]\d|2[0-3]))(?::?([0-5]\d))?"
USUAL = rf"^\d{{4}}-\d{{2}}-\d{{2}}[Tt{SPACE}]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?{WS}*(?:[Zz]|{OFFSET})?$"
USUAL_WHOLE = USUAL.removesuffix("$") + r"\z"
CLOCK_TAIL = rf"^(.*?(?:\d:\d{{2}}|T\d{{4}}(?:\d\d)?)(?:[.,]\d+)?(?:{WS}?[AaPp][Mm])?){WS}*(?:[Zz]|UTC|GMT|{OFFSET})$"
# a year, and not just a number of seconds
DATED = r"^(?=.*\d{4})(?:.*[^\d.].*|\d{8}(?:\d{4}(?:\d{2})?)?|.*\.\d+\..*)$"
# what the rewrites below lead to
REWRITTEN = "yyyy-[MMM][M]-d[ h:m[:s][ ]a][ H:m[:s[.SSSSSSSSS]]]"

# Rewrites towards year-month-day, applied in turn to texts that are not in the usual form.
REWRITES = [
    (r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\s+", ""),
    (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1"),
    (r"(:\d{2}),(\d)", "$1.$2"),
    # a zone's name after the clock: what is no known offset reads as UTC
    (
        r"(?i)(\d:\d{2}(?:\.\d+)?(?:\s?[ap]m)?)\s+(?!(?:am|pm|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b)[a-z]{2,5}(?=\s|$)",
        "$1",
    ),
    # 12:00:00 01.09.2025
    (r"^(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s+(\S.*)$", "$2 $1"),
    # Apr 3 00:10:19 2025
    (r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\d{4})$", "$4-$1-$2 $3"),
    # Apr 3, 2025 ...
    (r"^([A-Za-z]{3})\s+(\d{1,2}),?\s+(\d{4})(?:[,:\s]+|$)", "$3-$1-$2 "),
    # 03/Apr/2025:... and 3 Apr 2025 ...
    (r"^(\d{1,2})[-/\s]([A-Za-z]{3})[-/\s](\d{4})(?:[Tt:\s]+|$)", "$3-$2-$1 "),
    # 20250403T001019 and 20250403001019
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt\s]?(\d{2})(\d{2})(\d{2})?(\.\d+)?$", "$1-$2-$3 $4:$5:0$6$7"),
    (r":0(\d{2})", ":$1"),
    # 2025/04/03 and 2025.04.03
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt\s]+|$)", "$1-$2-$3 "),
    # 13/04/2025 can only be day first; otherwise slashes are month first
    (r"^(1[3-9]|[23]\d)[-/](\d{1,2})[-/](\d{4})(?:[Tt\s]+|$)", "$3-$2-$1 "),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?:[Tt\s]+|$)", "$3-$1-$2 "),
]
DAY_FIRST_DOTS = [(r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[Tt\s]+|$)", "$3-$2-$1 ")]
MONTH_FIRST_DOTS = [
    (r"^(1[3-9]|[23]\d)\.(\d{1,2})\.(\d{4})(?:[Tt\s]+|$)", "$3-$2-$1 "),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[Tt\s]+|$)", "$3-$1-$2 "),
]


def _checked(wall: Column, offset: Column) -> Column:
    """Wall clock and offset as one text, NULL when no such date or time of day exists."""

    def real(text: Column) -> Column:
        exists = F.concat(text, F.lit("Z")).try_cast("timestamp").isNotNull()
        return F.when(exists & ~F.startswith(text, F.lit("0000")), F.concat(text, offset))

    return let(wall, real)


def _offset(tail: Column) -> Column:
    """``+hh:mm`` from ``$1:$2`` text whose parts may be missing."""
    marked = F.replace(F.concat(F.lit("|"), tail), F.lit("|:"), F.lit("|" + UTC))
    padded = F.rpad(F.substr(marked, F.lit(2)), 6, "0")
    return F.replace(padded, F.lit("-00:00"), F.lit(UTC))


def _usual(text: Column) -> Column:
    after = F.substr(text, F.lit(20))
    millis = F.rpad(F.regexp_extract(after, r"^[.,](\d{1,3})", 1), 3, "0")
    wall = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8), F.lit("."), millis)
    tail = F.regexp_replace(after, rf"^(?:[.,]\d+)?{WS}*(?:[Zz]|{OFFSET})?$", "$1:$2")
    return _checked(wall, _offset(tail))


def _other(text: Column, day_first: bool) -> Column:
    zoned = text.rlike(CLOCK_TAIL)
    offset = F.when(zoned, _offset(F.regexp_replace(text, CLOCK_TAIL, "$2:$3"))).otherwise(UTC)
    body = F.regexp_replace(text, CLOCK_TAIL, "$1")
    for pattern, replacement in REWRITES + (DAY_FIRST_DOTS if day_first else MONTH_FIRST_DOTS):
        body = F.regexp_replace(body, pattern, replacement)
    parsed = F.try_to_timestamp(F.rtrim(body), F.lit(REWRITTEN))
    return F.concat(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSS"), offset)


def parse_time(text: Column, day_first: bool = True) -> Column:
    """Canonical time text of one timestamp in a known notation, NULL when it is none.

    ``day_first`` says how ``03.04.2025`` reads; slashed dates are month first where possible.
    """

    def parsed(clean: Column) -> Column:
        return F.when(clean.rlike(USUAL), _usual(clean)).when(clean.rlike(DATED), _other(clean, day_first))

    def cleaned(given: Column) -> Column:
        # with single blanks and short fractions no pattern looks at a place of a long text more than once
        plain = F.regexp_replace(F.regexp_replace(strip(given), rf"{WS}+", " "), r"([.,]\d{9})\d+", "$1")
        # most times need no cleaning
        return F.when(given.rlike(USUAL_WHOLE), _usual(given)).when(given.isNotNull(), let(plain, parsed))

    return let(text, cleaned)


def offset_of(time: Column) -> Column:
    return F.substr(time, F.lit(24))


def instant_of(time: Column) -> Column:
    """Point in time of a canonical time text."""
    wall = F.concat(F.substring(time, 1, 23), F.lit("Z")).try_cast("timestamp")
    minutes = F.concat(F.substring(time, 24, 1), F.lit("1")).try_cast("int") * (
        F.substring(time, 25, 2).try_cast("int") * 60 + F.substring(time, 28, 2).try_cast("int")
    )
    return F.timestamp_millis(F.unix_millis(wall) - minutes.cast("bigint") * 60000)


def format_time(instant: Column, offset: Column) -> Column:
    """Canonical time text of a timestamp, shown at a given offset."""
    local = F.from_utc_timestamp(instant, offset)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS"), offset)


def day_first_time(found: Column) -> Column:
    """Canonical time of a ``DD.MM.YYYY H:MM:SS`` match; NULL for '' or an impossible date."""
    wall = F.concat(
        F.substring(found, 7, 4), F.lit("-"), F.substring(found, 4, 2), F.lit("-"),
        F.substring(found, 1, 2), F.lit(" "),
        F.lpad(strip(F.substr(found, F.lit(11))), 8, "0"), F.lit(".000"),
    )
    return _checked(wall, F.lit(UTC))


def year_first_time(found: Column) -> Column:
    """Canonical time of a ``YYYY-MM-DD HH:MM:SS[.fff]`` match."""
    clock = F.concat(strip(F.substr(found, F.lit(11))), F.lit(".000"))
    wall = F.concat(F.substring(found, 1, 10), F.lit(" "), F.substring(clock, 1, 12))
    return _checked(wall, F.lit(UTC))


def event_time_in_text(line: Column) -> Column:
    """First day-first time anywhere in the line, else the first year-first one; offsets ignored."""
    return F.coalesce(
        day_first_time(F.regexp_extract(line, DAY_FIRST_TIME, 0)),
        year_first_time(F.regexp_extract(line, YEAR_FIRST_TIME, 0)),
    )


def line_start_time(line: Column) -> Column:
    """Time at the start of the line, with a blank or ``T`` and any fraction."""
    return parse_time(F.regexp_extract(line, LINE_START_TIME, 1))
