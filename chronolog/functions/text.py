"""Text helpers with Python's notions of whitespace and title case."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolog.functions.fixed import FORBIDDEN_IN_NAMES, SERVICES, SPACE_CHARS, WS

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
FIELD_MARK = "\u0001"
ESCAPE = "\u0002"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value it uses several times, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(column: Column) -> Column:
    """A column whose expression stays in its own projection.

    Catalyst moves a filter below the projections it reads from, copying their expressions; with
    columns built on one another that multiplies the work. A condition that Spark must not move,
    though it always holds, keeps such filters above.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def groups(text: Column, pattern: str, count: int) -> Column:
    """All capture groups of the first match as one array, with a single regex run.

    The array is shorter than ``count`` when the pattern does not match. Marks that the text itself holds
    are escaped before and restored in the parts.
    """
    marked = FIELD_MARK.join(f"${i + 1}" for i in range(count))
    flags, body = re.match(r"(\(\?[a-zA-Z]+\))?(.*)", pattern, re.S).groups()
    lead = "" if body.startswith("^") else "^.*?"
    split = lambda t: F.split(F.regexp_replace(t, (flags or "") + lead + body, marked), FIELD_MARK)
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(FIELD_MARK), F.lit(ESCAPE + "1"))
    restored = F.transform(
        split(escaped),
        lambda p: F.replace(F.replace(p, F.lit(ESCAPE + "1"), F.lit(FIELD_MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE)),
    )
    return F.when(F.contains(text, F.lit(FIELD_MARK)), restored).otherwise(split(text))


def title_case(text: Column) -> Column:
    """Capital after anything that is not a cased letter, lower case elsewhere.

    ``initcap`` only knows blanks as word breaks, so a blank is put before every word start;
    original blanks travel as a mark meanwhile.
    """
    spaced = F.regexp_replace(
        F.translate(text, " ", FIELD_MARK), f"(?<!{CASED})(?={CASED})", " "
    )
    return F.translate(F.initcap(spaced), FIELD_MARK + " ", " ")


def sanitize_name(name: Column) -> Column:
    return F.translate(name, FORBIDDEN_IN_NAMES, "_" * len(FORBIDDEN_IN_NAMES))


def basename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def stem(name: Column) -> Column:
    """A file name without its last extension; leading dots do not start an extension."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def service_from_path(path: Column) -> Column:
    """Known service named in the file name, else the titled file stem, else ``Unknown``."""
    name = F.lower(basename(path))
    known = [F.when(F.contains(name, F.lit(service)), F.lit(service)) for service in SERVICES]
    own = title_case(F.coalesce(*known, sanitize_name(stem(name))))
    return F.coalesce(nonempty(own), F.lit("Unknown"))


def source_key(path: Column) -> Column:
    """Short stable key of a source, distinct for equal file names in different folders."""
    return F.substring(F.md5(path), 1, 8)


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))
