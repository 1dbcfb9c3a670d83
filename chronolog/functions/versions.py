"""Version numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolog.functions.fixed import TEXT_VERSION, VERSIONS
from chronolog.functions.text import let, nonempty

UNKNOWN = "unknown"


def version_from_text(text: Column) -> Column:
    """First version by the ordered patterns, ``unknown`` when none matches."""

    def search(given: Column) -> Column:
        found = [
            F.when(
                F.contains(given, F.lit(must_hold)),
                nonempty(F.regexp_extract(given, pattern, group)),
            )
            for must_hold, pattern, group in VERSIONS
        ]
        return F.coalesce(*found, F.lit(UNKNOWN))

    return let(text, search)


def bare_version(text: Column) -> Column:
    """First dotted run of three or four numbers, wherever it stands."""
    found = F.when(F.contains(text, F.lit(".")), nonempty(F.regexp_extract(text, TEXT_VERSION, 0)))
    return F.coalesce(found, F.lit(UNKNOWN))
