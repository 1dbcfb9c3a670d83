"""Words and shingle hashes of texts as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[ \t\n\x0B\f\r]+"
WIDTH = 5


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.array_remove(parts, "")


def folded(text: Column) -> Column:
    """An image of the text that is equal for two texts just when they differ at most in the case of A-Z.

    The UTF-8 bytes are read as Latin-1 and lower-cased: a lead byte C0-DE becomes E0-FE, but the number
    of continuation bytes still tells it apart, so the mapping merges nothing beyond A-Z with a-z. It is
    meant for hashing and comparing only.
    """
    return F.lower(F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1"))


def hashes(w: Column, width: int = WIDTH) -> Column:
    """The 64-bit hashes of all runs of ``width`` words, in text order; a shorter text is one run.

    ``w`` has to be a column of the input, not an expression: it is read once for every word.
    """
    n = F.size(w)
    runs = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
    )
    whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
    none = F.array().cast("array<bigint>")
    return F.when(n >= width, runs).when(n > 0, whole).otherwise(none)


def distinct_hashes(w: Column, width: int = WIDTH) -> Column:
    """The set of shingle hashes, sorted."""
    return F.sort_array(F.array_distinct(hashes(w, width)))
