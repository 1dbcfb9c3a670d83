"""Reading JSON objects as ``MAP<STRING, VARIANT>`` and looking into their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions.text import pinned

STRICT = {"allowSingleQuotes": "false"}
OBJECT = "map<string,variant>"
# Texts that count as "no value" unless they are strings.
EMPTY_TEXTS = ["0", "-0", "0.0", "-0.0", "false", "{}", "[]"]


def with_json_object(df: DataFrame, line: str, out: str = "record") -> DataFrame:
    """Add the line's top-level object, NULL unless the whole line is one JSON object.

    ``from_json`` ignores what follows the first value, so the line must first count as exactly one
    element of an array. That test only skips over tokens. It is fooled by a line that closes the
    array itself, right after its first object; lines with such a text must also be the only member
    of an object, which the same line cannot be. Not-a-number words, which the count does not know,
    take both tests in full.
    """
    text = F.col(line)
    in_array = F.concat(F.lit("["), text, F.lit("]"))
    only_member = F.size(F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), OBJECT, STRICT)) == 1
    only_element = F.size(F.from_json(in_array, f"array<{OBJECT}>", STRICT)) == 1
    counted = F.json_array_length(in_array) == 1
    whole = (
        F.when(counted, ~text.rlike(r"\}\s*\]") | only_member)
        .when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), only_element & only_member)
    )
    read = F.when(F.startswith(text, F.lit("{")) & whole, read_known_object(text))
    df = df.withColumn("_read", read).withColumn(out, pinned(last_wins(F.col("_read"))))
    return df.drop("_read")


def read_known_object(text: Column) -> Column:
    """The object of a text already known to be one."""
    return F.from_json(text, OBJECT, STRICT)


def last_wins(record: Column) -> Column:
    """Keep the last value of a repeated key."""
    keys = F.array_distinct(F.map_keys(record))

    def last(key: Column) -> Column:
        same = F.filter(F.map_entries(record), lambda e: e["key"] == key)
        return F.element_at(same, -1)["value"]

    return F.when(F.size(keys) == F.size(record), record).when(
        F.size(record) > 0, F.map_from_arrays(keys, F.transform(keys, last))
    )


def member(record: Column, key: str) -> Column:
    return F.try_element_at(record, F.lit(key))


def has(record: Column, key: str) -> Column:
    return F.map_contains_key(record, key)


def text(value: Column) -> Column:
    """A string as it is, anything else as its JSON text, JSON null as NULL."""
    return F.try_variant_get(value, "$", "string")


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def nested(value: Column, key: str) -> Column:
    """A member of a nested object, NULL when absent or when ``value`` is no object."""
    return F.try_variant_get(value, f'$["{key}"]', "variant")


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT)


def counts(value: Column, shown: Column | None = None) -> Column:
    """The value is present and not empty, zero, false or null; ``shown`` is its text if that is at hand."""
    shown = text(value) if shown is None else shown
    empty = shown.isin("", *EMPTY_TEXTS) & ((shown == "") | ~is_string(value))
    return ~F.coalesce(empty, F.lit(True))


def truthy(value: Column, shown: Column | None = None) -> Column:
    """Text of a value that counts, else NULL."""
    shown = text(value) if shown is None else shown
    return F.when(counts(value, shown), shown)
