"""Record columns of JSON objects.

A ``View`` of the objects is worked out once; the column functions then only look things up in it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions import records as R
from chronolog.functions.fixed import ERROR_KEYS, MARKED_LEVELS
from chronolog.functions.text import contains_any, let, title_case
from chronolog.functions.versions import UNKNOWN, version_from_text

# Keys whose values fill record columns, at the top and inside objects.
TOP_KEYS = [
    "level", "log.level", "pid", "process.id", "tr", "lg", "logger", "component", "app_id", "tn",
    "cluster.name", "node.name", "mt", "message", "v", "l",
]
INNER_KEYS = [
    ("log", "level"), ("log", "logger"), ("process", "pid"), ("process", "id"), ("trace", "id"),
    ("transaction", "id"), ("logger", "name"), ("service", "name"), ("service", "version"),
    ("host", "name"),
]


@dataclass(frozen=True)
class View:
    """Lookups into JSON objects; ``outer/inner`` names a member of a nested object."""

    record: Column

    def has(self, key: str) -> Column:
        """The key is present, whatever its value."""
        return self.value(key).isNotNull() if "/" in key else F.map_contains_key(self.record, F.lit(key))

    def value(self, key: str) -> Column:
        return F.col(f"`_inner:{key}`") if "/" in key else R.member(self.record, key)

    def text(self, key: str) -> Column:
        """The value as text, also when empty."""
        return R.text(self.value(key))

    def given(self, key: str) -> Column:
        """The value as text, NULL when it is empty, zero or false."""
        return F.col(f"`_given:{key}`")


def with_view(df: DataFrame, record: str = "record") -> tuple[DataFrame, View]:
    """Add what a ``View`` of the objects needs, one column per key; Spark leaves out those that are not looked at."""
    view = View(F.col(record))
    inner = [f"{outer}/{inner}" for outer, inner in INNER_KEYS]
    df = df.withColumns(
        {f"_inner:{key}": R.nested(R.member(view.record, key.split("/")[0]), key.split("/")[1]) for key in inner}
    )
    keys = [*TOP_KEYS, *inner]
    df = df.withColumns({f"_text:{key}": view.text(key) for key in keys})
    df = df.withColumns({f"_given:{key}": R.truthy(view.value(key), F.col(f"`_text:{key}`")) for key in keys})
    return df.drop(*[f"_text:{key}" for key in keys]), view


def named_level(view: View) -> Column:
    """Level the record names, as written."""
    return F.coalesce(view.given("log/level"), view.given("level"), view.given("log.level"))


def marked_level(line: Column) -> Column:
    """Level from a bracketed word anywhere in the record's text."""

    def of_text(low: Column) -> Column:
        (first, marks), *others = MARKED_LEVELS
        case = F.when(contains_any(low, marks), F.lit(first))
        for level, marks in others:
            case = case.when(contains_any(low, marks), F.lit(level))
        return case.otherwise(F.lit("Information"))

    return let(F.lower(line), of_text)


def json_full_level(view: View, line: Column) -> Column:
    return F.coalesce(named_level(view), marked_level(line))


def json_level(view: View, line: Column) -> Column:
    """Level as written; only ``Information`` is shortened. An input ``l`` is not looked at."""
    return shorten_information(json_full_level(view, line))


def shorten_information(level: Column) -> Column:
    return F.regexp_replace(level, "^Information$", "Info")


def short_level(level: Column) -> Column:
    for long, short in (("Information", "Info"), ("Warning", "Warn"), ("Critical", "Fatal")):
        level = F.replace(level, F.lit(long), F.lit(short))
    return level


def json_level_titled(view: View, line: Column) -> Column:
    """Level with an input ``l`` first, title-cased and shortened."""
    return short_level(title_case(F.coalesce(view.given("l"), json_full_level(view, line))))


def json_pid(view: View) -> Column:
    return F.coalesce(
        view.given("pid"), view.given("process/pid"), view.given("process/id"),
        view.given("process.id"), view.text("process.pid"), F.lit("1"),
    )


def json_trace_id(view: View) -> Column:
    """``trace.id`` when it exists, even empty, else a non-empty ``tr``."""
    return F.when(view.has("trace/id"), view.text("trace/id")).otherwise(view.given("tr"))


def json_transaction_id(view: View) -> Column:
    return view.text("transaction/id")


def json_logger(view: View, service: Column) -> Column:
    """The first logger-like key decides, even when its value is empty; then the service."""
    found = (
        F.when(view.has("lg"), view.given("lg"))
        .when(R.is_string(view.value("logger")), view.given("logger"))
        .when(view.has("logger/name"), view.given("logger/name"))
        .when(view.has("component"), view.given("component"))
        .when(view.has("service/name"), view.given("service/name"))
        .when(view.has("app_id"), view.given("app_id"))
    )
    return F.coalesce(found, service)


def json_tenant(view: View, service: Column) -> Column:
    """``tn`` or ``host.name`` decide when present; then cluster and node names; then the service."""
    cluster, node = view.given("cluster.name"), view.given("node.name")
    found = (
        F.when(view.has("tn"), view.given("tn"))
        .when(view.has("host/name"), view.given("host/name"))
        .when(cluster.isNotNull() | node.isNotNull(), F.concat_ws("-", cluster, node))
    )
    return F.coalesce(found, service)


def json_message(view: View) -> Column:
    msg = F.when(view.has("msg"), view.text("msg")).otherwise(F.lit(""))
    return F.coalesce(view.given("mt"), view.given("message"), msg)


def json_version_text(view: View) -> Column:
    """The text to look for a version in: the message, unless it is no string."""
    value = (
        F.when(view.given("mt").isNotNull(), view.value("mt"))
        .when(view.given("message").isNotNull(), view.value("message"))
        .otherwise(view.value("msg"))
    )
    return let(value, lambda v: F.when(R.is_string(v), R.text(v)))


def named_version(view: View) -> Column:
    return F.coalesce(view.given("v"), view.given("service/version"))


def json_version(view: View) -> Column:
    """``v``, else ``service.version``, else a version in the message."""
    return F.coalesce(named_version(view), version_from_text(json_version_text(view)), F.lit(UNKNOWN))


def json_errors(record: Column) -> Column:
    """Object of the error-describing keys, NULL without any."""
    found = F.map_filter(record, lambda key, _: key.isin(ERROR_KEYS))
    return let(found, lambda errors: F.when(F.size(errors) > 0, F.to_variant_object(errors)))


# --- records in the Elastic Common Schema


def ecs_level(view: View) -> Column:
    return short_level(title_case(F.coalesce(view.text("log/level"), F.lit("information"))))


def ecs_service(view: View) -> Column:
    return F.coalesce(view.text("service/name"), F.lit("UnknownService"))


def ecs_logger(view: View) -> Column:
    return F.coalesce(view.text("log/logger"), ecs_service(view))


def ecs_pid(view: View) -> Column:
    return F.coalesce(view.text("process/pid"), F.lit("1"))


def or_default(view: View, key: str, default: str) -> Column:
    return F.coalesce(view.text(key), F.lit(default))


# --- search-engine JSON


def es_json_level(view: View) -> Column:
    level = title_case(or_default(view, "level", "INFO"))
    return F.replace(level, F.lit("Critical"), F.lit("Fatal"))


# --- keep-everything JSON


def present_level(view: View, line: Column) -> Column:
    """Level of the first level key that is present, else from marks in the text; titled."""
    named = (
        F.when(view.has("log/level"), view.given("log/level"))
        .when(view.has("level"), view.given("level"))
        .when(view.has("log.level"), view.given("log.level"))
    )
    return short_level(title_case(F.coalesce(named, marked_level(line))))


def enriched(view: View, line: Column, service: Column, t: Column) -> Column:
    """All input keys, with ``t`` normalised and missing canonical keys added."""
    record = view.record
    # without a message the whole record is searched, where quoted keys are no version marks
    searched = F.when(view.has("message"), view.text("message")).otherwise(F.translate(line, '"', "'"))
    additions = {
        "pid": F.coalesce(view.text("process/pid"), F.lit("1")),
        "tr": F.coalesce(view.text("trace/id"), view.text("transaction/id")),
        "l": present_level(view, line),
        "lg": json_logger(view, service),
        "mt": F.coalesce(view.text("message"), view.text("msg")),
        "tn": json_tenant(view, service),
        "v": F.coalesce(view.text("service/version"), version_from_text(searched)),
    }
    pairs = reduce(lambda acc, kv: [*acc, F.lit(kv[0]), kv[1].cast("variant")], additions.items(), [])
    pairs += [F.lit("ex"), json_errors(record)]
    added = F.map_filter(
        F.create_map(*pairs), lambda key, value: value.isNotNull() & ~F.map_contains_key(record, key)
    )
    kept = F.map_filter(record, lambda key, _: key != "t")
    return F.map_concat(kept, F.create_map(F.lit("t"), t.cast("variant")), added)
