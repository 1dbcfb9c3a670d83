"""The ``args`` object: what a JSON record holds beyond its own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions import deep_json as D
from chronolog.functions import records as R
from chronolog.functions.fixed import (
    DROPPED_TIME_KEYS,
    ECS_KEYS,
    ES_JSON_KEYS,
    LIFTED_KEYS,
    REPEATED_KEYS,
    STANDARD_KEYS,
)
from chronolog.functions.text import let, pinned, title_case
from chronolog.functions.times import parse_time
from chronolog.options import DEFAULT, Options

TIME_KEY_TEXT = '"(?:' + "|".join(DROPPED_TIME_KEYS) + ')":'
LOST_KEYS = ["l", "args", "ex", "trace_id", "transaction_id"]


def _object_without(value: Column, key: str, even_empty: bool = False) -> Column:
    least = 0 if even_empty else 1
    rest = F.map_filter(R.as_object(value), lambda k, _: k != key)
    return let(rest, lambda found: F.when(F.size(found) >= least, F.to_variant_object(found)))


def _no_object(record: Column, *keys: str) -> Column:
    """Some of the keys is present but holds no object; such a record gets no arguments."""
    bad = F.lit(False)
    for key in keys:
        bad = bad | (R.has(record, key) & R.as_object(R.member(record, key)).isNull())
    return bad


def _host_rest(record: Column) -> Column:
    """``host.user`` without its name; a marker when neither host nor user leave anything."""
    host = R.member(record, "host")
    user = R.as_object(R.nested(host, "user"))
    rest = F.map_filter(user, lambda k, _: k != "name")
    return F.when(
        F.size(rest) > 0, F.to_variant_object(F.create_map(F.lit("user"), F.to_variant_object(rest)))
    ).when(
        user.isNotNull() & R.nested(host, "name").isNull(),
        F.parse_json(F.lit('{"name":null}')),
    )


def leftovers(record: Column, options: Options = DEFAULT) -> Column:
    """Arguments before cleaning, as ``MAP<STRING, VARIANT>``; NULL when they cannot be built."""
    log, host = R.member(record, "log"), R.member(record, "host")
    trace, transaction = R.member(record, "trace"), R.member(record, "transaction")
    process = R.member(record, "process")
    restored: dict[str, Column] = {}
    if options.arguments == "clean":
        out = [*STANDARD_KEYS, *LIFTED_KEYS, *REPEATED_KEYS]
        restored = {
            "trace": _object_without(trace, "id"),
            "transaction": _object_without(transaction, "id"),
            "host": _host_rest(record),
            "log": _object_without(log, "level"),
            "process": _object_without(process, "pid"),
        }
        broken = _no_object(record, "log", "trace", "transaction", "process")
    elif options.arguments == "full":
        out = [*STANDARD_KEYS, *LIFTED_KEYS]
        level = F.create_map(F.lit("level"), F.col("_full_level").cast("variant"))
        user = R.nested(host, "user")
        restored = {
            "trace": trace,
            "transaction": transaction,
            "host": F.when(
                R.as_object(user).isNotNull(), F.to_variant_object(F.create_map(F.lit("user"), user))
            ),
            "log": F.to_variant_object(
                F.map_concat(F.map_filter(R.as_object(log), lambda k, _: k != "level"), level)
            ),
            "process": _object_without(process, "pid", even_empty=True),
        }
        broken = _no_object(record, "log", "process")
    else:
        own = [k for k in STANDARD_KEYS if k not in ("trace_id", "transaction_id")]
        out = [*own, *LIFTED_KEYS, "span"]
        broken = F.lit(False)
    if options.preserve_standard:
        # an input key of that name stays where there is nothing to keep under it
        for key in LOST_KEYS:
            kept = f"original_{key}"
            restored[kept] = F.coalesce(R.member(record, key), R.member(record, kept))
    base = F.map_filter(record, lambda key, _: ~key.isin(out))
    if restored:
        pairs = [part for key, value in restored.items() for part in (F.lit(key), value)]
        given = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
        base = F.map_concat(F.map_filter(base, lambda key, _: ~key.isin(list(restored))), given)
    return F.when(~broken, base)


def ecs_arguments(record: Column) -> Column:
    """All keys but those lifted into columns, plus the original log text."""
    original = R.nested(R.member(record, "log"), "original")
    rest = F.map_filter(record, lambda key, _: ~key.isin([*ECS_KEYS, "original_log_info"]))
    added = F.map_filter(
        F.create_map(
            F.lit("original_log_info"), F.coalesce(original, R.member(record, "original_log_info"))
        ),
        lambda _, value: value.isNotNull(),
    )
    return F.to_variant_object(F.map_concat(rest, added))


def es_json_arguments(record: Column) -> Column:
    return F.to_variant_object(F.map_filter(record, lambda key, _: ~key.isin(ES_JSON_KEYS)))


# --- cleaning


def _quoted(value: Column) -> Column:
    """A string as it stands in masked compact JSON."""
    return D.masked(let(F.to_json(F.struct(value.alias("v"))), lambda j: F.substr(j, F.lit(6), F.length(j) - 6)))


def _drops(keep_empty: bool, keep_times: bool) -> D.Drops:
    """Which members of nested objects go: time keys, and unless ``keep_empty`` what repeats a column."""

    def drops(key: Column, value: Column) -> Column:
        gone = F.lit(False) if keep_times else key.isin([f'"{k}"' for k in DROPPED_TIME_KEYS])
        if keep_empty:
            return gone
        shown = D.scalar_text(value)
        repeated = ((key == '"level"') & (F.col("l") != "") & (title_case(shown) == F.col("l"))) | (
            (key == '"pid"') & (F.col("pid") != "") & (shown == F.col("pid"))
        )
        for name, column in (("message", "mt"), ("name", "tn"), ("version", "v")):
            repeated = repeated | ((key == f'"{name}"') & (F.col(column) != "") & (value == _quoted(F.col(column))))
        return gone | F.coalesce(repeated, F.lit(False))

    return drops


def _names(key: str, value: Column) -> Column:
    """``"key":"value"`` as it stands in compact JSON."""
    text = F.to_json(F.struct(value.alias(key)))
    return F.substring(text, 2, 1 << 30)


def with_arguments(df: DataFrame, is_json: Column, options: Options = DEFAULT) -> DataFrame:
    """Add ``args`` to JSON rows that already have their other columns.

    Top-level keys are handled by map functions. Nested values are only looked into when their text shows a
    key that might have to go; all other rows have NULL there.
    """
    record = F.col("record")
    if options.json_rules != "generic":
        build = ecs_arguments if options.json_rules == "ecs" else es_json_arguments
        return df.withColumn("_json_args", F.when(is_json, build(record)))
    clean = options.arguments == "clean"
    df = df.withColumn("_rest", F.when(is_json, leftovers(record, options)))
    level = R.text(R.member(record, "level"))
    df = df.withColumn("_same_level", F.coalesce(title_case(level) == F.col("l"), F.lit(False)))

    def stays(key: Column, value: Column) -> Column:
        timed = key.isin(DROPPED_TIME_KEYS)
        if options.keep_other_times:
            timed = timed & F.coalesce(parse_time(R.text(value), options.day_first) == F.col("t"), F.lit(False))
        if not clean:
            return ~timed
        shown = R.text(value)
        repeated = (
            ((key == "level") & F.col("_same_level"))
            | ((key == "name") & (F.col("tn") != "") & (shown == F.col("tn")) & R.is_string(value))
            | ((key == "version") & (F.col("v") != "") & (shown == F.col("v")) & R.is_string(value))
        )
        empty = shown.isin("{}", "[]") & ~R.is_string(value)
        return ~timed & ~F.coalesce(repeated | empty, F.lit(False))

    df = df.withColumn("_rest", F.map_filter("_rest", stays))
    containers = F.map_filter("_rest", lambda _, value: F.substring(R.text(value), 1, 1).isin("{", "["))
    inside = let(containers, lambda found: F.when(F.size(found) > 0, F.to_json(found)))
    df = df.withColumn("_inside", inside)
    inside = F.substr("_inside", F.lit(2))
    suspect = F.lit(False) if options.keep_other_times else inside.rlike(TIME_KEY_TEXT)
    if clean:
        suspect = (
            suspect
            | F.contains(inside, F.lit("{}"))
            | F.contains(inside, F.lit("[]"))
            | F.contains(inside, F.lit('"level":'))
            | F.contains(inside, F.lit('"pid":'))
        )
        for key, column in (("message", "mt"), ("name", "tn"), ("version", "v")):
            quoted = F.rtrim(_names(key, F.col(column)), F.lit("}"))
            suspect = suspect | F.coalesce(F.contains(inside, quoted), F.lit(False))
    df = df.withColumn("_deep", F.when(suspect, F.to_json("_rest")))
    pruned = D.pruned_json(F.col("_deep"), _drops(not clean, options.keep_other_times), keep_empty=not clean)
    df = df.withColumn("_pruned", pinned(F.when(F.col("_deep").isNotNull(), pruned)))
    json_args = F.when(
        F.col("_pruned").isNotNull(), F.when(F.col("_pruned") != "{}", F.try_parse_json("_pruned"))
    ).when(F.size("_rest") > 0, F.to_variant_object("_rest"))
    return df.withColumn("_json_args", json_args).drop(
        "_rest", "_same_level", "_inside", "_deep", "_pruned"
    )
