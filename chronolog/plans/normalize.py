"""Lines in, canonical records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions import records as R
from chronolog.functions import times as T
from chronolog.functions.text import pinned, service_from_path, strip
from chronolog.functions.versions import UNKNOWN, bare_version, version_from_text
from chronolog.operators import json_records as J
from chronolog.operators import route
from chronolog.operators import text_records as X
from chronolog.operators.arguments import with_arguments
from chronolog.options import DEFAULT, Options

RENDERED = [
    "t", "pid", "l", "lg", "tn", "v", "mt", "trace_id", "transaction_id", "tr", "un",
    "span", "ex", "args",
]
PROVENANCE = [
    "event_ts", "tz_offset", "time_source", "format", "file_path", "file_block_start", "line_seq",
]
COLUMNS = [*RENDERED, "extra", "raw_record", *PROVENANCE]
LINE_COLUMNS = ["line", "file_path", "file_block_start", "line_seq"]
TIMED_COLUMNS = [*LINE_COLUMNS, "format", "time_source", "t", "event_ts"]


def as_lines(df: DataFrame, text: str, path: str, *order: str) -> DataFrame:
    """Use a text column of any table as log lines.

    ``path`` names the column that plays the file name, ``order`` up to two numeric columns that
    give the order of lines within it.
    """
    order_columns = [F.col(c).cast("bigint") for c in order] + [F.lit(0).cast("bigint")] * 2
    block, seq = (F.lit(0).cast("bigint"), order_columns[0]) if len(order) < 2 else order_columns[:2]
    return df.select(
        F.col(text).alias("line"),
        F.col(path).alias("file_path"),
        block.alias("file_block_start"),
        seq.alias("line_seq"),
    )


def timed(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Non-blank lines with format and event time; helper columns are kept for the next step."""
    return route.with_event_time(route.with_format(route.drop_blank(lines), options), options)


def _with_record(df: DataFrame, options: Options) -> DataFrame:
    """Read again what ``timed`` had read, for lines that were shuffled without it."""
    line, kind = F.col("line"), F.col("format")
    text = F.substr(line, F.instr(line, "{")) if options.prefixed_json else line
    known = F.when(kind.isin(route.JSON, route.CANONICAL), R.read_known_object(text))
    df = df.withColumn("_record", known).withColumn("record", R.last_wins(F.col("_record")))
    return route.with_parts(df.drop("_record"), "format", options)


def _by_format(**columns: Column) -> Column:
    """One expression per format; formats that are not named give NULL."""
    items = list(columns.items())
    case = F.when(F.col("format") == items[0][0], items[0][1])
    for kind, column in items[1:]:
        case = case.when(F.col("format") == kind, column)
    return case


def _json_text(options: Options) -> Column:
    """The JSON part of a line that may begin with other text."""
    line = F.col("line")
    return F.substr(line, F.instr(line, "{")) if options.prefixed_json else line


def _json_columns(options: Options, view: J.View) -> dict[str, Column]:
    """Columns of JSON objects, by the chosen rules; ``v`` only where a key names it."""
    if options.json_rules == "ecs":
        return {
            "pid": J.ecs_pid(view), "l": J.ecs_level(view), "lg": J.ecs_logger(view),
            "tn": J.ecs_service(view), "mt": J.or_default(view, "message", ""),
        }
    if options.json_rules == "es_json":
        return {
            "pid": J.or_default(view, "process.id", "1"), "l": J.es_json_level(view),
            "lg": J.or_default(view, "component", "Elasticsearch"),
            "tn": J.or_default(view, "node.name", "Elasticsearch"),
            "mt": J.or_default(view, "message", ""),
        }
    level = (
        J.json_level_titled(view, _json_text(options))
        if options.levels == "titled"
        else J.shorten_information(F.col("_full_level"))
    )
    columns = {
        "pid": J.json_pid(view), "l": level, "lg": J.json_logger(view, F.col("service")),
        "tn": J.json_tenant(view, F.col("service")), "v": J.named_version(view),
        "mt": J.json_message(view), "span": view.value("span"), "ex": J.json_errors(view.record),
    }
    if options.arguments == "leftovers":
        columns["tr"] = view.given("tr")
    else:
        columns["trace_id"] = J.json_trace_id(view)
        columns["transaction_id"] = J.json_transaction_id(view)
    return columns


def with_fields(df: DataFrame, options: Options = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """All record columns of timed lines, and any columns to carry along.

    Narrow: no shuffle, one row out per row in.
    """
    if "record" not in df.columns:
        df = _with_record(df, options)
    line, record, parts = F.col("line"), F.col("record"), F.col("parts")
    df = df.withColumn("service", service_from_path(F.col("file_path")))
    service = F.col("service")
    df, view = J.with_view(df)
    searched = (
        J.json_version_text(view) if options.json_rules == "generic" else view.text("message")
    )
    df = df.withColumns(
        {
            "_message": _by_format(
                procrun=X.procrun_message(X.procrun_tail(line), options.keep_two_bracket_message),
                es_text=strip(F.get(parts, F.lit(5))),
                syslog=F.get(parts, F.lit(4)),
                json=searched,
            ),
            # the level as first found, for arguments that repeat it in full
            "_full_level": F.when(F.col("format") == "json", J.json_full_level(view, _json_text(options))),
        }
    )
    message = F.col("_message")
    versioned = F.col("format").isin("procrun", "es_text", "json")
    version = F.when(versioned, F.coalesce(version_from_text(message), F.lit(UNKNOWN)))
    syslog_service = X.syslog_service(message, F.get(parts, F.lit(2)))

    def own(key: str) -> Column:
        return R.text(R.member(record, key))

    json = _json_columns(options, view)
    info = F.lit("Info")
    empty_object = F.parse_json(F.lit("{}"))
    text_columns = {
        "pid": dict(procrun=X.procrun_pid(X.procrun_tail(line)), es_text=F.get(parts, F.lit(3)),
                    syslog=F.get(parts, F.lit(3)), minimal=X.minimal_pid(line)),
        "l": dict(procrun=info, es_text=X.es_level(F.get(parts, F.lit(1))), syslog=info,
                  minimal=X.minimal_level(line)),
        "lg": dict(procrun=F.lit("Commons Daemon"), es_text=F.get(parts, F.lit(2)),
                   syslog=syslog_service, minimal=X.minimal_logger(line, service)),
        "tn": dict(procrun=service, es_text=F.get(parts, F.lit(4)), syslog=syslog_service,
                   minimal=service),
        "v": dict(minimal=bare_version(line)),
        "mt": dict(procrun=message, es_text=message),
        "tr": dict(minimal=X.minimal_trace(line)),
        "un": dict(minimal=X.minimal_user(line)),
        "span": dict(
            syslog=F.to_variant_object(
                X.span_of(X.syslog_span_name(message), "SystemLog", X.syslog_message(message))
            ),
            minimal=F.to_variant_object(X.span_of("RawLogLine", "Text", X.minimal_message(line))),
        ),
    }
    as_text = ["pid", "l", "lg", "tn", "v", "mt", "trace_id", "transaction_id", "tr", "un"]
    fields: dict[str, Column] = {}
    for name in [*as_text, "span", "ex"]:
        kinds = dict(text_columns.get(name, {}))
        if name in json:
            kinds["json"] = json[name]
        kinds["canonical"] = own(name) if name in as_text else R.member(record, name)
        column = _by_format(**kinds)
        fields[name] = pinned(F.coalesce(column, version) if name == "v" else column)
    df = df.withColumns(fields)
    df = with_arguments(df, F.col("format") == "json", options)
    extra = F.map_filter(record, lambda key, _: ~key.isin(RENDERED))
    df = df.withColumns(
        {
            "args": pinned(
                _by_format(
                    json=F.col("_json_args"),
                    canonical=R.member(record, "args"),
                    procrun=empty_object,
                    es_text=empty_object,
                )
            ),
            "extra": F.when((F.col("format") == "canonical") & (F.size(extra) > 0), extra),
            "raw_record": F.when(F.col("format") == "canonical", F.to_json(record)),
            "tz_offset": T.offset_of(F.col("t")),
        }
    )
    return df.select(*COLUMNS, *carry)


def normalize(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Canonical records of a line table (``line, file_path, file_block_start, line_seq``)."""
    return with_fields(timed(lines, options), options)


def rendered(records: DataFrame) -> Column:
    """One JSON object per record: absent members left out, non-ASCII text as it is.

    Records that came in canonical form go out with all their members and JSON types.
    """
    return F.coalesce(F.col("raw_record"), F.to_json(F.struct(*RENDERED)))


def normalize_json(df: DataFrame, column: str, options: Options = DEFAULT) -> DataFrame:
    """Replace a column of single JSON records by their canonical form, as JSON text in ``out``.

    Other JSON values are treated as text lines; what is no JSON at all gives a record with just
    the time, the text and level Error.
    """
    kept = df.columns
    raw = F.col(column)
    given = df.withColumn("_given", F.struct(*kept)).withColumn("_text", strip(raw))
    # the array wrapper tells one JSON value of any kind from anything else
    given = given.withColumn("_values", F.from_json(F.concat(F.lit("["), "_text", F.lit("]")), "array<variant>", R.STRICT))
    value = F.get("_values", F.lit(0))
    plain = ~F.startswith("_text", F.lit("{")) & (F.size("_values") == 1) & F.try_parse_json("_text").isNotNull()
    spaced = F.regexp_replace(
        F.to_json(value), r'((?:"(?:[^"\\]++|\\.)*+"|[^",:]++)*+)([,:])', "$1$2 "
    )
    given = given.withColumn("line", F.when(plain, spaced).otherwise(F.col("_text")))
    given = given.select(
        "_given", "_text", raw.alias("_raw"), F.coalesce(plain, F.lit(False)).alias("_plain"), "line",
        F.lit("").alias("file_path"), F.lit(0).cast("bigint").alias("file_block_start"),
        F.lit(0).cast("bigint").alias("line_seq"),
    )
    timed_lines = route.with_event_time(route.with_format(given, options), options)
    fields = with_fields(timed_lines, options, ("_given", "_raw", "_plain"))
    now = route.fallback_time(options)
    broken = F.to_json(F.struct(now.alias("t"), F.col("_raw").alias("mt"), F.lit("Error").alias("l")))
    valid = F.col("_plain") | F.col("format").isin(route.JSON, route.CANONICAL)
    out = F.when(valid, rendered(fields)).otherwise(broken)
    return fields.select(*[F.col("_given")[c].alias(c) for c in kept], out.alias("out"))
