"""Record forms of earlier releases, each under its own name; none is part of the default path."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolog.functions import records as R
from chronolog.functions import times as T
from chronolog.functions.fixed import (
    ANY_TIME,
    DAY_FIRST_TIME,
    ES_PARTS,
    LINE_START_TIME,
    SYSLOG_PARTS,
    YEAR_FIRST_TIME,
    ZONED_TIME,
)
from chronolog.functions.text import (
    collapse_spaces,
    groups,
    nonempty,
    pinned,
    service_from_path,
    strip,
)
from chronolog.functions.versions import bare_version, version_from_text
from chronolog.operators import json_records as J
from chronolog.operators import text_records as X
from chronolog.operators.route import drop_blank, fallback_time
from chronolog.options import DEFAULT, Options
from chronolog.plans.merge import with_position
from chronolog.sources.lookup import lookup_by_file, materialized

# The early release's time keys, service prefix, sample size and line patterns.
EARLY_TIME_KEYS = ["@timestamp", "timestamp", "date", "time"]
UNKNOWN_SERVICE = "DUNNOSERVICE"
SAMPLE_LINES = 20
PLACE_COLUMNS = ("file_path", "file_block_start", "line_seq")
EARLY_ECS = r'^\{"@timestamp":"'
EARLY_PROCRUN = r"^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] \[info\]"
EARLY_SYSLOG = (
    r"(?Ud)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.\d{6}\+\d{2}:\d{2} [a-zA-Z0-9_-]+ \w+\[\d+\]:"
)
ECS_SPAN_OUT = [
    "@timestamp", "log.level", "message", "labels", "ecs", "host", "log", "process", "service",
]
# English level words of the middle release.
ENGLISH_LEVELS = [
    ("Error", ["err"], r"(?U)\b(error|err)\b"),
    ("Warn", ["warn"], r"(?U)\b(warn|warning)\b"),
    ("Debug", ["debug"], r"(?U)\b(debug)\b"),
    ("Fatal", ["fatal", "crit"], r"(?U)\b(fatal|crit|critical)\b"),
]


# --- time zone of a file, and numbers for files without a service


def sample_time_zones(lines: DataFrame, sample: int = SAMPLE_LINES) -> DataFrame:
    """Offset of the first zoned time among each file's first lines, for files that have one.

    Only places and offsets are ranked, never line texts, and Spark keeps only the first places per file and task before
    it shuffles, so a file with most of all lines costs no more than any other.
    """
    zone = pinned(F.regexp_extract("line", ZONED_TIME, 1))
    narrow = lines.select("file_path", "file_block_start", "line_seq", zone.alias("zone"))
    in_file = Window.partitionBy("file_path").orderBy("file_block_start", "line_seq")
    zones = narrow.withColumn("_row", F.row_number().over(in_file)).where(F.col("_row") <= sample)
    return (
        zones.where(F.col("zone") != "").groupBy("file_path").agg(F.min_by("zone", "_row").alias("time_zone"))
    )


def with_time_zone(lines: DataFrame) -> DataFrame:
    """Lines with the sampled ``time_zone`` of their file, ``+00:00`` when none was found."""
    known = lookup_by_file(lines, sample_time_zones(lines))
    return known.withColumn("time_zone", F.coalesce("time_zone", F.lit(T.UTC)))


def labelled_time(time: Column, zone: Column) -> Column:
    """The wall clock of a time with the file's zone put on it, whatever offset it had."""
    return F.concat(F.substring(time, 1, 23), zone)


def unknown_services(paths: DataFrame) -> DataFrame:
    """``DUNNOSERVICE<n>`` per distinct path, numbered by path."""
    numbered = with_position(paths.select("file_path").distinct().orderBy("file_path"), "_n")
    return numbered.select(
        "file_path", F.concat(F.lit(UNKNOWN_SERVICE), (F.col("_n") + 1).cast("string")).alias("unknown_service")
    )


# --- the early release's record: t, service, l, lg, pid, span


def _early_level(level: Column) -> Column:
    for long, short in (("Information", "Info"), ("Warning", "Warn"), ("CRITICAL", "FATAL")):
        level = F.replace(level, F.lit(long), F.lit(short))
    return level


def _name_span(text: Column) -> Column:
    return F.when(text != "", F.to_variant_object(F.struct(text.alias("name"))))


def _ecs_span(record: Column) -> Column:
    rest = F.map_filter(record, lambda key, _: ~key.isin([*ECS_SPAN_OUT, "name", "original_log_info"]))
    message = R.member(record, "message")
    given = F.create_map(
        F.lit("name"), F.when(R.truthy(message).isNotNull(), message).otherwise(R.member(record, "name")),
        F.lit("original_log_info"),
        F.coalesce(R.nested(R.member(record, "log"), "original"), R.member(record, "original_log_info")),
        F.lit("host"), R.member(record, "host"),
    )
    return F.to_variant_object(F.map_concat(rest, F.map_filter(given, lambda _, value: value.isNotNull())))


def _early_time_text(record: Column) -> Column:
    """The first time key that is present decides, even when empty."""
    case = F.when(R.has(record, EARLY_TIME_KEYS[0]), R.truthy(R.member(record, EARLY_TIME_KEYS[0])))
    for key in EARLY_TIME_KEYS[1:]:
        case = case.when(R.has(record, key), R.truthy(R.member(record, key)))
    return case


def early_format(line: Column, record: Column) -> Column:
    """Kind of line, in the early release's order; a ``"t":`` in an object passes it through."""
    return (
        F.when(record.isNotNull() & F.contains(line, F.lit('"t":')), F.lit("canonical"))
        .when(record.isNotNull() & line.rlike(EARLY_ECS), F.lit("ecs"))
        .when(record.isNotNull(), F.lit("json"))
        .when(line.rlike(EARLY_PROCRUN) & line.rlike(r"^\[[^\n]*?\][^\n]*?\[[^\n]*?\][^\n]*?\["), F.lit("procrun"))
        .when(line.rlike(ES_PARTS), F.lit("es_text"))
        .when(line.rlike(EARLY_SYSLOG) & line.rlike(SYSLOG_PARTS), F.lit("syslog"))
        .otherwise(F.lit("other"))
    )


def early_records(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Records with ``t, service, l, lg, pid, span``; naive times get the file's sampled zone.

    Files without a service in some record are numbered by path; ECS records without one get
    numbers of their own, after the files, in file and line order.
    """
    if options.fallback_time is None:
        # several jobs evaluate the records: all of them take the same time for lines without one
        now = datetime.now(timezone.utc).isoformat(" ", "milliseconds")
        options = replace(options, fallback_time=now)
    df = R.with_json_object(drop_blank(with_time_zone(lines)), "line")
    line, record, zone = F.col("line"), F.col("record"), F.col("time_zone")
    df = df.withColumn("format", pinned(early_format(line, record)))
    kind = F.col("format")
    parts = F.when(kind == "es_text", groups(line, ES_PARTS, 6)).when(kind == "syslog", groups(line, SYSLOG_PARTS, 5))
    df = df.withColumn("parts", pinned(parts))
    tail, part = X.procrun_tail(line), lambda i: F.get("parts", F.lit(i))
    written = (
        F.when(kind == "ecs", R.truthy(R.member(record, "@timestamp")))
        .when(kind == "json", _early_time_text(record))
        .when(kind == "procrun", F.substring(line, 2, 19))
        .when(kind.isin("es_text", "syslog"), part(0))
        .when(kind == "other", F.regexp_extract(line, ANY_TIME, 0))
    )
    df = df.withColumn("_written", pinned(written))
    df = df.withColumn("_time", pinned(T.parse_time(F.col("_written"), options.day_first)))
    own_zone = kind.isin("ecs", "syslog")
    stamped = F.when(own_zone, F.col("_time")).otherwise(labelled_time(F.col("_time"), zone))
    named = R.truthy(R.nested(R.member(record, "service"), "name"))
    service = (
        F.when(kind == "ecs", named)
        .when(kind == "json", F.coalesce(named, R.truthy(R.member(record, "serviceName"))))
        .when(kind == "procrun", F.lit("procrun"))
        .when(kind == "es_text", part(4))
        .when(kind == "syslog", part(2))
    )
    process = R.member(record, "process")
    pid = (
        F.when(
            kind == "ecs",
            F.concat_ws(
                "+",
                F.coalesce(R.text(R.nested(process, "pid")), F.lit("1")),
                F.coalesce(R.text(R.nested(R.nested(process, "thread"), "id")), F.lit("1")),
            ),
        )
        .when(kind == "procrun", X.procrun_pid(tail))
        .when(kind.isin("es_text", "syslog"), part(3))
    )
    level = (
        F.when(kind == "ecs", _early_level(F.coalesce(R.text(R.member(record, "log.level")), F.lit("Information"))))
        .when(
            kind == "json",
            _early_level(
                F.coalesce(R.truthy(R.member(record, "log.level")), R.truthy(R.member(record, "level")), F.lit("Info"))
            ),
        )
        .when(kind == "es_text", F.initcap(part(1)))
        .otherwise(F.lit("Info"))
    )
    span = (
        F.when(kind == "ecs", _ecs_span(record))
        .when(kind == "json", F.to_variant_object(record))
        .when(kind == "procrun", _name_span(X.procrun_message(tail)))
        .when(kind == "es_text", _name_span(strip(part(5))))
        .when(kind == "syslog", _name_span(strip(part(4))))
        .otherwise(_name_span(line))
    )
    logger = (
        F.when(kind == "ecs", R.text(R.nested(R.member(record, "log"), "logger")))
        .when(kind == "json", R.truthy(R.member(record, "logger")))
        .when(kind == "procrun", F.lit("Commons Daemon"))
        .when(kind == "es_text", part(2))
        .when(kind == "syslog", part(1))
    )
    canonical = kind == "canonical"

    def own(key: str, made: Column) -> Column:
        return F.when(canonical, R.text(R.member(record, key))).otherwise(made)

    records = df.select(
        own("t", F.coalesce(stamped, fallback_time(options))).alias("t"),
        pinned(own("service", service)).alias("service"),
        own("l", level).alias("l"),
        own("lg", logger).alias("lg"),
        own("pid", pid).alias("pid"),
        F.when(canonical, R.member(record, "span")).otherwise(span).alias("span"),
        F.when(canonical, F.to_json(record)).alias("raw_record"),
        "format", "file_path", "file_block_start", "line_seq",
    )
    return _with_unknown_services(records)


def _with_unknown_services(records: DataFrame) -> DataFrame:
    nameless = F.col("service").isNull() & (F.col("format") != "canonical")
    single = nameless & (F.col("format") == "ecs")
    # numbering needs several passes over these records: they are made once, without what only the others hold
    kept = records.where(nameless).withColumn("span", F.when(single, F.col("span")))
    kept = materialized(kept)
    per_file = unknown_services(kept.where(~single))
    named = lookup_by_file(records.where(~single), per_file)
    named = named.withColumn("service", F.when(nameless, F.col("unknown_service")).otherwise(F.col("service")))
    # ECS records count one by one, after the files
    order = ["file_path", "file_block_start", "line_seq"]
    singles = with_position(kept.where(single).orderBy(*order), "_n")
    number = (F.col("_n") + 1 + per_file.count()).cast("string")
    singles = singles.withColumn("service", F.concat(F.lit(UNKNOWN_SERVICE), number)).drop("_n")
    both = named.drop("unknown_service").unionByName(singles)
    logger = F.when(F.col("format") == "canonical", F.col("lg")).otherwise(F.coalesce("lg", "service"))
    return both.withColumn("lg", logger)


# --- forms of the middle release


def simple_syslog(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Syslog lines with the host as logger, the process as tenant and the plain message.

    Lines of another form become minimal records, whose own columns are NULL for syslog lines. One pass gives both.
    """
    df = drop_blank(lines).withColumn("parts", pinned(groups(F.col("line"), SYSLOG_PARTS, 5)))
    part = lambda i: F.get("parts", F.lit(i))
    syslog = F.size("parts") == 5
    other = _raw_line_columns(F.col("line"), options)
    own = {
        "t": F.coalesce(T.parse_time(part(0)), fallback_time(options)),
        "pid": part(3), "l": F.lit("Info"), "lg": part(1), "mt": strip(part(4)), "tn": part(2),
        "v": version_from_text(part(4)), "args": F.parse_json(F.lit("{}")),
    }
    either = [F.when(syslog, c).otherwise(other.get(name, F.lit(None))).alias(name) for name, c in own.items()]
    rest = [F.when(~syslog, c).alias(name) for name, c in other.items() if name not in own]
    return _with_raw_line_times(df, F.col("line"), ~syslog).select(*either, *PLACE_COLUMNS, *rest)


def english_level(line: Column) -> Column:
    return X.whole_word_level(line, ENGLISH_LEVELS)


def _with_raw_line_times(df: DataFrame, line: Column, wanted: Column) -> DataFrame:
    """The service, and for ``wanted`` lines the time in the line or else at its start."""
    event = F.coalesce(
        T.day_first_time(F.regexp_extract(line, DAY_FIRST_TIME, 0)),
        T.year_first_time(F.regexp_extract(line, YEAR_FIRST_TIME, 0)),
    )
    logged = T.parse_time(nonempty(F.regexp_extract(line, LINE_START_TIME, 1)))
    df = df.withColumn("service", service_from_path(F.col("file_path"))).withColumn("_event", F.when(wanted, event))
    return df.withColumn("_logged_at", F.when(wanted & F.col("_event").isNull(), logged))


def _raw_line_columns(line: Column, options: Options) -> dict[str, Column]:
    """A minimal record that keeps its line, over what ``_with_raw_line_times`` adds."""
    return {
        "t": F.coalesce("_event", "_logged_at", fallback_time(options)),
        "_raw_line": line, "_logged_at": F.col("_logged_at"),
        "l": english_level(line), "pid": X.minimal_pid(line),
        "v": bare_version(line), "lg": X.minimal_logger(line, F.col("service")),
        "tn": F.col("service"),
        "span": F.to_variant_object(X.span_of("RawLogLine", "Text", collapse_spaces(X.without_tags(line)))),
    }


def minimal_with_raw_line(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Minimal records that keep the line itself, and the line-start time when it is all there is."""
    line = F.col("line")
    df = _with_raw_line_times(drop_blank(lines), line, F.lit(True))
    return df.select(*[c.alias(name) for name, c in _raw_line_columns(line, options).items()], *PLACE_COLUMNS)


def keep_all_json(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """JSON lines, also after a text prefix, with all their keys and the missing canonical ones.

    The result has the enriched object as ``record``; lines that hold no JSON object have their
    minimal record there. One pass gives both.
    """
    whole = drop_blank(lines).withColumn("_whole", F.col("line"))
    found = F.when(F.contains("line", F.lit("{")), F.substr("line", F.instr("line", "{")))
    df = R.with_json_object(whole.withColumn("line", found), "line").withColumn("record", pinned(F.col("record")))
    plain = F.col("record").isNull()
    df = _with_raw_line_times(df, F.col("_whole"), plain)
    pairs = [part for name, c in _raw_line_columns(F.col("_whole"), options).items() for part in (F.lit(name), c.cast("variant"))]
    minimal = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    case = F.when(R.has(F.col("record"), "t"), R.truthy(R.member(F.col("record"), "t")))
    written = case.otherwise(_early_time_text(F.col("record")))
    df = df.withColumn("_time", T.parse_time(pinned(written), options.day_first))
    df = df.withColumn("_time", F.coalesce("_time", fallback_time(options)))
    df, view = J.with_view(df)
    full = J.enriched(view, F.col("line"), F.col("service"), F.col("_time"))
    return df.select(F.when(plain, minimal).otherwise(full).alias("record"), *PLACE_COLUMNS)
