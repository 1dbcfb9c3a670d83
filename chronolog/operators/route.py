"""Which kind of line is it, and when did its event happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions import records as R
from chronolog.functions import times as T
from chronolog.functions.fixed import (
    CANONICAL_KEYS,
    CANONICAL_TIME,
    DAY_FIRST_TIME,
    ES_LINE,
    ES_PARTS,
    LINE_START_TIME,
    MIXED_LINE,
    PROCRUN_LINE,
    SYSLOG_LINE,
    SYSLOG_PARTS,
    TIME_KEYS,
    YEAR_FIRST_TIME,
)
from chronolog.functions.text import groups, pinned, strip
from chronolog.options import DEFAULT, Options

CANONICAL, JSON, PROCRUN, ES_TEXT, SYSLOG, MINIMAL = (
    "canonical", "json", "procrun", "es_text", "syslog", "minimal",
)


def drop_blank(df: DataFrame, text: str = "line") -> DataFrame:
    """Strip every line and drop those with nothing left."""
    return df.withColumn(text, pinned(strip(F.col(text)))).where(F.col(text) != "")


def is_canonical(record: Column) -> Column:
    """Has all required keys, and ``t`` is a string in the canonical form."""
    present = F.lit(True)
    for key in CANONICAL_KEYS:
        present = present & R.has(record, key)
    return F.coalesce(present & R.text(R.member(record, "t")).rlike(CANONICAL_TIME), F.lit(False))


def is_procrun(line: Column) -> Column:
    return F.startswith(line, F.lit("[")) & line.rlike(PROCRUN_LINE)


def is_es_text(line: Column) -> Column:
    return F.contains(line, F.lit("][")) & line.rlike(ES_LINE)


def is_syslog(line: Column) -> Column:
    return line.rlike(SYSLOG_LINE)


def es_parts(line: Column) -> Column:
    """Six parts of a search-engine line, also when another log's prefix stands before it."""
    plain = F.when(F.startswith(line, F.lit("[")), line).otherwise(
        F.regexp_extract(line, MIXED_LINE, 1)
    )
    return groups(plain, ES_PARTS, 6)


def syslog_parts(line: Column) -> Column:
    return groups(line, SYSLOG_PARTS, 5)


def with_format(df: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Add ``format``, and the line's JSON object or text parts.

    The first kind that fits wins. A line its own parser cannot take apart becomes ``minimal``.
    """
    line = F.col("line")
    if options.prefixed_json:
        df = df.withColumn("_json", F.when(F.contains(line, F.lit("{")), F.substr(line, F.instr(line, "{"))))
        df = R.with_json_object(df, "_json").drop("_json")
    else:
        df = R.with_json_object(df, "line")
    text_kind = (
        F.when(is_procrun(line), F.lit(PROCRUN))
        .when(is_es_text(line), F.lit(ES_TEXT))
        .when(is_syslog(line), F.lit(SYSLOG))
        .otherwise(F.lit(MINIMAL))
    )
    kind = (
        F.when(F.col("record").isNull(), text_kind)
        .when(is_canonical(F.col("record")), F.lit(CANONICAL))
        .otherwise(F.lit(JSON))
    )
    df = with_parts(df.withColumn("_kind", kind), "_kind", options)
    unread = F.col("_kind").isin(ES_TEXT, SYSLOG) & F.col("parts").isNull()
    kind = F.when(unread, F.lit(MINIMAL)).otherwise(F.col("_kind"))
    return df.withColumn("format", pinned(kind)).drop("_kind")


def with_parts(df: DataFrame, kind: str, options: Options = DEFAULT) -> DataFrame:
    """Add the ``parts`` of search-engine and syslog lines, NULL where they cannot be read."""
    line = F.col("line")
    found = F.when(F.col(kind) == SYSLOG, syslog_parts(line))
    wanted = F.when(F.col(kind) == SYSLOG, F.lit(5))
    if options.es_text == "parse":
        found = F.when(F.col(kind) == ES_TEXT, es_parts(line)).otherwise(found)
        wanted = F.when(F.col(kind) == ES_TEXT, F.lit(6)).otherwise(wanted)
    df = df.withColumn("_found", found)
    return df.withColumn("parts", F.when(F.size("_found") == wanted, F.col("_found"))).drop("_found")


def json_time_text(record: Column, keys: list[str] = TIME_KEYS) -> Column:
    return F.coalesce(*[R.truthy(R.member(record, key)) for key in keys])


def with_event_time(df: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Add ``t``, ``time_source`` and ``event_ts`` to formatted lines."""
    line, kind = F.col("line"), F.col("format")
    minimal = kind == MINIMAL
    keys = {"ecs": ["@timestamp"], "es_json": ["timestamp"]}.get(options.json_rules, TIME_KEYS)
    written = (
        F.when(kind == CANONICAL, R.text(R.member(F.col("record"), "t")))
        .when(kind == JSON, json_time_text(F.col("record"), keys))
        .when(kind == PROCRUN, F.substring(line, 2, 19))
        .when(kind.isin(ES_TEXT, SYSLOG), F.get("parts", F.lit(0)))
        .otherwise(F.regexp_extract(line, LINE_START_TIME, 1))
    )
    # the two searches run over whole minimal lines; each result column is used several times below
    df = df.withColumn("_day_first", F.when(minimal, F.regexp_extract(line, DAY_FIRST_TIME, 0)))
    df = df.withColumn("_found", T.day_first_time(F.col("_day_first")))
    df = df.withColumn(
        "_year_first", F.when(minimal & F.col("_found").isNull(), F.regexp_extract(line, YEAR_FIRST_TIME, 0))
    )
    df = df.withColumn("_found", F.coalesce("_found", T.year_first_time(F.col("_year_first"))))
    df = df.withColumn("_written", F.when(F.col("_found").isNull(), written))
    df = df.withColumn(
        "_parsed",
        F.when(kind == CANONICAL, F.col("_written")).otherwise(T.parse_time(F.col("_written"), options.day_first)),
    )
    source = (
        F.when(F.col("_found").isNotNull(), F.lit("event_regex"))
        .when(F.col("_parsed").isNull(), F.lit("fallback_now"))
        .when(kind.isin(CANONICAL, JSON), F.lit("json_key"))
        .otherwise(F.lit("line_start"))
    )
    df = df.withColumn("time_source", pinned(source))
    df = df.withColumn("t", pinned(F.coalesce("_found", "_parsed", fallback_time(options))))
    df = df.withColumn("event_ts", T.instant_of(F.col("t")))
    return df.drop("_day_first", "_year_first", "_found", "_written", "_parsed")


def fallback_time(options: Options = DEFAULT) -> Column:
    """One time for every line without its own: given, or the start of the run."""
    if options.fallback_time is not None:
        return F.lit(options.fallback_time)
    return F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(T.UTC))
