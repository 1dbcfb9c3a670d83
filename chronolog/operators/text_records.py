"""Record columns of text lines: procrun, search-engine, syslog and minimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolog.functions.fixed import (
    BRACKETED_PID,
    MESSAGE_SERVICES,
    SPACE,
    TAG,
    TEXT_LEVELS,
    TRACE_FIELD,
    TRAILING_PID,
    USER_FIELD,
    VHOST,
    WS,
)
from chronolog.functions.text import collapse_spaces, contains_any, let, nonempty, strip

PROCRUN_HEAD = 28  # characters of "[YYYY-MM-DD HH:MM:SS] [info]"


def procrun_tail(line: Column) -> Column:
    return F.substr(line, F.lit(PROCRUN_HEAD + 1))


def procrun_pid(tail: Column) -> Column:
    """Content of the third bracket, ``1`` without one."""
    return F.when(
        tail.rlike(r"(?d)\[.*?\]"), strip(F.regexp_extract(tail, r"(?d)\[(.*?)\]", 1))
    ).otherwise(F.lit("1"))


def procrun_message(tail: Column, keep_two_bracket_message: bool = False) -> Column:
    """What follows the third bracket, with further brackets opened up into blanks."""
    rest = F.regexp_replace(
        F.regexp_replace(tail, r"(?ds)^.*?\[[^\n]*?\](.*)$", "$1"), r"(?d)\[(.*?)\]", " $1 "
    )
    lone = strip(tail) if keep_two_bracket_message else F.lit("")
    return F.when(tail.rlike(r"(?d)\[.*?\]"), strip(rest)).otherwise(lone)


def es_level(level: Column) -> Column:
    return F.replace(F.initcap(level), F.lit("Critical"), F.lit("Fatal"))


def syslog_service(message: Column, process: Column) -> Column:
    """First known service named in the message, else the logging process."""
    first, *others = MESSAGE_SERVICES
    case = F.when(F.contains(message, F.lit(first)), F.lit(first))
    for service in others:
        case = case.when(F.contains(message, F.lit(service)), F.lit(service))
    return case.otherwise(process)


def syslog_span_name(message: Column) -> Column:
    return (
        F.when(F.contains(message, F.lit("AMQP connection")), F.lit("AMQP connection"))
        .when(F.contains(message, F.lit("closing")), F.lit("Closing connection"))
        .otherwise(F.lit("SystemLog"))
    )


def without_tags(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, TAG, "")).otherwise(text)


def syslog_message(message: Column) -> Column:
    """Without tags and virtual hosts, blanks collapsed."""
    return collapse_spaces(F.regexp_replace(without_tags(message), VHOST, ""))


def span_of(name: Column | str, kind: str, message: Column) -> Column:
    return F.struct(
        F.lit("Info").alias("status"),
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        F.lit(kind).alias("messageType"),
        message.alias("message"),
    )


def minimal_level(line: Column) -> Column:
    """First level whose words occur as whole words, ``Info`` without any."""
    return whole_word_level(line, TEXT_LEVELS)


def whole_word_level(line: Column, levels: list[tuple[str, list[str], str]]) -> Column:
    def of_text(low: Column) -> Column:
        case = F
        for level, hints, words in levels:
            case = case.when(contains_any(low, hints) & low.rlike(words), F.lit(level))
        return case.otherwise(F.lit("Info"))

    return let(F.lower(line), of_text)


def minimal_pid(line: Column) -> Column:
    """Text in the first angle or round brackets, else a trailing number, else ``1``."""
    bracketed = F.when(
        F.contains(line, F.lit("<")) | F.contains(line, F.lit("(")),
        nonempty(F.regexp_extract(line, BRACKETED_PID, 1)),
    )
    numbered = F.when(
        F.right(line, F.lit(1)).between("0", "9"), nonempty(F.regexp_extract(line, TRAILING_PID, 1))
    )
    return F.coalesce(bracketed, numbered, F.lit("1"))


def minimal_logger(line: Column, service: Column) -> Column:
    """Last of several words before the first pipe, else the service of the file."""
    before = strip(F.substring_index(line, "|", 1))
    word = F.when(F.contains(line, F.lit("|")), F.regexp_extract(before, rf"{WS}([^{SPACE}]+)$", 1))
    return F.coalesce(nonempty(word), service)


def _field(line: Column, hint: str, pattern: str) -> Column:
    found = F.when(F.contains(F.lower(line), F.lit(hint)), F.regexp_extract(line, pattern, 1))
    return nonempty(strip(found))


def minimal_user(line: Column) -> Column:
    return _field(line, "username:", USER_FIELD)


def minimal_trace(line: Column) -> Column:
    return _field(line, "trace:", TRACE_FIELD)


def minimal_message(line: Column) -> Column:
    """The line without tags; inner blanks stay."""
    return strip(without_tags(line))
