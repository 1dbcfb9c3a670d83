"""Log lines written from the rows of an event table, one template per line shape.

They stand in for log files when the input is a table: the same rows give the same text in any
SQL engine, so what a parser reads back can be checked against the event columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolog.sources.lookup import spread

SHAPES = [
    "procrun", "syslog", "es_text", "minimal_dotted", "minimal_piped", "json_nested", "json_flat",
    "canonical",
]
# a line of an event takes some 0.1 to 0.3 ms to read: a task takes seconds however many events there are
ROWS_PER_TASK = 50_000


def stamp(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def templates() -> dict[str, Column]:
    """One log line per shape, from the columns of an event row."""
    event, user, kind, props = (F.col(c) for c in ("event_id", "user_id", "event_type", "props"))
    digit, node = event % 10, user % 5
    sec = stamp("yyyy-MM-dd HH:mm:ss")
    sec3, sec3c = stamp("yyyy-MM-dd HH:mm:ss.SSS"), stamp("yyyy-MM-dd HH:mm:ss,SSS")
    iso3c = stamp("yyyy-MM-dd'T'HH:mm:ss,SSS")
    iso6 = stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    dotted = stamp("dd.MM.yyyy HH:mm:ss")
    return {
        "procrun": _text("[", sec, "] [info] [ ", user, "] ", kind, " done version=1.2.", digit),
        "syslog": _text(
            iso6, "+03:00 host-", node, " rabbitmq[", user, "]: AMQP connection <0.", event,
            ".0> closed, vhost:/, user ", kind,
        ),
        "es_text": _text(
            "[", iso3c, "][WARN][o.e.t.Service] [", user, "] [", kind, "] slow shard v7.17.", digit
        ),
        "minimal_dotted": _text(dotted, " ", kind, " failed (job-", user, ") UserName: u", user),
        "minimal_piped": _text(sec3, " worker", user, " | error in ", kind, " build 2.0.", digit),
        "json_nested": _text(
            '{"@timestamp":"', iso6, 'Z","log":{"level":"error","logger":"L1"},"process":{"pid":',
            user, ',"name":"p"},"trace":{"id":"t', event, '"},"service":{"name":"', kind,
            '","version":"1.0.', digit, '"},"message":"m', event, '","props":', props, "}",
        ),
        "json_flat": _text(
            '{"timestamp":"', sec3c, '","level":"Information","component":"', kind,
            '","cluster.name":"c1","node.name":"n', node, '","msg":"rel [3.1.', digit,
            '] ok","error":{"code":', user, "}}",
        ),
        "canonical": _text(
            '{"t":"', sec3, '+00:00","pid":"', user, '","l":"Info","lg":"', kind, '","tn":"n', node,
            '","v":"1.0.0","mt":"m', event, '"}',
        ),
    }


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/events.parquet")
    return spread(rows, "event_id", "ts", "user_id", rows_per_task=ROWS_PER_TASK)


def lines_of(df: DataFrame, line: Column) -> DataFrame:
    """Line table of an event table: the event type plays the file, the event id the line number."""
    return df.select(
        line.alias("line"),
        _text("/logs/", F.col("event_type"), ".log").alias("file_path"),
        F.lit(0).cast("bigint").alias("file_block_start"),
        F.col("event_id").alias("line_seq"),
    )


def shaped_lines(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """Every event as a line of one shape."""
    return lines_of(events(spark, folder), templates()[shape])


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a line, its shape chosen by the event id."""
    written = templates()
    kind = F.col("event_id") % len(SHAPES)
    line = F.when(kind == 0, written[SHAPES[0]])
    for i, shape in enumerate(SHAPES[1:], 1):
        line = line.when(kind == i, written[shape])
    return lines_of(events(spark, folder), line)


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document: the source plays the file, (document, position) the order."""
    docs = spread(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    parts = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return parts.select(
        "line",
        _text("/docs/", F.col("source"), ".log").alias("file_path"),
        F.col("doc_id").alias("file_block_start"),
        F.col("pos").cast("bigint").alias("line_seq"),
    )
