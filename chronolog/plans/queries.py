"""Named queries over the provided tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolog.functions import records as R
from chronolog.functions import text as X
from chronolog.functions import times as T
from chronolog.functions.versions import bare_version, version_from_text
from chronolog.operators import json_records as J
from chronolog.operators import route
from chronolog.operators import text_records as L
from chronolog.operators import variants as V
from chronolog.options import DEFAULT, Options
from chronolog.plans import merge as M
from chronolog.plans import normalize as N
from chronolog.plans import sample_lines as S
from chronolog.session import configure
from chronolog.sources.lookup import spread

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["file_path", "line_seq"]
SPAN = ["status", "name", "messageType", "message"]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return S.events(configure(spark), folder)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _event() -> Column:
    return F.col("event_id")


def _user() -> Column:
    return F.col("user_id")


def _digit() -> Column:
    return F.col("event_id") % 10


def _cases(*columns: Column) -> Column:
    """One of several forms per event, by event id."""
    case = F.when(_event() % len(columns) == 0, columns[0])
    for i, column in enumerate(columns[1:], 1):
        case = case.when(_event() % len(columns) == i, column)
    return case


def _span(name: str) -> Column:
    return F.try_variant_get("span", f"$.{name}", "string")


def _read(spark: SparkSession, folder: str, line: Column) -> DataFrame:
    """Event rows, one JSON or text line each, with the line's JSON object."""
    df = _events(spark, folder).select("*", line.alias("line"))
    df = R.with_json_object(df, "line")
    return df.withColumn("service", X.service_from_path(_text("/logs/", F.col("event_type"), ".log")))


def _json_query(build: Callable[[], Column], out: Callable[[J.View], dict[str, Column]]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df, view = J.with_view(_read(spark, folder, build()))
        return df.select("event_id", *[column.alias(name) for name, column in out(view).items()])

    return run


# --- times


def parse_ts_iso(spark: SparkSession, folder: str) -> DataFrame:
    text = _text(S.stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "Z")
    df = _events(spark, folder).select("event_id", text.alias("written"))
    return df.select("event_id", T.parse_time(F.col("written")).alias("t"))


def parse_ts_offset(spark: SparkSession, folder: str) -> DataFrame:
    iso = S.stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = _cases(_text(iso, "+03:00"), _text(iso, "-0530"), _text(iso, " +05"), _text(iso, "-00:00"))
    df = _events(spark, folder).select("event_id", text.alias("written"))
    df = df.select("event_id", T.parse_time(F.col("written")).alias("t"))
    instant = F.date_format(T.instant_of(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS")
    return df.select("event_id", "t", T.offset_of(F.col("t")).alias("tz_offset"), instant.alias("instant"))


def parse_ts_notations(spark: SparkSession, folder: str) -> DataFrame:
    text = _cases(
        S.stamp("yyyy-MM-dd HH:mm:ss,SSS"),
        S.stamp("dd.MM.yyyy H:mm:ss"),
        S.stamp("yyyy/MM/dd HH:mm:ss"),
        _text(S.stamp("dd/MMM/yyyy:HH:mm:ss"), " +0300"),
        _text(S.stamp("EEE, dd MMM yyyy HH:mm:ss"), " GMT"),
        S.stamp("yyyyMMdd'T'HHmmss"),
        S.stamp("M/d/yyyy h:mm:ss a"),
        _text("not a time ", _user()),
        _text(S.stamp("yyyy-MM-dd HH:mm:ss"), " MSK"),
        _text(S.stamp("EEE MMM dd HH:mm:ss"), " MSK ", S.stamp("yyyy")),
        S.stamp("EEE MMM dd HH:mm:ss.SSSSSS yyyy"),
        _text(S.stamp("yyyy-MM-dd'T'HH:mm:ss"), "z"),
        _text(S.stamp("EEE, dd MMM yyyy HH:mm:ss"), " EST"),
        S.stamp("HH:mm:ss dd.MM.yyyy"),
        _text(S.stamp("yyyy-MM-dd"), " " * 60, S.stamp("HH:mm:ss.SSS"), "0" * 60),
    )
    df = _events(spark, folder).select("event_id", text.alias("written"))
    return df.select("event_id", T.parse_time(F.col("written")).alias("t"))


def format_ts(spark: SparkSession, folder: str) -> DataFrame:
    offset = _cases(F.lit("+00:00"), F.lit("+03:00"), F.lit("-05:30"))
    df = _events(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), offset.alias("tz"))
    return df.select("event_id", T.format_time(F.col("ts"), F.col("tz")).alias("t"))


def event_time_regex(spark: SparkSession, folder: str) -> DataFrame:
    line = _cases(
        _text("job ", S.stamp("dd.MM.yyyy H:mm:ss"), " done"),
        _text("at ", S.stamp("yyyy-MM-dd HH:mm:ss.SSS"), "+03:00 | x"),
        _text("31.02.2024 00:00:00 ", S.stamp("yyyy-MM-dd  HH:mm:ss"), " y"),
        _text("nothing ", _user()),
    )
    df = _events(spark, folder).select("event_id", line.alias("line"))
    return df.select("event_id", T.event_time_in_text(F.col("line")).alias("t"))


def line_start_time(spark: SparkSession, folder: str) -> DataFrame:
    line = _cases(
        _text(S.stamp("yyyy-MM-dd'T'HH:mm:ss,SSS"), " started"),
        _text("  ", S.stamp("yyyy-MM-dd'T'HH:mm:ss"), " started"),
        _text("x ", S.stamp("yyyy-MM-dd'T'HH:mm:ss"), " started"),
    )
    df = _events(spark, folder).select("event_id", line.alias("line"))
    return df.select("event_id", T.line_start_time(F.col("line")).alias("t"))


# --- routing


def drop_blank(spark: SparkSession, folder: str) -> DataFrame:
    lines = route.drop_blank(S.document_lines(configure(spark), folder))
    return lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters")
    )


def route_format(spark: SparkSession, folder: str) -> DataFrame:
    return route.with_format(S.mixed_lines(configure(spark), folder)).select(*KEY, "format")


def is_canonical(spark: SparkSession, folder: str) -> DataFrame:
    rest = _text('"pid":"', _user(), '","l":"Info","lg":"x","tn":"n","v":"1"}')
    stamp = S.stamp("yyyy-MM-dd HH:mm:ss.SSS")
    line = _cases(
        _text('{"t":"', stamp, '+00:00",', rest),
        _text('{"t":"', stamp, '",', rest),
        _text('{"t":', _user(), ",", rest),
        _text('{"t":"', stamp, '+00:00","pid":"', _user(), '","l":"Info","lg":"x","v":"1"}'),
        _text('{"t":"', stamp, '+00:00",', rest, " x"),
    )
    df = R.with_json_object(_events(spark, folder).select("event_id", line.alias("line")), "line")
    canonical = F.coalesce(route.is_canonical(F.col("record")), F.lit(False))
    return df.select("event_id", canonical.cast("int").alias("canonical"))


def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    pair = _text('{"a":', _user(), "}")
    line = _cases(
        pair, _text(pair, " x"), _text(pair, "}"), _text(pair, "]x[{}"), _text(pair, '}]x[{"r":{}'),
        _text(pair, ',"r":{}'), _text("{'a':", _user(), "}"), _text('{"a":[{"b":{"c":', _user(), "}}]}"),
    )
    df = R.with_json_object(_events(spark, folder).select("event_id", line.alias("line")), "line")
    return df.select("event_id", F.col("record").isNotNull().cast("int").alias("valid"))


# --- whole records


def _normalized(shape: str, columns: list[str], options: Options = DEFAULT) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        records = N.normalize(S.shaped_lines(configure(spark), folder, shape), options)
        spans = [_span(c).alias("span_" + c.lower()) for c in SPAN] if "span" in columns else []
        return records.select(*KEY, *[c for c in columns if c != "span"], *spans)

    return run


def _merged(order: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        records = M.merge(S.mixed_lines(configure(spark), folder), order=order)
        chosen = records.select(*KEY, "t", "pid", "l", "lg", "tn", "v", "mt", "format", "time_source")
        return M.with_position(chosen)

    return run


def merge_procrun(spark: SparkSession, folder: str) -> DataFrame:
    records = M.merge(S.shaped_lines(configure(spark), folder, "procrun"))
    return M.with_position(records.select(*KEY, "t", "pid", "l", "lg", "tn", "v", "mt"))


def merge_rendered(spark: SparkSession, folder: str) -> DataFrame:
    records = M.merge(S.shaped_lines(configure(spark), folder, "procrun"))
    return M.with_position(records.select(*KEY, N.rendered(records).alias("value")))


def _ranked(order: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        timed = N.timed(S.mixed_lines(configure(spark), folder))
        keys = timed.select("t", "event_ts", *M.TIES)
        return M.with_position(M.sort_records(keys, order)).select(*KEY, "t", "position")

    return run


def sort_files(spark: SparkSession, folder: str) -> DataFrame:
    timed = N.timed(S.mixed_lines(configure(spark), folder))
    keys = timed.select("t", "event_ts", *M.TIES)
    return M.with_position(M.sort_within_files(keys)).select(*KEY, "t", "position")


def union_all(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    shapes = [N.normalize(S.shaped_lines(spark, folder, shape)) for shape in ("procrun", "json_flat")]
    return M.union_records(*shapes).select(*KEY, "t", "pid", "mt", "format")


def lines_per_file(spark: SparkSession, folder: str) -> DataFrame:
    return M.records_per_file(route.drop_blank(S.document_lines(configure(spark), folder)))


def merge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return M.merge_metrics(N.normalize(S.shaped_lines(configure(spark), folder, "canonical")))


# --- minimal text over documents, conversations and pages


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    lines = route.drop_blank(S.document_lines(configure(spark), folder))
    return lines.withColumn("service", X.service_from_path(F.col("file_path")))


DOC = ["file_path", "file_block_start", "line_seq"]


def _minimal(**columns: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        made = [make().alias(name) for name, make in columns.items()]
        return _documents(spark, folder).select(*DOC, *made)

    return run


def minimal_docs(spark: SparkSession, folder: str) -> DataFrame:
    records = N.normalize(S.document_lines(configure(spark), folder))
    return records.select(*DOC, "format", "pid", "l", "lg", "tn", "v", _span("message").alias("message"))


def minimal_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = spread(configure(spark).read.parquet(f"{folder}/conversations.parquet"), "conv_id")
    lines = turns.select(
        F.explode(F.split("text", "\n")).alias("line"), _text("/chat/", F.col("role"), ".log").alias("file_path"),
        F.col("conv_id").alias("file_block_start"), F.col("turn").alias("line_seq"),
    )
    records = N.normalize(lines)
    return records.groupBy("tn", "l").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length(_span("message"))).alias("characters")
    )


def page_tags(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(configure(spark).read.parquet(f"{folder}/pages.parquet"), "page_id")
    lines = pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line"))
    lines = route.drop_blank(lines)
    return lines.select(
        "page_id", "pos", L.minimal_pid(F.col("line")).alias("pid"),
        L.minimal_message(F.col("line")).alias("message"),
    )


# --- scalars


def _of_url(name: str, make: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pages = configure(spark).read.parquet(f"{folder}/pages.parquet")
        return pages.select("page_id", make(F.col("url")).alias(name))

    return run


def service_names(spark: SparkSession, folder: str) -> DataFrame:
    path = _cases(
        _text("/a/node_exporter-", _user(), ".log"), _text("/a/my-svc_", _user(), "a.log"), _text("C:\\l\\WEB", _user(), ".LOG"),
        _text("/a/.hidden", _user()), _text("/a/x", _user(), ".tar.gz"), F.lit("/a/"),
    )
    df = _events(spark, folder).select("event_id", path.alias("path"))
    return df.select("event_id", X.service_from_path(F.col("path")).alias("service"))


def version_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = _cases(
        _text("x 9.9.9 [1.2.", _digit(), "] version=7"), _text('{"version" : "a', _user(), '"}'),
        _text('"module":"m, Version=4.', _digit(), ', x"'), _text('"Version":"B', _user(), '"'),
        _text("version: 'v", _user(), "' 1.1.1"), _text("elasticsearch-7.17.", _digit(), ".jar"),
        _text("at 10.0.0.", _digit(), "!"), _text("none here ", _user()),
    )
    df = _events(spark, folder).select("event_id", text.alias("text"))
    return df.select("event_id", version_from_text(F.col("text")).alias("v"))


def syslog_span(spark: SparkSession, folder: str) -> DataFrame:
    message = _cases(
        _text("closing <0.", _event(), ".0>   vhost:/a, now"), _text("AMQP connection closing ", _user()),
        _text("TextExtractorService up ", _user()), _text("GenericService RabbitMqSubscriber\t", _user()),
    )
    df = _events(spark, folder).select("event_id", message.alias("message"))
    message = F.col("message")
    return df.select(
        "event_id", L.syslog_span_name(message).alias("name"),
        L.syslog_service(message, F.lit("rabbitmq")).alias("service"),
        L.syslog_message(message).alias("message"),
    )


def minimal_fields(spark: SparkSession, folder: str) -> DataFrame:
    line = _cases(
        _text("user job (job-", _user(), ") UserName: u", _user(), "  "), _text("a <main", _user(), ") b Trace:  t", _event()),
        _text("job finished ", _user(), "+7"), _text("job finished ", _user()), _text("x | Ошибка: не удалось ", _user()),
        _text("svc w", _user(), " | WARNING 1.2.", _digit(), ".4 crit"), _text("debugging infos, critical ", _user(), " x"),
        _text("debug: исключения trace:", _user(), " x"),
    )
    df = _events(spark, folder).select("event_id", X.strip(line).alias("line"))
    line = F.col("line")
    return df.select(
        "event_id", L.minimal_level(line).alias("l"), L.minimal_pid(line).alias("pid"),
        bare_version(line).alias("v"), L.minimal_logger(line, F.lit("Svc")).alias("lg"),
        L.minimal_user(line).alias("un"), L.minimal_trace(line).alias("tr"),
        V.english_level(line).alias("english_l"),
    )


# --- JSON rules


def _line() -> Column:
    return F.col("line")


def _service() -> Column:
    return F.col("service")


def _json_time_lines() -> Column:
    stamp = S.stamp("yyyy-MM-dd HH:mm:ss.SSS")
    return _cases(
        _text('{"t":"","@timestamp":"', stamp, '","time":"x"}'), _text('{"date":"', stamp, '","time":"x"}'),
        _text('{"timestamp":0,"time":"', stamp, '"}'), _text('{"date":false,"x":"', stamp, '"}'),
    )


def _json_level_lines() -> Column:
    return _cases(
        _text('{"log":{"level":"error"},"level":"WARN","u":', _user(), "}"),
        _text('{"log":{"level":""},"level":"WARN","u":', _user(), "}"),
        _text('{"level":0,"log.level":"Information","u":', _user(), "}"),
        _text('{"l":"Error","msg":"[WARNING] disk ', _user(), '"}'),
        _text('{"x":{"level":"error"},"u":', _user(), "}"),
        _text('{"level":{"a":', _user(), "}}"),
        _text('{"l":"critical","level":"x","u":', _user(), "}"),
    )


def _json_pid_lines() -> Column:
    return _cases(
        _text('{"pid":', _user(), ',"process":{"pid":1}}'), _text('{"pid":0,"process":{"pid":', _user(), "}}"),
        _text('{"process":{"pid":0,"id":"', _user(), '"}}'), _text('{"process.id":0,"process.pid":"p', _user(), '"}'),
        _text('{"process.id":', _user(), ',"process":"x"}'), F.lit('{"process.pid":0}'), F.lit('{"pid":1,"pid":2}'),
    )


def _json_id_lines() -> Column:
    return _cases(
        _text('{"trace":{"id":"t', _user(), '"},"tr":"x","transaction":{"id":', _user(), "}}"),
        _text('{"trace":{"x":1},"tr":"r', _user(), '","transaction":"y"}'),
        _text('{"trace":{"id":""},"tr":"r', _user(), '"}'), _text('{"tr":"","u":', _user(), "}"),
    )


def _json_name_lines() -> Column:
    return _cases(
        _text('{"lg":"L', _user(), '","tn":"T', _user(), '"}'), _text('{"lg":"","logger":"a","tn":"","host":{"name":"h', _user(), '"}}'),
        _text('{"logger":"lg', _user(), '","host":{"name":"h', _user(), '"},"node.name":"n"}'),
        _text('{"logger":{"name":"ln', _user(), '"},"cluster.name":"c","node.name":"n', _user(), '"}'),
        _text('{"component":"c', _user(), '","service":{"name":"s"},"node.name":"n', _user(), '"}'),
        _text('{"service":{"name":"s', _user(), '"},"cluster.name":"c', _user(), '","host":"x"}'),
        _text('{"app_id":"a', _user(), '","host":{"name":""},"node.name":"n"}'), _text('{"logger":7,"u":', _user(), "}"),
    )


def _json_message_lines() -> Column:
    return _cases(
        _text('{"mt":"m 1.2.', _digit(), '","message":"x","v":"V', _user(), '"}'),
        _text('{"mt":"","message":"m [1.2.', _digit(), ']","service":{"version":"S', _user(), '"}}'),
        _text('{"msg":"rel-v3.1.', _digit(), '","service":{"version":""}}'), _text('{"message":{"a":', _user(), "}}"),
        _text('{"x":', _user(), "}"),
    )


def _json_error_lines() -> Column:
    return _cases(
        _text('{"error":{"code":', _user(), '},"err":"e"}'), _text('{"stack_trace":"at ', _user(), '","x":1}'), _text('{"x":', _user(), "}"),
    )


def _args_lines() -> Column:
    stamp = _text('{"@timestamp":"', S.stamp("yyyy-MM-dd HH:mm:ss.SSS"), '",')
    return _cases(
        _text(stamp, '"level":"Warn","u":', _user(), ',"e":{},"list":[]}'),
        _text(stamp, '"level":"ERROR","name":"n', _user(), '","tn":"n', _user(), '"}'),
        _text(stamp, '"log":"x","u":', _user(), "}"),
        _text(stamp, '"message":"m', _user(), '","k":{"message":"m', _user(), '","z":[{"time":1},{"a":', _user(), "}]}}"),
        _text(stamp, '"trace":{"id":1,"s":', _user(), '},"transaction":{"id":2},"process":{"pid":3,"t":{"id":', _user(), "}}}"),
        _text(stamp, '"host":{"name":"h","ip":1,"user":{"name":"x","id":', _user(), '}},"log":{"level":"a","file":"f', _user(), '"}}'),
        _text(stamp, '"host":{"user":{"name":"x"}},"u":', _user(), "}"),
        _text(stamp, '"date":"x","pid":', _user(), ',"k":{"pid":"', _user(), '","version":"1.0","q":[[{"time":1}]]},"v":"1.0"}'),
    )


def _args(options: Options = DEFAULT) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = S.lines_of(_events(spark, folder), _args_lines())
        return N.normalize(lines, options).select(*KEY, F.to_json("args").alias("args"))

    return run


def normalize_single(spark: SparkSession, folder: str) -> DataFrame:
    stamp = S.stamp("yyyy-MM-dd HH:mm:ss.SSS")
    line = _cases(
        _text('{"t":"', stamp, '+00:00","pid":', _user(), ',"l":"Info","lg":"x","tn":"n","v":"1","q":[1]}'),
        _text('{"time":"', stamp, '","pid":', _user(), ',"msg":"m"}'),
        _text("not json ", _user()),
        _text('["', stamp, '", ', _user(), "]"),
    )
    df = _events(spark, folder).select("event_id", line.alias("line"))
    options = Options(fallback_time="2000-01-01 00:00:00.000+00:00")
    return N.normalize_json(df, "line", options).select("event_id", "out")


# --- variants


def _optional(shape: Callable[[], Column], options: Options, *columns: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return N.normalize(S.lines_of(_events(spark, folder), shape()), options).select(*KEY, "format", *columns)

    return run


def _mixed_es() -> Column:
    return _text(S.stamp("yyyy-MM-dd HH:mm:ss.SSS"), " node ", S.templates()["es_text"])


def _prefixed() -> Column:
    # the level of the text before the object is not the object's
    return _text("[error] worker: ", F.replace(S.templates()["json_flat"], F.lit('"level":"Information",'), F.lit("")))


def _ecs() -> Column:
    return _text(
        '{"@timestamp":"', S.stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+03:00","log":{"level":"critical","logger":"L',
        _user(), '","original":"o"},"service":{"name":"s', _user(), '"},"process":{"pid":', _user(),
        '},"message":"v1 [1.2.', _digit(), ']","labels":{"a":1},"ecs":{"version":"1"},"host":{"name":"h"},"k":', _user(), "}",
    )


def _es_json() -> Column:
    return _text(
        '{"type":"server","timestamp":"', S.stamp("yyyy-MM-dd'T'HH:mm:ss,SSS"),
        '","level":"CRITICAL","component":"o.e.x","cluster.name":"c","node.name":"n', _user(),
        '","message":"v7.17.', _digit(), '","process.id":', _user(), ',"extra":', _user(), "}",
    )


def _args_text(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder).withColumn("args", F.to_json("args"))

    return run


def _early_lines() -> Column:
    shapes = S.templates()
    return _cases(
        shapes["procrun"], shapes["syslog"], shapes["es_text"],
        _text("plain ", S.stamp("yyyy-MM-dd HH:mm:ss,SSS"), " text ", _user()),
        _text('{"timestamp":"', S.stamp("yyyy-MM-dd HH:mm:ss.SSS"), '","level":"Warning","serviceName":"s', _user(), '"}'),
        _text('{"@timestamp":"', S.stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z","log.level":"Information","process":{"pid":', _user(),
              ',"thread":{"id":7}},"service":{"name":"e', _user(), '"},"message":"m', _user(), '"}'),
        shapes["canonical"], _text('{"date":"', S.stamp("yyyy-MM-dd HH:mm:ss.SSS"), '","logger":"l', _user(), '"}'),
    )


def early_records(spark: SparkSession, folder: str) -> DataFrame:
    records = V.early_records(S.lines_of(_events(spark, folder), _early_lines()))
    return records.select(
        *KEY, "t", "service", "l", "lg", "pid", "format", F.try_variant_get("span", "$.name", "string").alias("span_name")
    )


def tz_sample(spark: SparkSession, folder: str) -> DataFrame:
    return V.sample_time_zones(S.mixed_lines(configure(spark), folder))


def tz_label(spark: SparkSession, folder: str) -> DataFrame:
    lines = V.with_time_zone(S.shaped_lines(configure(spark), folder, "syslog"))
    time = T.parse_time(F.regexp_extract("line", r"^(\S+)\s", 1))
    return lines.select(*KEY, V.labelled_time(time, F.col("time_zone")).alias("t"))


def unknown_service_id(spark: SparkSession, folder: str) -> DataFrame:
    return V.unknown_services(S.document_lines(configure(spark), folder))


def syslog_simple(spark: SparkSession, folder: str) -> DataFrame:
    options = Options(fallback_time=FIXED)
    records = V.simple_syslog(S.mixed_lines(configure(spark), folder), options)
    syslog = F.col("args").isNotNull()
    own = [F.when(syslog, F.col(c)).alias(c) for c in ("t", "pid", "l", "lg", "mt", "tn", "v")]
    return records.select(*KEY, *own, (~syslog & F.col("_raw_line").isNotNull()).cast("int").alias("minimal"))


def minimal_raw_line(spark: SparkSession, folder: str) -> DataFrame:
    line = _cases(
        _text(S.stamp("yyyy-MM-dd'T'HH:mm:ss,SSS"), "  warn   <x> ", _user()), S.templates()["minimal_dotted"]
    )
    records = V.minimal_with_raw_line(S.lines_of(_events(spark, folder), line))
    return records.select(*KEY, "t", "_raw_line", "_logged_at", "l", "pid", "v", "lg", "tn", _span("message").alias("message"))


def json_span(spark: SparkSession, folder: str) -> DataFrame:
    line = _text(
        '{"timestamp":"', S.stamp("yyyy-MM-dd HH:mm:ss,SSS"), '","span":{"name":"s', _user(), '","parts":[', F.col("event_id"), ',{"a":null}]}}'
    )
    records = N.normalize(S.lines_of(_events(spark, folder), line))
    return records.select(*KEY, "t", F.to_json("span").alias("span"))


def keep_all_json(spark: SparkSession, folder: str) -> DataFrame:
    line = _cases(
        _text("prefix ", S.templates()["json_flat"]), S.templates()["json_nested"], S.templates()["canonical"],
        S.templates()["minimal_dotted"],
    )
    records = V.keep_all_json(S.lines_of(_events(spark, folder), line))
    keys = ["t", "pid", "l", "lg", "mt", "tn", "v", "tr", "timestamp", "@timestamp", "ex"]
    columns = [R.text(R.member(F.col("record"), key)).alias(key.replace("@", "at_")) for key in keys]
    return records.select(*KEY, *columns, F.size("record").alias("keys"))


FIXED = "2000-01-01 00:00:00.000+00:00"
RECORD_COLUMNS = ["t", "pid", "l", "lg", "tn", "v", "mt"]

QUERIES: dict[str, Query] = {
    "merge_procrun": merge_procrun,
    "merge_rendered": merge_rendered,
    "parse_ts_iso": parse_ts_iso,
    "parse_ts_offset": parse_ts_offset,
    "parse_ts_notations": parse_ts_notations,
    "format_ts": format_ts,
    "event_time_regex": event_time_regex,
    "line_start_time": line_start_time,
    "drop_blank": drop_blank,
    "route_format": route_format,
    "is_canonical": is_canonical,
    "strict_json": strict_json,
    "norm_procrun": _normalized("procrun", [*RECORD_COLUMNS, "format", "time_source"]),
    "norm_syslog": _normalized("syslog", [*RECORD_COLUMNS, "span"]),
    "es_text": _normalized("es_text", RECORD_COLUMNS),
    "norm_minimal_dotted": _normalized("minimal_dotted", ["t", "pid", "l", "lg", "tn", "v", "un", "tr", "time_source", "span"]),
    "norm_minimal_piped": _normalized("minimal_piped", ["t", "pid", "l", "lg", "tn", "v", "time_source", "span"]),
    "norm_json_nested": _normalized("json_nested", [*RECORD_COLUMNS, "trace_id", "transaction_id"]),
    "norm_json_flat": _normalized("json_flat", [*RECORD_COLUMNS, "trace_id"]),
    "canonical_passthrough": _normalized("canonical", [*RECORD_COLUMNS, "raw_record"]),
    "minimal_level": _minimal(l=lambda: L.minimal_level(F.col("line"))),
    "minimal_pid": _minimal(pid=lambda: L.minimal_pid(F.col("line"))),
    "minimal_version": _minimal(v=lambda: bare_version(F.col("line"))),
    "minimal_logger": _minimal(lg=lambda: L.minimal_logger(F.col("line"), F.col("service"))),
    "minimal_user_trace": _minimal(
        un=lambda: L.minimal_user(F.col("line")), tr=lambda: L.minimal_trace(F.col("line"))
    ),
    "minimal_docs": minimal_docs,
    "minimal_fields": minimal_fields,
    "minimal_conversations": minimal_conversations,
    "page_tags": page_tags,
    "version_from_text": version_texts,
    "service_from_path": _of_url("service", X.service_from_path),
    "service_names": service_names,
    "sanitize_name": _of_url("name", X.sanitize_name),
    "title_case": _of_url("title", X.title_case),
    "source_key": _of_url("source_key", X.source_key),
    "syslog_span": syslog_span,
    "json_time": _json_query(_json_time_lines, lambda view: {"t": T.parse_time(route.json_time_text(view.record))}),
    "json_level": _json_query(_json_level_lines, lambda view: {"l": J.json_level(view, _line())}),
    "level_titled": _json_query(_json_level_lines, lambda view: {"l": J.json_level_titled(view, _line())}),
    "json_pid": _json_query(_json_pid_lines, lambda view: {"pid": J.json_pid(view)}),
    "json_trace": _json_query(
        _json_id_lines,
        lambda view: {"trace_id": J.json_trace_id(view), "transaction_id": J.json_transaction_id(view)},
    ),
    "json_logger": _json_query(_json_name_lines, lambda view: {"lg": J.json_logger(view, _service())}),
    "json_tenant": _json_query(_json_name_lines, lambda view: {"tn": J.json_tenant(view, _service())}),
    "json_message": _json_query(_json_message_lines, lambda view: {"mt": J.json_message(view)}),
    "json_version": _json_query(_json_message_lines, lambda view: {"v": J.json_version(view)}),
    "json_ex": _json_query(_json_error_lines, lambda view: {"ex": F.to_json(J.json_errors(view.record))}),
    "args_clean": _args(),
    "args_full": _args(Options(arguments="full")),
    "args_leftovers": _args(Options(arguments="leftovers")),
    "normalize_json": normalize_single,
    "union_all": union_all,
    "merge_all": _merged("instant"),
    "merge_text_order": _ranked("text"),
    "merge_rank": _ranked("instant"),
    "sort_files": sort_files,
    "lines_per_file": lines_per_file,
    "merge_metrics": merge_metrics,
    "es_mixed": _optional(_mixed_es, DEFAULT, *RECORD_COLUMNS),
    "es_text_minimal": _optional(
        lambda: S.templates()["es_text"], Options(es_text="minimal", fallback_time=FIXED),
        "t", "pid", "l", "lg", "v", "time_source",
    ),
    "json_prefixed": _optional(_prefixed, Options(prefixed_json=True), *RECORD_COLUMNS),
    "ecs_norm": _args_text(_optional(_ecs, Options(json_rules="ecs"), *RECORD_COLUMNS, "args")),
    "es_json": _args_text(_optional(_es_json, Options(json_rules="es_json"), *RECORD_COLUMNS, "args")),
    "early_records": early_records,
    "tz_sample": tz_sample,
    "tz_label": tz_label,
    "unknown_service_id": unknown_service_id,
    "syslog_simple": syslog_simple,
    "minimal_raw_line": minimal_raw_line,
    "keep_all_json": keep_all_json,
    "json_span": json_span,
}
