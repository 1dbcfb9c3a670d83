"""SQL counterparts of the named queries.

Expected columns are computed from the event columns, not by parsing the lines again, wherever the
lines were written from events.
"""

from __future__ import annotations

# Service names, in order of precedence.
SERVICES = [
    "elasticsearch", "kibana", "logstash", "nginx", "apache", "redis", "postgres", "mysql", "mongo",
    "rabbitmq", "rabbit", "kafka", "zookeeper", "traefik", "haproxy", "grafana", "prometheus",
    "alertmanager", "consul", "vault", "nomad", "beats", "filebeat", "metricbeat", "auditbeat",
    "journalbeat", "winlogbeat", "fluentd", "vector", "telegraf", "cadvisor", "node_exporter",
    "blackbox_exporter", "gateway", "auth", "payment", "user", "catalog", "search", "cache", "queue",
    "worker", "scheduler", "report", "backup", "monitor", "health", "api", "web",
]
FILE = "'/logs/' || event_type || '.log'"
KEY = f"{FILE} AS file_path, event_id AS line_seq"
TITLE = "upper(event_type[1]) || lower(event_type[2:])"
SEC = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
SEC3 = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"
T0 = f"{SEC} || '.000+00:00'"
T3 = f"{SEC3} || '+00:00'"
USER = "user_id::VARCHAR"
DIGIT = "(event_id % 10)::VARCHAR"
NODE = "'n' || (user_id % 5)::VARCHAR"
FIXED = "'2000-01-01 00:00:00.000+00:00'"
# Python's whitespace characters.
SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
WS = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]


def cases(count: int, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values))
    return f"CASE event_id % {count} {arms} END"


def of_events(*columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM events"


def title(text: str) -> str:
    runs = rf"regexp_extract_all({text}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def sanitized(text: str) -> str:
    return f"translate({text}, '<>:\"/\\|?*', '_________')"


def service(path: str) -> str:
    names = "[" + ", ".join(f"'{s}'" for s in SERVICES) + "]"
    file = rf"lower(regexp_extract({path}, '([^/\\]*)$', 1))"
    known = f"list_filter({names}, lambda s: contains({file}, s))[1]"
    stem = rf"regexp_replace({file}, '^(\.*[^.].*)\.[^.]*$', '\1')"
    own = title(sanitized(stem))
    return f"coalesce({title(known)}, nullif({own}, ''), 'Unknown')"


DOC_LINES = (
    "SELECT doc_id AS file_block_start, unnest(range(len(parts)))::BIGINT AS line_seq,"
    f" '/docs/' || source || '.log' AS file_path, trim(unnest(parts), {SPACES}) AS line, source"
    " FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)"
)
DOCS = f"(SELECT * FROM ({DOC_LINES}) WHERE line <> '')"
DOC_KEY = "file_path, file_block_start, line_seq"


def word(words: str, text: str = "lower(line)") -> str:
    edge = r"[^\p{L}\p{N}\p{M}_]"
    return f"regexp_matches({text}, '(^|{edge})({words})($|{edge})')"


LEVEL = (
    f"CASE WHEN {word('error|err|не удалось|исключение')} THEN 'Error' WHEN {word('warn|warning')} THEN 'Warn'"
    f" WHEN {word('debug')} THEN 'Debug' WHEN {word('fatal|crit|critical')} THEN 'Fatal' ELSE 'Info' END"
)
PID = (
    r"coalesce(nullif(regexp_extract(line, '[<(]([^>)]+)[>)]', 1), ''),"
    rf" nullif(regexp_extract(line, '{WS}([0-9]+(\+[0-9]+)?)$', 1), ''), '1')"
)
VERSION = r"coalesce(nullif(regexp_extract(line, '[0-9]+\.[0-9]+\.[0-9]+(\.[0-9]+)?'), ''), 'unknown')"
SOURCE_TITLE = title("source")
LOGGER = (
    f"coalesce(CASE WHEN contains(line, '|') THEN nullif(regexp_extract(trim(string_split(line, '|')[1], {SPACES}),"
    f" '{WS}({NOT_WS}+)$', 1), '') END, {SOURCE_TITLE})"
)


def field(name: str) -> str:
    found = rf"regexp_extract(line, '(?i){name}:{WS}*(.+?)(\n|$)', 1)"
    return f"nullif(trim({found}, {SPACES}), '')"


MESSAGE = rf"trim(regexp_replace(line, '<[^>]+>', '', 'g'), {SPACES})"

# --- the shapes of event lines

PROCRUN = {
    "t": T0, "pid": USER, "l": "'Info'", "lg": "'Commons Daemon'", "tn": TITLE,
    "v": f"'1.2.' || {DIGIT}", "mt": f"event_type || ' done version=1.2.' || {DIGIT}",
    "format": "'procrun'", "time_source": "'line_start'",
}
SYSLOG = {
    "t": f"{SEC3} || '+03:00'", "pid": USER, "l": "'Info'", "lg": "'rabbitmq'", "tn": "'rabbitmq'",
    "v": "NULL::VARCHAR", "mt": "NULL::VARCHAR", "format": "'syslog'", "time_source": "'line_start'",
    "span_status": "'Info'", "span_name": "'AMQP connection'", "span_messagetype": "'SystemLog'",
    "span_message": "'AMQP connection closed, user ' || event_type",
}
ES_TEXT = {
    "t": T3, "pid": USER, "l": "'Warn'", "lg": "'o.e.t.Service'", "tn": "event_type", "v": "'unknown'",
    "mt": f"'slow shard v7.17.' || {DIGIT}", "format": "'es_text'", "time_source": "'line_start'",
}
DOTTED_LINE = f"strftime(ts, '%d.%m.%Y %H:%M:%S') || ' ' || event_type || ' failed (job-' || {USER} || ') UserName: u' || {USER}"
DOTTED = {
    "t": T0, "pid": f"'job-' || {USER}", "l": "CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Info' END",
    "lg": TITLE, "tn": TITLE, "v": "strftime(ts, '%d.%m.%Y')", "mt": "NULL::VARCHAR", "un": f"'u' || {USER}",
    "tr": "NULL::VARCHAR", "format": "'minimal'", "time_source": "'event_regex'", "span_status": "'Info'",
    "span_name": "'RawLogLine'", "span_messagetype": "'Text'", "span_message": DOTTED_LINE,
}
PIPED_LINE = f"{SEC3} || ' worker' || {USER} || ' | error in ' || event_type || ' build 2.0.' || {DIGIT}"
PIPED = {
    "t": T3, "pid": "'1'", "l": "'Error'", "lg": f"'worker' || {USER}", "tn": TITLE, "v": f"'2.0.' || {DIGIT}",
    "mt": "NULL::VARCHAR", "format": "'minimal'", "time_source": "'event_regex'", "span_status": "'Info'",
    "span_name": "'RawLogLine'", "span_messagetype": "'Text'", "span_message": PIPED_LINE,
}
NESTED = {
    "t": T3, "pid": "CASE WHEN user_id = 0 THEN '1' ELSE user_id::VARCHAR END", "l": "'error'", "lg": "event_type", "tn": TITLE, "v": f"'1.0.' || {DIGIT}",
    "mt": "'m' || event_id::VARCHAR", "trace_id": "'t' || event_id::VARCHAR", "transaction_id": "NULL::VARCHAR",
    "format": "'json'", "time_source": "'json_key'",
}
FLAT = {
    "t": T3, "pid": "'1'", "l": "'Info'", "lg": "event_type", "tn": f"'c1-' || {NODE}", "v": f"'3.1.' || {DIGIT}",
    "mt": f"'rel [3.1.' || {DIGIT} || '] ok'", "trace_id": "NULL::VARCHAR", "format": "'json'",
    "time_source": "'json_key'",
}
CANONICAL_LINE = (
    f"'{{\"t\":\"' || {T3} || '\",\"pid\":\"' || {USER} || '\",\"l\":\"Info\",\"lg\":\"' || event_type ||"
    f" '\",\"tn\":\"' || {NODE} || '\",\"v\":\"1.0.0\",\"mt\":\"m' || event_id::VARCHAR || '\"}}'"
)
CANONICAL = {
    "t": T3, "pid": USER, "l": "'Info'", "lg": "event_type", "tn": NODE, "v": "'1.0.0'",
    "mt": "'m' || event_id::VARCHAR", "raw_record": CANONICAL_LINE, "format": "'canonical'",
    "time_source": "'json_key'",
}
SHAPES = [PROCRUN, SYSLOG, ES_TEXT, DOTTED, PIPED, NESTED, FLAT, CANONICAL]
RECORD = ["t", "pid", "l", "lg", "tn", "v", "mt"]
SPAN = ["span_status", "span_name", "span_messagetype", "span_message"]


def shape(values: dict[str, str], *names: str) -> str:
    return of_events(KEY, *[f"{values[n]} AS {n}" for n in names])


def mixed(*names: str, instant: bool = False) -> str:
    columns = [f"{cases(8, *[s[n] for s in SHAPES])} AS {n}" for n in names]
    return of_events(KEY, *columns, *([f"{INSTANT} AS instant"] if instant else []))


INSTANT = cases(
    8, *["date_trunc('second', ts)" if s["t"] == T0 else "date_trunc('milliseconds', ts)" + (" - INTERVAL 3 HOUR" if s is SYSLOG else "") for s in SHAPES]
)


def ranked(order: str, rank: str = "") -> str:
    inner = of_events(KEY, f"{cases(8, *[s['t'] for s in SHAPES])} AS t", f"{INSTANT} AS instant")
    return f"SELECT file_path, line_seq, t, row_number() OVER (ORDER BY {order}) - 1 AS position FROM ({inner})"


def merged(records: str) -> str:
    """Rows and their place in the order of their times; all offsets the same unless ``instant`` is there."""
    if " AS instant" in records:
        numbered = "row_number() OVER (ORDER BY instant, file_path, line_seq) - 1 AS position"
        return f"SELECT * EXCLUDE (instant), {numbered} FROM ({records})"
    return f"SELECT *, row_number() OVER (ORDER BY t, file_path, line_seq) - 1 AS position FROM ({records})"


RENDERED = (
    "'{\"t\":\"' || t || '\",\"pid\":\"' || pid || '\",\"l\":\"Info\",\"lg\":\"Commons Daemon\",\"tn\":\"' || tn ||"
    " '\",\"v\":\"' || v || '\",\"mt\":\"' || mt || '\",\"args\":{}}'"
)
LEVEL_TEXTS = ["'error'", "'WARN'", "'Info'", "'Warn'", "'Info'", "'{\"a\":' || user_id || '}'", "'x'"]
TITLED_TEXTS = ["'Error'", "'Warn'", "'Info'", "'Error'", "'Info'", "'{\"A\":' || user_id || '}'", "'Fatal'"]
NOTATIONS = [T3, T0, T0, f"{SEC} || '.000+03:00'", T0, T0, T0, "NULL::VARCHAR", T0, T0, T3, T0, T0, T0, T3]
ARGS_CLEAN = [
    "'{\"u\":' || user_id || '}'", "'{\"level\":\"ERROR\"}'", "NULL::VARCHAR",
    "'{\"k\":{\"z\":[{\"a\":' || user_id || '}]}}'",
    "'{\"process\":{\"t\":{\"id\":' || user_id || '}},\"trace\":{\"s\":' || user_id || '}}'",
    "'{\"host\":{\"user\":{\"id\":' || user_id || '}},\"log\":{\"file\":\"f' || user_id || '\"}}'",
    "'{\"host\":{\"name\":null},\"u\":' || user_id || '}'",
    "CASE WHEN user_id = 0 THEN '{\"k\":{\"pid\":\"0\",\"q\":[[{\"time\":1}]]}}' ELSE '{\"k\":{\"q\":[[{\"time\":1}]]}}' END",
]
ARGS_FULL = [
    "'{\"e\":{},\"level\":\"Warn\",\"list\":[],\"u\":' || user_id || '}'",
    "'{\"level\":\"ERROR\",\"name\":\"n' || user_id || '\"}'", "NULL::VARCHAR",
    "'{\"k\":{\"message\":\"m' || user_id || '\",\"z\":[{},{\"a\":' || user_id || '}]},\"message\":\"m' || user_id || '\"}'",
    "'{\"process\":{\"t\":{\"id\":' || user_id || '}},\"trace\":{\"id\":1,\"s\":' || user_id || '},\"transaction\":{\"id\":2}}'",
    "'{\"host\":{\"user\":{\"id\":' || user_id || ',\"name\":\"x\"}},\"log\":{\"file\":\"f' || user_id || '\",\"level\":\"a\"}}'",
    "'{\"host\":{\"user\":{\"name\":\"x\"}},\"u\":' || user_id || '}'",
    "'{\"k\":{\"pid\":\"' || user_id || '\",\"q\":[[{\"time\":1}]],\"version\":\"1.0\"}}'",
]
ARGS_LEFTOVERS = [
    *ARGS_FULL[:2], "'{\"u\":' || user_id || '}'", ARGS_FULL[3], "NULL::VARCHAR", "NULL::VARCHAR",
    "'{\"u\":' || user_id || '}'", ARGS_FULL[7],
]
EARLY = {
    "t": [f"{SEC} || '.000+03:00'", f"{SEC3} || '+03:00'", *[f"{SEC3} || '+03:00'"] * 3, T3, T3, f"{SEC3} || '+03:00'"],
    "service": ["'procrun'", "'rabbitmq'", "event_type", "unknown", "'s' || user_id", "'e' || user_id", "NULL", "unknown"],
    "l": ["'Info'", "'Info'", "'Warn'", "'Info'", "'Warn'", "'Info'", "'Info'", "'Info'"],
    "lg": ["'Commons Daemon'", "'host-' || (user_id % 5)", "'o.e.t.Service'", "unknown", "'s' || user_id", "'e' || user_id",
           "event_type", "'l' || user_id"],
    "pid": [USER, USER, USER, "NULL", "NULL", "user_id || '+7'", USER, "NULL"],
    "format": ["'procrun'", "'syslog'", "'es_text'", "'other'", "'json'", "'ecs'", "'canonical'", "'json'"],
    "span_name": [PROCRUN["mt"], "'AMQP connection <0.' || event_id || '.0> closed, vhost:/, user ' || event_type", ES_TEXT["mt"],
                  "'plain ' || strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' text ' || user_id", "NULL", "'m' || user_id", "NULL", "NULL"],
}
UNKNOWN = (
    "(SELECT *, 'DUNNOSERVICE' || dense_rank() OVER (ORDER BY '/logs/' || event_type || '.log') AS unknown FROM events)"
)

SQL: dict[str, str] = {
    "merge_procrun": merged(shape(PROCRUN, *RECORD)),
    "merge_rendered": f"SELECT file_path, line_seq, {RENDERED} AS value, position FROM ({merged(shape(PROCRUN, *RECORD))})",
    "parse_ts_iso": of_events("event_id", f"{T3} AS t"),
    "parse_ts_offset": of_events(
        "event_id", f"{SEC3} || {cases(4, *[repr(o) for o in ('+03:00', '-05:30', '+05:00', '+00:00')])} AS t",
        f"{cases(4, *[repr(o) for o in ('+03:00', '-05:30', '+05:00', '+00:00')])} AS tz_offset",
        "strftime(ts - to_minutes(CASE event_id % 4 WHEN 0 THEN 180 WHEN 1 THEN -330 WHEN 2 THEN 300 ELSE 0 END), '%Y-%m-%d %H:%M:%S.%g') AS instant",
    ),
    "parse_ts_notations": of_events("event_id", f"{cases(15, *NOTATIONS)} AS t"),
    "format_ts": of_events(
        "event_id",
        "strftime(ts + to_minutes(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 180 ELSE -330 END), '%Y-%m-%d %H:%M:%S.%g')"
        " || CASE event_id % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN '+03:00' ELSE '-05:30' END AS t",
    ),
    "event_time_regex": of_events("event_id", f"{cases(4, T0, T3, T0, 'NULL')} AS t"),
    "line_start_time": of_events("event_id", f"{cases(3, T3, T0, 'NULL')} AS t"),
    "drop_blank": f"SELECT file_path, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM {DOCS} GROUP BY file_path",
    "route_format": mixed("format"),
    "is_canonical": of_events("event_id", "CASE event_id % 5 WHEN 0 THEN 1 ELSE 0 END AS canonical"),
    "strict_json": of_events("event_id", "CASE WHEN event_id % 8 IN (0, 7) THEN 1 ELSE 0 END AS valid"),
    "norm_procrun": shape(PROCRUN, *RECORD, "format", "time_source"),
    "norm_syslog": shape(SYSLOG, *RECORD, *SPAN),
    "es_text": shape(ES_TEXT, *RECORD),
    "norm_minimal_dotted": shape(DOTTED, "t", "pid", "l", "lg", "tn", "v", "un", "tr", "time_source", *SPAN),
    "norm_minimal_piped": shape(PIPED, "t", "pid", "l", "lg", "tn", "v", "time_source", *SPAN),
    "norm_json_nested": shape(NESTED, *RECORD, "trace_id", "transaction_id"),
    "norm_json_flat": shape(FLAT, *RECORD, "trace_id"),
    "canonical_passthrough": shape(CANONICAL, *RECORD, "raw_record"),
    "minimal_level": f"SELECT {DOC_KEY}, {LEVEL} AS l FROM {DOCS}",
    "minimal_pid": f"SELECT {DOC_KEY}, {PID} AS pid FROM {DOCS}",
    "minimal_version": f"SELECT {DOC_KEY}, {VERSION} AS v FROM {DOCS}",
    "minimal_logger": f"SELECT {DOC_KEY}, {LOGGER} AS lg FROM {DOCS}",
    "minimal_user_trace": f"SELECT {DOC_KEY}, {field('UserName')} AS un, {field('Trace')} AS tr FROM {DOCS}",
    "minimal_docs": (
        f"SELECT {DOC_KEY}, 'minimal' AS format, {PID} AS pid, {LEVEL} AS l, {LOGGER} AS lg, {SOURCE_TITLE} AS tn,"
        f" {VERSION} AS v, {MESSAGE} AS message FROM {DOCS}"
    ),
    "minimal_fields": of_events(
        "event_id",
        cases(8, "'Info'", "'Info'", "'Info'", "'Info'", "'Error'", "'Warn'", "'Fatal'", "'Debug'") + " AS l",
        cases(8, "'job-' || user_id", "'main' || user_id", "user_id || '+7'", USER, USER, "'1'", "'1'", "'1'") + " AS pid",
        cases(8, *["'unknown'"] * 5, f"'1.2.' || {DIGIT} || '.4'", "'unknown'", "'unknown'") + " AS v",
        cases(8, *["'Svc'"] * 5, "'w' || user_id", "'Svc'", "'Svc'") + " AS lg",
        "CASE event_id % 8 WHEN 0 THEN 'u' || user_id END AS un",
        "CASE event_id % 8 WHEN 1 THEN 't' || event_id WHEN 7 THEN user_id || ' x' END AS tr",
        cases(8, "'Info'", "'Info'", "'Info'", "'Info'", "'Info'", "'Warn'", "'Fatal'", "'Debug'") + " AS english_l",
    ),
    "minimal_conversations": (
        f"SELECT {title('role')} AS tn, l, count(*) AS lines, sum(length(message))::BIGINT AS characters FROM"
        f" (SELECT role, {LEVEL} AS l, {MESSAGE} AS message FROM (SELECT role, trim(unnest(string_split(text, chr(10))), {SPACES}) AS line"
        " FROM conversations) WHERE line <> '') GROUP BY 1, 2"
    ),
    "page_tags": (
        f"SELECT page_id, pos, {PID} AS pid, {MESSAGE} AS message FROM (SELECT page_id, unnest(range(len(parts)))::INTEGER AS pos,"
        f" trim(unnest(parts), {SPACES}) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages)) WHERE line <> ''"
    ),
    "version_from_text": of_events(
        "event_id",
        cases(8, f"'1.2.' || {DIGIT}", "'a' || user_id", f"'4.' || {DIGIT}", "'B' || user_id", "'v' || user_id",
              f"'7.17.' || {DIGIT}", f"'10.0.0.' || {DIGIT}", "'unknown'") + " AS v",
    ),
    "service_from_path": f"SELECT page_id, {service('url')} AS service FROM pages",
    "service_names": of_events(
        "event_id",
        cases(6, "'Node_Exporter'", "'My-Svc_' || user_id || 'A'", "'Web'", "'.Hidden' || user_id", "'X' || user_id || '.Tar'", "'Unknown'")
        + " AS service",
    ),
    "sanitize_name": f"SELECT page_id, {sanitized('url')} AS name FROM pages",
    "title_case": f"SELECT page_id, {title('url')} AS title FROM pages",
    "source_key": "SELECT page_id, md5(url)[1:8] AS source_key FROM pages",
    "syslog_span": of_events(
        "event_id",
        cases(4, "'Closing connection'", "'AMQP connection'", "'SystemLog'", "'SystemLog'") + " AS name",
        cases(4, "'rabbitmq'", "'rabbitmq'", "'TextExtractorService'", "'RabbitMqSubscriber'") + " AS service",
        cases(4, "'closing now'", "'AMQP connection closing ' || user_id", "'TextExtractorService up ' || user_id",
              "'GenericService RabbitMqSubscriber ' || user_id") + " AS message",
    ),
    "json_time": of_events("event_id", f"{cases(4, T3, T3, T3, 'NULL')} AS t"),
    "json_level": of_events("event_id", f"{cases(7, *LEVEL_TEXTS)} AS l"),
    "level_titled": of_events("event_id", f"{cases(7, *TITLED_TEXTS)} AS l"),
    "json_pid": of_events(
        "event_id",
        cases(7, "CASE WHEN user_id = 0 THEN '1' ELSE user_id::VARCHAR END", "CASE WHEN user_id = 0 THEN '1' ELSE user_id::VARCHAR END",
              USER, "'p' || user_id", "CASE WHEN user_id = 0 THEN '1' ELSE user_id::VARCHAR END", "'0'", "'2'") + " AS pid",
    ),
    "json_trace": of_events(
        "event_id",
        cases(4, "'t' || user_id", "'r' || user_id", "''", "NULL") + " AS trace_id",
        cases(4, USER, "NULL", "NULL", "NULL") + " AS transaction_id",
    ),
    "json_logger": of_events(
        "event_id",
        cases(8, "'L' || user_id", TITLE, "'lg' || user_id", "'ln' || user_id", "'c' || user_id", "'s' || user_id", "'a' || user_id", TITLE)
        + " AS lg",
    ),
    "json_tenant": of_events(
        "event_id",
        cases(8, "'T' || user_id", TITLE, "'h' || user_id", "'c-n' || user_id", "'n' || user_id", "'c' || user_id", TITLE, TITLE) + " AS tn",
    ),
    "json_message": of_events(
        "event_id",
        cases(5, f"'m 1.2.' || {DIGIT}", f"'m [1.2.' || {DIGIT} || ']'", f"'rel-v3.1.' || {DIGIT}", "'{\"a\":' || user_id || '}'", "''")
        + " AS mt",
    ),
    "json_version": of_events(
        "event_id",
        cases(5, "'V' || user_id", "'S' || user_id", f"'3.1.' || {DIGIT}", "'unknown'", "'unknown'") + " AS v",
    ),
    "json_ex": of_events(
        "event_id",
        cases(3, "'{\"err\":\"e\",\"error\":{\"code\":' || user_id || '}}'", "'{\"stack_trace\":\"at ' || user_id || '\"}'", "NULL") + " AS ex",
    ),
    "args_clean": of_events(KEY, f"{cases(8, *ARGS_CLEAN)} AS args"),
    "args_full": of_events(KEY, f"{cases(8, *ARGS_FULL)} AS args"),
    "args_leftovers": of_events(KEY, f"{cases(8, *ARGS_LEFTOVERS)} AS args"),
    "normalize_json": of_events(
        "event_id",
        cases(
            4,
            f"'{{\"t\":\"' || {T3} || '\",\"pid\":' || user_id || ',\"l\":\"Info\",\"lg\":\"x\",\"tn\":\"n\",\"v\":\"1\",\"q\":[1]}}'",
            f"'{{\"t\":\"' || {T3} || '\",\"pid\":\"' || CASE WHEN user_id = 0 THEN '1' ELSE user_id::VARCHAR END ||"
            " '\",\"l\":\"Info\",\"lg\":\"Unknown\",\"tn\":\"Unknown\",\"v\":\"unknown\",\"mt\":\"m\",\"args\":{\"msg\":\"m\"}}'",
            f"'{{\"t\":\"' || {FIXED} || '\",\"mt\":\"not json ' || user_id || '\",\"l\":\"Error\"}}'",
            f"'{{\"t\":\"' || {T3} || '\",\"pid\":\"1\",\"l\":\"Info\",\"lg\":\"Unknown\",\"tn\":\"Unknown\",\"v\":\"unknown\",\"span\":"
            f"{{\"message\":\"[\\\"' || {SEC3} || '\\\", ' || user_id || ']\",\"messageType\":\"Text\",\"name\":\"RawLogLine\",\"status\":\"Info\"}}}}'",
        ) + " AS out",
    ),
    "union_all": f"{shape(PROCRUN, 't', 'pid', 'mt', 'format')} UNION ALL {shape(FLAT, 't', 'pid', 'mt', 'format')}",
    "merge_all": merged(mixed(*RECORD, "format", "time_source", instant=True)),
    "merge_text_order": ranked("t, file_path, line_seq"),
    "merge_rank": ranked("instant, file_path, line_seq"),
    "sort_files": ranked("file_path, t, line_seq"),
    "lines_per_file": f"SELECT file_path, count(*) AS records FROM {DOCS} GROUP BY file_path",
    "merge_metrics": (
        f"SELECT count(*) AS records, sum(strlen({CANONICAL_LINE}) + 1)::BIGINT AS bytes, count(DISTINCT event_type) AS files FROM events"
    ),
    "es_mixed": shape(ES_TEXT, "format", *RECORD),
    "es_text_minimal": of_events(
        KEY, "'minimal' AS format", f"{FIXED} AS t", "'1' AS pid",
        "CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Warn' END AS l", f"{TITLE} AS lg",
        f"'7.17.' || {DIGIT} AS v", "'fallback_now' AS time_source",
    ),
    "json_prefixed": shape(FLAT, "format", *RECORD),
    "json_span": of_events(KEY, f"{T3} AS t", "'{\"name\":\"s' || user_id || '\",\"parts\":[' || event_id || ',{\"a\":null}]}' AS span"),
    "ecs_norm": of_events(
        KEY, "'json' AS format", f"{SEC3} || '+03:00' AS t", f"{USER} AS pid", "'Fatal' AS l", "'L' || user_id AS lg",
        "'s' || user_id AS tn", f"'1.2.' || {DIGIT} AS v", f"'v1 [1.2.' || {DIGIT} || ']' AS mt",
        "'{\"host\":{\"name\":\"h\"},\"k\":' || user_id || ',\"original_log_info\":\"o\"}' AS args",
    ),
    "es_json": of_events(
        KEY, "'json' AS format", f"{T3} AS t", f"{USER} AS pid", "'Fatal' AS l", "'o.e.x' AS lg", "'n' || user_id AS tn",
        "'unknown' AS v", f"'v7.17.' || {DIGIT} AS mt", "'{\"extra\":' || user_id || '}' AS args",
    ),
    "early_records": f"SELECT {KEY}, " + ", ".join(f"{cases(8, *v)} AS {k}" for k, v in EARLY.items()) + f" FROM {UNKNOWN}",
    "tz_sample": (
        f"SELECT file_path, '+03:00' AS time_zone FROM (SELECT {FILE} AS file_path, event_id,"
        " row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)"
        " WHERE n <= 20 AND event_id % 8 = 1 GROUP BY file_path"
    ),
    "tz_label": shape(SYSLOG, "t"),
    "unknown_service_id": (
        "SELECT file_path, 'DUNNOSERVICE' || row_number() OVER (ORDER BY file_path) AS unknown_service FROM"
        " (SELECT DISTINCT '/docs/' || source || '.log' AS file_path FROM documents)"
    ),
    "syslog_simple": of_events(
        KEY,
        *[
            f"CASE event_id % 8 WHEN 1 THEN {value} END AS {name}"
            for name, value in {
                "t": SYSLOG["t"], "pid": USER, "l": "'Info'", "lg": "'host-' || (user_id % 5)",
                "mt": "'AMQP connection <0.' || event_id || '.0> closed, vhost:/, user ' || event_type",
                "tn": "'rabbitmq'", "v": "'0.' || event_id || '.0'",
            }.items()
        ],
        "CASE event_id % 8 WHEN 1 THEN 0 ELSE 1 END AS minimal",
    ),
    "minimal_raw_line": of_events(
        KEY, f"{cases(2, T3, T0)} AS t",
        f"{cases(2, chr(39) + chr(39) + ' || strftime(ts, ' + chr(39) + '%Y-%m-%dT%H:%M:%S,%g' + chr(39) + ') || ' + chr(39) + '  warn   <x> ' + chr(39) + ' || user_id', DOTTED_LINE)} AS _raw_line",
        f"CASE event_id % 2 WHEN 0 THEN {T3} END AS _logged_at",
        f"{cases(2, chr(39) + 'Warn' + chr(39), DOTTED['l'])} AS l", f"{cases(2, chr(39) + 'x' + chr(39), DOTTED['pid'])} AS pid",
        f"{cases(2, chr(39) + 'unknown' + chr(39), DOTTED['v'])} AS v", f"{TITLE} AS lg", f"{TITLE} AS tn",
        f"{cases(2, 'strftime(ts, ' + chr(39) + '%Y-%m-%dT%H:%M:%S,%g' + chr(39) + ') || ' + chr(39) + ' warn ' + chr(39) + ' || user_id', DOTTED_LINE)} AS message",
    ),
    "keep_all_json": of_events(
        KEY, f"{cases(4, T3, T3, T3, T0)} AS t", f"{cases(4, chr(39) + '1' + chr(39), USER, USER, DOTTED['pid'])} AS pid",
        cases(4, "'Info'", "'Error'", "'Info'", DOTTED["l"]) + " AS l",
        cases(4, "event_type", "event_type", "event_type", DOTTED["lg"]) + " AS lg",
        cases(4, FLAT["mt"], NESTED["mt"], CANONICAL["mt"], "NULL") + " AS mt",
        cases(4, FLAT["tn"], NESTED["tn"], CANONICAL["tn"], DOTTED["tn"]) + " AS tn",
        cases(4, FLAT["v"], NESTED["v"], CANONICAL["v"], DOTTED["v"]) + " AS v",
        cases(4, "NULL", "'t' || event_id", "NULL", "NULL") + " AS tr",
        "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%g') END AS timestamp",
        "CASE event_id % 4 WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS at_timestamp",
        "CASE event_id % 4 WHEN 0 THEN '{\"error\":{\"code\":' || user_id || '}}' END AS ex",
        cases(4, "15", "15", "7", "8") + " AS keys",
    ),
}
