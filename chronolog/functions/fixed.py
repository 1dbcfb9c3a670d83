"""Word lists, key lists and patterns that define the record format."""

# Characters Python regards as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java character class.
# The beyond-Latin part is tested as one range first, so that usual characters fail it at once.
SPACE = (
    r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WS = f"[{SPACE}]"

# Service names looked for in a file name, first hit wins.
SERVICES = [
    "elasticsearch", "kibana", "logstash", "nginx", "apache", "redis", "postgres",
    "mysql", "mongo", "rabbitmq", "rabbit", "kafka", "zookeeper", "traefik", "haproxy",
    "grafana", "prometheus", "alertmanager", "consul", "vault", "nomad",
    "beats", "filebeat", "metricbeat", "auditbeat", "journalbeat", "winlogbeat",
    "fluentd", "vector", "telegraf", "cadvisor", "node_exporter", "blackbox_exporter",
    "gateway", "auth", "payment", "user", "catalog", "search", "cache", "queue",
    "worker", "scheduler", "report", "backup", "monitor", "health", "api", "web",
]

# Service names looked for in a syslog message, first hit wins.
MESSAGE_SERVICES = [
    "DocumentAssemblerService", "TextExtractorService", "RabbitMqSubscriber", "GenericService",
]

# Characters not allowed in a file name.
FORBIDDEN_IN_NAMES = '<>:"/\\|?*'

# Keys of a canonical record, and the shape of its time.
CANONICAL_KEYS = ["t", "pid", "l", "lg", "tn", "v"]
CANONICAL_TIME = r"(?d)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}[+-]\d{2}:\d{2}$"

# Keys that may hold the event time, in order of preference.
TIME_KEYS = ["t", "@timestamp", "timestamp", "date", "time"]
# Time-named keys that never stay among the arguments.
DROPPED_TIME_KEYS = ["@timestamp", "timestamp", "time", "date"]
# Keys that describe an error.
ERROR_KEYS = ["exception", "error", "err", "stacktrace", "stack_trace"]
# Keys that the record itself owns.
STANDARD_KEYS = [
    "t", "pid", "tr", "l", "lg", "mt", "tn", "v", "args", "ex", "trace_id", "transaction_id",
]
# Keys whose content is lifted into record columns and so leaves the arguments.
LIFTED_KEYS = [
    "log", "process", "service", "host", "trace", "transaction", "logger", "component",
    "app_id", "cluster.name", "node.name",
]
# Keys additionally left out of the cleaned arguments.
REPEATED_KEYS = ["message", "log.level"]
# Keys left out of the arguments of search-engine JSON and of ECS records.
ES_JSON_KEYS = [
    "timestamp", "level", "component", "message", "type", "cluster.name", "node.name", "process.id",
]
ECS_KEYS = ["@timestamp", "log", "service", "process", "message", "labels", "ecs"]

# Line shapes.
PROCRUN_LINE = r"(?i)^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] \[info\]"
ES_LINE = r"(?id)\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d{3}\]\[[A-Z]+\]\[.*?\]"
ES_PARTS = (
    r"(?d)^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d{3})\]\[([A-Z]+)\]\[(.*?)\]"
    r" \[([A-Z0-9_-]+)\] \[(.*?)\] (.*)"
)
MIXED_LINE = (
    r"(?d)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d{3} .*?"
    r"(\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d{3}\].*)"
)
SYSLOG_LINE = (
    r"(?U)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+\d{2}:\d{2} [a-zA-Z0-9_-]+ \w+\[\d+\]:"
)
SYSLOG_PARTS = (
    r"(?Ud)(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+\d{2}:\d{2})"
    r" ([a-zA-Z0-9_-]+) (\w+)\[(\d+)\]: (.*)"
)

# Times inside a text line.
DAY_FIRST_TIME = rf"\d{{2}}\.\d{{2}}\.\d{{4}}{WS}+\d{{1,2}}:\d{{2}}:\d{{2}}"
YEAR_FIRST_TIME = rf"\d{{4}}-\d{{2}}-\d{{2}}{WS}+\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{3,6}})?"
LINE_START_TIME = rf"^{WS}*(\d{{4}}-\d{{2}}-\d{{2}}[T{SPACE}]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{3,}})?)"
ANY_TIME = rf"\d{{4}}-\d{{2}}-\d{{2}}[T{SPACE}]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{3,}})?"
ZONED_TIME = r"(?d)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.\d{6,}([-+]\d{2}:\d{2})"

# Level words of text lines, in order; a cheap substring test comes first.
TEXT_LEVELS = [
    ("Error", ["err", "не удалось", "исключение"], r"(?U)\b(error|err|не удалось|исключение)\b"),
    ("Warn", ["warn"], r"(?U)\b(warn|warning)\b"),
    ("Debug", ["debug"], r"(?U)\b(debug)\b"),
    ("Fatal", ["fatal", "crit"], r"(?U)\b(fatal|crit|critical)\b"),
]
# Level marks of JSON records that name no level, in order.
MARKED_LEVELS = [
    ("Error", ["[error]"]),
    ("Warn", ["[warn]", "[warning]"]),
    ("Debug", ["[debug]"]),
    ("Fatal", ["[fatal]"]),
]

# Version patterns, in order: (substring that must occur, pattern, group).
VERSIONS = [
    ("[", r"\[(\d+\.\d+\.\d+(?:\.\d+)?)\]", 1),
    ('"version"', rf'"version"{WS}*:{WS}*"([^"]+)"', 1),
    ('"module"', rf'"module"{WS}*:{WS}*"([^"]*Version=([^",]+)[^"]*)"', 2),
    ('"Version"', rf'"Version"{WS}*:{WS}*"([^"]+)"', 1),
    ("version", rf"version[=:]{WS}*[\"']?([^\"'>{SPACE},]+)", 1),
    (".", r"[-_]v?(\d+\.\d+\.\d+(?:\.\d+)?)", 1),
    (".", r"(?U)\b(\d+\.\d+\.\d+(?:\.\d+)?)\b", 1),
]
TEXT_VERSION = r"\d+\.\d+\.\d+(?:\.\d+)?"

# Fields of text lines.
BRACKETED_PID = r"[<\(]([^>)]+)[>\)]"
TRAILING_PID = rf"{WS}(\d+(?:\+\d+)?)$"
USER_FIELD = rf"(?id)UserName:{WS}*(.+?)(?:\n|$)"
TRACE_FIELD = rf"(?id)Trace:{WS}*(.+?)(?:\n|$)"
TAG = r"<[^>]+>"
VHOST = r"(?d)vhost:.*?,"
