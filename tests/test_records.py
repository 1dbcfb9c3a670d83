"""Hand-written lines and the records they must give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronolog import Options, normalize, normalize_json, rendered
from chronolog.functions.deep_json import pruned_json
from chronolog.functions.fixed import DROPPED_TIME_KEYS
from chronolog.operators import arguments

FALLBACK = "2000-01-01 00:00:00.000+00:00"
PATH = "/a/my-svc_1a.log"
T = '"time":"2025-09-01 12:00:00",'

# line, expected members (None: member absent)
CASES = [
    ('{"@timestamp":"2025-09-01T12:00:00.1482032Z"}', {"t": "2025-09-01 12:00:00.148+00:00"}),
    ('{"timestamp":"2025-04-03 00:10:19,148"}', {"t": "2025-04-03 00:10:19.148+00:00"}),
    ('{"time":"2025-04-03T00:10:19.148203+03:00"}', {"t": "2025-04-03 00:10:19.148+03:00"}),
    ("03.04.2025 0:10:19 x", {"t": "2025-04-03 00:10:19.000+00:00", "v": "03.04.2025"}),
    ("31.02.2025 00:00:00 2025-03-01 01:02:03 x", {"t": "2025-03-01 01:02:03.000+00:00"}),
    ("no time, исключение в модуле", {"l": "Error", "t": FALLBACK}),
    ("a <main) b", {"pid": "main"}),
    ("job finished 12+7", {"pid": "12+7"}),
    ('{"level":"ERROR"}', {"l": "ERROR", "args": {"level": "ERROR"}}),
    ('{"level":"Information"}', {"l": "Info"}),
    ('{"msg":"[warn] disk"}', {"l": "Warn", "mt": "[warn] disk"}),
    ('{"x":{"level":"error"}}', {"l": "Info"}),
    ('{"l":"Error"}', {"l": "Info"}),
    ('{"tn":"","host":{"name":"h"}}', {"tn": "My-Svc_1A"}),
    ('{"cluster.name":"c","node.name":"n"}', {"tn": "c-n"}),
    ('{"log":"x","k":1}', {"args": None}),
    ('{"@timestamp":"2025-09-01","date":"2025-09-02"}', {"args": None}),
    ('{"message":"m","k":{"message":"m","z":1}}', {"args": {"k": {"z": 1}}}),
    ('{"k":{},"a":[]}', {"args": None}),
    ('{"k":{"time":1,"q":{}},"a":[{"date":2},3,[{"time":1}]]}', {"args": {"a": [3, [{"time": 1}]]}}),
    ('{"a":1} x', {"span": {"status": "Info", "name": "RawLogLine", "messageType": "Text", "message": '{"a":1} x'}}),
    ('{"pid":1,"pid":2}', {"pid": "2"}),
    ('{"a":NaN}', {"mt": ""}),
    ('{"a":[{"b":{}}]}', {"mt": ""}),
    ('{"trace":{"id":null},"tr":"x"}', {"trace_id": None}),
    ("[2025-04-03 00:10:19] [INFO] hi", {"pid": "1", "mt": "", "v": "unknown", "args": {}}),
    ("[2025-04-03 00:10:19] [info] [ 7 ] a [b] 1.2.3", {"pid": "7", "mt": "a  b  1.2.3", "v": "1.2.3"}),
    ("2025-04-03T00:00:00.000000-03:00 h p[1]: m", {"lg": "My-Svc_1A", "tn": "My-Svc_1A"}),
    ("2025-04-03T00:00:00.000000+03:00 h p[1]: m", {"lg": "p", "v": None, "pid": "1", "mt": None}),
    ("2025-04-03T00:00:00.000000+03:00 h p[1]:", {"lg": "My-Svc_1A"}),
    ("[2025-04-03T00:10:19,148][CRITICAL][lg] [P1] [svc] m 7.1.2", {"l": "Fatal", "tn": "svc", "v": "7.1.2", "mt": "m 7.1.2"}),
    ("[2025-04-03T00:10:19,148][WARN][lg] other", {"l": "Warn", "tn": "My-Svc_1A"}),
    ('{"t":"2025-04-03 00:10:19.148+03:00","pid":5,"l":"x","lg":1,"tn":"n","v":"1","q":[1]}', {"pid": 5, "lg": 1, "q": [1]}),
]


def records(spark, lines, options=Options(fallback_time=FALLBACK)):
    df = spark.createDataFrame(
        [(line, PATH, 0, i) for i, line in enumerate(lines)],
        "line string, file_path string, file_block_start bigint, line_seq bigint",
    )
    out = normalize(df, options)
    rows = out.select("line_seq", "format", rendered(out).alias("value")).collect()
    return {r.line_seq: (r.format, json.loads(r.value)) for r in rows}


def test_hand_written_lines(spark):
    got = records(spark, [line for line, _ in CASES])
    assert len(got) == len(CASES)
    for i, (line, expected) in enumerate(CASES):
        for key, value in expected.items():
            assert got[i][1].get(key) == value, (line, key, got[i])


def test_every_line_gives_one_record_and_blank_lines_none(spark):
    got = records(spark, ["a", "  ", "\t ", "", "{", "}", "[", '""', "{}"])
    assert sorted(got) == [0, 4, 5, 6, 7, 8]


def test_canonical_output_is_stable(spark):
    first = records(spark, [line for line, _ in CASES])
    lines = [json.dumps(value, ensure_ascii=False) for _, value in first.values()]
    again = records(spark, lines)
    for i, line in enumerate(lines):
        if again[i][0] == "canonical":
            assert again[i][1] == json.loads(line)
    assert sum(kind == "canonical" for kind, _ in again.values()) > 25


def test_filters_on_records_stay_cheap(spark):
    df = spark.createDataFrame([("x error", PATH, 0, 0), ("y", PATH, 0, 1)], "line string, file_path string, file_block_start bigint, line_seq bigint")
    out = normalize(df).where("l = 'Error' and format = 'minimal' and pid = '1'")
    assert out.select("line_seq").collect()[0][0] == 0


@pytest.mark.parametrize(
    "options, line, expected",
    [
        (Options(levels="titled"), '{"l":"critical","level":"x"}', {"l": "Fatal"}),
        (Options(preserve_standard=True), '{"l":"E","k":1}', {"args": {"k": 1, "original_l": "E"}}),
        (Options(keep_two_bracket_message=True), "[2025-04-03 00:10:19] [info] hi", {"mt": "hi"}),
        (Options(day_first=False), '{"time":"03.04.2025 1:02:03"}', {"t": "2025-03-04 01:02:03.000+00:00"}),
        (Options(prefixed_json=True), 'INFO {"level":"x"}', {"l": "x"}),
        (
            Options(keep_other_times=True),
            '{"@timestamp":"2025-09-01T12:00:00Z","time":"2025-09-01 12:00:00","date":"2025-09-02","k":{"time":1,"message":"m"},"msg":"m"}',
            {"args": {"date": "2025-09-02", "k": {"time": 1}, "msg": "m"}},
        ),
        (Options(arguments="leftovers"), '{"tr":"x","trace":{"id":1}}', {"tr": "x", "trace_id": None, "args": None}),
        (Options(es_text="minimal"), "[2025-04-03T00:10:19,148][WARN][lg] [P1] [svc] m", {"tn": "My-Svc_1A"}),
    ],
)
def test_options(spark, options, line, expected):
    _, got = records(spark, [line], options)[0]
    for key, value in expected.items():
        assert got.get(key) == value, got


def test_single_records(spark):
    lines = ['{"a":1}', "x", "[1,2]", ' {"t":"2025-04-03 00:10:19.148+03:00","pid":5,"l":"x","lg":1,"tn":"n","v":"1"} ']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    out = [json.loads(r.out) for r in normalize_json(df, "value", Options(fallback_time=FALLBACK)).collect()]
    assert out[0]["tn"] == "Unknown" and out[0]["args"] == {"a": 1}
    assert out[1] == {"t": FALLBACK, "mt": "x", "l": "Error"}
    assert out[2]["span"]["message"] == "[1, 2]"
    assert out[3]["pid"] == 5


KNOWN = {"level": "Error", "pid": "5", "message": 'm "{,:}" \\\\ é', "name": "n", "version": "1"}


def prune(node, known, keep_empty=False):
    """The rule for nested arguments, member by member."""

    def repeats(key, value):
        if key in DROPPED_TIME_KEYS:
            return True
        if key == "level":
            return isinstance(value, str) and value.title() == known.get(key)
        return key in known and (str(value) if key == "pid" and isinstance(value, int) else value) == known[key]

    kept = {}
    for key, value in node.items():
        if repeats(key, value):
            continue
        if isinstance(value, dict):
            value = prune(value, known, keep_empty)
        elif isinstance(value, list):
            items = [prune(i, known, keep_empty) if isinstance(i, dict) else i for i in value]
            value = [i for i in items if keep_empty or i or not isinstance(i, dict)]
        if keep_empty or value or not isinstance(value, (dict, list)):
            kept[key] = value
    return kept


def nested(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        keys = ["level", "pid", "message", "name", "version", "time", "date", "k", 'q"{', "a,b:c", "é\\\\"]
        return {k: nested(rng, depth - 1) for k in rng.sample(keys, rng.randint(0, 5))}
    if depth and kind < 0.55:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice(["ERROR", "error", 5, "5", KNOWN["message"], "n", "1", 1, "", "{}", "[]", "a\n\t\"{[,:]}", None, True, 0, 1.5, "\u0001\u0007"])


@pytest.mark.parametrize("keep_empty", [False, True])
def test_nested_arguments_equal_the_rule(spark, keep_empty):
    rng = random.Random(5)
    nodes = [{"a": nested(rng, 6), "b": nested(rng, 3), "time": nested(rng, 2)} for _ in range(400)]
    deep = {"k": 1}
    for i in range(60):
        deep = {"x": deep, "time": 1} if i % 3 else {"x": [deep, {"date": 2}]}
    nodes += [{}, deep, {"a": [{"time": 1}] * 3000}, {"a": [[{"time": 1}]], "b": [{"c": [[], {}, [[{}]]]}]}]
    known = {} if keep_empty else KNOWN
    text = lambda n: json.dumps(n, ensure_ascii=False, separators=(",", ":"))
    df = spark.createDataFrame([(i, text(n)) for i, n in enumerate(nodes)] + [(-1, None)], "i int, text string")
    for column, name in (("l", "level"), ("pid", "pid"), ("mt", "message"), ("tn", "name"), ("v", "version")):
        df = df.withColumn(column, F.lit(KNOWN[name]))
    found = df.select("i", pruned_json(F.col("text"), arguments._drops(keep_empty, False), keep_empty).alias("p"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["i"]: r["p"] for r in found.collect()}
    assert rows.pop(-1) is None
    assert {i: json.loads(p) for i, p in rows.items()} == {i: prune(n, known, keep_empty) for i, n in enumerate(nodes)}


def test_long_and_odd_lines_are_not_demoted(spark):
    got = records(spark, ["2025-04-03T00:10:19.148203+03:00 host p[1]: a \u0001 b", "[2025-04-03T00:10:19,148][WARN][lg] [P1] [svc] m\u0001\u0002n"])
    assert got[0][0] == "syslog" and got[0][1]["span"]["message"] == "a \u0001 b"
    assert got[1][0] == "es_text" and got[1][1]["mt"] == "m\u0001\u0002n"


def test_input_original_keys_stay(spark):
    options = Options(preserve_standard=True)
    got = records(spark, ['{"original_l":"mine","k":1}', '{"original_l":"mine","l":"E"}'], options)
    assert got[0][1]["args"] == {"original_l": "mine", "k": 1}
    assert got[1][1]["args"] == {"original_l": "E"}


def test_level_of_prefixed_json_is_its_own(spark):
    assert records(spark, ['[error] worker {"a":1}'], Options(prefixed_json=True))[0][1]["l"] == "Info"
