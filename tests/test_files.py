"""Files in, merged files out."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronolog import Options, normalize
from chronolog.functions.text import source_key
from chronolog.plans import merge as M
from chronolog.plans import sample_lines, sinks
from chronolog.plans.normalize import rendered
from chronolog.sources import files
from chronolog.sources.lookup import lookup_by_file
from chronolog.streaming.folders import normalize_new_files

RUSSIAN = "2025-04-03 00:00:01 ошибка: не удалось И"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "logs é+1"
    for name in ("a", "b", "c"):
        (root / name).mkdir(parents=True)
    (root / "a/app.log").write_text("2025-04-03 00:00:03 from a\n")
    (root / "b/app.log").write_text("2025-04-03 00:00:02 from b\n")
    (root / "c/x.NDJSON").write_text('{"a":1}\n')
    (root / "cp1251.log").write_bytes(RUSSIAN.encode("cp1251").replace(b"\x98", b"") + b"\nplain\n")
    (root / "utf8.log").write_bytes((RUSSIAN + "\n").encode())
    (root / "bom.json").write_bytes(b"\xef\xbb\xbf" + b'{"msg":"bom","time":"2025-04-03"}\n')
    (root / "bad.log").write_bytes(b"x \x98 y\n")
    (root / "cr.log").write_bytes(b"one\rtwo\r\nthree\n \t\n")
    return root


def lines_of(df, name):
    rows = df.where(F.col("file_path").endswith(name)).orderBy("file_block_start", "line_seq").collect()
    return [r.line for r in rows]


def test_folder_encodings_and_line_ends(spark, folder):
    df = files.read_folder(spark, str(folder))
    assert lines_of(df, "cp1251.log") == [RUSSIAN, "plain"]
    assert lines_of(df, "utf8.log") == [RUSSIAN]
    assert lines_of(df, "bom.json") == ['{"msg":"bom","time":"2025-04-03"}']
    assert lines_of(df, "bad.log") == ["x � y"]
    assert lines_of(df, "cr.log") == ["one", "two", "three", " \t"]
    assert lines_of(df, "NDJSON") == []
    keys = df.where(F.col("file_path").endswith("app.log")).select(source_key(F.col("file_path"))).distinct()
    assert keys.count() == 2
    paths = {r.file_path for r in df.select("file_path").distinct().collect()}
    assert str(folder / "a/app.log") in paths


def test_other_encoding_profiles(spark, folder):
    first = files.read_folder(spark, str(folder), encoding_profile="cp1251_first")
    assert lines_of(first, "utf8.log") == [RUSSIAN]
    assert lines_of(first, "bad.log") == ["x � y"]
    lossy = files.read_folder(spark, str(folder), encoding_profile="lossy")
    assert lines_of(lossy, "bad.log") == ["x  y"]


def test_listed_twice_is_read_twice_and_nothing_is_no_error(spark, folder):
    path = str(folder / "a/app.log")
    assert files.read_files(spark, [path, path]).count() == 2
    assert files.read_files(spark, [str(folder / "none.txt")]).count() == 0
    assert files.read_folder(spark, str(folder / "c"), files.LEGACY_SUFFIXES).count() == 0


def test_merge_folder_writes_sorted_lines(spark, folder, tmp_path):
    out = tmp_path / "out"
    metrics = sinks.merge_folder(spark, str(folder), str(out), Options(fallback_time="2000-01-01 00:00:00.000+00:00"))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    times = [json.loads(line)["t"] for line in text.splitlines()]
    assert times == sorted(times) and len(times) == metrics["records"] == 10
    assert metrics["bytes"] == len(text.encode()) and metrics["files"] == 7


def lines_frame(spark, rows):
    return spark.createDataFrame(rows, "line string, file_path string, file_block_start bigint, line_seq bigint")


def test_orders_differ_when_offsets_do(spark):
    rows = [('{"time":"2025-04-03T02:00:00+03:00","msg":"early"}', "/f.log", 0, 0), ('{"time":"2025-04-03T00:00:00Z","msg":"late"}', "/f.log", 0, 1)]
    for order, expected in (("instant", ["early", "late"]), ("text", ["late", "early"])):
        assert [r.mt for r in M.merge(lines_frame(spark, rows), order=order).collect()] == expected


def test_equal_times_keep_file_and_line_order_over_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"2025-04-03 00:00:00 line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        merged = M.merge(files.read_files(spark, [str(path)]), partitions=7)
        assert files.read_files(spark, [str(path)]).rdd.getNumPartitions() > 3
        pids = [int(r.pid) for r in merged.select("pid").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pids == list(range(5000))


def test_positions_number_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("x")).orderBy(F.desc("x"))
    rows = M.with_position(df).collect()
    assert all(r.position == 999 - r.x for r in rows) and len(rows) == 1000


def test_lookup_gives_the_same_with_and_without_broadcast(spark):
    lines = lines_frame(spark, [("l", f"/f{i % 3}", 0, i) for i in range(300)])
    facts = spark.createDataFrame([("/f0", "a"), ("/f1", "b")], "file_path string, fact string")
    small = lookup_by_file(lines, facts).select("line_seq", "fact")
    salted = lookup_by_file(lines, facts, broadcast_bytes=0).select("line_seq", "fact")
    assert sorted(small.collect()) == sorted(salted.collect()) and small.count() == 300


def test_table_sink_and_union(spark, tmp_path):
    out = normalize(lines_frame(spark, [("03.04.2025 0:10:19 x", "/f.log", 0, 0), ('{"time":"2025-04-04"}', "/f.log", 0, 1)]))
    sinks.write_table(M.union_records(out, out.drop("extra")), str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.groupBy("event_date").count().count() == 2 and back.count() == 4
    assert sinks.default_name().startswith("mrgd(")


def test_new_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_bytes((RUSSIAN + "\n").encode("utf8"))
    for round_number, name in enumerate(["b.log", None]):
        query = normalize_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1 + round_number
        if name:
            Path(tmp_path / "in" / name).write_text("2025-04-03 00:00:01 second\n")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.l for r in back.select("l").collect()} == {"Error", "Info"}
    assert back.select(rendered(back)).count() == 2


def test_valid_utf8_wins_in_every_profile(spark, tmp_path):
    (tmp_path / "one.log").write_bytes("café\n".encode())
    for profile in ("utf8_first", "cp1251_first"):
        assert lines_of(files.read_folder(spark, str(tmp_path), encoding_profile=profile), "one.log") == ["café"]


def test_missing_paths_and_folders_in_a_list(spark, folder):
    path = str(folder / "a/app.log")
    gone = str(folder / "gone.log")
    assert files.path_faults(spark, [path, gone, str(folder / "b")]) == {gone: "missing", str(folder / "b"): "folder"}
    rows = files.read_files(spark, [path, gone, str(folder / "b")]).collect()
    assert sorted(r.line for r in rows) == ["2025-04-03 00:00:02 from b", "2025-04-03 00:00:03 from a"]
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, [path, gone], skip_unreadable=False)


def test_merge_tells_which_files_gave_no_line(spark, tmp_path, caplog):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/full.log").write_text("2025-04-03 00:00:03 x\n")
    (tmp_path / "in/empty.log").write_text(" \n\n")
    found = sinks.merge_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (found["files"], found["files_read"], found["records"]) == (2, 1, 1)
    assert "empty.log" in caplog.text


def test_parts_never_outnumber_their_names():
    size = 200 * 10**12
    assert sinks.ranges_for(size) == 99_999 and sinks.ranges_for(size, 10**6) == 99_999
    names = [f"part-{k:05d}-x" for k in (0, 9, 10, 99_998)]
    assert names == sorted(names)


def test_events_come_in_tasks_of_few_rows(spark, tmp_path):
    count = 2 * sample_lines.ROWS_PER_TASK * spark.sparkContext.defaultParallelism
    rows = spark.range(0, count, 1, 8).selectExpr(
        "id AS event_id", "CAST('2025-01-01' AS TIMESTAMP_NTZ) AS ts", "id % 7 AS user_id", "'view' AS event_type"
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    spread_rows = sample_lines.events(spark, str(tmp_path))
    sizes = [r["count"] for r in spread_rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == count and max(sizes) < 1.1 * sample_lines.ROWS_PER_TASK


def test_lookup_without_broadcast_spreads_rows(spark):
    lines = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 4 == 1, F.lit("cold")).alias("file"),
        F.lit(0).alias("file_block_start"), F.col("id").alias("line_seq"),
    )
    facts = spark.createDataFrame([("hot", "a"), ("other", "b")], "file_path string, fact string")
    joined = lookup_by_file(lines, facts, "file", broadcast_bytes=0, lines_per_copy=100)
    broadcast = lookup_by_file(lines, facts, "file")
    key = lambda df: sorted((r.line_seq, r.file or "", r.fact or "") for r in df.collect())
    assert key(joined) == key(broadcast)
    none = joined.where("file IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(none) > 1 and max(r["count"] for r in none) < 1000


def test_utf16_files(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    # U+0A8A before U+0100 holds the bytes of a line feed across two characters, as U+0100 before U+0A8A does
    lines = [f"2025-04-03 00:00:{i % 60:02d} строка {i}" for i in range(3000)]
    lines[7], lines[8], lines[2000] = "a \u0a8a\u0100 b \u0100\u0a8a c", "\u0100\u0a8a\u0a8a\u0100", "\u0a8a\u0100\u0a8a\u0100 \u2028 😀"
    for name, charset in (("le", "utf-16-le"), ("be", "utf-16-be")):
        (root / f"{name}.log").write_bytes(("\ufeff" + "\n".join(lines) + "\n").encode(charset))
    (root / "crlf.log").write_bytes("\ufeffone\r\n\r\nlast é".encode("utf-16-le"))
    (root / "only.json").write_bytes(b"\xff\xfe")
    (root / "half.log").write_bytes("\ufeffok\n\ud800x\n".encode("utf-16-be", "surrogatepass"))
    (root / "utf8.log").write_bytes((RUSSIAN + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_folder(spark, str(root))
        assert lines_of(df, "le.log") == lines and lines_of(df, "be.log") == lines
        assert df.where(F.col("file_path").endswith("le.log")).select("file_block_start").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lines_of(df, "crlf.log") == ["one", "", "last é"] and lines_of(df, "utf8.log") == [RUSSIAN]
    assert lines_of(df, "only.json") in ([], [""]) and lines_of(df, "half.log") == ["ok", "\ufffd"]  # the unit behind a lone surrogate goes with it
    path = str(root / "crlf.log")
    assert files.read_files(spark, [path, path]).count() == 6


TEXT = [
    "Ошибка соединения с сервером базы данных, повтор через пять секунд",
    "2025-04-03 00:00:01 INFO запрос выполнен успешно, обработано записей: 120",
    "ВНИМАНИЕ: превышено время ожидания ответа от внешней службы",
    "Пользователь Иванов вошёл в систему с адреса 10.0.0.1",
]


@pytest.mark.parametrize("profile", ["utf8_first", "cp1251_first"])
def test_charsets_are_told_apart(spark, tmp_path, profile):
    written = {}
    for charset in ("cp1251", "koi8-r", "cp866", "utf-8"):
        for k in range(len(TEXT) + 1):
            name = f"{charset}-{k}.log"
            written[name] = TEXT if k == len(TEXT) else [TEXT[k], "plain"]
            (tmp_path / name).write_bytes(("\n".join(written[name]) + "\n").encode(charset))
    (tmp_path / "latin.log").write_bytes("café".encode("latin-1"))
    df = files.read_folder(spark, str(tmp_path), encoding_profile=profile)
    found = {name: lines_of(df, "/" + name) for name in written}
    assert found == written
    assert lines_of(df, "latin.log") == ["cafй"]
