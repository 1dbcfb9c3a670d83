"""Merged logs by parts: reading by time, adding to them."""

import bisect
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolog import Options
from chronolog.plans import parts, sinks
from chronolog.plans.parts import place_among

FIXED = Options(fallback_time="2025-04-03 00:30:00.000+00:00")


def stamp(second):
    return f"2025-04-03 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def write_logs(root, name, seconds, mark):
    root.mkdir(parents=True, exist_ok=True)
    (root / name).write_text("".join(f"{stamp(s)} {mark} number {i}\n" for i, s in enumerate(seconds)))


def joined(out):
    return "".join(p.read_text() for p in sorted(out.glob("part-*.txt")))


@pytest.fixture
def merged(spark, tmp_path):
    pick = random.Random(5)
    write_logs(tmp_path / "in", "a.log", sorted(pick.sample(range(7200), 600)), "old")
    write_logs(tmp_path / "in", "b.log", [60] * 40 + [3000] * 300, "tie")
    out = tmp_path / "out"
    sinks.merge_folder(spark, str(tmp_path / "in"), str(out), FIXED)
    return out


def check_manifest(spark, out):
    """Offsets and spans hold for the bytes of the joined parts; the manifest names all files."""
    rows = parts.manifest(spark, str(out)).collect()
    whole = joined(out).encode()
    assert [r.name for r in rows] == sorted(p.name for p in out.glob("part-*.txt") if p.stat().st_size)
    assert sum(r.length for r in rows) == len(whole)
    for r in rows:
        own = whole[r.offset : r.offset + r.length]
        assert own == (out / r.name).read_bytes()
        ms = [round(datetime.fromisoformat(json.loads(line)["t"]).timestamp() * 1000) for line in own.decode().splitlines()]
        assert r.from_ms <= ms[0] and ms == sorted(ms) and ms[-1] <= r.until_ms
    return rows


def test_manifest_and_reading_by_time(spark, merged):
    rows = check_manifest(spark, merged)
    assert len(rows) > 2
    whole = joined(merged).encode()
    for start, end in ((stamp(2999), stamp(3001)), (stamp(0), stamp(59)), (stamp(7000), "2025-04-05"), (stamp(0), stamp(7200))):
        expected = [line for line in whole.decode().splitlines() if start <= json.loads(line)["t"][:19] <= end]
        first, last = parts.byte_window(spark, str(merged), start, end)
        cut = whole[first:last].decode().splitlines()
        assert [line for line in cut if start <= json.loads(line)["t"][:19] <= end] == expected
        read = parts.read_window(spark, str(merged), start, end).orderBy("file_path", "file_block_start", "line_seq")
        assert [r.line for r in read.collect()] == expected
    assert parts.byte_window(spark, str(merged), "2030-01-01", "2030-01-02") == (0, 0)
    assert parts.read_window(spark, str(merged), "2030-01-01", "2030-01-02").count() == 0
    narrow = parts.byte_window(spark, str(merged), stamp(7100), stamp(7100))
    assert narrow[1] - narrow[0] < len(whole)
    with pytest.raises(ValueError):
        parts.byte_window(spark, str(merged), "no time", "2030")


def test_adding_gives_the_whole_merge(spark, tmp_path, merged):
    before = {p.name: p.read_bytes() for p in merged.glob("part-*.txt")}
    rows = check_manifest(spark, merged)
    middle = (rows[1].from_ms // 1000) % 86400 + 1
    write_logs(tmp_path / "more", "z.log", [middle, middle, middle + 1], "new")
    found = sinks.add_folder(spark, str(tmp_path / "more"), str(merged), FIXED)
    assert found == {"records": 3, "rewritten": 1, "new": 0}
    kept = {p.name for p in merged.glob("part-*.txt")} & set(before)
    assert len(kept) == len(before) - 1 and all((merged / n).read_bytes() == before[n] for n in kept)
    check_manifest(spark, merged)
    # before the first record, ties, after the last one, at a line's own zone, without a time
    write_logs(tmp_path / "third", "zz.log", [0, 60, 3000, 7300, 9000, 7199], "third")
    (tmp_path / "third" / "zzz.log").write_text("no time here\n" + '{"time":"2025-04-03T05:00:00+03:00","msg":"zoned"}\n')
    found = sinks.add_folder(spark, str(tmp_path / "third"), str(merged), FIXED)
    assert found["records"] == 8 and found["new"] >= 1
    check_manifest(spark, merged)
    for k, source in enumerate(("in", "more", "third")):
        for p in (tmp_path / source).iterdir():
            (tmp_path / "all" / str(k)).mkdir(parents=True, exist_ok=True)
            (tmp_path / "all" / str(k) / p.name).write_bytes(p.read_bytes())
    sinks.merge_folder(spark, str(tmp_path / "all"), str(tmp_path / "whole"), FIXED)
    assert joined(merged) == joined(tmp_path / "whole")
    assert not (merged / "_adding").exists()


def test_a_lost_run_leaves_no_trace(spark, tmp_path, merged):
    text = joined(merged)
    (merged / "part-00001-000002-00000.txt").write_text('{"t":"2025-04-03 00:00:01.000+00:00"}\n')
    (merged / "_adding/end").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    found = sinks.add_folder(spark, str(tmp_path / "empty"), str(merged), FIXED)
    assert found == {"records": 0, "rewritten": 0, "new": 0}
    assert joined(merged) == text and not (merged / "_adding").exists()


def test_adding_to_an_empty_log_and_to_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sinks.merge_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), FIXED)
    write_logs(tmp_path / "more", "z.log", [5, 3], "new")
    found = sinks.add_folder(spark, str(tmp_path / "more"), str(tmp_path / "out"), FIXED)
    assert found["records"] == 2 and found["new"] == 1
    assert [json.loads(x)["t"][:19] for x in joined(tmp_path / "out").splitlines()] == [stamp(3), stamp(5)]
    with pytest.raises(parts.NoManifest):
        sinks.add_folder(spark, str(tmp_path / "more"), str(tmp_path / "nothing"), FIXED)


def test_place_among_many_bounds(spark):
    bounds = sorted(random.Random(3).choices(range(10**6), k=99_999))
    xs = [-5, 0, bounds[0], bounds[-1], 10**7, *random.Random(4).choices(range(10**6), k=200)]
    rows = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", place_among(bounds, F.col("x")).alias("at")).collect()
    assert all(r["at"] == max(0, bisect.bisect_right(bounds, r.x) - 1) for r in rows)
