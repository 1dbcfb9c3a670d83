"""A merged log as numbered parts: the place of each in the whole, reading by time, adding to it.

The manifest of a merged log lies in its folder below ``_parts`` (which readers of the folder pass over), one version
for each change. It has one row per part file: ``number`` (from the name), ``name``, ``length``, ``offset`` (bytes of
all files before it, in name order), ``from_ms`` and ``until_ms`` (no record of the number is earlier or later; the first
has NULL where records without a time lead it). There are at most 99,999 numbers, so the driver may hold the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolog.functions.text import pinned
from chronolog.options import DEFAULT, Options
from chronolog.plans import merge as M
from chronolog.plans import normalize as N
from chronolog.sources.files import plain_path
from chronolog.sources.lookup import materialized

MANIFEST, STAGING = "_parts", "_adding"
#: Part files are numbered with five digits; with more of them, name order would not be sort order.
MOST_RANGES = 99_999
#: Enough halvings to find one of ``MOST_RANGES`` bounds.
STEPS = [1 << k for k in range(16, -1, -1)]
SCHEMA = "number int, name string, length bigint, offset bigint, from_ms bigint, until_ms bigint"


class NoManifest(ValueError):
    """The folder is no merged log whose parts are known."""


def _files(spark: SparkSession, path: str):
    """The file system and the path of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str, folders: bool = False) -> dict[str, int]:
    """Names and lengths of the files (or of the folders) directly below a folder."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return {}
    return {s.getPath().getName(): s.getLen() for s in files.listStatus(place) if s.isDirectory() == folders}


def number_of(name: str) -> int:
    return int(name.split("-")[1])


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the manifest that were written to their end, oldest first."""
    below = f"{path}/{MANIFEST}"
    known = [name for name in _names(spark, below, folders=True) if name.startswith("v")]
    return sorted(int(name[1:]) for name in known if "_SUCCESS" in _names(spark, f"{below}/{name}"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a merged log, in order; ``NoManifest`` where the folder has none."""
    versions = _versions(spark, path)
    if not versions:
        raise NoManifest(f"{path} has no manifest of its parts")
    return spark.read.schema(SCHEMA).json(f"{path}/{MANIFEST}/v{versions[-1]:06d}").orderBy("name")


def write_manifest(spark: SparkSession, path: str, spans: dict[int, tuple[int | None, int | None]], names: set[str] | None = None) -> int:
    """Write the next version of a manifest from the folder's files and the span of each number; returns the version.

    ``names`` are the files that belong to the log; otherwise all part files do.
    """
    version = max([0, *_versions(spark, path)]) + 1
    rows, offset = [], 0
    for name, length in sorted(_names(spark, path).items()):
        if name.startswith("part-") and (names is None or name in names):
            if length:
                rows.append((number_of(name), name, length, offset, *spans[number_of(name)]))
            offset += length
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{MANIFEST}/v{version:06d}")
    return version


def spans_of(starts: list[str], last: int | None, shift: int = 0) -> dict[int, tuple[int | None, int | None]]:
    """First and last possible time of each part, from the ``part:milliseconds`` of their first records.

    A part ends no later than the next one begins.
    """
    first = {}
    for start in starts:
        part, _, ms = start.partition(":")
        first[int(part) + shift] = int(ms) if ms else None
    numbers = sorted(first)
    after = [first[n] for n in numbers[1:]] + [last]
    return {n: (first[n], until) for n, until in zip(numbers, after)}


# --- reading by time


def _within(parts: DataFrame, start: int, end: int) -> DataFrame:
    return parts.where((F.coalesce("until_ms", F.lit(start - 1)) >= start) & (F.coalesce("from_ms", F.lit(start)) <= end))


def _millis(spark: SparkSession, *times: str) -> list[int]:
    """Milliseconds of times as Spark casts them; one that is no time is an error."""
    found = spark.range(1).select(*[F.unix_millis(F.lit(t).try_cast("timestamp")) for t in times]).first()
    if None in tuple(found):
        raise ValueError(f"no times: {times}")
    return list(found)


def byte_window(spark: SparkSession, path: str, start: str, end: str) -> tuple[int, int]:
    """Bytes, of all parts joined in name order, that hold every record from ``start`` to ``end``, both included.

    They begin and end at a part, so records beside the window are in them too; ``(0, 0)`` where there is none.
    """
    first, last = _millis(spark, start, end)
    span = _within(manifest(spark, path), first, last).agg(F.min("offset"), F.max(F.col("offset") + F.col("length"))).first()
    return (span[0], span[1]) if span[0] is not None else (0, 0)


def _lines_of(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text([f"{path}/{name}" for name in names])
    return read.select(
        F.col("value").alias("line"), plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"), F.monotonically_increasing_id().alias("line_seq"),
    )


def read_window(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Lines of a merged log from ``start`` to ``end``, both included, as ``N.timed`` gives them.

    Only parts that can hold such a line are read. ``file_path, file_block_start, line_seq`` give their order.
    """
    first, last = _millis(spark, start, end)
    names = [r.name for r in _within(manifest(spark, path), first, last).select("name").collect()]
    lines = _lines_of(spark, path, names) if names else spark.createDataFrame([], "line string, file_path string, file_block_start bigint, line_seq bigint")
    timed = N.timed(lines).select(*N.TIMED_COLUMNS)
    return timed.where(F.unix_millis("event_ts").between(first, last) & (F.col("time_source") != "fallback_now"))


# --- adding


def place_among(bounds: list[int], x: Column) -> Column:
    """Index of the last of the sorted ``bounds`` that is no greater than ``x``, by halving; 0 where there is none.

    The bounds are one constant of the plan, whatever their number.
    """
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    further = lambda at, step: F.coalesce(F.get(known, at + step) <= x, F.lit(False))
    found = F.aggregate(
        F.array(*[F.lit(s) for s in STEPS]), F.lit(-1), lambda at, step: F.when(further(at, step), at + step).otherwise(at)
    )
    return F.greatest(found, F.lit(0))


def _old_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of some parts with their number and a time that never falls within it, so that their order stays."""
    lines = N.timed(_lines_of(spark, path, names)).select(*N.TIMED_COLUMNS)
    known = F.when(F.col("time_source") != "fallback_now", F.unix_millis("event_ts"))
    number = F.regexp_extract("file_path", r"part-(\d+)-[^/]*$", 1).cast("int")
    in_part = Window.partitionBy("number").orderBy(*M.TIES).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("number", number).withColumn("ms", F.max(known).over(in_part))


def add_records(spark: SparkSession, lines: DataFrame, path: str, options: Options = DEFAULT, target: int = 256 * 1024 * 1024) -> dict[str, int]:
    """Add lines to a merged log (by instant) that has a manifest; returns records added, parts rewritten and parts new.

    The result is the log that merging all lines at once would give, but that of records of the same millisecond those
    already there come first. Only numbers whose span holds a new record are read and rewritten; records from the
    log's last time on become new numbers at its end. All other files stay as they are. New files take their names before the
    next version of the manifest is written, replaced ones go after it: readers through the manifest see the log before or
    after. What a run that was lost left behind is removed by the next one. One run at a time may add.
    """
    known = manifest(spark, path).collect()
    version = _versions(spark, path)[-1] + 1
    files, folder = _files(spark, path)
    staged = f"{path}/{STAGING}"
    below = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)
    names = {r.name for r in known}
    stale = [n for n, length in _names(spark, path).items() if n.startswith("part-") and length and n not in names]
    for name in [STAGING, *stale]:
        files.delete(below(name), True)

    spans = {r.number: (r.from_ms, r.until_ms) for r in known}
    numbers = sorted(spans)
    tail = numbers[-1] + 1 if numbers else 0
    last = max((u for _, u in spans.values() if u is not None), default=None)
    timed = N.timed(lines, options).select(*N.TIMED_COLUMNS, F.unix_millis("event_ts").alias("ms"))
    if numbers:
        lowest = -(1 << 62)
        found = place_among([lowest if spans[n][0] is None else spans[n][0] for n in numbers], F.coalesce("ms", F.lit(lowest)))
        known_numbers = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")
        inside = F.get(known_numbers, found)
        at_end = F.col("ms").isNotNull() if last is None else F.coalesce(F.col("ms") >= last, F.lit(False))
        number = F.when(at_end, F.lit(tail)).otherwise(inside)
    else:
        number = F.lit(tail)
    new = materialized(timed.withColumn("number", pinned(number)))
    touched = {
        r.number: r for r in new.groupBy("number").agg(
            F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("line")).alias("size"), F.min("ms").alias("least"),
            F.max(F.col("ms").isNull()).alias("without"), F.max("ms").alias("most"),
        ).collect()
    }
    old_of = {n: sorted(r.name for r in known if r.number == n) for n in touched if n in spans}
    moved: dict[str, str] = {}
    if old_of:
        replaced = [name for n in sorted(old_of) for name in old_of[n]]
        size = sum(r.length for r in known if r.number in old_of) + sum(touched[n].size for n in old_of)
        order = ["number", F.col("ms").asc_nulls_first(), "added", *M.TIES]
        inserted = new.where(F.col("number") < tail)
        both = _old_lines(spark, path, replaced).withColumn("added", F.lit(False)).unionByName(inserted.withColumn("added", F.lit(True)))
        ranges = min(MOST_RANGES, max(len(old_of), -(-size // target)))
        ordered = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        fields = N.with_fields(ordered.withColumnRenamed("line", "_line").withColumn("line", F.when(F.col("added"), F.col("_line"))), options, ("_line", "added", "number"))
        value = F.when(F.col("added"), N.rendered(fields)).otherwise(F.col("_line"))
        fields.select(value.alias("value"), "number").write.partitionBy("number").text(f"{staged}/inside")
        for n in sorted(old_of):
            inside_names = sorted(x for x in _names(spark, f"{staged}/inside/number={n}") if x.startswith("part-"))
            moved |= {f"{STAGING}/inside/number={n}/{x}": f"part-{n:05d}-{version:06d}-{k:05d}.txt" for k, x in enumerate(inside_names)}
            low, high = spans[n]
            if n == numbers[0]:
                least = touched[n].least
                low = None if touched[n].without or low is None else min(low, least)
                high = max((x for x in (high, touched[n].most) if x is not None), default=None)
            spans[n] = (low, high)
    if tail in touched:
        ranges = max(1, -(-touched[tail].size // target))
        if tail + ranges > MOST_RANGES + 1:
            raise ValueError("the log has no part numbers left; merge it anew")
        keys = M.order_keys()
        ordered = new.where(F.col("number") == tail).select(*N.TIMED_COLUMNS).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        starts = write_rendered(N.with_fields(ordered, options), f"{staged}/end", "errorifexists")
        spans |= spans_of(starts["starts"], starts["last"], tail)
        for name, length in _names(spark, f"{staged}/end").items():
            if name.startswith("part-") and length:
                moved[f"{STAGING}/end/{name}"] = f"part-{number_of(name) + tail:05d}-{version:06d}-00000.txt"
    for source, name in moved.items():
        if not files.rename(below(source), below(name)):
            raise OSError(f"could not move {source} to {name}")
    gone = {name for n in old_of for name in old_of[n]}
    if moved:
        write_manifest(spark, path, spans, (names - gone) | set(moved.values()))
    for name in [*gone, STAGING]:
        files.delete(below(name), True)
    new_parts = sum(1 for name in moved.values() if number_of(name) >= tail)
    return {"records": sum(r.records for r in touched.values()), "rewritten": len(gone), "new": new_parts}


def write_rendered(records: DataFrame, path: str, mode: str) -> dict:
    """Write records as JSON Lines; what was observed meanwhile: ``M.observed``, without another pass."""
    shown = [N.rendered(records).alias("value"), *[F.col(c) for c in ("file_path", "event_ts") if c in records.columns]]
    rows = records.select(*shown, F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"))
    lines, observation = M.observed(rows)
    lines.select("value").write.mode(mode).text(path)
    return observation.get
