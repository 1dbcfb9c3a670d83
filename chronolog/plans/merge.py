"""Merging records of all sources into one order, and counting them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chronolog.options import DEFAULT, Options
from chronolog.plans import normalize as N
from chronolog.sources.lookup import materialized

TIES = ["file_path", "file_block_start", "line_seq"]
ORDERS = ("instant", "text")


def order_keys(order: str = "instant") -> list[Column]:
    """Sort keys: event time as instant or as text, then file and line order."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    time = F.col("event_ts") if order == "instant" else F.col("t")
    return [time.asc_nulls_first(), *[F.col(c) for c in TIES]]


def union_records(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def sort_records(df: DataFrame, order: str = "instant", partitions: int | None = None) -> DataFrame:
    """Global order by range-partitioned sort. File and line keys also split ranges of equal times.

    ``partitions`` sets the number of ranges; otherwise ``spark.sql.shuffle.partitions`` does.
    """
    keys = order_keys(order)
    if partitions is None:
        return df.orderBy(*keys)
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def merge(
    lines: DataFrame,
    options: Options = DEFAULT,
    order: str = "instant",
    partitions: int | None = None,
) -> DataFrame:
    """Canonical records of all lines in event-time order.

    Only the line, its format and its time are shuffled; the remaining columns are worked out
    after the sort. That keeps the shuffle as small as the input, and the pass in which Spark
    samples the sort keys does not evaluate what the keys do not need.
    """
    timed = N.timed(lines, options).select(*N.TIMED_COLUMNS)
    return N.with_fields(sort_records(timed, order, partitions), options)


def sort_within_files(records: DataFrame, order: str = "text", partitions: int | None = None) -> DataFrame:
    """Each file's records together and in time order.

    Ranges over file and time, rather than one task per file, keep a very large file spread out.
    """
    time, *ties = order_keys(order)
    keys = [F.col("file_path"), time, *ties[1:]]
    spread = records.repartitionByRange(*keys) if partitions is None else records.repartitionByRange(partitions, *keys)
    return spread.sortWithinPartitions(*keys)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a globally sorted table from 0.

    The sorted rows are put on reliable storage first, which fixes their partitions. Each row then
    takes its place within the partition plus the number of rows in earlier partitions; that table
    of offsets has one row per partition.
    """
    fixed = materialized(ordered)
    numbered = fixed.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.select("*", part.alias("_part"), place.alias("_place")).drop("_id")
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_first_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumnRenamed("_part", "_first_part").select(
        "_first_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    joined = numbered.join(F.broadcast(offsets), F.col("_part") == F.col("_first_part"))
    return joined.withColumn(name, F.col("_start") + F.col("_place")).drop(
        "_part", "_place", "_first_part", "_start"
    )


# --- metrics


def rendered_bytes(line: Column) -> Column:
    """UTF-8 length of one output line with its newline."""
    return F.octet_length(line).cast("bigint") + 1


def records_per_file(records: DataFrame) -> DataFrame:
    return records.groupBy("file_path").agg(F.count(F.lit(1)).alias("records"))


def merge_metrics(records: DataFrame) -> DataFrame:
    """Records, output bytes and files that gave output, as one row."""
    per_file = records.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(rendered_bytes(N.rendered(records))).alias("bytes"),
    )
    return per_file.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count(F.lit(1)).alias("files"),
    )


def observed(rendered: DataFrame, name: str = "merge") -> tuple[DataFrame, Observation]:
    """Count records and bytes of rendered lines while they are written, without another pass.

    Where the rows also tell their ``file_path``, ``files`` is the set of the paths' hashes: eight bytes for each file.
    Where they tell their ``event_ts``, ``row`` and ``part``, ``starts`` has ``part:milliseconds`` for the first row of each
    part (no more than there are part files), and ``last`` the latest time.
    """
    observation = Observation(name)
    files = [F.collect_set(F.xxhash64("file_path")).alias("files")] if "file_path" in rendered.columns else []
    starts = []
    if "part" in rendered.columns and "event_ts" in rendered.columns:
        ms = F.unix_millis("event_ts")
        first = F.when(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.concat("part", F.lit(":"), F.coalesce(ms.cast("string"), F.lit(""))))
        starts = [F.collect_set(first).alias("starts"), F.max(ms).alias("last")]
    counted = rendered.observe(
        observation,
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(rendered_bytes(F.col("value"))), F.lit(0)).alias("bytes"),
        *files,
        *starts,
    )
    return counted, observation
