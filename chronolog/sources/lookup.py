"""Joining lines to facts about their files, whatever the number of files or lines per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolog.session import ensure_checkpoint_dir

FEW = 16
BROADCAST_BYTES = 32 * 1024 * 1024
LINES_PER_COPY = 4_000_000


def spread(df: DataFrame, *keys: str, rows_per_task: int | None = None) -> DataFrame:
    """A table that comes in fewer partitions than there are cores, spread over all cores.

    Reading a line costs more than moving it, so one unsplittable file should not keep all but one
    core idle. Only tables of a few partitions move: beyond ``FEW``, whatever the cluster, a table stays
    where it is, unless it has more than ``rows_per_task`` rows to a partition; then it is spread over as many
    partitions as that asks for, so that no task grows with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df.rdd.getNumPartitions()
    wanted = cores if partitions < min(cores, FEW) else 0
    if rows_per_task and (needed := -(-df.count() // rows_per_task)) > max(partitions, wanted):
        wanted = max(needed, cores)
    return df.repartition(wanted, *keys) if wanted else df


def materialized(df: DataFrame) -> DataFrame:
    """The table on reliable storage, so that it is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def size_in_bytes(df: DataFrame) -> int:
    """Size of a small-looking table, measured over its rows as JSON text."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]


def lookup_by_file(
    lines: DataFrame, facts: DataFrame, key: str = "file_path", fact_key: str = "file_path",
    broadcast_bytes: int = BROADCAST_BYTES, lines_per_copy: int = LINES_PER_COPY,
) -> DataFrame:
    """Left join of lines with facts holding at most one row per file.

    The facts are computed and measured first. Up to ``broadcast_bytes`` they are broadcast and the
    lines do not move. Beyond, lines without a key, which no fact can match, stay out of the join, and the
    others are spread over copies of their file's row: one for every ``lines_per_copy`` lines that
    the file is counted to have, so that a file with a large share of all lines meets many tasks.
    """
    facts = materialized(facts)
    on = F.col("_key") == F.col(key)
    right = facts.withColumnRenamed(fact_key, "_key")
    if size_in_bytes(facts) <= broadcast_bytes:
        return lines.join(F.broadcast(right), on, "left").drop("_key")
    keyed = lines.where(F.col(key).isNotNull())
    counted = keyed.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_lines"))
    many = F.ceil(F.col("_lines") / lines_per_copy).cast("int")
    # only files that need more than one copy, at most one for every lines_per_copy lines of the input
    large = F.broadcast(counted.where(many > 1).select("_key", many.alias("_copies")))
    copies = right.join(large, "_key", "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    )
    salted = keyed.join(large.withColumnRenamed("_key", "_large"), F.col("_large") == F.col(key), "left").withColumn(
        "_salt", F.pmod(F.xxhash64("file_block_start", "line_seq"), F.coalesce("_copies", F.lit(1))).cast("int")
    )
    joined = salted.drop("_large", "_copies").join(
        copies.drop("_copies"), on & (F.col("_copy") == F.col("_salt")), "left"
    )
    return joined.drop("_key", "_copy", "_salt").unionByName(lines.where(F.col(key).isNull()), allowMissingColumns=True)
