"""Written intermediate tables, checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows of a few numbers each (some 30 MB); beyond
#: that the join is left to shuffle.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; a temporary one on local masters only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="chronolog-llm-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh(*names: str) -> list[str]:
    """Column names that no table has by chance, to stand beside a caller's own columns."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{name}_{tag}" for name in names]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python workers at most so many rows at once, which both sides hold in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder; lineage ends there.

    Files survive the loss of executors and are read again column by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """As ``written``, with the rows bucketed by a column: a join or grouping by it need not move them.

    There are as many buckets as ``spark.sql.shuffle.partitions``. The catalog forgets the table's name at
    once; its files stay in the shared folder.
    """
    spark = df.sparkSession
    name = f"chronolog_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved while the name is known
    spark.sql(f"DROP TABLE {name}")
    return table


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have few rows. Pass narrow, written tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(id, component)``, the least id reachable.

    Labels spread to neighbours and labels of labels are followed, so rounds grow with the logarithm
    of a component's width. Every round is written to the shared folder. A node of many links is
    pre-aggregated in each task, its copies of the label come by a join that may be split for skew.
    """
    both = written(
        links.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(links.select("b", "a"))
        .where("id <> other")
        .distinct()
    )
    labels = written(both.groupBy("id").agg(F.min(F.least("id", "other")).alias("component")))
    for _ in range(rounds):
        near = (
            both.join(labels.withColumnRenamed("id", "other"), "other")
            .groupBy("id")
            .agg(F.min("component").alias("near"))
        )
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = written(
            labels.join(near, "id", "left")
            .join(jump, "component", "left")
            .select(
                "id",
                F.least("component", "near", "far").alias("component"),
                (F.least("near", "far") < F.col("component")).alias("moved"),
            )
        )
        labels = new.select("id", "component")
        if not new.where("moved").head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
