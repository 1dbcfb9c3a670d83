"""Writing merged records."""

from __future__ import annotations

import datetime
import logging
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolog.options import DEFAULT, Options
from chronolog.plans import merge as M
from chronolog.plans import parts
from chronolog.plans.parts import MOST_RANGES
from chronolog.sources.files import SUFFIXES, file_listing, read_folder

RANGE_BYTES = 256 * 1024 * 1024
#: So many files without lines are named in the log.
LOGGED = 100


def default_name(day: datetime.date | None = None) -> str:
    """Output folder name of a run."""
    return f"mrgd({(day or datetime.date.today()).isoformat()}).log"


def write_merged(records: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write sorted records as JSON Lines and return how many records and bytes were written.

    The part files, read in name order, are the merged log; each is sorted and they do not overlap.
    """
    return {k: v for k, v in parts.write_rendered(records, path, mode).items() if k in ("records", "bytes")}


def write_table(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records as Parquet by event date.

    The rebalance hint lets Spark split a date that holds a large share of the rows and join small
    ones, so that files come out evenly sized.
    """
    dated = records.withColumn("event_date", F.to_date("event_ts"))
    dated.hint("rebalance", F.col("event_date")).write.mode(mode).partitionBy("event_date").parquet(path)


def ranges_for(size: int, minimum: int = 1, target: int = RANGE_BYTES) -> int:
    """Number of sort ranges for an input of so many bytes, never more than part names can order.

    Beyond that, ranges get larger; the sort within a range spills.
    """
    return min(MOST_RANGES, max(minimum, math.ceil(size / target)))


def merge_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    options: Options = DEFAULT,
    order: str = "instant",
    encoding_profile: str = "utf8_first",
    suffixes: Iterable[str] = SUFFIXES,
) -> dict[str, int]:
    """Merge every log file below a folder; returns files found and read, records and bytes written.

    ``files_read`` counts files that gave records: one with blank lines only, or one that could not be read, is
    found, but not counted there, and is logged. The sort gets one range per 256 MB of input, and never fewer than the session's setting.
    In the order of instants a manifest of the parts is written too (``plans/parts.py``), for reading by time and ``add_folder``.
    """
    suffixes = tuple(suffixes)
    found = file_listing(spark, folder, suffixes).agg(F.count(F.lit(1)), F.sum("length")).first()
    ranges = ranges_for(found[1] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = read_folder(spark, folder, suffixes, encoding_profile)
    seen = parts.write_rendered(M.merge(lines, options, order, ranges), out, "errorifexists")
    if order == "instant":
        parts.write_manifest(spark, out, parts.spans_of(seen["starts"], seen["last"]))
    read = seen["files"]
    known = spark.createDataFrame([(h,) for h in read], "hash bigint")
    silent = file_listing(spark, folder, suffixes).join(known, F.xxhash64("file_path") == F.col("hash"), "left_anti")
    for row in silent.select("file_path").limit(LOGGED).collect():
        logging.getLogger(__name__).warning("no record came from %s", row.file_path)
    return {"files": found[0], "files_read": len(read), "records": seen["records"], "bytes": seen["bytes"]}


def add_folder(
    spark: SparkSession, folder: str, out: str, options: Options = DEFAULT, encoding_profile: str = "utf8_first",
    suffixes: Iterable[str] = SUFFIXES,
) -> dict[str, int]:
    """Add every log file below a folder to a merged log; see ``parts.add_records``.

    Which files a log holds already is not looked at: name a folder of new ones.
    """
    return parts.add_records(spark, read_folder(spark, folder, tuple(suffixes), encoding_profile), out, options)
