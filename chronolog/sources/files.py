"""Reading log files as line tables."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolog.session import configure
from chronolog.sources.encoding import decode_lines, file_encodings, wide_lines
from chronolog.sources.lookup import lookup_by_file, materialized

SUFFIXES = ("log", "json", "ndjson")
LEGACY_SUFFIXES = ("log", "json")
MISSING, FOLDER = "missing", "folder"
#: Encodings of two bytes a character, and their line feeds.
WIDE = {"utf_16_le": "\n\0", "utf_16_be": "\0\n"}


def _pattern(suffixes: tuple[str, ...]) -> str:
    return "*.{" + ",".join(suffixes) + "}"


def plain_path(path: Column) -> Column:
    """File path as the user knows it: no percent escapes, no ``file:`` scheme."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def raw_lines(reader, uri: bool = False) -> DataFrame:
    """Line table over a text reader: undecoded line, path, split start and order in the split.

    ``line_seq`` grows along each split, and splits of one file are ordered by where they start, so
    the last two columns give the line order of a file however many tasks read it. ``uri`` adds the path as Spark names it.
    """
    return reader.select(
        F.col("value").alias("line"),
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.monotonically_increasing_id().alias("line_seq"),
        *[F.col("_metadata.file_path").alias("uri")] * uri,
    )


def _reader(spark: SparkSession, skip_unreadable: bool):
    configure(spark)
    skip = str(skip_unreadable).lower()
    return spark.read.option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip)


def read_files(
    spark: SparkSession,
    paths: list[str],
    suffixes: tuple[str, ...] = SUFFIXES,
    encoding_profile: str = "utf8_first",
    skip_unreadable: bool = True,
) -> DataFrame:
    """Lines of the listed files, a file listed twice read twice; other suffixes are left out.

    A folder in the list is read with everything below it. What does not exist is skipped and logged, as
    ``path_faults`` tells beforehand; with ``skip_unreadable`` off it is an error.
    """
    faults = path_faults(spark, paths)
    for path, fault in faults.items():
        if fault == MISSING:
            if not skip_unreadable:
                raise FileNotFoundError(path)
            logging.getLogger(__name__).warning("skipped, no such file: %s", path)
    folders = [p for p in paths if faults.get(p) == FOLDER]
    wanted = [p for p in paths if p not in faults and p.rsplit(".", 1)[-1].lower() in suffixes]
    tables = [_reader(spark, skip_unreadable).text(wanted)] if wanted else []
    if folders:
        below = _reader(spark, skip_unreadable).option("recursiveFileLookup", "true")
        tables.append(below.option("pathGlobFilter", _pattern(suffixes)).text(folders))
    if not tables:
        return _none(spark)
    lines = raw_lines(tables[0], uri=True)
    for table in tables[1:]:
        lines = lines.unionByName(raw_lines(table, uri=True))
    return _decoded(spark, lines, encoding_profile, skip_unreadable, wanted)


def path_faults(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Of the listed paths those that are no file: ``missing`` or ``folder``. Patterns match files."""
    context = spark.sparkContext
    faults = {}
    for path in dict.fromkeys(paths):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(place)
        if not found:
            faults[path] = MISSING
        elif any(status.isDirectory() for status in found):
            faults[path] = FOLDER
    return faults


def read_folder(
    spark: SparkSession,
    folder: str,
    suffixes: tuple[str, ...] = SUFFIXES,
    encoding_profile: str = "utf8_first",
    skip_unreadable: bool = True,
) -> DataFrame:
    """Lines of all log files below a folder. Suffixes are case-sensitive; finding none is no error."""
    reader = (
        _reader(spark, skip_unreadable)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _pattern(suffixes))
    )
    return _decoded(spark, raw_lines(reader.text(folder), uri=True), encoding_profile, skip_unreadable)


def _decoded(spark: SparkSession, raw: DataFrame, profile: str, skip_unreadable: bool, listed: list[str] = ()) -> DataFrame:
    """Lines of all files by their encodings. UTF-16 files are read again, cut at their own line feeds.

    The driver holds the paths of those files, as it holds those of all files to read them; a file listed
    twice is read twice again.
    """
    if profile == "lossy":
        return decode_lines(raw.drop("uri"), profile)
    encodings = materialized(file_encodings(raw, profile))
    wide = {e: [] for e in WIDE}
    for row in encodings.where(F.col("encoding").isin(*WIDE)).collect():
        wide[row.encoding] += [row.uri] * max(1, list(listed).count(row.file_path))
    facts = encodings.select("file_path", "encoding")
    narrow = raw.drop("uri")
    if not any(wide.values()):
        return decode_lines(narrow, profile, facts)
    others = facts.where(F.col("encoding").isin(*WIDE)).select(F.col("file_path").alias("wide_path"))
    narrow = lookup_by_file(narrow, others.withColumn("wide", F.lit(True)), fact_key="wide_path").where("wide IS NULL").drop("wide")
    lines = decode_lines(narrow, profile, facts)
    for encoding, feed in WIDE.items():
        if wide[encoding]:
            reader = _reader(spark, skip_unreadable).option("lineSep", feed).text(wide[encoding])
            lines = lines.unionByName(wide_lines(raw_lines(reader), encoding == "utf_16_le"))
    return lines


def file_listing(
    spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """Path and size of every log file below a folder, without reading contents."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _pattern(suffixes))
    )
    return reader.load(folder).select(plain_path(F.col("path")).alias("file_path"), "length")


def _none(spark: SparkSession) -> DataFrame:
    schema = "line string, file_path string, file_block_start bigint, line_seq bigint"
    return spark.createDataFrame([], schema)
