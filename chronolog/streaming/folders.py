"""The same normalisation over a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chronolog.options import DEFAULT, Options
from chronolog.plans.normalize import normalize
from chronolog.session import configure
from chronolog.sources.encoding import decode_lines
from chronolog.sources.files import SUFFIXES, raw_lines


def normalize_new_files(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    options: Options = DEFAULT,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the records of new files to a Parquet table, one ``batch`` partition per micro-batch.

    A file arrives whole in one micro-batch, so each batch decides encodings and normalises as a
    batch run would. A repeated batch overwrites its own partition. Global order is a batch matter.
    """
    configure(spark)
    stream = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}")
        .text(folder)
        .select("value", "_metadata")
    )

    def write(batch: DataFrame, number: int) -> None:
        records = normalize(decode_lines(raw_lines(batch)), options)
        records.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
