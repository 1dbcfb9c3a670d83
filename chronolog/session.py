"""Session settings the library depends on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # wall-clock texts without an offset are read as UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated key inside a nested JSON object keeps its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # decode(..., 'windows-1251') needs the JVM's full charset list
    "spark.sql.legacy.javaCharsets": "true",
    # bytes that a charset does not know become replacement characters
    "spark.sql.legacy.codingErrorAction": "true",
    # HotSpot does not compile methods above this size: larger generated methods are better split
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above; safe to call on a shared session, any number of times."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder: on a cluster a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="chronolog-checkpoint-")
    context.setCheckpointDir(folder)
    return folder
