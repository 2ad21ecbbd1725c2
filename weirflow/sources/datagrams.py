"""Captured datagrams: one file each, as a capture tool leaves them; batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A datagram's buffer: what is longer is cut there, and is no sound packet any more.
MOST_BYTES = 1500
_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _packets(files: DataFrame) -> DataFrame:
    return files.select(F.substring("content", F.lit(1), F.lit(MOST_BYTES)).alias("packet"), F.col("modificationTime").alias("received_at"), "path", (F.col("length") > MOST_BYTES).alias("cut"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """packet, received_at (the file's time), path and cut of each file below a path."""
    return _packets(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def stream(spark: SparkSession, path: str, per_trigger: int = 10_000) -> DataFrame:
    """The same of files as they come, `per_trigger` at a time."""
    return _packets(spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(path))
