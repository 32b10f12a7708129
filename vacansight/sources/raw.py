"""Raw posting records: read as text columns, unusable rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansight.schemas import RAW_POSTING


def place() -> Column:
    """Where a record's split lies: file, then the split's first byte in it. Not the order of the tasks,
    which depends on sizes and settings."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start")


def positioned(rows: DataFrame, split: Column) -> DataFrame:
    """``rows`` with ``batch_pos``: the split, then the place within it."""
    return rows.withColumn("batch_pos", F.struct(split.alias("split"), F.monotonically_increasing_id().alias("at")))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with their position; the position decides which of two duplicates is first."""
    return positioned(spark.read.schema(RAW_POSTING).json(path), place())


def stream_raw(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_POSTING)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("source_place", place())


def write_aside(rows: DataFrame, path: str) -> None:
    """Keeps records as JSON where they could not be stored or read."""
    rows.write.mode("append").json(path)
