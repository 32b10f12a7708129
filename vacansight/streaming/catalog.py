"""Registered streaming queries: the events file as a stream, read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansight.session import shared_dir
from vacansight.streaming import windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumns({"ts": windows.utc_instant("ts"), "skill": F.get_json_object("props", "$.k")})


def _fresh_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4()}"


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _fresh_dir(spark)
    windows.to_table(windows.daily_counts(_events(spark, sf_dir), "ts", "skill"), f"{base}/counts", f"{base}/progress")
    return windows.latest_counts(spark.read.parquet(f"{base}/counts"))


def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _fresh_dir(spark)
    kept = windows.drop_repeats(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "31 days")
    windows.first_rows_to_table(kept.select("user_id", "event_type"), f"{base}/rows", f"{base}/progress")
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/rows")


def stream_distinct_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the days the watermark has passed; every event is sent twice."""
    base = _fresh_dir(spark)
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    counts = windows.distinct_daily_counts(twice, "ts", "skill", "event_id")
    windows.first_rows_to_table(counts, f"{base}/rows", f"{base}/progress")
    return spark.read.schema("snapshot_date date, skill string, posting_count long").parquet(f"{base}/rows")


QUERIES = {
    "stream_daily_counts": stream_daily_counts,
    "stream_distinct_daily_counts": stream_distinct_daily_counts,
    "stream_first_sightings": stream_first_sightings,
}
