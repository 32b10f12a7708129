"""Event-time jobs: repeat dropping and daily counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_instant(c: str) -> Column:
    """A zone-less time read as UTC. Watermarks need an instant; a cast would read the
    time in the session's own zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {c}))")


def utc_day(c: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def drop_repeats(stream: DataFrame, keys: list[str], time_col: str, horizon: str) -> DataFrame:
    """First sighting of each key; a key is forgotten ``horizon`` after it was last kept."""
    return stream.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, time_col: str, key_col: str, lateness: str = "1 day") -> DataFrame:
    """Rows per day and key; rows later than the watermark are left out."""
    return (
        stream.withWatermark(time_col, lateness)
        .groupBy(F.window(time_col, "1 day").alias("day"), F.col(key_col).alias("skill"))
        .agg(F.count(F.lit(1)).alias("posting_count"))
        .select(utc_day(F.col("day.start")).alias("snapshot_date"), "skill", "posting_count")
    )


def distinct_daily_counts(
    stream: DataFrame, time_col: str, key_col: str, id_col: str, lateness: str = "1 day"
) -> DataFrame:
    """Daily counts where a repeated id counts once.

    A stream cannot count distinct ids exactly, so repeats are dropped first. Days come
    out once the watermark has passed them (``append`` mode), the last ones later.
    """
    once = drop_repeats(stream, [id_col, key_col], time_col, lateness)
    return (
        once.groupBy(F.window(time_col, "1 day").alias("day"), F.col(key_col).alias("skill"))
        .agg(F.count(F.lit(1)).alias("posting_count"))
        .select(utc_day(F.col("day.start")).alias("snapshot_date"), "skill", "posting_count")
    )


def to_table(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the counts over everything waiting and appends each micro-batch's changed rows.

    ``update`` mode shows the current day at once; ``append`` would hold a day back
    until the watermark has passed it.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(path)

    counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def latest_counts(saved: DataFrame) -> DataFrame:
    """The last word on each day and key."""
    return saved.groupBy("snapshot_date", "skill").agg(F.max_by("posting_count", "batch").alias("posting_count"))


def first_rows_to_table(kept: DataFrame, path: str, checkpoint: str) -> None:
    kept.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
