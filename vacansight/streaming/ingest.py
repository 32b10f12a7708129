"""Incremental ingestion: new raw files are merged as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacansight.plans.ingest import ingest_batch
from vacansight.sources.raw import positioned
from vacansight.sources.store import Store


def ingest_stream(
    store: Store, raw: DataFrame, checkpoint: str, as_of: Callable[[], date] = date.today, first_batch_id: int = 0
) -> StreamingQuery:
    """Takes every waiting file and stops. A replayed micro-batch changes nothing.

    Batch ids go on from ``first_batch_id``, so that they stay apart from the ids of
    batches ingested in another way.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ordered = positioned(batch, F.col("source_place")).drop("source_place")
        ingest_batch(store, ordered, as_of(), first_batch_id + number)

    return (
        raw.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
