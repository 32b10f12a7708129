"""Keyed merge of a batch of sightings into the postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.session import with_dense_ids

KEPT = ["job_id", "first_seen_date"]
TRACKED = ["first_seen_date", "last_seen_date", "times_seen", "last_batch_id"]


def first_sightings(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.

    Keeping only place 1 lets Spark drop the others in the map tasks already, so a
    key that holds a large part of the batch sends one row per task to the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def new_job_ids(current: DataFrame, batch: DataFrame, key: str, order: list[str], highest: Column | None = None) -> DataFrame:
    """``key, job_id`` for keys not in ``current``, numbered on in batch order.

    Works on the keys alone; the wide rows are not moved for it.
    """
    unknown = batch.select(key, *[c for c in order if c != key]).join(current.select(key), key, "left_anti")
    start = highest if highest is not None else current.agg(F.coalesce(F.max("job_id"), F.lit(0).cast("long"))).scalar()
    return with_dense_ids(unknown, "job_id", order, start).select(key, "job_id")


def merge_batch(
    current: DataFrame, batch: DataFrame, new_ids: DataFrame, as_of: Column, batch_id: int, key: str = "fingerprint"
) -> DataFrame:
    """``current`` with the batch applied: new keys inserted, known ones refreshed.

    ``batch`` has one row per key. Job id and first day never change; the counter
    goes up once per batch, and not again when the same batch is applied twice.
    """
    values = [c for c in current.columns if c not in {key, *KEPT, *TRACKED}]
    seen = F.col("b._in_batch").isNotNull()
    known = F.col("c.job_id").isNotNull()
    replayed = known & F.col("c.last_batch_id").eqNullSafe(F.lit(batch_id))
    incoming = batch.join(new_ids.withColumnRenamed("job_id", "_new_id"), key, "left").withColumn("_in_batch", F.lit(True))
    joined = current.alias("c").join(incoming.alias("b"), F.col(f"c.{key}") == F.col(f"b.{key}"), "full_outer")
    out = {
        key: F.coalesce(f"c.{key}", f"b.{key}"),
        "job_id": F.coalesce("c.job_id", "b._new_id"),
        "first_seen_date": F.coalesce("c.first_seen_date", as_of),
        "last_seen_date": F.when(seen, as_of).otherwise(F.col("c.last_seen_date")),
        "times_seen": F.when(~known, 1)
        .when(seen & ~replayed, F.col("c.times_seen") + 1)
        .otherwise(F.col("c.times_seen"))
        .cast("int"),
        "last_batch_id": F.when(seen, F.lit(batch_id)).otherwise(F.col("c.last_batch_id")).cast("long"),
    }
    out |= {v: F.when(seen, F.col(f"b.{v}")).otherwise(F.col(f"c.{v}")) for v in values}
    return joined.select(*[out[c].alias(c) for c in current.columns])


def batch_counts(merged: DataFrame, batch_id: int) -> DataFrame:
    """New and repeated postings of one batch."""
    mine = merged.filter(F.col("last_batch_id") == batch_id)
    return mine.agg(
        F.count_if(F.col("times_seen") == 1).alias("new_postings"),
        F.count_if(F.col("times_seen") > 1).alias("repeat_postings"),
    )


def rebuild_children(children: DataFrame, touched: DataFrame, fresh: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of untouched parents as they are, rows of touched parents replaced."""
    kept = children.join(touched.select(key).distinct(), key, "left_anti")
    return kept.select(*children.columns).unionByName(fresh.select(*children.columns))
