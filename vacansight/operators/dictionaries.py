"""Name dictionaries: existing entries keep their id, new names get the next ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.session import with_dense_ids


def new_entries(
    dictionary: DataFrame, names: DataFrame, keys: list[str], id_col: str, extra: dict[str, Column] | None = None,
    highest: int | None = None,
) -> DataFrame:
    """Rows to append: the names not yet known, numbered after the highest id in key order.

    ``extra`` fills further columns, such as a skill's first category, which is set
    here once and never again. ``highest`` is the highest id so far where that is known.
    """
    missing = names.select(*keys).dropna(subset=keys).distinct().join(dictionary.select(*keys), keys, "left_anti")
    start = dictionary.agg(F.coalesce(F.max(id_col).cast("long"), F.lit(0).cast("long"))).scalar() if highest is None else highest
    numbered = with_dense_ids(missing, "_id", keys, start)
    for name, value in (extra or {}).items():
        numbered = numbered.withColumn(name, value)
    kind = dictionary.schema[id_col].dataType
    return numbered.withColumn(id_col, F.col("_id").cast(kind)).select(*dictionary.columns)


def seed(existing: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The seed rows that are not there yet."""
    return values.join(existing.select(*keys), keys, "left_anti").select(*existing.columns)
