"""Seed dimensions as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacansight import schemas, vocab
from vacansight.session import small_table


def states(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(enumerate(vocab.STATES, 1)), schemas.STATE)


def cities(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(i, name, state) for i, (name, state) in enumerate(vocab.CITIES, 1)], schemas.CITY)


def blocklist(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(s,) for s in vocab.BLOCKLIST], schemas.BLOCKLIST)


def coordinates(spark: SparkSession) -> DataFrame:
    return small_table(spark, vocab.CITY_COORDINATES, "city_name string, lat double, lon double")
