"""Location text -> canonical cities, with what could not be placed kept visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.functions.text import let, list_parts, look_up, strip
from vacansight.vocab import CITY_ALIASES


def city_ids_by_name(cities: DataFrame, aliases: dict[str, str] | None = None) -> Column:
    """One ``map<city_name, city_id>``, limited to the cities the alias table can name."""
    named = sorted(set((aliases or CITY_ALIASES).values()))
    return (
        cities.filter(F.col("city_name").isin(named))
        .agg(F.map_from_entries(F.collect_list(F.struct("city_name", "city_id"))))
        .scalar()
    )


def resolve_locations(
    df: DataFrame, location_col: str, cities: DataFrame, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Adds ``city_ids`` (sorted, distinct) and ``unmapped_locations``.

    A locality in brackets is ignored; the country and remote mentions are not
    places; a known city that is missing from ``cities`` stays unmapped.
    """
    table = aliases or CITY_ALIASES
    fragments = F.filter(list_parts(F.coalesce(F.col(location_col), F.lit(""))), lambda f: f != "")

    def placed(fragment: Column, key: Column, place: Column) -> Column:
        return F.struct(
            fragment.alias("fragment"),
            F.try_element_at(F.col("_city_map"), place).alias("city_id"),
            (place.isNull() & ((key == "india") | key.contains("remote"))).alias("ignored"),
        )

    def read(fragment: Column) -> Column:
        bracketed = F.when(fragment.contains("("), strip(F.regexp_replace(fragment, r"\(.*?\)", "")))
        bare = F.lower(bracketed.otherwise(fragment))
        return let(bare, lambda key: let(look_up(table, key), lambda place: placed(fragment, key, place)))

    return (
        df.withColumn("_city_map", city_ids_by_name(cities, table))
        .withColumn("_places", F.transform(fragments, read))
        .withColumn(
            "city_ids",
            F.sort_array(F.array_distinct(F.array_compact(F.transform("_places", lambda p: p["city_id"])))),
        )
        .withColumn(
            "unmapped_locations",
            F.transform(
                F.filter("_places", lambda p: p["city_id"].isNull() & ~p["ignored"]), lambda p: p["fragment"]
            ),
        )
        .drop("_city_map", "_places")
    )
