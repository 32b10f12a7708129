"""Small tables behind the overview pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.functions.exact import whole_div
from vacansight.operators.distributions import experience_band, skill_demand
from vacansight.operators.trends import first_appearances, movers
from vacansight.schemas import Tables
from vacansight.vocab import EXPERIENCE_BANDS, NOT_STATED, SENIORITY_ORDER

BAND_ORDER = [label for _, label in EXPERIENCE_BANDS] + [NOT_STATED]


def in_fixed_order(buckets: DataFrame, order: list[str], bucket: str = "bucket") -> DataFrame:
    """Adds ``place``: the bucket's position in the display order."""
    return buckets.withColumn("place", F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket)))


def bands_in_order(t: Tables) -> DataFrame:
    counts = t.postings.groupBy(experience_band(F.col("experience_min")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("postings")
    )
    return in_fixed_order(counts, BAND_ORDER).orderBy("place")


def seniority_in_order(distribution: DataFrame) -> DataFrame:
    return in_fixed_order(distribution, SENIORITY_ORDER).orderBy("place")


def band_squares(t: Tables, units: int = 100) -> DataFrame:
    """Experience bands as whole shares that add up to exactly ``units`` (largest remainders go up).

    The windows see one row per band.
    """
    everything = Window.partitionBy()
    counted = bands_in_order(t).withColumn("_total", F.sum("postings").over(everything))
    scaled = F.col("postings") * units
    floored = counted.withColumn("_whole", whole_div(scaled, F.col("_total"))).withColumn(
        "_rest", scaled - F.col("_whole") * F.col("_total")
    )
    missing = F.lit(units) - F.sum("_whole").over(everything)
    turn = F.row_number().over(everything.orderBy(F.desc("_rest"), "place"))
    return floored.withColumn("squares", F.col("_whole") + F.when(turn <= missing, 1).otherwise(0)).select(
        "bucket", "postings", "squares"
    )


def fresher_ratio(t: Tables) -> DataFrame:
    """How many postings there are for each one open to freshers."""
    facts = t.postings.agg(
        F.count_if(F.col("experience_min") <= 1).alias("freshers"), F.count(F.lit(1)).alias("total_postings")
    )
    each = F.bround(F.try_divide(F.col("total_postings"), F.col("freshers")), 0).cast("long").cast("string")
    return facts.withColumn("one_in", F.coalesce(F.concat(F.lit("1 in "), each), F.lit("None")))


def city_map(cities: DataFrame, coordinates: DataFrame) -> DataFrame:
    """City counts with coordinates; cities without coordinates drop out."""
    return cities.join(coordinates, "city_name").select("city_name", "postings", "lat", "lon")


def weekly_digest(t: Tables, as_of: Column, trend_as_of: Column | None = None) -> DataFrame:
    """One row: what is new, what is still listed, what moved and what leads.

    ``trend_as_of`` is "today" for the daily counts where it differs from ``as_of``.
    """
    week_ago = F.date_sub(as_of, 7)
    trend_day = as_of if trend_as_of is None else trend_as_of
    facts = t.postings.agg(
        F.count_if(F.col("first_seen_date") >= week_ago).alias("new_postings"),
        F.count_if(F.col("last_seen_date") >= week_ago).alias("active_postings"),
    )
    mover = movers(t.daily_counts, t.blocklist, limit=1)
    fresh = first_appearances(t.daily_counts, t.blocklist, limit=None).filter(
        F.col("first_seen") > F.date_sub(trend_day, 7)
    )
    leader = skill_demand(t, limit=1)
    return facts.select(
        "*",
        mover.select("skill").scalar().alias("biggest_mover"),
        mover.select("change").scalar().alias("mover_change"),
        mover.select("comparison").scalar().alias("comparison"),
        fresh.agg(F.count(F.lit(1))).scalar().alias("new_skills"),
        leader.select("name").scalar().alias("top_skill"),
    )

