"""Counts per dictionary entry, zero counts included where the list is a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansight.functions.exact import share_pct
from vacansight.operators.distributions import counted, mentions, skill_counts, top
from vacansight.operators.filters import not_blocked
from vacansight.schemas import Tables
from vacansight.vocab import NOT_STATED


def _zero_kept(dimension: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    return dimension.join(counts, key, "left").withColumn("postings", F.coalesce("postings", F.lit(0).cast("long")))


def _city_counts(t: Tables) -> DataFrame:
    return _zero_kept(t.cities, counted(mentions(t.postings, "city_ids", "city_id"), "city_id"), "city_id")


def cities_reference(t: Tables, with_postings_only: bool = False) -> DataFrame:
    counts = _city_counts(t).select("city_id", "city_name", "state", "postings")
    if with_postings_only:
        counts = counts.filter(F.col("postings") > 0)
    return top(counts, None, "city_name")


def states_reference(t: Tables) -> DataFrame:
    per_state = _city_counts(t).groupBy(F.col("state").alias("state_name")).agg(
        F.count_distinct("city_id").alias("cities"), F.sum("postings").alias("postings")
    )
    listed = _zero_kept(t.states, per_state, "state_name")
    return top(listed.select("state_name", F.coalesce("cities", F.lit(0).cast("long")).alias("cities"), "postings"), None, "state_name")


def roles_reference(t: Tables) -> DataFrame:
    return top(counted(t.postings, F.coalesce("role_family", F.lit("Other")).alias("name")), None, "name")


def _named_list(t: Tables, dimension: DataFrame, key: str) -> DataFrame:
    counts = counted(t.postings.filter(F.col(key).isNotNull()), key)
    return top(_zero_kept(dimension, counts, key).select("name", "postings"), None, "name")


def role_categories_reference(t: Tables) -> DataFrame:
    return _named_list(t, t.role_categories, "role_category_id")


def departments_reference(t: Tables) -> DataFrame:
    return _named_list(t, t.departments, "department_id")


def industry_types_reference(t: Tables) -> DataFrame:
    return _named_list(t, t.industry_types, "industry_type_id")


def degrees_reference(t: Tables) -> DataFrame:
    counts = counted(mentions(t.postings, "accepted_degree_ids", "degree_id"), "degree_id")
    listed = _zero_kept(t.degrees, counts, "degree_id").select(F.col("degree_name").alias("name"), "level", "postings")
    return listed.orderBy(F.desc("postings"), "name", "level")


def specializations_reference(t: Tables) -> DataFrame:
    """A posting that reaches a specialization through two degrees counts once.

    Distinct (posting, specialization) links first, keyed by both, then a plain count:
    a specialization every posting accepts is spread over all tasks.
    """
    pair_ids = mentions(t.postings, "accepted_degree_specialization_ids", "degree_specialization_id", "job_id")
    once = (
        pair_ids.join(t.degree_specializations, "degree_specialization_id")
        .select("job_id", "specialization_id")
        .distinct()
    )
    counts = counted(once, "specialization_id")
    listed = _zero_kept(t.specializations, counts, "specialization_id")
    return top(listed.select(F.col("specialization_name").alias("name"), "postings"), None, "name")


def companies_reference(t: Tables, limit: int = 100, min_postings: int = 1, search: str | None = None) -> DataFrame:
    named = t.postings.filter(F.col("company").isNotNull())
    if search:
        named = named.filter(F.col("company").ilike(f"%{search}%"))
    counts = counted(named, F.col("company").alias("name")).filter(F.col("postings") >= min_postings)
    return top(counts, limit, "name")


def skills_reference(
    t: Tables, limit: int = 200, min_postings: int = 1, include_blocked: bool = False, search: str | None = None
) -> DataFrame:
    total = t.postings.agg(F.count(F.lit(1))).scalar()
    counts = skill_counts(t, t.postings).select(F.col("skill_name").alias("skill"), "postings")
    if not include_blocked:
        counts = not_blocked(counts, t.blocklist, "skill")
    if search:
        counts = counts.filter(F.col("skill").ilike(f"%{search}%"))
    kept = counts.filter(F.col("postings") >= min_postings)
    return top(kept.withColumn("share_pct", share_pct(F.col("postings"), total)), limit, "skill")


def stated_values(t: Tables, column: str) -> DataFrame:
    """Working, employment or contract types with what is not stated as its own entry."""
    return top(counted(t.postings, F.coalesce(column, F.lit(NOT_STATED)).alias("name")), None, "name")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("postings"))
