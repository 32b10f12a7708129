"""Headline figures, demand and share reports.

Names come in last: counts are made per id, so that only a counts table (one row
per id) meets a dictionary, never the exploded postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.functions.exact import rounded, share_pct
from vacansight.operators.filters import Filters, matching, not_blocked
from vacansight.schemas import Tables
from vacansight.vocab import EXPERIENCE_BANDS, NOT_STATED


def mentions(postings: DataFrame, ids: str, id_col: str, *keep: str) -> DataFrame:
    """One row per array element."""
    return postings.select(*keep, F.explode(ids).alias(id_col))


def counted(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("postings"))


def with_share(counts: DataFrame) -> DataFrame:
    """Share of the total of all buckets. The window sees one row per bucket."""
    total = F.sum("postings").over(Window.partitionBy())
    return counts.withColumn("share_pct", share_pct(F.col("postings"), total))


def top(counts: DataFrame, limit: int | None, name_col: str) -> DataFrame:
    """Highest counts first, ties by name."""
    ordered = counts.orderBy(F.desc("postings"), F.asc(name_col))
    return ordered if limit is None else ordered.limit(limit)


def skill_counts(t: Tables, postings: DataFrame) -> DataFrame:
    """``skill_id, postings, skill_name, category`` for every skill asked for."""
    return counted(mentions(postings, "skill_ids", "skill_id"), "skill_id").join(t.skills, "skill_id")


def _reference_totals(postings: DataFrame) -> DataFrame:
    """One row, one struct: distinct skills and cities, and the number of skill mentions."""

    def tagged(kind: str, ids: str) -> Column:
        return F.transform(ids, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("id")))

    refs = postings.select(
        F.explode_outer(F.concat(tagged("skill", "skill_ids"), tagged("city", "city_ids"))).alias("ref")
    )
    counts = refs.groupBy("ref.kind", "ref.id").agg(F.count(F.lit(1)).alias("n"))
    is_skill = F.col("kind") == "skill"
    return counts.agg(
        F.struct(
            F.count_if(is_skill).alias("skills"),
            F.count_if(F.col("kind") == "city").alias("cities"),
            F.coalesce(F.sum(F.when(is_skill, F.col("n"))), F.lit(0).cast("long")).alias("mentions"),
        ).alias("totals")
    )


def summary(t: Tables, as_of: Column) -> DataFrame:
    """The headline row. Plain columns, id arrays, qualification rows and the histogram
    behind the median are each read once; the median is exact, from value counts."""
    week_ago = F.date_sub(as_of, 7)
    c = F.col
    facts = t.postings.agg(
        F.count(F.lit(1)).alias("total_postings"),
        F.count_if(c("last_seen_date") >= week_ago).alias("active_last_7_days"),
        F.count_if(c("first_seen_date") >= week_ago).alias("new_postings_7d"),
        F.count_distinct("company").alias("companies"),
        F.size(F.collect_set("role_family")).cast("long").alias("distinct_roles"),
        F.count_if(c("salary_min").isNotNull()).alias("postings_with_salary"),
        F.min("posted_date").alias("earliest_posting"),
        F.max("posted_date").alias("latest_posting"),
        F.max("openings").alias("max_openings"),
    )
    educated = t.qualifications.agg(F.count_distinct("job_id"))
    histogram = t.postings.filter(c("openings").isNotNull()).groupBy("openings").agg(F.count(F.lit(1)).alias("n"))
    median = histogram.agg(F.percentile("openings", 0.5, F.col("n")))
    return (
        facts.withColumn("_totals", _reference_totals(t.postings).scalar())
        .select(
            "*",
            c("_totals.skills").alias("distinct_skills"),
            c("_totals.cities").alias("cities_covered"),
            educated.scalar().alias("postings_with_education"),
            median.scalar().alias("median_openings"),
            F.coalesce(rounded(c("_totals.mentions"), c("total_postings"), 2), F.lit(0.0)).alias("avg_skills_per_posting"),
            F.coalesce(share_pct(c("postings_with_salary"), c("total_postings")), F.lit(0.0)).alias("salary_disclosure_pct"),
        )
        .drop("_totals")
    )


def skill_demand(t: Tables, limit: int | None = 25, include_blocked: bool = False, scope: Filters | None = None) -> DataFrame:
    counts = skill_counts(t, matching(t, scope)).select(F.col("skill_name").alias("name"), "postings")
    if not include_blocked:
        counts = not_blocked(counts, t.blocklist, "name")
    return top(counts, limit, "name")


def _buckets(postings: DataFrame, bucket: Column) -> DataFrame:
    return with_share(counted(postings, bucket.alias("bucket"))).orderBy(F.desc("postings"), "bucket")


def role_distribution(t: Tables, scope: Filters | None = None) -> DataFrame:
    return _buckets(matching(t, scope), F.coalesce("role_family", F.lit("Other")))


def seniority_distribution(t: Tables, scope: Filters | None = None) -> DataFrame:
    """Only titles that state a level count, in the shares too."""
    stated = matching(t, scope).filter(F.col("seniority_level").isNotNull())
    return _buckets(stated, F.col("seniority_level"))


def experience_band(years: Column) -> Column:
    chain = F.when(years.isNull(), NOT_STATED)
    for upper, label in EXPERIENCE_BANDS:
        chain = chain.otherwise(F.lit(label)) if upper is None else chain.when(years <= upper, label)
    return chain


def experience_distribution(t: Tables, scope: Filters | None = None) -> DataFrame:
    return _buckets(matching(t, scope), experience_band(F.col("experience_min")))


def location_distribution(
    t: Tables, by: str = "city", limit: int | None = 30, role_family: list[str] | None = None
) -> DataFrame:
    """Shares are of posting-city links: two cities of one state count twice for it."""
    if by not in ("city", "state"):
        raise ValueError("by must be 'city' or 'state'")
    kept = matching(t, Filters(role_family=role_family))
    per_city = counted(mentions(kept, "city_ids", "city_id"), "city_id").join(t.cities, "city_id")
    bucket = F.col("city_name" if by == "city" else "state").alias("bucket")
    counts = per_city.groupBy(bucket).agg(F.sum("postings").alias("postings"))
    return top(with_share(counts), limit, "bucket")


def qualification_distribution(t: Tables) -> DataFrame:
    """Shares of the postings that state any level; they may add up to more than 100."""
    total = t.qualifications.agg(F.count_distinct("job_id")).scalar()
    counts = t.qualifications.groupBy(F.col("level").alias("bucket")).agg(F.count_distinct("job_id").alias("postings"))
    return counts.withColumn("share_pct", share_pct(F.col("postings"), total)).orderBy(F.desc("postings"), "bucket")


def category_mix(t: Tables, scope: Filters | None = None) -> DataFrame:
    """Mentions, not postings; skills without a category stay out of the total."""
    known = skill_counts(t, matching(t, scope)).filter(F.col("category").isNotNull())
    counts = known.groupBy(F.col("category").alias("bucket")).agg(F.sum("postings").alias("postings"))
    return with_share(counts).orderBy(F.desc("postings"), "bucket")


def openings_distribution(t: Tables) -> DataFrame:
    stated = t.postings.filter(F.col("openings").isNotNull())
    return (
        with_share(counted(stated, "openings"))
        .orderBy("openings")
        .select(F.col("openings").cast("string").alias("bucket"), "postings", "share_pct")
    )


def openings_overflow(t: Tables, up_to: int = 20) -> DataFrame:
    c = F.col("openings")
    return t.postings.agg(
        F.count_if(c <= up_to).alias("postings_up_to"),
        F.count_if(c > up_to).alias("postings_above"),
        F.max(F.when(c > up_to, c)).alias("largest_above"),
    )


def repost_groups(postings: DataFrame, hash_col: str = "description_hash", company_col: str = "company") -> DataFrame:
    """Descriptions published word for word by more than one company.

    Per description and company first, so a description most postings share is one
    row per company and task. Missing descriptions are sorted out at the end: a filter
    on a hash that is still being computed would compute it twice.
    """
    per_company = postings.groupBy(hash_col, company_col).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_company.groupBy(hash_col)
        .agg(
            F.count(company_col).alias("companies"),
            F.sum("n").alias("postings"),
            F.count(hash_col).alias("_stated"),
        )
        .filter((F.col("companies") > 1) & (F.col("_stated") > 0))
        .drop("_stated")
    )


def source_productivity(t: Tables, as_of: Column) -> DataFrame:
    return t.postings.groupBy("source_search").agg(
        F.count(F.lit(1)).alias("postings"),
        F.count_if(F.col("first_seen_date") >= F.date_sub(as_of, 7)).alias("new_postings"),
        F.sum("times_seen").alias("sightings"),
    )
