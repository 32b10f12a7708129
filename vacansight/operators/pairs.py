"""Which skills are asked for together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.functions.exact import share_pct
from vacansight.operators.distributions import counted, mentions, skill_counts, top
from vacansight.operators.filters import Filters, has_any_skill, matching, not_blocked
from vacansight.schemas import Tables
from vacansight.vocab import LEVEL_BANDS


def _pairs_of(ids: Column) -> Column:
    """``array<struct<a, b>>`` with a before b; ``ids`` sorted and at most the top list long."""
    return F.flatten(
        F.transform(
            ids,
            lambda a, i: F.transform(F.slice(ids, i + 2, F.size(ids)), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )


def co_occurrence(t: Tables, top_skills: int = 20, limit: int | None = 100, min_together: int = 1) -> DataFrame:
    """Pairs among the most wanted skills; ``skill_a`` is the one with the lower id.

    Each posting's array is cut to the top skills before pairing, so a row yields at
    most top_skills * (top_skills - 1) / 2 pairs and the counts combine before the
    shuffle to at most that many rows per task.
    """
    ranked = top(not_blocked(skill_counts(t, t.postings), t.blocklist, "skill_name"), top_skills, "skill_name")
    wanted = ranked.agg(F.collect_list("skill_id")).scalar()
    cut = t.postings.select(F.sort_array(F.array_intersect("skill_ids", wanted)).alias("ids"))
    paired = cut.filter(F.size("ids") > 1).select(F.explode_outer(_pairs_of(F.col("ids"))).alias("p"))
    together = paired.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("together"))
    first = ranked.select(F.col("skill_id").alias("a"), F.col("skill_name").alias("skill_a"), F.col("postings").alias("n"))
    second = ranked.select(F.col("skill_id").alias("b"), F.col("skill_name").alias("skill_b"))
    report = (
        together.filter(F.col("together") >= min_together)
        .join(first, "a")
        .join(second, "b")
        .select("skill_a", "skill_b", "together", share_pct(F.col("together"), F.col("n")).alias("pct_of_skill_a"))
        .orderBy(F.desc("together"), "skill_a", "skill_b")
    )
    return report if limit is None else report.limit(limit)


def skill_suggestions(t: Tables, skills: list[str], limit: int | None = 15, role_family: list[str] | None = None) -> DataFrame:
    """Other skills wanted by postings that ask for any of ``skills``, with the share of those postings."""
    alike = matching(t, Filters(role_family=role_family)).filter(has_any_skill(t.skills, skills))
    base = alike.agg(F.count(F.lit(1))).scalar()
    others = skill_counts(t, alike).filter(~F.col("skill_name").isin(skills))
    counts = not_blocked(others, t.blocklist, "skill_name").select(F.col("skill_name").alias("skill"), "postings")
    return top(counts.withColumn("share_pct", share_pct(F.col("postings"), base)), limit, "skill")


def pair_matrix(t: Tables, top_skills: int = 20) -> DataFrame:
    """Both directions of every pair as a square table, zeros where skills never meet."""
    pairs = co_occurrence(t, top_skills, limit=None)
    both = pairs.select("skill_a", "skill_b", "together").unionByName(
        pairs.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"), "together")
    )
    return both.groupBy("skill_a").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("skill_b", "together")))).alias("together")
    )


def matrix_columns(matrix: DataFrame, names: list[str]) -> DataFrame:
    """The square table with one column per given skill."""
    zero = F.lit(0).cast("long")
    return matrix.select(
        "skill_a", *[F.coalesce(F.try_element_at("together", F.lit(n)), zero).alias(n) for n in names]
    )


def level_share_matrix(t: Tables, per_level: int = 18) -> DataFrame:
    """Each level's most wanted skills as shares of that level's list, biggest swing first."""
    years = F.col("experience_min")
    level = F
    for label, low, high in LEVEL_BANDS:
        inside = years >= low
        level = level.when(inside if high is None else inside & (years <= high), label)
    banded = t.postings.withColumn("level", level).filter(F.col("level").isNotNull())
    counts = counted(mentions(banded, "skill_ids", "skill_id", "level"), "level", "skill_id").join(t.skills, "skill_id")
    counts = not_blocked(counts, t.blocklist, "skill_name")
    by_demand = Window.partitionBy("level").orderBy(F.desc("postings"), "skill_name")
    best = counts.withColumn("place", F.row_number().over(by_demand)).filter(F.col("place") <= per_level)
    shares = best.withColumn(
        "share", share_pct(F.col("postings"), F.sum("postings").over(Window.partitionBy("level")))
    )
    labels = [label for label, _, _ in LEVEL_BANDS]
    wide = shares.groupBy(F.col("skill_name").alias("skill")).pivot("level", labels).agg(F.first("share"))
    wide = wide.select(
        "skill", *[F.coalesce(F.col(f"`{l}`"), F.lit(0.0)).alias(a) for l, a in zip(labels, ("junior", "mid", "senior"))]
    )
    swing = F.greatest("junior", "mid", "senior") - F.least("junior", "mid", "senior")
    return wide.withColumn("swing", F.round(swing, 2)).orderBy(F.desc("swing"), "skill")
