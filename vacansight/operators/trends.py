"""Daily counts over time. Windows run over recorded days, not over the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.functions.exact import rounded
from vacansight.operators.distributions import counted, mentions
from vacansight.operators.filters import not_blocked

BASELINE_DAYS = 7


def _by_day() -> Window:
    return Window.partitionBy("skill").orderBy("snapshot_date")


def with_history(daily: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Each day with the day before and the sum and size of the trailing window.

    One sort serves all three; the current day is not part of its own baseline.
    """
    trailing = _by_day().rowsBetween(-BASELINE_DAYS, -1)
    return not_blocked(daily, blocklist, "skill").select(
        "skill",
        "snapshot_date",
        "posting_count",
        F.lag("posting_count").over(_by_day()).alias("previous_count"),
        F.sum("posting_count").over(trailing).alias("base_sum"),
        F.count("posting_count").over(trailing).alias("base_days"),
    )


def _daily_change() -> tuple[Column, Column]:
    change = F.col("posting_count") - F.col("previous_count")
    return change, rounded(change * 100, F.col("previous_count"), 1)


def _baseline_change() -> tuple[Column, Column, Column]:
    """Baseline, change and percentage from whole numbers: n - S/k = (n*k - S)/k."""
    gap = F.col("posting_count") * F.col("base_days") - F.col("base_sum")
    return (
        rounded(F.col("base_sum"), F.col("base_days"), 1),
        rounded(gap, F.col("base_days"), 1),
        rounded(gap * 100, F.col("base_sum"), 1),
    )


def delta_daily(daily: DataFrame, blocklist: DataFrame) -> DataFrame:
    change, pct = _daily_change()
    return with_history(daily, blocklist).select(
        "skill", "snapshot_date", "posting_count", "previous_count", change.alias("change"), pct.alias("pct_change")
    )


def delta_baseline(daily: DataFrame, blocklist: DataFrame) -> DataFrame:
    baseline, change, pct = _baseline_change()
    return (
        with_history(daily, blocklist)
        .filter(F.col("base_days") > 0)
        .select(
            "skill",
            "snapshot_date",
            "posting_count",
            baseline.alias("baseline_7d"),
            change.alias("change_vs_baseline"),
            pct.alias("pct_vs_baseline"),
        )
    )


def _days(daily: DataFrame) -> DataFrame:
    return daily.agg(F.count_distinct("snapshot_date").alias("n"), F.max("snapshot_date").alias("latest"))


def coverage(daily: DataFrame) -> DataFrame:
    per_day = daily.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))
    span = per_day.agg(
        F.count(F.lit(1)).alias("days_recorded"),
        F.min("snapshot_date").alias("earliest"),
        F.max("snapshot_date").alias("latest"),
    )
    return span.select(
        "*",
        daily.agg(F.count_distinct("skill")).scalar().alias("distinct_skills"),
        (F.col("days_recorded") >= 2).alias("daily_delta_available"),
        (F.col("days_recorded") >= 8).alias("baseline_delta_available"),
    )


def _latest_rows(daily: DataFrame, target: Column) -> DataFrame:
    """The rows of each skill that can matter on ``target``: its own and those of the trailing window before it.

    Keeping the first places lets Spark drop older days in the map tasks already, so what is
    shuffled does not grow with the length of the history. Skills may skip days, so the days cannot be bounded by date.
    """
    newest = Window.partitionBy("skill").orderBy(F.desc("snapshot_date"))
    upto = daily.filter(F.col("snapshot_date") <= target).withColumn("_place", F.row_number().over(newest))
    return upto.filter(F.col("_place") <= BASELINE_DAYS + 1).drop("_place")


def movers(
    daily: DataFrame,
    blocklist: DataFrame,
    comparison: str = "auto",
    limit: int | None = 25,
    direction: str = "both",
    on: str | None = None,
    skills: list[str] | None = None,
) -> DataFrame:
    """Biggest changes of one day. Too little history gives no rows, not an error.

    How much history there is, is a scalar subquery, so choosing the comparison
    needs no extra job; both comparisons come from the same window pass.
    """
    if comparison not in ("auto", "previous_day", "rolling_7d") or direction not in ("both", "up", "down"):
        raise ValueError("unknown comparison or direction")
    days = _days(daily).select("n").scalar()
    latest = _days(daily).select("latest").scalar()
    rolling = {"auto": days >= 8, "rolling_7d": F.lit(True), "previous_day": F.lit(False)}[comparison]
    day_change, day_pct = _daily_change()
    baseline, base_change, base_pct = _baseline_change()

    def either(a: Column, b: Column) -> Column:
        return F.when(F.col("_rolling"), a.cast("double")).otherwise(b.cast("double"))

    target = F.lit(on).cast("date") if on else latest
    day = with_history(_latest_rows(daily, target), blocklist).filter(F.col("snapshot_date") == target)
    if skills:
        day = day.filter(F.col("skill").isin(skills))
    moved = (
        day.withColumn("_rolling", rolling)
        .withColumn("_days", days)
        .filter(F.when(F.col("_rolling"), F.col("_days") >= 8).otherwise(F.col("_days") >= 2))
        .select(
            "skill",
            "snapshot_date",
            "posting_count",
            either(baseline, F.col("previous_count")).alias("previous_count"),
            either(base_change, day_change).alias("change"),
            either(base_pct, day_pct).alias("pct_change"),
            F.when(F.col("_rolling"), "rolling_7d").otherwise("previous_day").alias("comparison"),
        )
        .filter(F.col("change").isNotNull())
    )
    if direction == "up":
        ordered = moved.filter(F.col("change") > 0).orderBy(F.desc("change"), "skill")
    elif direction == "down":
        ordered = moved.filter(F.col("change") < 0).orderBy(F.asc("change"), "skill")
    else:
        ordered = moved.orderBy(F.desc(F.abs("change")), "skill")
    return ordered if limit is None else ordered.limit(limit)


def first_appearances(
    daily: DataFrame, blocklist: DataFrame, since: str | None = None, limit: int | None = 50
) -> DataFrame:
    seen = (
        daily.groupBy("skill")
        .agg(F.min("snapshot_date").alias("first_seen"), F.count(F.lit(1)).alias("days_present"))
    )
    seen = not_blocked(seen, blocklist, "skill")
    if since:
        seen = seen.filter(F.col("first_seen") >= F.lit(since).cast("date"))
    ordered = seen.orderBy(F.desc("first_seen"), "skill")
    return ordered if limit is None else ordered.limit(limit)


def skill_series(daily: DataFrame, skills: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    kept = daily.filter(F.col("skill").isin(skills))
    if since:
        kept = kept.filter(F.col("snapshot_date") >= F.lit(since).cast("date"))
    if until:
        kept = kept.filter(F.col("snapshot_date") <= F.lit(until).cast("date"))
    return kept.select("snapshot_date", "skill", "posting_count").orderBy("snapshot_date", "skill")


def snapshot(postings: DataFrame, skills: DataFrame, as_of: Column) -> DataFrame:
    """Counts per skill of the postings seen on ``as_of``; blocked terms are recorded too."""
    today = postings.filter(F.col("last_seen_date") == as_of).select(F.array_distinct("skill_ids").alias("ids"))
    return counted(mentions(today, "ids", "skill_id"), "skill_id").join(skills, "skill_id").select(
        as_of.alias("snapshot_date"), F.col("skill_name").alias("skill"), F.col("postings").alias("posting_count")
    )


def upsert_counts(daily: DataFrame, fresh: DataFrame) -> DataFrame:
    """New counts win; counts of keys not in ``fresh`` stay as they are."""
    keys = ["snapshot_date", "skill"]
    new = fresh.select(*keys, F.col("posting_count").alias("_new"))
    return daily.join(new, keys, "full_outer").select(
        *keys, F.coalesce("_new", "posting_count").alias("posting_count")
    )
