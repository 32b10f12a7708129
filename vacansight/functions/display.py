"""Text as shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansight.vocab import LEVEL_ORDER, NOT_STATED


def plain_number(c: Column) -> Column:
    """No trailing zeros: 12.50 -> 12.5, 12.00 -> 12; ``nan`` where it is not known."""
    text = c.cast("decimal(14,2)").cast("string")
    return F.coalesce(F.regexp_replace(text, r"\.?0+$", ""), F.lit("nan"))


def span(low: Column, high: Column, unit: str, otherwise: str) -> Column:
    whole = F.concat(plain_number(low), F.lit("-"), plain_number(high), F.lit(f" {unit}"))
    return F.when(low.isNotNull(), whole).otherwise(otherwise)


def experience_text(low: Column, high: Column) -> Column:
    return span(low, high, "yrs", NOT_STATED)


def salary_text(low: Column, high: Column) -> Column:
    return span(low, high, "LPA", "Not disclosed")


def cities_text(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(NOT_STATED)


def skills_text(names: Column, shown: int = 6) -> Column:
    more = F.size(names) - shown
    return F.concat(
        F.array_join(F.slice(names, 1, shown), ", "),
        F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""),
    )


def applicants_text(count: Column, qualifier: Column) -> Column:
    number = count.cast("string")
    return (
        F.when(count.isNull(), "—")
        .when(qualifier == "at_least", F.concat(number, F.lit("+")))
        .when(qualifier == "less_than", F.concat(F.lit("<"), number))
        .otherwise(number)
    )


def education_text(degrees: Column) -> Column:
    """``UG: B.Tech (CSE), B.E. · PG: MCA`` from ``array<struct<degree, level, specializations>>``."""

    def label(d: Column) -> Column:
        extra = F.concat(F.lit(" ("), F.array_join(d["specializations"], ", "), F.lit(")"))
        return F.concat(d["degree"], F.when(F.size(d["specializations"]) > 0, extra).otherwise(""))

    parts = []
    for level in LEVEL_ORDER:
        own = F.transform(F.filter(degrees, lambda d: d["level"] == level), label)
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{level}: "), F.array_join(own, ", "))))
    return F.array_join(F.array_compact(F.array(*parts)), " · ")
