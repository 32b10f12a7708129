"""Numbers, dates and small vocabularies read out of posting text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansight.functions.text import list_parts, look_up, strip
from vacansight.vocab import CONTRACT_TYPES, EMPLOYMENT_TYPES, TODAY_WORDS

# Number patterns.
RANGE = r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)"
FLOOR = r"(\d+(?:\.\d+)?)\s*\+"
YEARS_RANGE = r"(?i)(\d{1,2})\s*(?:-|to|–)\s*(\d{1,2})\s*\+?\s*(?:years|yrs|year)"
YEARS_FLOOR = (
    r"(?i)(?:minimum|at least|min\.?)?\s*(\d{1,2})\s*\+\s*(?:years|yrs|year)"
    r"|(?:minimum|at least|min\.?)\s+(\d{1,2})\s*(?:years|yrs|year)"
)
SUFFIXED = r"([\d.]+)\s*([KkMm]?)"


def group(c: Column, pattern: str, number: int) -> Column:
    """A capture group, NULL where the pattern or the group did not match."""
    return F.nullif(F.regexp_extract(c, pattern, number), F.lit(""))


def range_min(c: Column) -> Column:
    return F.coalesce(group(c, RANGE, 1), group(c, FLOOR, 1))


def range_max(c: Column) -> Column:
    return group(c, RANGE, 2)


def to_years(number: Column) -> Column:
    """Whole years, halves away from zero."""
    return F.round(number.try_cast("decimal(20,6)")).try_cast("int")


def to_money(number: Column) -> Column:
    return number.try_cast("decimal(12,2)")


def years_in_text(c: Column) -> Column:
    """``struct(min, max)`` from phrases such as ``4-7 years`` or ``at least 3 years``."""
    low, high = group(c, YEARS_RANGE, 1), group(c, YEARS_RANGE, 2)
    floor = F.coalesce(group(c, YEARS_FLOOR, 1), group(c, YEARS_FLOOR, 2))
    return F.struct(
        F.coalesce(low, floor).cast("int").alias("min"),
        F.when(low.isNotNull(), high).cast("int").alias("max"),
    )


def first_in_list(c: Column, vocabulary: dict[str, str]) -> Column:
    """First comma-separated part that is in ``vocabulary``."""
    hits = F.transform(list_parts(c), lambda part: look_up(vocabulary, F.lower(part)))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))


def employment_type(c: Column) -> Column:
    return first_in_list(c, EMPLOYMENT_TYPES)


def contract_type(c: Column) -> Column:
    return first_in_list(c, CONTRACT_TYPES)


def working_type(c: Column) -> Column:
    """No work-mode badge means on-site."""
    text = F.lower(c)
    return (
        F.when(text.contains("hybrid"), "Hybrid")
        .when(text.contains("remote") | text.contains("work from home"), "Remote")
        .otherwise("On-site")
    )


def first_phrase(c: Column, patterns: list[tuple[str, str, int]], default: str | None) -> Column:
    """The label of the phrase with the lowest priority number found inside the text."""
    text = F.lower(c)
    chain = F
    for phrase, label, _ in sorted(patterns, key=lambda row: row[2]):
        chain = chain.when(text.contains(phrase), label)
    return chain.otherwise(F.lit(default))


def posted_date(c: Column, as_of: Column) -> Column:
    """Calendar date of ``3 days ago``; NULL where the text is open-ended or unknown."""
    text = F.lower(strip(c))
    days = group(text, r"(\d+)\s*day", 1).try_cast("int")
    months = group(text, r"(\d+)\s*month", 1).try_cast("int")
    return (
        F.when(text.contains("+"), F.lit(None).cast("date"))
        .when(F.reduce(F.array(*[text.contains(w) for w in TODAY_WORDS]), F.lit(False), lambda a, b: a | b), as_of)
        .when(days.isNotNull(), F.date_sub(as_of, days))
        .when(months.isNotNull(), F.date_sub(as_of, months * 30))
    )


def suffixed_count(c: Column) -> Column:
    """``50.5K Reviews`` -> 50500."""
    number = group(c, SUFFIXED, 1).try_cast("decimal(20,6)")
    unit = F.lower(F.regexp_extract(c, SUFFIXED, 2))
    times = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)
    return F.floor(number * times).cast("long")


def first_whole_number(c: Column) -> Column:
    return group(c, r"\d+", 0).try_cast("int")


def applicants(c: Column) -> Column:
    """``struct(count, qualifier)``; the qualifier says which way an inexact count is open."""
    count = first_whole_number(c)
    return F.struct(
        count.alias("count"),
        F.when(count.isNull(), F.lit(None).cast("string"))
        .when(c.contains("+"), "at_least")
        .when(F.lower(c).contains("less than"), "less_than")
        .alias("qualifier"),
    )
