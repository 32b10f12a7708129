"""The cleaning job: raw posting records in, cleaned postings out.

One narrow stage of column expressions; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.functions import education, parsing, skills, text
from vacansight.functions.places import resolve_locations
from vacansight.schemas import RAW_FIELDS
from vacansight.vocab import CERTIFICATION_PATTERNS, ROLE_PATTERNS, SENIORITY_PATTERNS

_LISTS = ["key_skills", "tech_in_description", "preferred_key_skills", "company_badges"]
_TEXTS = [
    "title", "company", "experience", "salary", "location", "description", "working_type", "employment_type",
    "role_category", "listed_role", "industry_type", "department", "posted_date", "posted_raw",
    "applicant_count_qualifier", "company_rating", "source_search",
]


def _typed(raw: DataFrame) -> DataFrame:
    """Marks become NULL; lists and the education block are read from their JSON text.

    A value of the wrong kind (the missing-value mark in a list or number) is NULL.
    """
    kinds = dict(raw.dtypes)

    def listed(name: str) -> Column:
        c = F.col(name)
        return c if kinds[name].startswith("array") else F.from_json(c, "array<string>")

    block = F.col("education")
    block = block if kinds["education"].startswith("map") else F.from_json(block, "map<string,string>")
    columns = {name: F.col(name) for name in raw.columns if name not in RAW_FIELDS}
    columns["url"] = F.col("url")
    columns |= {name: text.present(F.col(name)) for name in _TEXTS}
    columns |= {name: listed(name) for name in _LISTS}
    columns |= {n: F.col(n).try_cast("int") for n in ("openings", "applicant_count", "company_reviews")}
    columns["education"] = block
    return raw.select(*[c.alias(n) for n, c in columns.items()])


def clean_postings(raw: DataFrame, cities: DataFrame) -> DataFrame:
    """Columns of ``CLEAN_POSTING``, plus any extra column of ``raw`` unchanged."""
    extra = [name for name in raw.columns if name not in RAW_FIELDS]
    c = F.col
    typed = resolve_locations(_typed(raw), "location", cities)
    typed = skills.mine_terms(typed, "description", CERTIFICATION_PATTERNS, "certifications")
    merged = typed.withColumn("skills", skills.merge_skills(c("key_skills"), c("tech_in_description")))
    columns = {
        "fingerprint": text.fingerprint(c("company"), c("title"), c("location"), c("experience")),
        "url": c("url"),
        "title": c("title"),
        "company": c("company"),
        "description": c("description"),
        "description_hash": text.description_hash(c("description")),
        "experience_min": parsing.to_years(parsing.range_min(c("experience"))),
        "experience_max": parsing.to_years(parsing.range_max(c("experience"))),
        "salary_min": parsing.to_money(parsing.range_min(c("salary"))),
        "salary_max": parsing.to_money(parsing.range_max(c("salary"))),
        "city_ids": c("city_ids"),
        "unmapped_locations": c("unmapped_locations"),
        "working_type": parsing.working_type(c("working_type")),
        "employment_type": parsing.employment_type(c("employment_type")),
        "contract_type": parsing.contract_type(c("employment_type")),
        "role_family": parsing.first_phrase(c("title"), ROLE_PATTERNS, "Other"),
        "seniority_level": parsing.first_phrase(c("title"), SENIORITY_PATTERNS, None),
        "role_category": c("role_category"),
        "listed_role": c("listed_role"),
        "industry_type": c("industry_type"),
        "department": c("department"),
        "posted_date": c("posted_date").try_cast("date"),
        "posted_raw": c("posted_raw"),
        "openings": c("openings"),
        "applicant_count": c("applicant_count"),
        "applicant_count_qualifier": c("applicant_count_qualifier"),
        "company_rating": c("company_rating").try_cast("decimal(3,1)"),
        "company_reviews": c("company_reviews"),
        "company_badges": F.coalesce("company_badges", F.array().cast("array<string>")),
        "source_search": c("source_search"),
        "certifications": c("certifications"),
        "skills": c("skills"),
        "preferred_skills": skills.preferred_skills(c("skills"), c("preferred_key_skills")),
        "qualifications": education.qualification_levels(c("education")),
        "qualification_degrees": education.degree_breakdown(c("education")),
    }
    return merged.select(*[v.alias(k) for k, v in columns.items()], *extra)


def unreadable(raw: DataFrame) -> DataFrame:
    """Raw rows whose rating or date is stated but cannot be read; kept aside for a look."""
    rating, posted = text.present(F.col("company_rating")), text.present(F.col("posted_date"))
    return raw.filter(
        (rating.isNotNull() & rating.try_cast("decimal(3,1)").isNull())
        | (posted.isNotNull() & posted.try_cast("date").isNull())
    )
