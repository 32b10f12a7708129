"""Optional posting filters. What is not given does not restrict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.schemas import Tables


@dataclass(frozen=True)
class Filters:
    skill: list[str] | None = None
    skills_all: list[str] | None = None
    role_family: list[str] | None = None
    seniority_level: list[str] | None = None
    company: str | None = None
    search: str | None = None
    city: list[str] | None = None
    state: list[str] | None = None
    experience_min: int | None = None
    experience_max: int | None = None
    has_salary: bool | None = None
    salary_min: float | None = None
    salary_max: float | None = None
    working_type: list[str] | None = None
    employment_type: list[str] | None = None
    contract_type: list[str] | None = None
    qualification_level: list[str] | None = None
    posted_after: str | None = None
    posted_before: str | None = None
    seen_after: str | None = None
    min_openings: int | None = None


def _ids(dimension: DataFrame, id_col: str, condition: Column) -> Column:
    """The ids of the named entries, as one array (a scalar subquery, run once)."""
    return dimension.filter(condition).agg(F.sort_array(F.collect_set(id_col))).scalar()


def has_any_skill(skills: DataFrame, names: list[str]) -> Column:
    """Unknown names match nothing; if all are unknown no posting passes."""
    return F.arrays_overlap("skill_ids", _ids(skills, "skill_id", F.col("skill_name").isin(names)))


def has_all_skills(skills: DataFrame, names: list[str]) -> Column:
    """Every name must exist and be wanted; one unknown name means no posting passes."""
    wanted = _ids(skills, "skill_id", F.col("skill_name").isin(names))
    return (F.size(wanted) == len(set(names))) & (F.size(F.array_except(wanted, F.col("skill_ids"))) == 0)


def conditions(t: Tables, f: Filters) -> list[Column]:
    c = F.col
    found: list[Column] = []

    for name in ("role_family", "seniority_level", "working_type", "employment_type", "contract_type"):
        if getattr(f, name):
            found.append(c(name).isin(list(getattr(f, name))))
    for name, bound in (
        (c("experience_min") >= F.lit(f.experience_min), f.experience_min),
        (c("experience_min") <= F.lit(f.experience_max), f.experience_max),
        (c("salary_max") >= F.lit(f.salary_min), f.salary_min),
        (c("salary_min") <= F.lit(f.salary_max), f.salary_max),
        (c("openings") >= F.lit(f.min_openings), f.min_openings),
        (c("posted_date") >= F.lit(f.posted_after).cast("date"), f.posted_after),
        (c("posted_date") <= F.lit(f.posted_before).cast("date"), f.posted_before),
        (c("last_seen_date") >= F.lit(f.seen_after).cast("date"), f.seen_after),
    ):
        if bound is not None:
            found.append(name)
    if f.has_salary is not None:
        found.append(c("salary_min").isNotNull() if f.has_salary else c("salary_min").isNull())
    if f.company:
        found.append(c("company").ilike(f"%{f.company}%"))
    if f.search:
        found.append(c("title").ilike(f"%{f.search}%") | c("company").ilike(f"%{f.search}%"))
    if f.skill:
        found.append(has_any_skill(t.skills, f.skill))
    if f.skills_all:
        found.append(has_all_skills(t.skills, f.skills_all))
    if f.city:
        found.append(F.arrays_overlap("city_ids", _ids(t.cities, "city_id", c("city_name").isin(f.city))))
    if f.state:
        found.append(F.arrays_overlap("city_ids", _ids(t.cities, "city_id", c("state").isin(f.state))))
    return found


def matching(t: Tables, f: Filters | None = None) -> DataFrame:
    """The postings that pass every given filter."""
    f = f or Filters()
    kept = t.postings
    tests = conditions(t, f)
    if tests:
        kept = kept.filter(reduce(lambda a, b: a & b, tests))
    if f.qualification_level:
        stated = t.qualifications.filter(F.col("level").isin(list(f.qualification_level))).select("job_id")
        kept = kept.join(stated, "job_id", "left_semi")
    return kept


def not_blocked(df: DataFrame, blocklist: DataFrame, name_col: str) -> DataFrame:
    return df.join(blocklist.select(F.col("skill").alias(name_col)), name_col, "left_anti")
