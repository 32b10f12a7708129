"""Posting search: filters, sorting, pages and one posting in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.functions import display
from vacansight.functions.education import NO_DEGREES, NO_LEVELS
from vacansight.functions.sections import description_sections
from vacansight.operators.filters import Filters, matching
from vacansight.schemas import Tables

SORT_KEYS = {
    "posted_date": "posted_date",
    "experience_min": "experience_min",
    "experience_max": "experience_max",
    "salary_min": "salary_min",
    "salary_max": "salary_max",
    "openings": "openings",
    "applicant_count": "applicant_count",
    "times_seen": "times_seen",
    "first_seen": "first_seen_date",
    "last_seen": "last_seen_date",
    "company": "company",
    "title": "title",
}

SUMMARY_COLUMNS = [
    "job_id", "title", "company", "role_family", "seniority_level", "role_category", "listed_role", "industry_type",
    "department", "experience_min", "experience_max", "salary_min", "salary_max", "skills", "cities", "working_type",
    "employment_type", "contract_type", "posted_date", "openings", "applicant_count", "applicant_count_qualifier",
    "company_rating", "company_reviews", "url",
]


def _dictionary(t: Tables, kinds: set[str]) -> DataFrame:
    """``kind, id, name, level, degree_id`` of the dictionaries behind the id arrays."""
    c, none = F.col, F.lit(None)
    parts = []
    if "skill" in kinds:
        parts.append(t.skills.select(F.lit("skill").alias("kind"), c("skill_id").alias("id"), c("skill_name").alias("name")))
    if "city" in kinds:
        parts.append(t.cities.select(F.lit("city").alias("kind"), c("city_id").alias("id"), c("city_name").alias("name")))
    if "degree" in kinds:
        parts.append(
            t.degrees.select(F.lit("degree").alias("kind"), c("degree_id").alias("id"), c("degree_name").alias("name"), "level")
        )
    if "pair" in kinds:
        parts.append(
            t.degree_specializations.join(t.specializations, "specialization_id").select(
                F.lit("pair").alias("kind"), c("degree_specialization_id").alias("id"),
                c("specialization_name").alias("name"), "degree_id",
            )
        )
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = {"level": none.cast("string"), "degree_id": none.cast("int")}
    return every.withColumns({n: v for n, v in missing.items() if n not in every.columns})


def _tagged_ids(arrays: dict[str, tuple[str, str]]) -> Column:
    """All id arrays of a row as one array of ``struct(out, kind, id)``."""

    def tagged(out: str, kind: str, ids: str) -> Column:
        return F.transform(
            ids, lambda i: F.struct(F.lit(out).alias("out"), F.lit(kind).alias("kind"), i.alias("id"))
        )

    return F.concat(*[tagged(out, kind, ids) for out, (ids, kind) in arrays.items()])


def _collected(arrays: dict[str, tuple[str, str]]) -> list[Column]:
    """Names as a sorted list; degrees and pairs with what ties them together."""
    shape = {
        "degree": F.struct("level", F.col("name").alias("degree"), F.col("id").alias("degree_id")),
        "pair": F.struct("degree_id", "name"),
    }
    return [
        F.sort_array(
            F.collect_list(F.when((F.col("out") == out) & F.col("name").isNotNull(), shape.get(kind, F.col("name"))))
        ).alias(out)
        for out, (_, kind) in arrays.items()
    ]


def with_names(t: Tables, rows: DataFrame, arrays: dict[str, tuple[str, str]], few: bool = False) -> DataFrame:
    """Adds for each ``{out: (id array, kind)}`` the sorted entries; NULL or empty where there are none.

    Exploded and joined on the id: a join on array membership would compare every
    posting with every dictionary entry. All arrays share one explode, one join and
    one regrouping. ``few`` rows (a page) travel along and are read only once; for a
    whole table only ids do and the names are joined back to the rows.
    """
    names = _dictionary(t, {kind for _, kind in arrays.values()})
    if few:
        carried = rows.select(
            "job_id", F.struct(*rows.columns).alias("row"), F.explode_outer(_tagged_ids(arrays)).alias("ref")
        ).select("job_id", "row", "ref.*")
        return (
            carried.join(names, ["kind", "id"], "left")
            .groupBy("job_id")
            .agg(F.any_value("row").alias("row"), *_collected(arrays))
            .select("row.*", *arrays)
        )
    found = (
        rows.select("job_id", F.explode_outer(_tagged_ids(arrays)).alias("ref"))
        .select("job_id", "ref.*")
        .join(names, ["kind", "id"])
        .groupBy("job_id")
        .agg(*_collected(arrays))
    )
    return rows.join(found, "job_id", "left")


def _or_none(out: str) -> Column:
    return F.coalesce(out, F.array().cast("array<string>")).alias(out)


def _with_dictionaries(t: Tables, rows: DataFrame) -> DataFrame:
    for dimension, key, out in (
        (t.role_categories, "role_category_id", "role_category"),
        (t.departments, "department_id", "department"),
        (t.industry_types, "industry_type_id", "industry_type"),
    ):
        rows = rows.join(dimension.select(key, F.col("name").alias(out)), key, "left")
    return rows


def _list_columns(t: Tables, rows: DataFrame, few: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    arrays = {"skills": ("skill_ids", "skill"), "cities": ("city_ids", "city")}
    named = with_names(t, rows, arrays, few).withColumns({out: _or_none(out) for out in arrays})
    return _with_dictionaries(t, named).select(*SUMMARY_COLUMNS, *[k for k in keep if k not in SUMMARY_COLUMNS])


def summaries(t: Tables, rows: DataFrame) -> DataFrame:
    """The 25 list columns; the description is never read for a list."""
    return _list_columns(t, _light(rows), few=False)


def _order(sort_by: str, order: str) -> list[Column]:
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of: {', '.join(SORT_KEYS)}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    key = F.col(SORT_KEYS[sort_by])
    return [key.asc_nulls_last() if order == "asc" else key.desc_nulls_last(), F.col("job_id").desc()]


def _check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page starts at 1; page_size is 1 to 200")


def _light(rows: DataFrame) -> DataFrame:
    return rows.drop("description")


def search_postings(
    t: Tables,
    filters: Filters | None = None,
    sort_by: str = "posted_date",
    order: str = "desc",
    page: int = 1,
    page_size: int = 25,
) -> DataFrame:
    """One page. Only the page's rows meet the dictionaries."""
    _check_page(page, page_size)
    keys = _order(sort_by, order)
    rows = _light(matching(t, filters)).orderBy(*keys).offset((page - 1) * page_size).limit(page_size)
    named = _list_columns(t, rows, few=True, keep=(SORT_KEYS[sort_by],))
    return named.orderBy(*keys).select(*SUMMARY_COLUMNS)


def search_after(
    t: Tables,
    after: tuple[object, int],
    filters: Filters | None = None,
    sort_by: str = "posted_date",
    order: str = "desc",
    page_size: int = 25,
) -> DataFrame:
    """The page behind the row with this sort value and job id.

    A deep page by number has to sort everything before it; this starts from the
    last row of the page before and keeps only ``page_size`` rows per task.
    """
    _check_page(1, page_size)
    keys = _order(sort_by, order)
    key, (value, job_id) = F.col(SORT_KEYS[sort_by]), after
    earlier = F.col("job_id") < job_id
    if value is None:
        behind = key.isNull() & earlier
    else:
        beyond = key > F.lit(value) if order == "asc" else key < F.lit(value)
        behind = beyond | ((key == F.lit(value)) & earlier) | key.isNull()
    rows = _light(matching(t, filters)).filter(behind).orderBy(*keys).limit(page_size)
    named = _list_columns(t, rows, few=True, keep=(SORT_KEYS[sort_by],))
    return named.orderBy(*keys).select(*SUMMARY_COLUMNS)


def page_info(t: Tables, filters: Filters | None = None, page: int = 1, page_size: int = 25) -> DataFrame:
    """Total and number of pages of a search, at least one page."""
    _check_page(page, page_size)
    return matching(t, filters).agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long").alias("pages"),
    )


def posting_degrees(t: Tables, postings: DataFrame) -> DataFrame:
    """``job_id, degree, level, specializations``: each degree only with its own pairs of that posting."""
    pairs = (
        postings.select("job_id", F.explode("accepted_degree_specialization_ids").alias("degree_specialization_id"))
        .join(t.degree_specializations, "degree_specialization_id")
        .join(t.specializations, "specialization_id")
        .groupBy("job_id", "degree_id")
        .agg(F.sort_array(F.collect_list("specialization_name")).alias("specializations"))
    )
    return (
        postings.select("job_id", F.explode("accepted_degree_ids").alias("degree_id"))
        .join(pairs, ["job_id", "degree_id"], "left")
        .join(t.degrees, "degree_id")
        .select(
            "job_id",
            F.col("degree_name").alias("degree"),
            "level",
            F.coalesce("specializations", F.array().cast("array<string>")).alias("specializations"),
        )
    )


def _degrees_with_pairs(degrees: Column, pairs: Column) -> Column:
    """Each degree with the names of its own pairs, from the row's two small arrays."""
    return F.transform(
        degrees,
        lambda d: F.struct(
            d["degree"].alias("degree"),
            d["level"].alias("level"),
            F.transform(
                F.filter(pairs, lambda p: p["degree_id"] == d["degree_id"]), lambda p: p["name"]
            ).alias("specializations"),
        ),
    )


def posting_detail(t: Tables, job_id: int | None = None) -> DataFrame:
    """Postings in full; with ``job_id`` one posting, or no row if there is none."""
    rows = t.postings if job_id is None else t.postings.filter(F.col("job_id") == job_id)
    none = F.array().cast("array<string>")
    arrays = {
        "skills": ("skill_ids", "skill"),
        "preferred_skills": ("preferred_skill_ids", "skill"),
        "cities": ("city_ids", "city"),
        "_degrees": ("accepted_degree_ids", "degree"),
        "_pairs": ("accepted_degree_specialization_ids", "pair"),
    }
    named = with_names(t, rows, arrays, few=job_id is not None)
    named = named.withColumns({out: _or_none(out) for out in ("skills", "preferred_skills", "cities")})
    stated = t.qualifications if job_id is None else t.qualifications.filter(F.col("job_id") == job_id)
    levels = stated.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct("level", "field_of_study"))).alias("qualifications")
    )
    sections = description_sections(F.col("description"))
    return (
        _with_dictionaries(t, named)
        .join(levels, "job_id", "left")
        .withColumn("_sections", sections)
        .select(
            *SUMMARY_COLUMNS,
            "description",
            F.col("_sections.responsibilities").alias("responsibilities_text"),
            F.col("_sections.requirements").alias("requirements_text"),
            F.coalesce("certifications", none).alias("certifications"),
            "preferred_skills",
            F.coalesce("company_badges", none).alias("company_badges"),
            "source_search",
            F.coalesce("qualifications", F.array().cast(NO_LEVELS)).alias("qualifications"),
            F.coalesce(
                _degrees_with_pairs(F.col("_degrees"), F.col("_pairs")), F.array().cast(NO_DEGREES)
            ).alias("qualification_degrees"),
            "first_seen_date",
            "last_seen_date",
            "times_seen",
            F.datediff("last_seen_date", "first_seen_date").alias("days_listed"),
        )
    )


def display_rows(t: Tables, postings: DataFrame) -> DataFrame:
    """List rows as shown to a reader."""
    c = F.col
    return summaries(t, postings).select(
        "job_id",
        "title",
        "company",
        "role_family",
        display.experience_text(c("experience_min"), c("experience_max")).alias("experience"),
        display.cities_text(c("cities")).alias("cities"),
        "working_type",
        display.salary_text(c("salary_min"), c("salary_max")).alias("salary"),
        display.skills_text(c("skills")).alias("skills"),
        display.applicants_text(c("applicant_count"), c("applicant_count_qualifier")).alias("applicants"),
        "posted_date",
        "url",
    )
