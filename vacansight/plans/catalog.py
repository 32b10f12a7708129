"""The registered queries: each operator over the whole given tables.

Arrays are shown as joined text so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacansight.functions import display, education, parsing, sections, text
from vacansight.functions import skills as skill_steps
from vacansight.functions.places import resolve_locations
from vacansight.operators import digest, dictionaries, distributions, health, merge, pairs, reference_lists, search, trends
from vacansight.operators.filters import Filters, matching
from vacansight.plans import standins, stored
from vacansight.plans.clean import clean_postings
from vacansight.sources import pages as page_jobs
from vacansight.session import small_table, unfolded
from vacansight.sources import seeds
from vacansight.vocab import CERTIFICATION_PATTERNS, ROLE_PATTERNS, SENIORITY_PATTERNS, SKILL_PATTERNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries, shared with their SQL.
AS_OF = "2000-06-01"
TREND_DAY = "2024-01-30"
SERIES = ["7", "13", "88"]
SUGGEST_FOR = ["Brand#5", "Brand#9", "No such skill"]
DOC_VOCABULARY = {
    "Article": ["the", "les"],
    "License": ["license", "licen[cs]ed"],
    "MIT": ["mit"],
    "Apache": ["apache", r"apache \d\.\d"],
    "Mail": [r"mail", "e-mail"],
    "Never": ["zzzz"],
}
PAGE_RULES = page_jobs.PageRules(
    texts={"title": page_jobs.element("title"), "heading": page_jobs.element("h1"), "body": page_jobs.element("body"), "advert": page_jobs.element("div")},
    lists={"items": page_jobs.element("li")},
)
MAP_PLACES = [(0, 12.5, 77.25), (3, 17.0, 78.5), (7, 19.25, 72.75), (24, 28.5, 77.0)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def flat(df: DataFrame) -> DataFrame:
    """Text arrays joined, decimals as doubles."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        columns.append(c.alias(f.name))
    return df.select(*columns)


# --- headline figures and distributions -------------------------------------------------


@query
def summary(spark, sf):
    return distributions.summary(standins.StandIns(spark, sf, skills=True, cities=True), day(AS_OF))


@query
def skill_demand(spark, sf):
    return distributions.skill_demand(standins.StandIns(spark, sf, skills=True), limit=25)


@query
def skill_demand_all(spark, sf):
    return distributions.skill_demand(standins.StandIns(spark, sf, skills=True), limit=None, include_blocked=True)


@query
def skill_demand_scoped(spark, sf):
    scope = Filters(
        role_family=["BUILDING", "MACHINERY"], state=["ASIA", "EUROPE"], experience_min=2, experience_max=9,
        posted_after="1996-03-01", company="customer#0000",
    )
    return distributions.skill_demand(standins.StandIns(spark, sf, skills=True, cities=True), limit=None, scope=scope)


@query
def role_distribution(spark, sf):
    return distributions.role_distribution(standins.StandIns(spark, sf), Filters(experience_min=1, experience_max=8))


@query
def role_distribution_by_city(spark, sf):
    t = standins.StandIns(spark, sf, cities=True)
    return distributions.role_distribution(t, Filters(city=["NATION_3", "NATION_11", "Nowhere"]))


@query
def seniority_distribution(spark, sf):
    return distributions.seniority_distribution(standins.StandIns(spark, sf))


@query
def experience_distribution(spark, sf):
    return distributions.experience_distribution(standins.StandIns(spark, sf), Filters(role_family=["BUILDING", "FURNITURE"]))


@query
def location_distribution_city(spark, sf):
    return distributions.location_distribution(standins.StandIns(spark, sf, cities=True), "city", 30)


@query
def location_distribution_state(spark, sf):
    t = standins.StandIns(spark, sf, cities=True)
    return distributions.location_distribution(t, "state", 30, role_family=["AUTOMOBILE"])


@query
def qualification_distribution(spark, sf):
    return distributions.qualification_distribution(standins.StandIns(spark, sf))


@query
def skill_category_mix(spark, sf):
    return distributions.category_mix(standins.StandIns(spark, sf, skills=True), Filters(role_family=["MACHINERY"]))


@query
def openings_distribution(spark, sf):
    return distributions.openings_distribution(standins.StandIns(spark, sf))


@query
def openings_overflow(spark, sf):
    return distributions.openings_overflow(standins.StandIns(spark, sf))


@query
def repost_groups(spark, sf):
    docs = standins.texts(spark, sf, "documents")
    hashed = docs.select(text.description_hash(F.col("text")).alias("description_hash"), F.col("source").alias("company"))
    return distributions.repost_groups(hashed)


@query
def source_productivity(spark, sf):
    return distributions.source_productivity(standins.StandIns(spark, sf), day(AS_OF))


# --- pairs -----------------------------------------------------------------------------


@query
def co_occurrence(spark, sf):
    return pairs.co_occurrence(standins.StandIns(spark, sf, skills=True), top_skills=20, limit=None)


@query
def co_occurrence_top(spark, sf):
    return pairs.co_occurrence(standins.StandIns(spark, sf, skills=True), top_skills=12, limit=15, min_together=5)


@query
def skill_suggestions(spark, sf):
    return pairs.skill_suggestions(standins.StandIns(spark, sf, skills=True), SUGGEST_FOR, 15)


@query
def skill_suggestions_by_role(spark, sf):
    t = standins.StandIns(spark, sf, skills=True)
    return pairs.skill_suggestions(t, SUGGEST_FOR, None, role_family=["BUILDING"])


@query
def pair_matrix(spark, sf):
    matrix = pairs.pair_matrix(standins.StandIns(spark, sf, skills=True), 20)
    return pairs.matrix_columns(matrix, ["Brand#1", "Brand#2", "Brand#10", "Brand#25"])


@query
def level_share_matrix(spark, sf):
    return pairs.level_share_matrix(standins.StandIns(spark, sf, skills=True))


# --- reference lists --------------------------------------------------------------------


@query
def cities_reference(spark, sf):
    return reference_lists.cities_reference(standins.StandIns(spark, sf, cities=True))


@query
def cities_with_postings(spark, sf):
    return reference_lists.cities_reference(standins.StandIns(spark, sf, cities=True), with_postings_only=True)


@query
def states_reference(spark, sf):
    return reference_lists.states_reference(standins.StandIns(spark, sf, cities=True))


@query
def roles_reference(spark, sf):
    return reference_lists.roles_reference(standins.StandIns(spark, sf))


@query
def role_categories_reference(spark, sf):
    return reference_lists.role_categories_reference(standins.StandIns(spark, sf))


@query
def departments_reference(spark, sf):
    return reference_lists.departments_reference(standins.StandIns(spark, sf))


@query
def industry_types_reference(spark, sf):
    return reference_lists.industry_types_reference(standins.StandIns(spark, sf))


@query
def degrees_reference(spark, sf):
    return reference_lists.degrees_reference(standins.StandIns(spark, sf, degrees=True))


@query
def specializations_reference(spark, sf):
    return reference_lists.specializations_reference(standins.StandIns(spark, sf, degrees=True))


@query
def companies_reference(spark, sf):
    return reference_lists.companies_reference(standins.StandIns(spark, sf), limit=100, min_postings=2, search="000")


@query
def skills_reference(spark, sf):
    return reference_lists.skills_reference(standins.StandIns(spark, sf, skills=True), min_postings=3, search="brand#1")


@query
def working_types(spark, sf):
    return reference_lists.stated_values(standins.StandIns(spark, sf), "working_type")


@query
def employment_types(spark, sf):
    return reference_lists.stated_values(standins.StandIns(spark, sf), "employment_type")


@query
def contract_types(spark, sf):
    return reference_lists.stated_values(standins.StandIns(spark, sf), "contract_type")


@query
def posting_count(spark, sf):
    return reference_lists.row_count(standins.postings(spark, sf))


# --- search -----------------------------------------------------------------------------


@query
def search_page(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    return flat(search.search_postings(t, Filters(min_openings=2), "posted_date", "desc", page=3, page_size=25))


@query
def search_page_first_seen(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    return flat(search.search_postings(t, Filters(), "first_seen", "asc", page=1, page_size=40))


@query
def search_after_row(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    return flat(search.search_after(t, (7, 900), Filters(), "experience_min", "asc", page_size=30))


@query
def search_page_info(spark, sf):
    return search.page_info(standins.StandIns(spark, sf), Filters(has_salary=True, salary_min=12, salary_max=40), 2, 25)


def _matching_ids(t, f):
    return matching(t, f).select("job_id")


@query
def search_skill_any(spark, sf):
    return _matching_ids(standins.StandIns(spark, sf, skills=True), Filters(skill=["Brand#2", "Brand#14", "No such skill"]))


@query
def search_skill_all(spark, sf):
    return _matching_ids(standins.StandIns(spark, sf, skills=True), Filters(skills_all=["Brand#2", "Brand#14"]))


@query
def search_skill_all_unknown(spark, sf):
    return _matching_ids(standins.StandIns(spark, sf, skills=True), Filters(skills_all=["Brand#2", "No such skill"]))


@query
def search_locations(spark, sf):
    t = standins.StandIns(spark, sf, cities=True)
    return _matching_ids(t, Filters(city=["NATION_4", "NATION_9"], state=["MIDDLE EAST"]))


@query
def search_text(spark, sf):
    return _matching_ids(standins.StandIns(spark, sf), Filters(search="DATA%engineer", company="#0000000"))


@query
def search_everything(spark, sf):
    f = Filters(
        role_family=["BUILDING", "MACHINERY", "FURNITURE"], seniority_level=["Senior", "Junior"], experience_min=1,
        experience_max=11, has_salary=True, salary_min=5, salary_max=45, working_type=["Remote", "On-site"],
        employment_type=["Full Time"], contract_type=["Permanent", "Contract"], qualification_level=["UG", "PG"],
        posted_after="1995-02-01", posted_before="2001-02-01", seen_after="1995-06-01", min_openings=2,
    )
    return _matching_ids(standins.StandIns(spark, sf), f)


@query
def search_undisclosed_salary(spark, sf):
    return _matching_ids(standins.StandIns(spark, sf), Filters(has_salary=False, qualification_level=["Doctorate"]))


@query
def posting_detail(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True, degrees=True, description=True)
    full = search.posting_detail(t)
    return flat(
        full.withColumns(
            {
                "qualifications": F.transform("qualifications", lambda q: F.concat_ws(": ", q["level"], q["field_of_study"])),
                "education_text": display.education_text(F.col("qualification_degrees")),
                "description": F.md5("description"),
            }
        ).drop("qualification_degrees", "responsibilities_text", "requirements_text")
    )


@query
def posting_degrees(spark, sf):
    t = standins.StandIns(spark, sf, degrees=True)
    return flat(search.posting_degrees(t, t.postings))


@query
def display_rows(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    return search.display_rows(t, t.postings)


# --- trends -----------------------------------------------------------------------------


def _daily(spark, sf):
    return standins.daily_counts(spark, sf), standins.blocklist(spark)


@query
def delta_daily(spark, sf):
    return trends.delta_daily(*_daily(spark, sf))


@query
def delta_baseline(spark, sf):
    return trends.delta_baseline(*_daily(spark, sf))


@query
def coverage(spark, sf):
    return trends.coverage(standins.daily_counts(spark, sf))


@query
def movers_both(spark, sf):
    return trends.movers(*_daily(spark, sf), limit=25)


@query
def movers_up(spark, sf):
    return trends.movers(*_daily(spark, sf), direction="up", limit=None, on="2024-01-20")


@query
def movers_down(spark, sf):
    return trends.movers(*_daily(spark, sf), direction="down", limit=10)


@query
def movers_previous_day(spark, sf):
    return trends.movers(*_daily(spark, sf), comparison="previous_day", limit=None, skills=[str(n) for n in range(20, 60)])


@query
def first_appearances(spark, sf):
    return trends.first_appearances(*_daily(spark, sf), since="2024-01-02", limit=None)


@query
def first_appearances_late(spark, sf):
    """Counts of which every skill lacks its first days, as many as its number says."""
    daily, blocked = _daily(spark, sf)
    began = F.date_add(day("2024-01-01"), (F.col("skill").cast("int") % 20).cast("int"))
    return trends.first_appearances(daily.filter(F.col("snapshot_date") >= began), blocked, since="2024-01-10", limit=None)


@query
def skill_series(spark, sf):
    return trends.skill_series(standins.daily_counts(spark, sf), SERIES, since="2024-01-03", until="2024-01-25")


@query
def snapshot_daily(spark, sf):
    t = standins.StandIns(spark, sf, skills=True)
    return trends.snapshot(t.postings, t.skills, day(AS_OF))


@query
def snapshot_upsert(spark, sf):
    """A day counted twice as high for view events only: those keys change, the others stay."""
    daily = standins.daily_counts(spark, sf)
    fresh = (
        standins.table(spark, sf, "events")
        .filter((F.col("event_type") == "view") & (F.to_date("ts") == day("2024-01-10")))
        .groupBy(F.to_date("ts").alias("snapshot_date"), standins.event_key().alias("skill"))
        .agg((F.count(F.lit(1)) * 2).alias("posting_count"))
    )
    return trends.upsert_counts(daily, fresh)


# --- overview tables --------------------------------------------------------------------


@query
def band_squares(spark, sf):
    return digest.band_squares(standins.StandIns(spark, sf))


@query
def bands_in_order(spark, sf):
    return digest.bands_in_order(standins.StandIns(spark, sf))


@query
def seniority_in_order(spark, sf):
    return digest.seniority_in_order(distributions.seniority_distribution(standins.StandIns(spark, sf)))


@query
def fresher_ratio(spark, sf):
    return digest.fresher_ratio(standins.StandIns(spark, sf))


@query
def city_map(spark, sf):
    t = standins.StandIns(spark, sf, cities=True)
    places = small_table(spark, MAP_PLACES, "n int, lat double, lon double").select(
        F.concat(F.lit("NATION_"), F.col("n").cast("string")).alias("city_name"), "lat", "lon"
    )
    return digest.city_map(reference_lists.cities_reference(t), places)


@query
def weekly_digest(spark, sf):
    t = standins.StandIns(spark, sf, skills=True)
    return digest.weekly_digest(t, day(AS_OF), day(TREND_DAY))


# --- feed health and checks -------------------------------------------------------------


@query
def field_fill_counts(spark, sf):
    raw = standins.raw_text(spark, sf)
    fields = ["title", "experience", "salary", "working_type", "role_category", "department", "pg"]
    counts = health.field_fill_counts(raw.withColumn("day", F.trunc("seen_on", "month")), fields, ["day"])
    return counts.select("day", "postings_scraped", F.explode("field_found_counts").alias("field", "found"))


@query
def run_list(spark, sf):
    return health.run_list(standins.runs(spark, sf), 20).select(
        "run_id", "search_url", "postings_found", "postings_scraped", "postings_written", "storage_ok",
        "error_message", "duration_seconds",
    )


@query
def field_health(spark, sf):
    return health.field_health(standins.runs(spark, sf), 27, 10)


@query
def field_health_history(spark, sf):
    return health.field_health_history(standins.runs(spark, sf), 10)


@query
def constraint_report(spark, sf):
    return health.constraint_report(standins.StandIns(spark, sf, skills=True))


@query
def orphan_report(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    t.skills = t.skills.filter(F.col("category").isNotNull())
    t.role_categories = t.role_categories.filter(F.col("name") != "ASIA")
    return health.orphan_report(t, health.CORE_REFERENCES)


@query
def reference_report(spark, sf):
    """Every reference of the model, each with entries taken out of its dictionary."""
    t = standins.StandIns(spark, sf, skills=True, cities=True, degrees=True)
    c = F.col
    t.postings = t.postings.filter(c("job_id") % 50 != 0)
    t.skills = t.skills.filter(c("category").isNotNull())
    t.cities = t.cities.filter(c("city_id") % 4 != 0)
    t.states = t.states.filter(c("state_name") != "ASIA")
    t.departments = t.departments.filter(c("department_id") % 3 != 0)
    t.role_categories, t.industry_types = t.role_categories.filter(c("name") != "ASIA"), t.industry_types.filter(c("name") != "AFRICA")
    t.degree_specializations = t.degree_specializations.filter(c("degree_specialization_id") % 7 != 0)
    t.degrees, t.specializations = t.degrees.filter(c("degree_name") != "PROMO"), t.specializations.filter(c("specialization_id") != 2)
    return health.orphan_report(t)


@query
def constraint_breaches(spark, sf):
    """Postings changed so that each rule of the model is broken."""
    t = standins.StandIns(spark, sf, skills=True)
    c = F.col
    every = lambda n: c("job_id") % n == 0
    t.postings = t.postings.withColumns(
        {
            "working_type": F.when(every(97), "Afloat").otherwise(c("working_type")),
            "employment_type": F.when(every(89), "By the tide").otherwise(c("employment_type")),
            "contract_type": F.when(every(83), "Handshake").otherwise(c("contract_type")),
            "preferred_skill_ids": F.when(every(79), F.array(F.lit(9999))).otherwise(c("preferred_skill_ids")),
            "fingerprint": F.floor(c("job_id") / 3).cast("string"),
        }
    )
    t.qualifications = t.qualifications.unionByName(t.qualifications.filter(every(71)))
    return health.constraint_report(t)


# --- merge ------------------------------------------------------------------------------


def _sightings(spark, sf):
    """Events as sightings of (user, kind), the first half of the month already stored."""
    sighted = standins.table(spark, sf, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("fingerprint"),
        F.col("value").alias("salary_min"),
        F.col("event_id").alias("batch_pos"),
        F.to_date("ts").alias("seen_on"),
    )
    split = day("2024-01-16")
    return sighted.filter(F.col("seen_on") < split), sighted.filter(F.col("seen_on") >= split)


@query
def batch_dedupe(spark, sf):
    _, late = _sightings(spark, sf)
    return merge.first_sightings(late, ["fingerprint"], ["batch_pos"]).select("fingerprint", "salary_min", "batch_pos")


def _merged(spark, sf):
    early, late = _sightings(spark, sf)
    stored = merge.first_sightings(early, ["fingerprint"], ["batch_pos"]).select(
        "fingerprint",
        F.col("batch_pos").alias("job_id"),
        "salary_min",
        F.col("seen_on").alias("first_seen_date"),
        F.col("seen_on").alias("last_seen_date"),
        F.lit(1).alias("times_seen"),
        F.lit(1).cast("long").alias("last_batch_id"),
    )
    batch = merge.first_sightings(late, ["fingerprint"], ["batch_pos"])
    ids = merge.new_job_ids(stored, batch, "fingerprint", ["batch_pos"])
    return merge.merge_batch(stored, batch, ids, day("2024-01-31"), 2)


@query
def fingerprint_merge(spark, sf):
    return _merged(spark, sf)


@query
def new_vs_repeat(spark, sf):
    return merge.batch_counts(_merged(spark, sf), 2)


@query
def child_rebuild(spark, sf):
    children = standins.qualifications(spark, sf)
    touched = standins.postings(spark, sf).filter(F.col("seniority_level") == "Senior").select("job_id")
    fresh = touched.select("job_id", F.lit("UG").alias("level"), F.lit("Any Graduate").alias("field_of_study"))
    return merge.rebuild_children(children, touched, fresh)


@query
def dictionary_ids(spark, sf):
    """Companies of the first two market segments are known; the others are registered in name order."""
    people = standins.table(spark, sf, "customer")
    known = people.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").cast("int").alias("company_id"), F.col("c_name").alias("name")
    )
    new = dictionaries.new_entries(known, people.select(F.col("c_name").alias("name")), ["name"], "company_id")
    return known.unionByName(new)


# --- cleaning steps ---------------------------------------------------------------------


def _raw(spark, sf, *columns):
    return standins.raw_text(spark, sf).select("job_id", *columns)


@query
def canonical_text(spark, sf):
    c = F.col
    return _raw(
        spark, sf, text.present(c("department")).alias("department"), text.present(c("role_category")).alias("role_category"),
        text.canonical(c("company")).alias("company"),
        text.fingerprint(c("company"), c("title"), c("location"), c("experience")).alias("fingerprint"),
    )


@query
def description_hashes(spark, sf):
    docs = standins.texts(spark, sf, "documents")
    return docs.select("doc_id", text.description_hash(F.col("text")).alias("description_hash"))


@query
def initcap_runs(spark, sf):
    return _raw(spark, sf, text.initcap_runs(F.concat_ws("/", F.upper("title"), F.lower("location"))).alias("cased"))


@query
def parsed_ranges(spark, sf):
    e, s = F.col("experience"), F.col("salary")
    return flat(
        _raw(
            spark, sf,
            parsing.to_years(parsing.range_min(e)).alias("experience_min"),
            parsing.to_years(parsing.range_max(e)).alias("experience_max"),
            parsing.to_money(parsing.range_min(s)).alias("salary_min"),
            parsing.to_money(parsing.range_max(s)).alias("salary_max"),
        )
    )


@query
def employment_terms(spark, sf):
    c = F.col
    return _raw(
        spark, sf,
        parsing.employment_type(c("employment_type")).alias("employment_type"),
        parsing.contract_type(c("employment_type")).alias("contract_type"),
        parsing.working_type(text.present(c("working_type"))).alias("working_type"),
    )


@query
def resolved_locations(spark, sf):
    placed = resolve_locations(_raw(spark, sf, "location"), "location", seeds.cities(spark))
    return flat(placed.drop("location"))


@query
def classified_titles(spark, sf):
    c = F.col("title")
    return _raw(
        spark, sf,
        parsing.first_phrase(c, ROLE_PATTERNS, "Other").alias("role_family"),
        parsing.first_phrase(c, SENIORITY_PATTERNS, None).alias("seniority_level"),
    )


@query
def posted_dates(spark, sf):
    return _raw(spark, sf, parsing.posted_date(F.col("posted_raw"), F.col("seen_on")).alias("posted_date"))


@query
def counted_applicants(spark, sf):
    a = parsing.applicants(F.col("applicants_raw"))
    return _raw(
        spark, sf, a["count"].alias("applicant_count"), a["qualifier"].alias("qualifier"),
        parsing.suffixed_count(F.col("reviews_raw")).alias("reviews"),
    )


@query
def years_in_text(spark, sf):
    phrase = F.concat(F.lit("We want "), F.lower("experience"), F.lit(", at least "), (F.col("job_id") % 8).cast("string"), F.lit(" years"))
    y = parsing.years_in_text(phrase)
    return _raw(spark, sf, y["min"].alias("years_min"), y["max"].alias("years_max"))


@query
def qualification_levels(spark, sf):
    block = F.create_map(F.lit("Under Graduate"), F.col("ug"), F.lit(" PhD "), F.col("pg"), F.lit("Diploma"), F.lit("Any"))
    rows = unfolded(standins.raw_text(spark, sf), education.qualification_levels(block), "q", "job_id")
    return rows.select("job_id", "q.level", "q.field_of_study")


@query
def degree_breakdown(spark, sf):
    block = F.create_map(F.lit("UG"), F.col("ug"), F.lit("Post Graduate"), F.col("pg"))
    rows = unfolded(standins.raw_text(spark, sf), education.degree_breakdown(block), "d", "job_id")
    return flat(rows.select("job_id", "d.degree", "d.level", "d.specializations"))


@query
def section_split(spark, sf):
    docs = standins.texts(spark, sf, "documents")
    full = F.concat(F.lit("Intro.\nKey Responsibilities:\n"), F.col("text"), F.lit("\nAbout Company\nlost.\nRequired Skills\n"), F.col("source"), F.lit(" 1.\n"))
    s = sections.description_sections(full)
    return docs.select("doc_id", F.md5(s["responsibilities"]).alias("responsibilities"), s["requirements"].alias("requirements"))


@query
def vocabulary_mining(spark, sf):
    docs = standins.texts(spark, sf, "documents").select("doc_id", "text")
    return flat(skill_steps.mine_terms(docs, "text", DOC_VOCABULARY, "found").drop("text"))


@query
def certification_mining(spark, sf):
    docs = standins.texts(spark, sf, "documents").select("doc_id", "text")
    return flat(skill_steps.mine_terms(docs, "text", CERTIFICATION_PATTERNS, "certifications").drop("text"))


def _tagged(spark, sf):
    raw = standins.raw_postings(spark, sf)
    return raw.select(F.col("batch_pos").alias("job_id"), "key_skills", "tech_in_description", "preferred_key_skills")


@query
def skill_mining(spark, sf):
    """Taxonomy over each order's tags written as one sentence."""
    written = _tagged(spark, sf).select("job_id", F.array_join("key_skills", ", ").alias("text"))
    return flat(skill_steps.mine_terms(written, "text", SKILL_PATTERNS, "found").drop("text"))


@query
def merged_skills(spark, sf):
    c = F.col
    merged = _tagged(spark, sf).withColumn("skills", skill_steps.merge_skills(c("key_skills"), c("tech_in_description")))
    return flat(
        merged.select(
            "job_id", "skills",
            skill_steps.preferred_skills(c("skills"), c("preferred_key_skills")).alias("preferred_skills"),
            skill_steps.not_already_tagged(c("tech_in_description"), c("key_skills")).alias("only_in_text"),
        )
    )


@query
def alternative_skills(spark, sf):
    c = F.col
    merged = skill_steps.merge_skills(c("key_skills"), c("tech_in_description"))
    return flat(_tagged(spark, sf).select("job_id", merged.alias("skills")).select("job_id", skill_steps.group_alternatives(c("skills")).alias("grouped")))


@query
def skill_categories(spark, sf):
    named = unfolded(_tagged(spark, sf), skill_steps.normalise_skills(F.col("key_skills")), "skill")
    return named.groupBy("skill", skill_steps.skill_category(F.col("skill")).alias("category")).agg(F.count(F.lit(1)).alias("postings"))


@query
def cleaned_postings(spark, sf):
    """The whole cleaning job."""
    cleaned = clean_postings(standins.raw_postings(spark, sf), seeds.cities(spark))
    return flat(
        cleaned.withColumns(
            {
                "qualifications": F.transform("qualifications", lambda q: F.concat_ws(": ", q["level"], q["field_of_study"])),
                "qualification_degrees": F.transform(
                    "qualification_degrees",
                    lambda d: F.concat(d["degree"], F.lit("/"), d["level"], F.lit("/"), F.array_join(d["specializations"], "+")),
                ),
                "description": F.md5("description"),
            }
        )
    )


# --- pages ------------------------------------------------------------------------------


@query
def page_fields(spark, sf):
    found = page_jobs.extract_fields(standins.texts(spark, sf, "pages"), PAGE_RULES)
    return flat(found.select("page_id", "title", "heading", "items", "body", "advert"))


@query
def posting_pages(spark, sf):
    found = page_jobs.page_fields(standins.posting_pages(spark, sf), day(AS_OF))
    education = F.array_join(F.transform(F.map_entries("education"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    shown = ["url", "title", "company", "key_skills", "preferred_key_skills", "company_badges", "department", "openings", "description"]
    return flat(found.select(*shown, education.alias("education")))


@query
def page_links(spark, sf):
    return page_jobs.page_links(standins.texts(spark, sf, "pages"))


@query
def url_discovery(spark, sf):
    links = standins.table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    return page_jobs.discover_urls(links, "example.com", ["pos"])


@query
def url_discovery_limited(spark, sf):
    links = page_jobs.page_links(standins.texts(spark, sf, "pages"))
    whole = links.select("page_id", "pos", F.concat(F.lit("https://www.site.example.org"), "url").alias("url"))
    return page_jobs.discover_urls(whole, "site.example", ["page_id", "pos"], limit=50)


QUERIES.update(stored.QUERIES)
