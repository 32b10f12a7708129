"""Registered queries over a store that batches were ingested into: orders as sightings, dealt into batches by their key.

A posting is a customer's orders of one priority: most are seen in several batches, some twice in one,
and each batch has new ones. Orders whose key 5 divides state no education. The first batch is sent once more at the end.
"""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansight.operators.merge import batch_counts
from vacansight.plans import standins
from vacansight.plans.ingest import ingest_batch
from vacansight.session import shared_dir
from vacansight.sources.store import Store

# Parameters shared with the SQL.
BATCH_DAYS = [date(2000, 6, 1), date(2000, 6, 2), date(2000, 6, 4)]
BUCKETS = 8
TOOLS, FIELDS, DEPARTMENTS = 40, 7, 6

_BUILT: dict[tuple[str, str], str] = {}


def sightings(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """Raw records of one batch."""
    c = F.col
    order, customer = c("o_orderkey"), c("o_custkey").cast("string")
    named = lambda start, n: F.concat(F.lit(start), n.cast("string"))
    absent, nothing = F.lit("not found"), F.lit(None).cast("array<string>")
    taught = F.create_map(F.lit("UG"), named("B.Sc in Field ", c("o_custkey") % FIELDS))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    columns = {
        "url": named("https://postings.example.net/", order), "title": F.concat(F.lit("Post "), "o_orderpriority"), "company": F.concat(F.lit("Firm "), customer),
        "key_skills": F.array(named("Tool", order % TOOLS), named("Tool", c("o_custkey") % TOOLS)), "tech_in_description": nothing, "preferred_key_skills": F.array(named("Tool", order % TOOLS)),
        "company_badges": nothing, "department": named("Department ", c("o_custkey") % DEPARTMENTS), "openings": (order % 50).cast("string"),
        "education": F.when(order % 5 == 0, none).otherwise(taught), "description": absent, "location": F.lit("Pune"), "batch_pos": order,
    }
    rest = ["experience", "salary", "employment_type", "working_type", "role_category", "listed_role", "industry_type", "posted_date", "posted_raw"]
    rest += ["applicant_count", "applicant_count_qualifier", "company_rating", "company_reviews", "source_search"]
    own = standins.texts(spark, sf_dir, "orders").filter(order % len(BATCH_DAYS) == number)
    return own.select(*[v.alias(k) for k, v in columns.items()], *[absent.alias(r) for r in rest])


def filled_store(spark: SparkSession, sf_dir: str) -> Store:
    """The store after all batches; built once per session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}", BUCKETS)
        store.seed()
        for number in [*range(len(BATCH_DAYS)), 0]:
            ingest_batch(store, sightings(spark, sf_dir, number), BATCH_DAYS[number], number + 1)
        store.compact(3)
        _BUILT[key] = store.root
    return Store(spark, _BUILT[key], BUCKETS)


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name: F.array_join(F.col(name).cast("array<string>"), "|").alias(name)
    return filled_store(spark, sf_dir).read("postings").select(
        "job_id", "title", "company", "openings", "department_id", "first_seen_date", "last_seen_date", "times_seen", "last_batch_id",
        ids("skill_ids"), ids("preferred_skill_ids"), ids("accepted_degree_ids"), ids("accepted_degree_specialization_ids"),
    )


def stored_qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_store(spark, sf_dir).read("qualifications").select("job_id", "level", "field_of_study")


def stored_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_store(spark, sf_dir).read("daily_counts").select("snapshot_date", "skill", "posting_count")


def stored_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = filled_store(spark, sf_dir)
    m = store.manifest()
    shown = {
        "skills": ("skill_id", F.col("skill_name")), "departments": ("department_id", F.col("name")),
        "specializations": ("specialization_id", F.col("specialization_name")), "degrees": ("degree_id", F.concat_ws("|", "degree_name", "level")),
        "degree_specializations": ("degree_specialization_id", F.concat_ws("|", "degree_id", "specialization_id")),
    }
    parts = [store.read(t, m).select(F.lit(t).alias("dictionary"), F.col(i).alias("id"), name.alias("name")) for t, (i, name) in shown.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def stored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and repeated postings of the last batch."""
    return batch_counts(filled_store(spark, sf_dir).read("postings"), len(BATCH_DAYS))


QUERIES = {f.__name__: f for f in (stored_outcomes, stored_postings, stored_qualifications, stored_daily_counts, stored_dictionaries)}


def _entries(name: str, value: str, where: str = "true") -> str:
    """Ids of a dictionary: names in the order of the batch that brought them, then by name."""
    return f"""{name} AS (SELECT name, CAST(row_number() OVER (ORDER BY batch, name) AS INTEGER) AS id
      FROM (SELECT {value} AS name, min(batch) AS batch FROM f WHERE {where} GROUP BY 1))"""


_TAUGHT = "o_orderkey % 5 <> 0"
_BASE = f"""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % {len(BATCH_DAYS)} AS batch FROM orders
  QUALIFY row_number() OVER (PARTITION BY batch, o_custkey, o_orderpriority ORDER BY o_orderkey) = 1),
day AS (SELECT * FROM (VALUES {", ".join(f"({i}, DATE '{d}')" for i, d in enumerate(BATCH_DAYS))}) d(batch, day)),
tool AS (SELECT *, 'Tool' || (o_orderkey % {TOOLS}) AS skill, true AS starred FROM f UNION SELECT *, 'Tool' || (o_custkey % {TOOLS}), o_custkey % {TOOLS} = o_orderkey % {TOOLS} FROM f),
skills AS (SELECT skill AS name, CAST(row_number() OVER (ORDER BY min(batch), skill) AS INTEGER) AS id FROM tool GROUP BY skill),
{_entries("departments", f"'Department ' || (o_custkey % {DEPARTMENTS})")},
{_entries("specializations", f"'Field ' || (o_custkey % {FIELDS})", _TAUGHT)},
{_entries("degrees", "'B.Sc|UG'", _TAUGHT)},
links AS (SELECT CAST(row_number() OVER (ORDER BY batch, specialization_id) AS INTEGER) AS id, specialization_id FROM (
  SELECT s.id AS specialization_id, min(batch) AS batch FROM f JOIN specializations s ON s.name = 'Field ' || (o_custkey % {FIELDS}) WHERE {_TAUGHT} GROUP BY s.id)),
seen AS (SELECT o_custkey, o_orderpriority, min(batch) AS first, max(batch) AS last, CAST(count(*) AS INTEGER) AS times, arg_min(o_orderkey, batch) AS came, arg_max(o_orderkey, batch) AS o_orderkey
  FROM f GROUP BY ALL),
job AS (SELECT *, row_number() OVER (ORDER BY first, came) AS job_id FROM seen)
"""
SQL = {
    "stored_postings": f"""{_BASE}
SELECT job_id, 'Post ' || job.o_orderpriority AS title, 'Firm ' || job.o_custkey AS company, CAST(job.o_orderkey % 50 AS INTEGER) AS openings,
  (SELECT id FROM departments WHERE name = 'Department ' || (job.o_custkey % {DEPARTMENTS})) AS department_id,
  a.day AS first_seen_date, b.day AS last_seen_date, times AS times_seen, CAST(last + 1 AS BIGINT) AS last_batch_id,
  array_to_string(list_sort(list(DISTINCT s.id)), '|') AS skill_ids, array_to_string(list_sort(list(DISTINCT s.id) FILTER (starred)), '|') AS preferred_skill_ids,
  CASE WHEN job.{_TAUGHT} THEN '1' ELSE '' END AS accepted_degree_ids,
  CASE WHEN job.{_TAUGHT} THEN CAST((SELECT l.id FROM links l JOIN specializations p ON p.id = l.specialization_id WHERE p.name = 'Field ' || (job.o_custkey % {FIELDS})) AS VARCHAR) ELSE '' END AS accepted_degree_specialization_ids
FROM job JOIN day a ON a.batch = first JOIN day b ON b.batch = last JOIN tool t ON t.o_orderkey = job.o_orderkey JOIN skills s ON s.name = t.skill
GROUP BY job_id, job.o_orderpriority, job.o_custkey, job.o_orderkey, a.day, b.day, times, last""",
    "stored_outcomes": f"""{_BASE}
SELECT count(*) FILTER (times = 1) AS new_postings, count(*) FILTER (times > 1) AS repeat_postings FROM job WHERE last = {len(BATCH_DAYS) - 1}""",
    "stored_qualifications": f"""{_BASE}
SELECT job_id, 'UG' AS level, 'B.Sc in Field ' || (o_custkey % {FIELDS}) AS field_of_study FROM job WHERE {_TAUGHT}""",
    "stored_daily_counts": f"""{_BASE}
SELECT day AS snapshot_date, skill, count(DISTINCT o_orderkey) AS posting_count FROM tool JOIN day USING (batch) GROUP BY ALL""",
    "stored_dictionaries": f"""{_BASE}
SELECT 'skills' AS dictionary, id, name FROM skills UNION ALL SELECT 'departments', id, name FROM departments UNION ALL SELECT 'specializations', id, name FROM specializations
UNION ALL SELECT 'degrees', id, name FROM degrees UNION ALL SELECT 'degree_specializations', id, '1|' || specialization_id FROM links""",
}
