"""SQL with the same meaning as each registered query, for checking results.

Written against the given tables directly and in another way than the Spark jobs where
there is one: links instead of arrays, self joins instead of pairs within a row.
"""

from __future__ import annotations

from vacansight import vocab
from vacansight.functions.text import BLOCK_TAGS
from vacansight.plans import catalog, standins, stored


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def choose(values: list[str], number: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], CAST(({number}) % {len(values)} AS INTEGER) + 1)"


def rounded(num: str, den: str, places: int) -> str:
    """num / den, halves away from zero, from whole numbers."""
    num, den, scale = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)", 10**places
    size = f"((abs({num}) * {2 * scale} + {den}) // ({den} * 2)) / {float(scale)}"
    return f"CAST(CASE WHEN {den} = 0 THEN NULL WHEN {num} < 0 THEN -({size}) ELSE {size} END AS DOUBLE)"


def pct(part: str, whole: str) -> str:
    return rounded(f"({part}) * 100", whole, 2)


def cases(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + " END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def present(x: str) -> str:
    return f"CASE WHEN {x} <> 'not found' AND regexp_matches({x}, '[A-Za-z0-9]') THEN {x} END"


SPACE = "[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]".replace("{{", "{").replace("}}", "}")


def canonical(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{SPACE}+', ' ', 'g'))"


def group(x: str, pattern: str, number: int) -> str:
    return f"NULLIF(regexp_extract({x}, {lit(pattern)}, {number}), '')"


TITLE = (
    "(CASE o_orderpriority "
    + " ".join(f"WHEN {lit(k)} THEN {lit(v + ' ')}" for k, v in standins.TITLE_STARTS.items())
    + " ELSE '' END || "
    + choose(standins.TITLES, "o_orderkey")
    + ")"
)
BRAND = "CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)"
DEGREE = f"list_position([{', '.join(lit(d) for d in standins.DEGREES)}], p_type)"
BAND = "((p_size - 1) // 10 + 1)"
BLOCKED = in_list(standins.BLOCKED)

FACT = f"""
fact AS (
  SELECT o_orderkey AS job_id, sha256(CAST(o_orderkey AS VARCHAR)) AS fingerprint,
    'https://jobs.example.com/job/' || o_orderkey AS url, {TITLE} AS title, c_name AS company,
    NULLIF(c_mktsegment, 'HOUSEHOLD') AS role_family,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Lead/Principal' WHEN '2-HIGH' THEN 'Senior'
      WHEN '3-MEDIUM' THEN 'Junior' WHEN '5-LOW' THEN 'Associate' END AS seniority_level,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 13 AS INTEGER) END AS experience_min,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 13 + 3 AS INTEGER) END AS experience_max,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 10000) AS DECIMAL(12,2)) END AS salary_min,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 10000) + 5 AS DECIMAL(12,2)) END AS salary_max,
    CASE o_orderstatus WHEN 'O' THEN 'On-site' WHEN 'F' THEN 'Remote' ELSE 'Hybrid' END AS working_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Part Time' WHEN o_orderpriority <> '5-LOW' THEN 'Full Time' END AS employment_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'Permanent' WHEN 1 THEN 'Contract' END AS contract_type,
    CAST(o_custkey % 4 AS INTEGER) AS role_category_id,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(c_nationkey AS INTEGER) END AS department_id,
    CAST(o_orderkey % 5 AS INTEGER) AS industry_type_id, 'Role ' || (o_orderkey % 9) AS listed_role,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_date,
    CAST(o_orderdate AS DATE) AS first_seen_date,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS last_seen_date,
    CAST(o_orderkey % 5 + 1 AS INTEGER) AS times_seen,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST((o_orderkey * 7919) % 40 + 1 AS INTEGER) END AS openings,
    CAST(o_orderkey % 200 AS INTEGER) AS applicant_count,
    CASE WHEN o_orderkey % 200 >= 100 THEN 'at_least' WHEN o_orderkey % 200 < 10 THEN 'less_than' END AS applicant_count_qualifier,
    (o_custkey % 40 + 10) / 10.0 AS company_rating, CAST((o_custkey * 13) % 50000 AS INTEGER) AS company_reviews,
    'https://jobs.example.com/' || lower(c_mktsegment) AS source_search
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
LINKS = f"""
links AS (
  SELECT DISTINCT job_id, {BRAND} AS skill_id, p_brand AS skill_name,
    list_extract([NULL, {', '.join(lit(c) for c in standins.CATEGORIES)}], {BRAND} % 5 + 1) AS category
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fact ON job_id = l_orderkey
)"""
STARRED = f"""
starred AS (
  SELECT DISTINCT job_id, p_brand AS skill_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fact ON job_id = l_orderkey
  WHERE l_returnflag = 'R'
)"""
PLACES = """
places AS (
  SELECT DISTINCT job_id, n_nationkey AS city_id, n_name AS city_name, r_name AS state
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN fact ON job_id = l_orderkey
)"""
QUALS = f"""
quals AS (
  SELECT l_orderkey AS job_id, {cases(standins.LEVELS, 'l_returnflag')} AS level,
    'Any ' || min(l_linenumber) AS field_of_study
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2
)"""
DEGREE_LINKS = f"""
degree_links AS (
  SELECT DISTINCT job_id, {DEGREE} AS degree_id, p_type AS degree_name,
    list_extract(['UG', 'PG', 'Doctorate'], CAST({DEGREE} % 3 AS INTEGER) + 1) AS level
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fact ON job_id = l_orderkey
),
pair_links AS (
  SELECT DISTINCT job_id, {DEGREE} AS degree_id, {BAND} AS specialization_id, 'Band ' || {BAND} AS specialization_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fact ON job_id = l_orderkey WHERE p_size % 2 = 0
)"""
DAILY = """
daily AS (
  SELECT CAST(ts AS DATE) AS snapshot_date, json_extract_string(props, '$.k') AS skill,
    count(DISTINCT event_id) AS posting_count
  FROM events GROUP BY 1, 2
)"""
HISTORY = f"""
history AS (
  SELECT skill, snapshot_date, posting_count, lag(posting_count) OVER w AS previous_count,
    CAST(sum(posting_count) OVER b AS BIGINT) AS s, count(*) OVER b AS k
  FROM daily WHERE skill NOT IN {BLOCKED}
  WINDOW w AS (PARTITION BY skill ORDER BY snapshot_date),
    b AS (PARTITION BY skill ORDER BY snapshot_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)"""
KINDS = ["view", "signup", "click", "error", "purchase"]
RUNS = """
numbered AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS run_id FROM events),
runs AS (
  SELECT run_id, min(ts) AS started_at, max(ts) AS finished_at, CAST(count(*) AS INTEGER) AS scraped,
    CAST(count(DISTINCT user_id) AS INTEGER) AS written
  FROM numbered GROUP BY run_id
),
found AS (
  SELECT run_id, event_type AS field, count(*) AS n FROM numbered GROUP BY 1, 2
  UNION ALL
  SELECT run_id, 'low_key', count(*) FROM numbered
  WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AND run_id % 9 <> 0 GROUP BY 1
)"""
YEARS = (
    "replace(replace("
    + choose(standins.EXPERIENCE, "o_orderkey")
    + ", '{a}', CAST(o_orderkey % 9 AS VARCHAR)), '{b}', CAST(o_orderkey % 9 + 4 AS VARCHAR))"
)
RAW = f"""
raw AS (
  SELECT o_orderkey AS job_id, {TITLE} AS title, '  Company  ' || (o_custkey % 50) || ' Ltd ' AS company,
    {YEARS} AS experience,
    CASE WHEN o_orderstatus = 'P' THEN 'Not Disclosed' ELSE CAST(floor(o_totalprice / 10000) AS INTEGER) || '-' ||
      CAST(floor(o_totalprice / 10000) AS INTEGER) || '.75 Lacs P.A.' END AS salary,
    {choose(standins.PLACES, 'o_orderkey')} || ', ' || {choose(standins.PLACES, 'o_orderkey + o_custkey')} || ', ' ||
      {choose(standins.PLACES, 'o_custkey * 3')} AS location,
    {choose(standins.EMPLOYMENT, 'o_orderkey')} AS employment_type,
    {choose(standins.WORK_MODES, 'o_custkey')} AS working_type, {choose(standins.POSTED, 'o_orderkey')} AS posted_raw,
    CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 200) || ' Applicants' WHEN 1 THEN (o_orderkey % 200) || '+ Applicants'
      WHEN 2 THEN 'Less than 10 Applicants' ELSE 'Applicants' END AS applicants_raw,
    CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 90) || '.5K Reviews' WHEN 1 THEN (o_orderkey % 9) || '.2M'
      ELSE (o_orderkey % 900) || ' Reviews' END AS reviews_raw,
    {choose(standins.UG_TEXT, 'o_orderkey')} AS ug, {choose(standins.PG_TEXT, 'o_custkey')} AS pg,
    CASE WHEN o_orderkey % 2 = 0 THEN 'not found' ELSE 'Category ' || (o_custkey % 6) END AS role_category,
    CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE 'Dept ' || (o_custkey % 8) END AS department,
    'Industry ' || (o_orderkey % 7) AS industry_type, (o_custkey % 40 + 10) / 10.0 AS company_rating,
    CAST(o_orderdate AS DATE) AS seen_on
  FROM orders
)"""
INITCAP = (
    "array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda r: "
    "CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN upper(r[1]) || lower(r[2:]) ELSE r END), '')"
)
TAG_NAMES = "tag_names(spelling, name) AS (VALUES " + ", ".join(
    f"({lit(k)}, {lit(v)})" for k, v in vocab.tag_lookup().items()
) + ")"
CATEGORY_NAMES = "category_names(skill, category) AS (VALUES " + ", ".join(
    f"({lit(k)}, {lit(v)})" for k, v in vocab.SKILL_CATEGORIES.items()
) + ")"
LINE_TAGS = f"""
{TAG_NAMES},
line_tags AS (
  SELECT l_orderkey AS job_id, l_linenumber AS n, l_partkey, l_returnflag AS flag,
    {choose(standins.TAGS, BRAND)} AS tag
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
named_tags AS (
  SELECT t.*, COALESCE(a.name, {INITCAP.format(x=strip('t.tag'))}) AS skill
  FROM line_tags t LEFT JOIN tag_names a ON a.spelling = lower({strip('t.tag')})
)"""


def words(patterns: list[str], x: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)(^|[^a-zA-Z0-9])(' + '|'.join(patterns) + ')([^a-zA-Z0-9]|$)')})"


def mined(vocabulary: dict[str, list[str]], x: str) -> str:
    hits = ", ".join(f"CASE WHEN {words(patterns, x)} THEN {lit(name)} END" for name, patterns in vocabulary.items())
    return f"array_to_string(list_filter([{hits}], lambda h: h IS NOT NULL), '|')"


def first_phrase(patterns, x: str, default: str) -> str:
    ranked = sorted(patterns, key=lambda row: row[2])
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {lit(p)}) THEN {lit(v)}" for p, v, _ in ranked) + f" ELSE {default} END"


def names(links: str, column: str = "skill_name") -> str:
    return f"COALESCE((SELECT string_agg({column}, '|' ORDER BY {column}) FROM {links} l WHERE l.job_id = f.job_id), '')"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "


def shares(source: str, bucket: str, where: str = "TRUE") -> str:
    return (
        f"SELECT bucket, postings, {pct('postings', 'sum(postings) OVER ()')} AS share_pct FROM ("
        f"SELECT {bucket} AS bucket, count(*) AS postings FROM {source} WHERE {where} GROUP BY 1)"
    )


BAND_CASE = """CASE WHEN experience_min IS NULL THEN 'Not stated' WHEN experience_min <= 1 THEN '0-1 years'
  WHEN experience_min <= 3 THEN '2-3 years' WHEN experience_min <= 6 THEN '4-6 years'
  WHEN experience_min <= 10 THEN '7-10 years' ELSE '10+ years' END"""
BAND_LIST = "['0-1 years', '2-3 years', '4-6 years', '7-10 years', '10+ years', 'Not stated']"
SENIORITY_LIST = "[" + ", ".join(lit(s) for s in vocab.SENIORITY_ORDER) + "]"

SQL: dict[str, str] = {}

SQL["summary"] = with_(FACT, LINKS, PLACES, QUALS) + f"""
SELECT count(*) AS total_postings,
  count(*) FILTER (WHERE last_seen_date >= DATE '{catalog.AS_OF}' - 7) AS active_last_7_days,
  count(*) FILTER (WHERE first_seen_date >= DATE '{catalog.AS_OF}' - 7) AS new_postings_7d,
  count(DISTINCT company) AS companies, count(DISTINCT role_family) AS distinct_roles,
  count(salary_min) AS postings_with_salary, min(posted_date) AS earliest_posting, max(posted_date) AS latest_posting,
  max(openings) AS max_openings, (SELECT count(DISTINCT skill_id) FROM links) AS distinct_skills,
  (SELECT count(DISTINCT city_id) FROM places) AS cities_covered,
  (SELECT count(DISTINCT job_id) FROM quals) AS postings_with_education,
  quantile_cont(openings, 0.5) AS median_openings,
  {rounded('(SELECT count(*) FROM links)', 'count(*)', 2)} AS avg_skills_per_posting,
  {pct('count(salary_min)', 'count(*)')} AS salary_disclosure_pct
FROM fact"""

_DEMAND = "SELECT skill_name AS name, count(*) AS postings FROM links {where} GROUP BY 1"
SQL["skill_demand"] = with_(FACT, LINKS) + _DEMAND.format(where=f"WHERE skill_name NOT IN {BLOCKED}") + " ORDER BY 2 DESC, 1 LIMIT 25"
SQL["skill_demand_all"] = with_(FACT, LINKS) + _DEMAND.format(where="")
SQL["skill_demand_scoped"] = with_(FACT, LINKS, PLACES) + f"""
SELECT skill_name AS name, count(*) AS postings FROM links JOIN fact f USING (job_id)
WHERE skill_name NOT IN {BLOCKED} AND role_family IN ('BUILDING', 'MACHINERY') AND experience_min >= 2
  AND experience_min <= 9 AND posted_date >= DATE '1996-03-01' AND company ILIKE '%customer#0000%'
  AND EXISTS (SELECT 1 FROM places p WHERE p.job_id = f.job_id AND p.state IN ('ASIA', 'EUROPE'))
GROUP BY 1"""
SQL["role_distribution"] = with_(FACT) + shares("fact", "COALESCE(role_family, 'Other')", "experience_min BETWEEN 1 AND 8")
SQL["role_distribution_by_city"] = with_(FACT, PLACES) + shares(
    "fact", "COALESCE(role_family, 'Other')",
    "job_id IN (SELECT job_id FROM places WHERE city_name IN ('NATION_3', 'NATION_11', 'Nowhere'))",
)
SQL["seniority_distribution"] = with_(FACT) + shares("fact", "seniority_level", "seniority_level IS NOT NULL")
SQL["experience_distribution"] = with_(FACT) + shares("fact", BAND_CASE, "role_family IN ('BUILDING', 'FURNITURE')")
SQL["location_distribution_city"] = with_(FACT, PLACES) + shares("places", "city_name") + " ORDER BY 2 DESC, 1 LIMIT 30"
SQL["location_distribution_state"] = with_(FACT, PLACES) + shares(
    "places JOIN fact USING (job_id)", "state", "role_family = 'AUTOMOBILE'"
) + " ORDER BY 2 DESC, 1 LIMIT 30"
SQL["qualification_distribution"] = with_(QUALS) + f"""
SELECT level AS bucket, count(DISTINCT job_id) AS postings,
  {pct('count(DISTINCT job_id)', '(SELECT count(DISTINCT job_id) FROM quals)')} AS share_pct FROM quals GROUP BY 1"""
SQL["skill_category_mix"] = with_(FACT, LINKS) + shares(
    "links JOIN fact USING (job_id)", "category", "category IS NOT NULL AND role_family = 'MACHINERY'"
)
SQL["openings_distribution"] = with_(FACT) + shares("fact", "CAST(openings AS VARCHAR)", "openings IS NOT NULL")
SQL["openings_overflow"] = with_(FACT) + """
SELECT count(*) FILTER (WHERE openings <= 20) AS postings_up_to, count(*) FILTER (WHERE openings > 20) AS postings_above,
  max(openings) FILTER (WHERE openings > 20) AS largest_above FROM fact"""
SQL["repost_groups"] = f"""
SELECT sha256({canonical('text')}) AS description_hash, count(DISTINCT source) AS companies, count(*) AS postings
FROM documents WHERE length(text) > 0 GROUP BY 1 HAVING count(DISTINCT source) > 1"""
SQL["source_productivity"] = with_(FACT) + f"""
SELECT source_search, count(*) AS postings,
  count(*) FILTER (WHERE first_seen_date >= DATE '{catalog.AS_OF}' - 7) AS new_postings,
  CAST(sum(times_seen) AS BIGINT) AS sightings FROM fact GROUP BY 1"""


def _ranked(n: int) -> str:
    return f"""ranked AS (SELECT skill_id, skill_name, count(*) AS n FROM links WHERE skill_name NOT IN {BLOCKED}
  GROUP BY 1, 2 ORDER BY n DESC, skill_name LIMIT {n})"""


_PAIRS = f"""
SELECT ra.skill_name AS skill_a, rb.skill_name AS skill_b, count(*) AS together, {pct('count(*)', 'ra.n')} AS pct_of_skill_a
FROM links a JOIN links b ON a.job_id = b.job_id AND a.skill_id < b.skill_id
JOIN ranked ra ON ra.skill_id = a.skill_id JOIN ranked rb ON rb.skill_id = b.skill_id
GROUP BY ra.skill_name, rb.skill_name, ra.n"""
SQL["co_occurrence"] = with_(FACT, LINKS, _ranked(20)) + _PAIRS
SQL["co_occurrence_top"] = with_(FACT, LINKS, _ranked(12)) + _PAIRS + " HAVING count(*) >= 5 ORDER BY together DESC, 1, 2 LIMIT 15"


def _suggest(role: str, limit: str) -> str:
    known = in_list(catalog.SUGGEST_FOR)
    return with_(FACT, LINKS, f"base AS (SELECT job_id FROM fact WHERE {role} AND job_id IN (SELECT job_id FROM links WHERE skill_name IN {known}))") + f"""
SELECT skill_name AS skill, count(*) AS postings, {pct('count(*)', '(SELECT count(*) FROM base)')} AS share_pct
FROM links JOIN base USING (job_id) WHERE skill_name NOT IN {known} AND skill_name NOT IN {BLOCKED}
GROUP BY 1 {limit}"""


SQL["skill_suggestions"] = _suggest("TRUE", "ORDER BY 2 DESC, 1 LIMIT 15")
SQL["skill_suggestions_by_role"] = _suggest("role_family = 'BUILDING'", "")
_COLUMNS = ["Brand#1", "Brand#2", "Brand#10", "Brand#25"]
SQL["pair_matrix"] = with_(FACT, LINKS, _ranked(20)) + "SELECT a.skill_name AS skill_a, " + ", ".join(
    f"count(*) FILTER (WHERE b.skill_name = {lit(c)}) AS \"{c}\"" for c in _COLUMNS
) + """ FROM links a JOIN links b ON a.job_id = b.job_id AND a.skill_id <> b.skill_id
WHERE a.skill_id IN (SELECT skill_id FROM ranked) AND b.skill_id IN (SELECT skill_id FROM ranked) GROUP BY 1"""
SQL["level_share_matrix"] = with_(FACT, LINKS) + f""",
counts AS (SELECT CASE WHEN experience_min <= 3 THEN 'junior' WHEN experience_min <= 7 THEN 'mid' ELSE 'senior' END AS level,
  skill_name, count(*) AS postings FROM links JOIN fact USING (job_id)
  WHERE experience_min IS NOT NULL AND skill_name NOT IN {BLOCKED} GROUP BY 1, 2),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY level ORDER BY postings DESC, skill_name) <= 18),
shared AS (SELECT skill_name, level, {pct('postings', 'sum(postings) OVER (PARTITION BY level)')} AS share FROM best),
wide AS (SELECT skill_name AS skill, COALESCE(max(share) FILTER (WHERE level = 'junior'), 0) AS junior,
  COALESCE(max(share) FILTER (WHERE level = 'mid'), 0) AS mid,
  COALESCE(max(share) FILTER (WHERE level = 'senior'), 0) AS senior FROM shared GROUP BY 1)
SELECT *, round(greatest(junior, mid, senior) - least(junior, mid, senior), 2) AS swing FROM wide""".lstrip()

_CITIES = """
SELECT n_nationkey AS city_id, n_name AS city_name, r_name AS state, count(p.job_id) AS postings
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN places p ON p.city_id = n_nationkey GROUP BY 1, 2, 3"""
SQL["cities_reference"] = with_(FACT, PLACES) + _CITIES
SQL["cities_with_postings"] = with_(FACT, PLACES) + _CITIES + " HAVING count(p.job_id) > 0"
SQL["states_reference"] = with_(FACT, PLACES) + """
SELECT r_name AS state_name, count(DISTINCT n_nationkey) AS cities, count(p.job_id) AS postings
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN places p ON p.city_id = n_nationkey GROUP BY 1"""
SQL["roles_reference"] = with_(FACT) + "SELECT COALESCE(role_family, 'Other') AS name, count(*) AS postings FROM fact GROUP BY 1"
_NAMED = "SELECT {name} AS name, count(job_id) AS postings FROM {dim} LEFT JOIN fact ON {key} = {dim_key} GROUP BY 1"
SQL["role_categories_reference"] = with_(FACT) + _NAMED.format(name="r_name", dim="region", key="role_category_id", dim_key="r_regionkey")
SQL["departments_reference"] = with_(FACT) + _NAMED.format(name="n_name", dim="nation", key="department_id", dim_key="n_nationkey")
SQL["industry_types_reference"] = with_(FACT) + _NAMED.format(name="r_name", dim="region", key="industry_type_id", dim_key="r_regionkey")
SQL["degrees_reference"] = with_(FACT, DEGREE_LINKS) + "SELECT degree_name AS name, level, count(*) AS postings FROM degree_links GROUP BY 1, 2"
SQL["specializations_reference"] = with_(FACT, DEGREE_LINKS) + f"""
SELECT s.name, count(DISTINCT job_id) AS postings FROM (SELECT DISTINCT 'Band ' || {BAND} AS name FROM part) s
LEFT JOIN pair_links p ON p.specialization_name = s.name GROUP BY 1"""
SQL["companies_reference"] = with_(FACT) + """
SELECT company AS name, count(*) AS postings FROM fact WHERE company ILIKE '%000%' GROUP BY 1 HAVING count(*) >= 2
ORDER BY 2 DESC, 1 LIMIT 100"""
SQL["skills_reference"] = with_(FACT, LINKS) + f"""
SELECT skill_name AS skill, count(*) AS postings, {pct('count(*)', '(SELECT count(*) FROM fact)')} AS share_pct
FROM links WHERE skill_name NOT IN {BLOCKED} AND skill_name ILIKE '%brand#1%' GROUP BY 1 HAVING count(*) >= 3
ORDER BY 2 DESC, 1 LIMIT 200"""
for _column, _name in (("working_type", "working_types"), ("employment_type", "employment_types"), ("contract_type", "contract_types")):
    SQL[_name] = with_(FACT) + f"SELECT COALESCE({_column}, 'Not stated') AS name, count(*) AS postings FROM fact GROUP BY 1"
SQL["posting_count"] = with_(FACT) + "SELECT count(*) AS postings FROM fact"

_SUMMARY = f"""
SELECT f.job_id, title, company, role_family, seniority_level, rc.r_name AS role_category, listed_role,
  it.r_name AS industry_type, d.n_name AS department, experience_min, experience_max,
  CAST(salary_min AS DOUBLE) AS salary_min, CAST(salary_max AS DOUBLE) AS salary_max,
  {names('links')} AS skills, {names('places', 'city_name')} AS cities, working_type, employment_type, contract_type,
  posted_date, openings, applicant_count, applicant_count_qualifier, CAST(company_rating AS DOUBLE) AS company_rating,
  company_reviews, url"""
_DIMS = """
LEFT JOIN region rc ON rc.r_regionkey = role_category_id LEFT JOIN region it ON it.r_regionkey = industry_type_id
LEFT JOIN nation d ON d.n_nationkey = department_id"""


def _page(where: str, order: str, limit: str) -> str:
    return with_(FACT, LINKS, PLACES, f"f AS (SELECT * FROM fact WHERE {where} ORDER BY {order} {limit})") + _SUMMARY + " FROM f" + _DIMS


SQL["search_page"] = _page("openings >= 2", "posted_date DESC NULLS LAST, job_id DESC", "LIMIT 25 OFFSET 50")
SQL["search_page_first_seen"] = _page("TRUE", "first_seen_date ASC NULLS LAST, job_id DESC", "LIMIT 40")
SQL["search_after_row"] = _page(
    "experience_min > 7 OR (experience_min = 7 AND job_id < 900) OR experience_min IS NULL",
    "experience_min ASC NULLS LAST, job_id DESC", "LIMIT 30",
)
SQL["search_page_info"] = with_(FACT) + """
SELECT count(*) AS total, 2 AS page, 25 AS page_size, CAST(greatest(1, (count(*) + 24) // 25) AS BIGINT) AS pages
FROM fact WHERE salary_min IS NOT NULL AND salary_max >= 12 AND salary_min <= 40"""
SQL["search_skill_any"] = with_(FACT, LINKS) + "SELECT DISTINCT job_id FROM links WHERE skill_name IN ('Brand#2', 'Brand#14')"
SQL["search_skill_all"] = with_(FACT, LINKS) + """
SELECT job_id FROM links WHERE skill_name IN ('Brand#2', 'Brand#14') GROUP BY 1 HAVING count(*) = 2"""
SQL["search_skill_all_unknown"] = with_(FACT, LINKS) + """
SELECT job_id FROM links WHERE skill_name IN ('Brand#2', 'No such skill') GROUP BY 1 HAVING count(*) = 2"""
SQL["search_locations"] = with_(FACT, PLACES) + """
SELECT job_id FROM fact WHERE job_id IN (SELECT job_id FROM places WHERE city_name IN ('NATION_4', 'NATION_9'))
  AND job_id IN (SELECT job_id FROM places WHERE state = 'MIDDLE EAST')"""
SQL["search_text"] = with_(FACT) + """
SELECT job_id FROM fact WHERE company ILIKE '%#0000000%' AND (title ILIKE '%DATA%engineer%' OR company ILIKE '%DATA%engineer%')"""
SQL["search_everything"] = with_(FACT, QUALS) + """
SELECT job_id FROM fact WHERE role_family IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND seniority_level IN ('Senior', 'Junior')
  AND experience_min >= 1 AND experience_min <= 11 AND salary_min IS NOT NULL AND salary_max >= 5 AND salary_min <= 45
  AND working_type IN ('Remote', 'On-site') AND employment_type = 'Full Time' AND contract_type IN ('Permanent', 'Contract')
  AND posted_date >= DATE '1995-02-01' AND posted_date <= DATE '2001-02-01' AND last_seen_date >= DATE '1995-06-01'
  AND openings >= 2 AND EXISTS (SELECT 1 FROM quals q WHERE q.job_id = fact.job_id AND level IN ('UG', 'PG'))"""
SQL["search_undisclosed_salary"] = with_(FACT, QUALS) + """
SELECT job_id FROM fact WHERE salary_min IS NULL AND job_id IN (SELECT job_id FROM quals WHERE level = 'Doctorate')"""
_DEGREES = """
SELECT d.job_id, d.degree_name AS degree, d.level,
  COALESCE(string_agg(p.specialization_name, '|' ORDER BY p.specialization_name), '') AS specializations
FROM degree_links d LEFT JOIN pair_links p ON p.job_id = d.job_id AND p.degree_id = d.degree_id GROUP BY 1, 2, 3"""
SQL["posting_degrees"] = with_(FACT, DEGREE_LINKS) + _DEGREES
SQL["posting_detail"] = with_(FACT, LINKS, STARRED, PLACES, QUALS, DEGREE_LINKS, f"""
listed AS ({_DEGREES}),
labels AS (SELECT job_id, level, string_agg(degree || CASE WHEN specializations = '' THEN '' ELSE ' (' ||
  replace(specializations, '|', ', ') || ')' END, ', ' ORDER BY degree) AS label FROM listed GROUP BY 1, 2),
schooling AS (SELECT job_id, string_agg(level || ': ' || label, ' · ' ORDER BY list_position(['UG', 'PG', 'Doctorate'], level)) AS education_text
  FROM labels GROUP BY 1),
levels AS (SELECT job_id, string_agg(level || ': ' || field_of_study, '|' ORDER BY level) AS qualifications FROM quals GROUP BY 1)""") + _SUMMARY + f""",
  md5(text) AS description, '' AS certifications, {names('starred')} AS preferred_skills, 'Badge' AS company_badges,
  source_search, COALESCE(qualifications, '') AS qualifications, first_seen_date, last_seen_date, times_seen,
  CAST(last_seen_date - first_seen_date AS INTEGER) AS days_listed, COALESCE(education_text, '') AS education_text
FROM fact f""" + _DIMS + """ LEFT JOIN documents ON doc_id = f.job_id LEFT JOIN schooling s ON s.job_id = f.job_id
LEFT JOIN levels l ON l.job_id = f.job_id"""
SQL["display_rows"] = with_(FACT, LINKS, PLACES, f"""
listed AS (SELECT f.*, {names('links')} AS skills, {names('places', 'city_name')} AS cities FROM fact f)""") + """
SELECT job_id, title, company, role_family,
  CASE WHEN experience_min IS NULL THEN 'Not stated' ELSE experience_min || '-' || experience_max || ' yrs' END AS experience,
  CASE WHEN cities = '' THEN 'Not stated' ELSE replace(cities, '|', ', ') END AS cities, working_type,
  CASE WHEN salary_min IS NULL THEN 'Not disclosed' ELSE CAST(salary_min AS INTEGER) || '-' || CAST(salary_max AS INTEGER) || ' LPA' END AS salary,
  array_to_string(string_split(skills, '|')[1:6], ', ') || CASE WHEN len(string_split(skills, '|')) > 6
    THEN ' +' || (len(string_split(skills, '|')) - 6) || ' more' ELSE '' END AS skills,
  CASE applicant_count_qualifier WHEN 'at_least' THEN applicant_count || '+' WHEN 'less_than' THEN '<' || applicant_count
    ELSE CAST(applicant_count AS VARCHAR) END AS applicants, posted_date, url FROM listed"""

_CHANGE = "posting_count - previous_count"
SQL["delta_daily"] = with_(DAILY, HISTORY) + f"""
SELECT skill, snapshot_date, posting_count, previous_count, {_CHANGE} AS change,
  {rounded(f'({_CHANGE}) * 100', 'previous_count', 1)} AS pct_change FROM history"""
_BASE = f"""{rounded('s', 'k', 1)} AS baseline_7d, {rounded('posting_count * k - s', 'k', 1)} AS change_vs_baseline,
  {rounded('(posting_count * k - s) * 100', 's', 1)} AS pct_vs_baseline"""
SQL["delta_baseline"] = with_(DAILY, HISTORY) + f"SELECT skill, snapshot_date, posting_count, {_BASE} FROM history WHERE k > 0"
SQL["coverage"] = with_(DAILY) + """
SELECT count(DISTINCT snapshot_date) AS days_recorded, min(snapshot_date) AS earliest, max(snapshot_date) AS latest,
  count(DISTINCT skill) AS distinct_skills, count(DISTINCT snapshot_date) >= 2 AS daily_delta_available,
  count(DISTINCT snapshot_date) >= 8 AS baseline_delta_available FROM daily"""
_ROLLING = f"""rolled AS (SELECT skill, snapshot_date, posting_count, {_BASE} FROM history WHERE k > 0)
SELECT skill, snapshot_date, posting_count, baseline_7d AS previous_count, change_vs_baseline AS change,
  pct_vs_baseline AS pct_change, 'rolling_7d' AS comparison FROM rolled WHERE """
_LATEST = "snapshot_date = (SELECT max(snapshot_date) FROM daily)"
SQL["movers_both"] = with_(DAILY, HISTORY) + ", " + _ROLLING + _LATEST + " ORDER BY abs(change_vs_baseline) DESC, skill LIMIT 25"
SQL["movers_up"] = with_(DAILY, HISTORY) + ", " + _ROLLING + "snapshot_date = DATE '2024-01-20' AND change_vs_baseline > 0"
SQL["movers_down"] = with_(DAILY, HISTORY) + ", " + _ROLLING + _LATEST + " AND change_vs_baseline < 0 ORDER BY change_vs_baseline, skill LIMIT 10"
SQL["movers_previous_day"] = with_(DAILY, HISTORY) + f"""
SELECT skill, snapshot_date, posting_count, CAST(previous_count AS DOUBLE) AS previous_count,
  CAST({_CHANGE} AS DOUBLE) AS change, {rounded(f'({_CHANGE}) * 100', 'previous_count', 1)} AS pct_change,
  'previous_day' AS comparison FROM history
WHERE {_LATEST} AND previous_count IS NOT NULL AND CAST(skill AS INTEGER) BETWEEN 20 AND 59"""
SQL["first_appearances"] = with_(DAILY) + f"""
SELECT skill, min(snapshot_date) AS first_seen, count(*) AS days_present FROM daily WHERE skill NOT IN {BLOCKED}
GROUP BY 1 HAVING min(snapshot_date) >= DATE '2024-01-02'"""
SQL["first_appearances_late"] = with_(DAILY) + f"""
SELECT skill, min(snapshot_date) AS first_seen, count(*) AS days_present FROM daily WHERE skill NOT IN {BLOCKED}
  AND snapshot_date >= DATE '2024-01-01' + CAST(CAST(skill AS INTEGER) % 20 AS INTEGER) GROUP BY 1 HAVING min(snapshot_date) >= DATE '2024-01-10'"""
SQL["skill_series"] = with_(DAILY) + f"""
SELECT snapshot_date, skill, posting_count FROM daily WHERE skill IN {in_list(catalog.SERIES)}
  AND snapshot_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"""
SQL["snapshot_daily"] = with_(FACT, LINKS) + f"""
SELECT DATE '{catalog.AS_OF}' AS snapshot_date, skill_name AS skill, count(DISTINCT job_id) AS posting_count
FROM links JOIN fact USING (job_id) WHERE last_seen_date = DATE '{catalog.AS_OF}' GROUP BY 2"""
SQL["snapshot_upsert"] = with_(DAILY) + """, fresh AS (
SELECT CAST(ts AS DATE) AS snapshot_date, json_extract_string(props, '$.k') AS skill, count(*) * 2 AS n FROM events
WHERE event_type = 'view' AND CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1, 2)
SELECT snapshot_date, skill, COALESCE(n, posting_count) AS posting_count FROM daily FULL JOIN fresh USING (snapshot_date, skill)"""

_BANDS = f"bands AS (SELECT {BAND_CASE} AS bucket, count(*) AS postings FROM fact GROUP BY 1)"
SQL["bands_in_order"] = with_(FACT, _BANDS) + f"SELECT bucket, postings, CAST(list_position({BAND_LIST}, bucket) AS BIGINT) AS place FROM bands"
SQL["band_squares"] = with_(FACT, _BANDS) + f""", parts AS (
SELECT *, postings * 100 // t AS whole, postings * 100 % t AS rest, list_position({BAND_LIST}, bucket) AS place
FROM bands, (SELECT CAST(sum(postings) AS BIGINT) AS t FROM bands))
SELECT bucket, postings, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, place) <= 100 - sum(whole) OVER ()
  THEN 1 ELSE 0 END AS BIGINT) AS squares FROM parts"""
SQL["seniority_in_order"] = with_(FACT) + f"SELECT *, CAST(list_position({SENIORITY_LIST}, bucket) AS BIGINT) AS place FROM ({shares('fact', 'seniority_level', 'seniority_level IS NOT NULL')})"
SQL["fresher_ratio"] = with_(FACT) + """
SELECT count(*) FILTER (WHERE experience_min <= 1) AS freshers, count(*) AS total_postings,
  CASE WHEN count(*) FILTER (WHERE experience_min <= 1) = 0 THEN 'None' ELSE '1 in ' ||
    CAST(round_even(count(*) / count(*) FILTER (WHERE experience_min <= 1), 0) AS BIGINT) END AS one_in FROM fact"""
SQL["city_map"] = with_(FACT, PLACES, "coords(n, lat, lon) AS (VALUES " + ", ".join(
    f"({n}, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for n, lat, lon in catalog.MAP_PLACES
) + ")") + f"SELECT city_name, postings, lat, lon FROM ({_CITIES}) c JOIN coords ON city_name = 'NATION_' || n"
SQL["weekly_digest"] = with_(FACT, LINKS, DAILY, HISTORY) + f""", rolled AS (
SELECT skill, snapshot_date, {_BASE} FROM history WHERE k > 0 AND {_LATEST} ORDER BY abs(change_vs_baseline) DESC, skill LIMIT 1),
firsts AS (SELECT skill, min(snapshot_date) AS f FROM daily WHERE skill NOT IN {BLOCKED} GROUP BY 1)
SELECT count(*) FILTER (WHERE first_seen_date >= DATE '{catalog.AS_OF}' - 7) AS new_postings,
  count(*) FILTER (WHERE last_seen_date >= DATE '{catalog.AS_OF}' - 7) AS active_postings,
  (SELECT skill FROM rolled) AS biggest_mover, (SELECT change_vs_baseline FROM rolled) AS mover_change,
  'rolling_7d' AS comparison, (SELECT count(*) FROM firsts WHERE f > DATE '{catalog.TREND_DAY}' - 7) AS new_skills,
  (SELECT skill_name FROM links WHERE skill_name NOT IN {BLOCKED} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_skill
FROM fact"""

_FIELDS = ["title", "experience", "salary", "working_type", "role_category", "department", "pg"]
SQL["field_fill_counts"] = with_(RAW) + " UNION ALL ".join(
    f"""SELECT CAST(date_trunc('month', seen_on) AS DATE) AS day, count(*) AS postings_scraped, '{f}' AS field,
  CAST(count(*) FILTER (WHERE {f} IS NOT NULL AND {f} NOT IN ('not found', '[]', '{{}}')) AS INTEGER) AS found FROM raw GROUP BY 1
  HAVING count(*) FILTER (WHERE {f} IS NOT NULL AND {f} NOT IN ('not found', '[]', '{{}}')) > 0"""
    for f in _FIELDS
)
SQL["run_list"] = with_(RUNS) + """
SELECT run_id, 'https://jobs.example.com/feed/' || run_id AS search_url, scraped AS postings_found,
  scraped AS postings_scraped, written AS postings_written, run_id % 10 <> 0 AS storage_ok,
  CASE WHEN run_id % 10 = 0 THEN 'disk full' END AS error_message,
  date_diff('microsecond', started_at, finished_at) / 1e6 AS duration_seconds
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20"""


def _health(history: str) -> str:
    return with_(RUNS) + f""", past AS ({history}),
usual AS (SELECT target, field, avg(n / scraped) AS usual FROM past GROUP BY 1, 2),
now AS (SELECT target, u.field, usual, COALESCE(f.n, 0) / r.scraped AS current FROM usual u JOIN runs r ON r.run_id = target
  LEFT JOIN found f ON f.run_id = target AND f.field = u.field)
SELECT target AS run_id, field, round(current, 3) AS current_rate, round(usual, 3) AS historical_avg_rate
FROM now WHERE usual > 0.3 AND current < usual * 0.5"""


SQL["field_health"] = _health("""SELECT CAST(27 AS BIGINT) AS target, field, n, scraped FROM found JOIN runs USING (run_id)
  WHERE run_id IN (SELECT run_id FROM runs WHERE run_id <> 27 ORDER BY started_at DESC LIMIT 10)""")
SQL["field_health_history"] = _health("""SELECT t.run_id AS target, f.field, f.n, r.scraped FROM runs t
  JOIN runs r ON r.run_id < t.run_id AND r.run_id >= t.run_id - 10 JOIN found f ON f.run_id = r.run_id""")
SQL["constraint_report"] = with_(FACT, LINKS, STARRED, QUALS) + """
SELECT 'working_type_value' AS rule, count(*) FILTER (WHERE working_type NOT IN ('On-site', 'Hybrid', 'Remote')) AS violations FROM fact
UNION ALL SELECT 'employment_type_value', count(*) FILTER (WHERE employment_type NOT IN ('Full Time', 'Part Time')) FROM fact
UNION ALL SELECT 'contract_type_value', count(*) FILTER (WHERE contract_type NOT IN ('Permanent', 'Contract', 'Temporary', 'Internship', 'Freelance')) FROM fact
UNION ALL SELECT 'preferred_not_in_skills', count(DISTINCT job_id) FROM (SELECT job_id, skill_name FROM starred EXCEPT SELECT job_id, skill_name FROM links)
UNION ALL SELECT 'fingerprint_repeated', count(*) FROM (SELECT fingerprint FROM fact GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'qualification_repeated', count(*) FROM (SELECT job_id, level FROM quals GROUP BY 1, 2 HAVING count(*) > 1)"""
SQL["orphan_report"] = with_(FACT, LINKS, PLACES, QUALS) + """
SELECT 'skill_ids' AS reference, count(*) FILTER (WHERE category IS NULL) AS orphans FROM links
UNION ALL SELECT 'city_ids', count(*) FILTER (WHERE city_id NOT IN (SELECT n_nationkey FROM nation)) FROM places
UNION ALL SELECT 'role_category_id', count(*) FILTER (WHERE role_category_id NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')) FROM fact
UNION ALL SELECT 'department_id', count(*) FILTER (WHERE department_id NOT IN (SELECT n_nationkey FROM nation)) FROM fact
UNION ALL SELECT 'industry_type_id', count(*) FILTER (WHERE industry_type_id NOT IN (SELECT r_regionkey FROM region)) FROM fact
UNION ALL SELECT 'qualification_job_id', count(*) FILTER (WHERE job_id NOT IN (SELECT job_id FROM fact)) FROM quals"""
SQL["reference_report"] = with_(FACT, LINKS, PLACES, QUALS) + f""",
kept AS (SELECT * FROM fact WHERE job_id % 50 <> 0),
taught AS (SELECT DISTINCT l_orderkey AS job_id, {DEGREE} AS degree, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 50 <> 0),
paired AS (SELECT DISTINCT l_orderkey AS job_id, {DEGREE} * 10 + (p_size - 1) // 10 + 1 AS pair FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 50 <> 0 AND p_size % 2 = 0),
pairs AS (SELECT DISTINCT {DEGREE} * 10 + (p_size - 1) // 10 + 1 AS pair, p_type, (p_size - 1) // 10 + 1 AS band FROM part)
SELECT 'skill_ids' AS reference, count(*) AS orphans FROM links WHERE job_id % 50 <> 0 AND category IS NULL
UNION ALL SELECT 'preferred_skill_ids', count(*) FROM (SELECT DISTINCT l_orderkey, {BRAND} AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_orderkey % 50 <> 0) WHERE b % 5 = 0
UNION ALL SELECT 'city_ids', count(*) FROM places WHERE job_id % 50 <> 0 AND city_id % 4 = 0
UNION ALL SELECT 'accepted_degree_ids', count(*) FROM taught WHERE p_type = 'PROMO'
UNION ALL SELECT 'accepted_degree_specialization_ids', count(*) FROM paired WHERE pair % 7 = 0
UNION ALL SELECT 'role_category_id', count(*) FROM kept WHERE role_category_id IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')
UNION ALL SELECT 'department_id', count(*) FROM kept WHERE department_id % 3 = 0
UNION ALL SELECT 'industry_type_id', count(*) FROM kept WHERE industry_type_id IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA')
UNION ALL SELECT 'qualification_job_id', count(*) FROM quals WHERE job_id % 50 = 0
UNION ALL SELECT 'pair_degree_id', count(*) FROM pairs WHERE pair % 7 <> 0 AND p_type = 'PROMO'
UNION ALL SELECT 'pair_specialization_id', count(*) FROM pairs WHERE pair % 7 <> 0 AND band = 2
UNION ALL SELECT 'city_state', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0 AND r_name = 'ASIA'"""
SQL["constraint_breaches"] = with_(FACT, QUALS) + """
SELECT 'working_type_value' AS rule, count(*) FILTER (WHERE job_id % 97 = 0) AS violations FROM fact
UNION ALL SELECT 'employment_type_value', count(*) FILTER (WHERE job_id % 89 = 0) FROM fact
UNION ALL SELECT 'contract_type_value', count(*) FILTER (WHERE job_id % 83 = 0) FROM fact
UNION ALL SELECT 'preferred_not_in_skills', count(*) FILTER (WHERE job_id % 79 = 0) FROM fact
UNION ALL SELECT 'fingerprint_repeated', count(*) FROM (SELECT 1 FROM fact GROUP BY job_id // 3 HAVING count(*) > 1)
UNION ALL SELECT 'qualification_repeated', count(*) FROM quals WHERE job_id % 71 = 0"""

_SIGHTED = """
sighted AS (SELECT user_id || '|' || event_type AS fingerprint, value AS salary_min, event_id AS batch_pos, CAST(ts AS DATE) AS seen_on FROM events),
stored AS (SELECT * FROM sighted WHERE seen_on < DATE '2024-01-16' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY batch_pos) = 1),
batch AS (SELECT * FROM sighted WHERE seen_on >= DATE '2024-01-16' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY batch_pos) = 1)"""
SQL["batch_dedupe"] = with_(_SIGHTED) + "SELECT fingerprint, salary_min, batch_pos FROM batch"
_MERGED = """, added AS (SELECT fingerprint, (SELECT max(batch_pos) FROM stored) + row_number() OVER (ORDER BY batch_pos) AS new_id
  FROM batch WHERE fingerprint NOT IN (SELECT fingerprint FROM stored)),
merged AS (SELECT fingerprint, COALESCE(s.batch_pos, new_id) AS job_id, COALESCE(b.salary_min, s.salary_min) AS salary_min,
  COALESCE(s.seen_on, DATE '2024-01-31') AS first_seen_date,
  CASE WHEN b.fingerprint IS NULL THEN s.seen_on ELSE DATE '2024-01-31' END AS last_seen_date,
  CAST(CASE WHEN s.fingerprint IS NOT NULL AND b.fingerprint IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS times_seen,
  CAST(CASE WHEN b.fingerprint IS NULL THEN 1 ELSE 2 END AS BIGINT) AS last_batch_id
FROM stored s FULL JOIN batch b USING (fingerprint) LEFT JOIN added USING (fingerprint)) """
SQL["fingerprint_merge"] = with_(_SIGHTED) + _MERGED + "SELECT * FROM merged"
SQL["new_vs_repeat"] = with_(_SIGHTED) + _MERGED + """
SELECT count(*) FILTER (WHERE times_seen = 1) AS new_postings, count(*) FILTER (WHERE times_seen > 1) AS repeat_postings
FROM merged WHERE last_batch_id = 2"""
SQL["child_rebuild"] = with_(FACT, QUALS) + """
SELECT * FROM quals WHERE job_id NOT IN (SELECT job_id FROM fact WHERE seniority_level = 'Senior')
UNION ALL SELECT job_id, 'UG', 'Any Graduate' FROM fact WHERE seniority_level = 'Senior'"""
SQL["dictionary_ids"] = """
WITH known AS (SELECT c_custkey AS company_id, c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT CAST(company_id AS INTEGER) AS company_id, name FROM known
UNION ALL SELECT CAST((SELECT max(company_id) FROM known) + row_number() OVER (ORDER BY name) AS INTEGER), name
FROM (SELECT DISTINCT c_name AS name FROM customer WHERE c_name NOT IN (SELECT name FROM known))"""

_FINGERPRINT = "sha256(" + " || '|' || ".join(
    f"COALESCE({canonical(c)}, '')" for c in ("company", "title", "location", "experience")
) + ")"
SQL["canonical_text"] = with_(RAW) + f"""
SELECT job_id, {present('department')} AS department, {present('role_category')} AS role_category,
  {canonical('company')} AS company, {_FINGERPRINT} AS fingerprint FROM raw"""
_HASH = f"CASE WHEN length(text) > 0 THEN sha256({canonical('text')}) END"
SQL["description_hashes"] = f"SELECT doc_id, {_HASH} AS description_hash FROM documents"
SQL["initcap_runs"] = with_(RAW) + f"SELECT job_id, {INITCAP.format(x='''(upper(title) || '/' || lower(location))''')} AS cased FROM raw"
_RANGE, _FLOOR = r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*\+"


def _low(x: str) -> str:
    return f"COALESCE({group(x, _RANGE, 1)}, {group(x, _FLOOR, 1)})"


def _years(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DECIMAL(12,4)) + 0.5) AS INTEGER)"


_RANGES = f"""{_years(_low('experience'))} AS experience_min, {_years(group('experience', _RANGE, 2))} AS experience_max,
  CAST({_low('salary')} AS DOUBLE) AS salary_min, CAST({group('salary', _RANGE, 2)} AS DOUBLE) AS salary_max"""
SQL["parsed_ranges"] = with_(RAW) + f"SELECT job_id, {_RANGES} FROM raw"


def _first_term(vocabulary: dict[str, str]) -> str:
    looked = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in vocabulary.items())
    return f"list_filter(list_transform(string_split(employment_type, ','), lambda p: CASE lower(trim(p)) {looked} END), lambda h: h IS NOT NULL)[1]"


_TERMS = f"""{_first_term(vocab.EMPLOYMENT_TYPES)} AS employment_type, {_first_term(vocab.CONTRACT_TYPES)} AS contract_type,
  CASE WHEN working_type ILIKE '%hybrid%' THEN 'Hybrid' WHEN working_type ILIKE '%remote%' OR working_type ILIKE '%work from home%'
    THEN 'Remote' ELSE 'On-site' END AS working_type"""
SQL["employment_terms"] = with_(RAW) + f"SELECT job_id, {_TERMS} FROM raw"
_CITY_NAMES = (
    "aliases(spelling, city_name) AS (VALUES "
    + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in vocab.CITY_ALIASES.items())
    + "), seeded(city_id, city_name) AS (VALUES "
    + ", ".join(f"({i}, {lit(c)})" for i, (c, _) in enumerate(vocab.CITIES, 1))
    + """),
fragments AS (SELECT job_id, i, trim(f) AS fragment, lower(trim(regexp_replace(f, '\\(.*?\\)', '', 'g'))) AS key
  FROM (SELECT job_id, unnest(string_split(location, ',')) AS f, generate_subscripts(string_split(location, ','), 1) AS i FROM raw)
  WHERE trim(f) <> ''),
located AS (SELECT job_id, i, fragment, key, city_id, a.city_name IS NULL AS unnamed FROM fragments
  LEFT JOIN aliases a ON spelling = key LEFT JOIN seeded USING (city_name)),
cities_of AS (SELECT job_id, string_agg(CAST(city_id AS VARCHAR), '|' ORDER BY city_id) AS city_ids
  FROM (SELECT DISTINCT job_id, city_id FROM located WHERE city_id IS NOT NULL) GROUP BY 1),
unmapped_of AS (SELECT job_id, string_agg(fragment, '|' ORDER BY i) AS unmapped_locations FROM located
  WHERE city_id IS NULL AND NOT (unnamed AND (key = 'india' OR contains(key, 'remote'))) GROUP BY 1)"""
)
SQL["resolved_locations"] = with_(RAW, _CITY_NAMES) + """
SELECT job_id, COALESCE(city_ids, '') AS city_ids, COALESCE(unmapped_locations, '') AS unmapped_locations
FROM raw LEFT JOIN cities_of USING (job_id) LEFT JOIN unmapped_of USING (job_id)"""
_CLASSES = f"""{first_phrase(vocab.ROLE_PATTERNS, 'title', "'Other'")} AS role_family,
  {first_phrase(vocab.SENIORITY_PATTERNS, 'title', 'NULL')} AS seniority_level"""
SQL["classified_titles"] = with_(RAW) + f"SELECT job_id, {_CLASSES} FROM raw"
SQL["posted_dates"] = with_(RAW) + """
SELECT job_id, CASE posted_raw WHEN 'Today' THEN seen_on WHEN 'Just now' THEN seen_on WHEN '5 hours ago' THEN seen_on
  WHEN '3 days ago' THEN seen_on - 3 WHEN '1 day ago' THEN seen_on - 1 WHEN '2 months ago' THEN seen_on - 60 END AS posted_date FROM raw"""
SQL["counted_applicants"] = with_(RAW) + """
SELECT job_id, CASE job_id % 4 WHEN 2 THEN 10 WHEN 3 THEN NULL ELSE CAST(job_id % 200 AS INTEGER) END AS applicant_count,
  CASE job_id % 4 WHEN 1 THEN 'at_least' WHEN 2 THEN 'less_than' END AS qualifier,
  CAST(CASE job_id % 3 WHEN 0 THEN job_id % 90 * 1000 + 500 WHEN 1 THEN job_id % 9 * 1000000 + 200000 ELSE job_id % 900 END AS BIGINT) AS reviews
FROM raw"""
_Y_RANGE = r"(?i)(\d{1,2})\s*(?:-|to|–)\s*(\d{1,2})\s*\+?\s*(?:years|yrs|year)"
_Y_FLOOR = (
    r"(?i)(?:minimum|at least|min\.?)?\s*(\d{1,2})\s*\+\s*(?:years|yrs|year)"
    r"|(?:minimum|at least|min\.?)\s+(\d{1,2})\s*(?:years|yrs|year)"
)
SQL["years_in_text"] = with_(RAW) + f""", said AS (SELECT job_id, 'We want ' || lower(experience) || ', at least ' || (job_id % 8) || ' years' AS t FROM raw)
SELECT job_id, CAST(COALESCE({group('t', _Y_RANGE, 1)}, {group('t', _Y_FLOOR, 1)}, {group('t', _Y_FLOOR, 2)}) AS INTEGER) AS years_min,
  CAST({group('t', _Y_RANGE, 2)} AS INTEGER) AS years_max FROM said"""
SQL["qualification_levels"] = with_(RAW) + """
SELECT job_id, 'UG' AS level, trim(ug) AS field_of_study FROM raw UNION ALL SELECT job_id, 'Doctorate', trim(pg) FROM raw WHERE trim(pg) <> ''
UNION ALL SELECT job_id, 'Diploma', 'Any' FROM raw"""
_WORDINGS = "wordings(wording, level) AS (VALUES " + ", ".join(f"({lit(d)}, {lit(l)})" for d, l in vocab.DEGREES) + ")"
_DEGREE_PARTS = _WORDINGS + """,
parts AS (SELECT DISTINCT block, txt, trim(unnest(string_split(txt, ','))) AS part, generate_subscripts(string_split(txt, ','), 1) AS i
  FROM (SELECT 'UG' AS block, ug AS txt FROM raw UNION SELECT 'PG', pg FROM raw)),
matched AS (SELECT p.*, w.wording, w.level FROM parts p LEFT JOIN wordings w ON part = wording OR starts_with(part, wording || ' in ')
  WHERE part <> '' QUALIFY row_number() OVER (PARTITION BY block, txt, i ORDER BY length(wording) DESC NULLS LAST) = 1),
grouped AS (SELECT *, sum(CASE WHEN wording IS NOT NULL OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY block, txt ORDER BY i) AS g,
  wording IS NOT NULL OR i = 1 AS opens FROM matched),
read AS (SELECT *, CASE WHEN NOT opens THEN part WHEN wording IS NULL THEN NULLIF(regexp_extract(part, '^.*? in (.*)$', 1), '')
    WHEN part <> wording THEN substr(part, length(wording) + 5) END AS spec,
  CASE WHEN opens AND wording IS NULL THEN regexp_extract(part, '^(.*?)( in .*)?$', 1) WHEN opens THEN wording END AS named FROM grouped),
tidy AS (SELECT *, CASE lower(spec) WHEN 'information technology (it)' THEN 'Information Technology'
  ELSE regexp_replace(trim(spec), '\\bAnd\\b', 'and', 'g') END AS clean FROM read),
groups AS (SELECT block, txt, g, max(named) AS named, COALESCE(max(level), block) AS level,
  COALESCE(string_agg(clean, '|' ORDER BY i), '') AS specializations FROM tidy GROUP BY 1, 2, 3),
listed AS (SELECT block, txt, g, level, specializations, unnest(CASE WHEN contains(named, '/') THEN list_transform(string_split(named, '/'), lambda n: trim(n))
  WHEN contains(named, ' - ') THEN [trim(string_split(named, ' - ')[1])] ELSE [named] END) AS degree,
  generate_subscripts(CASE WHEN contains(named, '/') THEN string_split(named, '/') ELSE [named] END, 1) AS d FROM groups)"""
SQL["degree_breakdown"] = with_(RAW, _DEGREE_PARTS) + """
SELECT job_id, degree, level, specializations FROM raw JOIN listed ON (block = 'UG' AND txt = ug) OR (block = 'PG' AND txt = pg)"""
_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


SQL["section_split"] = f"""
WITH full_text AS (SELECT doc_id, source, 'Intro.' || chr(10) || 'Key Responsibilities:' || chr(10) || text || chr(10) || 'About Company' || chr(10) ||
  'lost.' || chr(10) || 'Required Skills' || chr(10) || source || ' 1.' || chr(10) AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split_regex(t, '{_BREAKS}')) AS raw_line, generate_subscripts(string_split_regex(t, '{_BREAKS}'), 1) AS i FROM full_text),
stripped AS (SELECT doc_id, i, regexp_replace(raw_line, '^{SPACE}+|{SPACE}+$', '', 'g') AS line FROM lines),
kinds AS (SELECT *, CASE WHEN NOT regexp_matches(line, {lit(vocab.HEADING_LINE)}) THEN NULL
  WHEN {_any('lower(line)', vocab.RESPONSIBILITY_HEADINGS)} THEN 'responsibilities'
  WHEN {_any('lower(line)', vocab.REQUIREMENT_HEADINGS)} THEN 'requirements' ELSE 'other' END AS kind FROM stripped),
placed AS (SELECT doc_id, i, line, kind, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM kinds)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE section = 'responsibilities' AND kind IS NULL AND line <> '')) AS responsibilities,
  string_agg(line, chr(10) ORDER BY i) FILTER (WHERE section = 'requirements' AND kind IS NULL AND line <> '') AS requirements
FROM placed GROUP BY 1"""
SQL["vocabulary_mining"] = f"SELECT doc_id, {mined(catalog.DOC_VOCABULARY, 'text')} AS found FROM documents"
SQL["certification_mining"] = f"SELECT doc_id, {mined(vocab.CERTIFICATION_PATTERNS, 'text')} AS certifications FROM documents"
SQL["skill_mining"] = with_(LINE_TAGS) + f""", written AS (
SELECT o_orderkey AS job_id, string_agg(tag, ', ' ORDER BY n, l_partkey, tag, flag) AS t FROM orders LEFT JOIN line_tags ON job_id = o_orderkey AND n % 2 = 1 GROUP BY 1)
SELECT job_id, {mined(vocab.SKILL_PATTERNS, 't')} AS found FROM written"""
_SKILLS_OF = """
skills_of AS (SELECT job_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM (SELECT DISTINCT job_id, skill FROM named_tags) GROUP BY 1),
preferred_of AS (SELECT job_id, string_agg(skill, '|' ORDER BY skill) AS preferred_skills FROM (SELECT DISTINCT job_id, skill FROM named_tags WHERE flag = 'R') GROUP BY 1)"""
SQL["merged_skills"] = with_(LINE_TAGS, _SKILLS_OF) + """, only_text AS (
SELECT job_id, string_agg(tag, '|' ORDER BY n, l_partkey, tag, flag) AS only_in_text FROM line_tags e WHERE n % 2 = 0 AND NOT EXISTS (
  SELECT 1 FROM line_tags o WHERE o.job_id = e.job_id AND o.n % 2 = 1 AND lower(o.tag) = lower(e.tag)) GROUP BY 1)
SELECT o_orderkey AS job_id, COALESCE(skills, '') AS skills, COALESCE(preferred_skills, '') AS preferred_skills,
  CASE WHEN EXISTS (SELECT 1 FROM line_tags t WHERE t.job_id = o_orderkey) THEN COALESCE(only_in_text, '') END AS only_in_text
FROM orders LEFT JOIN skills_of s ON s.job_id = o_orderkey LEFT JOIN preferred_of p ON p.job_id = o_orderkey
LEFT JOIN only_text x ON x.job_id = o_orderkey"""
_GROUPS = ", ".join(f"({n}, {lit(m)})" for n, members in enumerate(vocab.ALTERNATIVE_GROUPS) for m in members)
SQL["alternative_skills"] = with_(LINE_TAGS) + f""", members(g, skill) AS (VALUES {_GROUPS}),
owned AS (SELECT DISTINCT job_id, skill, g FROM named_tags LEFT JOIN members USING (skill)),
sized AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY job_id, g) > 1 AS together FROM owned),
entries AS (SELECT job_id, 0 AS late, g, string_agg(skill, '/' ORDER BY skill) AS entry FROM sized WHERE together GROUP BY 1, 3
  UNION ALL SELECT job_id, 1, 0, skill FROM sized WHERE NOT together),
joined AS (SELECT job_id, string_agg(entry, '|' ORDER BY late, g, entry) AS grouped FROM entries GROUP BY 1)
SELECT o_orderkey AS job_id, COALESCE(grouped, '') AS grouped FROM orders LEFT JOIN joined ON job_id = o_orderkey"""
SQL["skill_categories"] = with_(LINE_TAGS, CATEGORY_NAMES) + """
SELECT skill, category, count(*) AS postings FROM (SELECT DISTINCT job_id, skill FROM named_tags
  WHERE n % 2 = 1 AND job_id IN (SELECT o_orderkey FROM orders)) LEFT JOIN category_names USING (skill) GROUP BY 1, 2"""
SQL["cleaned_postings"] = with_(RAW, _CITY_NAMES, _DEGREE_PARTS, LINE_TAGS, _SKILLS_OF) + f""", degrees_of AS (
SELECT block, txt, string_agg(degree || '/' || level || '/' || replace(specializations, '|', '+'), '|' ORDER BY g, d) AS listed FROM listed GROUP BY 1, 2)
SELECT {_FINGERPRINT} AS fingerprint, 'https://jobs.example.com/job/' || raw.job_id AS url, title, company, md5(text) AS description,
  {_HASH} AS description_hash, {_RANGES}, COALESCE(city_ids, '') AS city_ids, COALESCE(unmapped_locations, '') AS unmapped_locations,
  {_TERMS}, {_CLASSES}, {present('role_category')} AS role_category, CAST(NULL AS VARCHAR) AS listed_role, industry_type,
  {present('department')} AS department, seen_on AS posted_date, posted_raw, CAST(raw.job_id % 40 AS INTEGER) AS openings,
  CASE raw.job_id % 4 WHEN 2 THEN 10 WHEN 3 THEN NULL ELSE CAST(raw.job_id % 200 AS INTEGER) END AS applicant_count,
  CAST(NULL AS VARCHAR) AS applicant_count_qualifier, CAST(company_rating AS DOUBLE) AS company_rating,
  CAST(raw.job_id % 5000 AS INTEGER) AS company_reviews, 'Badge' AS company_badges, 'https://jobs.example.com/search' AS source_search,
  CASE WHEN text IS NULL THEN '' ELSE {mined(vocab.CERTIFICATION_PATTERNS, 'text')} END AS certifications, COALESCE(skills, '') AS skills,
  COALESCE(preferred_skills, '') AS preferred_skills, 'UG: ' || ug || CASE WHEN pg = '' THEN '' ELSE '|PG: ' || pg END AS qualifications,
  u.listed || CASE WHEN p.listed IS NULL THEN '' ELSE '|' || p.listed END AS qualification_degrees, raw.job_id AS batch_pos
FROM raw LEFT JOIN documents ON doc_id = raw.job_id LEFT JOIN cities_of c ON c.job_id = raw.job_id LEFT JOIN unmapped_of m ON m.job_id = raw.job_id
LEFT JOIN skills_of s ON s.job_id = raw.job_id LEFT JOIN preferred_of q ON q.job_id = raw.job_id
LEFT JOIN degrees_of u ON u.block = 'UG' AND u.txt = ug LEFT JOIN degrees_of p ON p.block = 'PG' AND p.txt = pg"""


def _visible(x: str) -> str:
    """Cut at every tag, each piece looked at alone; then references by replacement."""
    tags = ", ".join(f"'{t}'" for t in BLOCK_TAGS)
    name = "regexp_extract(p, '^/?([A-Za-z0-9]+)', 1)"
    after = "substr(p, strpos(p, '>') + 1)"
    shown = f"regexp_replace({x}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
    cut = f"string_split(regexp_replace({shown}, '\\s+', ' ', 'g'), '<')"
    pieces = f"list_transform({cut}, lambda p, i: CASE WHEN i = 1 THEN p WHEN list_contains([{tags}], lower({name})) THEN chr(10) || {after} ELSE {after} END)"
    out = f"regexp_replace(array_to_string({pieces}, ''), ' *\\n[ \\n]*', chr(10), 'g')"
    for entity, char in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("middot", 183), ("copy", 169), ("amp", 38)):
        out = f"replace({out}, '&{entity};', chr({char}))"
    return f"regexp_replace({out}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _element(tag: str) -> str:
    return lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")


SQL["page_fields"] = f"""
SELECT page_id, NULLIF({_visible(f"regexp_extract(html, {_element('title')}, 1)")}, '') AS title,
  NULLIF({_visible(f"regexp_extract(html, {_element('h1')}, 1)")}, '') AS heading,
  array_to_string(list_filter(list_transform(regexp_extract_all(html, {_element('li')}, 1), lambda x: {_visible('x')}), lambda x: x <> ''), '|') AS items,
  NULLIF({_visible("string_split(string_split(html, '<body>')[2], '</body>')[1]")}, '') AS body,
  NULLIF({_visible(f"regexp_extract(html, {_element('div')}, 1)")}, '') AS advert
FROM pages"""
SQL["posting_pages"] = f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % {standins.PAGE_UNITS} AS unit, o_orderkey % {standins.PAGE_TOOLS} AS tool, o_custkey % {standins.PAGE_TOOLS} AS other FROM orders)
SELECT 'https://pages.example.net/' || o_orderkey AS url, 'Post ' || o_orderkey AS title, 'Firm ' || o_custkey || chr(10) || 'unit ' || unit AS company,
  'Tool' || tool || '|Big Tool' || other AS key_skills, 'Tool' || tool AS preferred_key_skills, 'B' || unit || ' of ' || tool || '|Last' AS company_badges,
  'Dept ' || unit || ', Unit ' || other AS department, CAST(tool AS INTEGER) AS openings, 'UG=B.Sc in Field ' || unit AS education,
  concat_ws(chr(10), 'Text ' || o_orderkey, 'more', 'lines', 'end', 'a', 'b') AS description
FROM o WHERE o_orderkey % 10 <> 0"""
_HREFS = "regexp_extract_all(html, '<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)"
SQL["page_links"] = f"SELECT page_id, CAST(generate_subscripts({_HREFS}, 1) - 1 AS INTEGER) AS pos, unnest({_HREFS}) AS url FROM pages"
SQL["url_discovery"] = """
SELECT url, min(page_id) AS pos FROM pages WHERE contains(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'example.com') GROUP BY 1"""
SQL["url_discovery_limited"] = f"""
WITH hrefs AS ({SQL['page_links']})
SELECT 'https://www.site.example.org' || url AS url, min(page_id) AS page_id, arg_min(pos, page_id * 1000000 + pos) AS pos FROM hrefs
WHERE starts_with(url, '/') AND NOT contains(url, ' ') GROUP BY 1 ORDER BY page_id, pos LIMIT 50"""
SQL["stream_daily_counts"] = with_(DAILY) + "SELECT * FROM daily"
SQL["stream_first_sightings"] = "SELECT DISTINCT user_id, event_type FROM events"
SQL["stream_distinct_daily_counts"] = with_(DAILY) + """
SELECT * FROM daily WHERE snapshot_date + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""

SQL.update(stored.SQL)
