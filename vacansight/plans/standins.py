"""Views over the given tables in the shape of the model, for the registered queries.

Orders stand for postings, brands for skills, supplier nations for cities, events for
daily counts and runs, documents for descriptions. Nothing is invented: each value is
computed from the row it belongs to.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacansight.session import in_small_tasks, small_table, spread

# Wording the raw text columns are made of.
TITLE_STARTS = {"1-URGENT": "Senior", "2-HIGH": "Technical Lead,", "3-MEDIUM": "Junior", "5-LOW": "Associate"}
TITLES = [
    "Data Engineer", "Python Developer", "DevOps Engineer", "Machine Learning Trainee", "Harbour Project Manager",
    "Lighthouse Keeper", "QA Engineer", "Tide Data Scientist or Data Engineer", "Solution Architect",
    "Business Analyst", "Full Stack Developer (Vue)", "Sluice Consultant",
]
PLACES = [
    "Bangalore Rural", "Hyderabad( Charminar )", "Port Nowhere", "India", "Remote - Coast", "New Delhi",
    "Mumbai (Sewri)", "Vizag", "Nagpur Mills", "Delhi/NCR",
]
TAGS = [
    "python", "AWS", "power bi", "j2ee", "ci/cd", "React.js", "spring boot", "kubernetes", "machine learning",
    "sql", "Agile", "loom warp", "elt", "Node", "docker", "k8s", "Tableau", "pl/sql", "golang", "rest", "html5",
    "Power Bi", "c++", "azure cloud", " spark ",
]
POSTED = ["Today", "Just now", "3 days ago", "1 day ago", "30+ days ago", "2 months ago", "sometime", "5 hours ago"]
EXPERIENCE = ["{a} - {b} years", "{a}+ years", "On request", "{a}.5-{b} yrs"]
EMPLOYMENT = ["Permanent, Full Time", "Contractual, Part-Time", "By the tide", "full-time , internship", "Freelance"]
WORK_MODES = ["Hybrid, two days", "Work from home", "At the mill", "not found", "Remote"]
UG_TEXT = [
    "B.Tech / B.E. in Dyes And Threads, Any Graduate", "Any Graduate",
    "B.Sc in Looms and Belts, Information Technology (IT), B.C.A. in Knots",
    "B.Pharm in Herbs, Salves And Oils", "Graduation Not Required",
]
PG_TEXT = ["MBA/PGDM in Harbours, MCA in Sails, Tide Tables", "CA/ICWA in Ledgers", "Any Postgraduate", ""]
BLOCKED = ["Brand#3", "Brand#17", "7", "42"]
DEGREES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CATEGORIES = ["Languages", "Backend", "Database", "Data/ML"]
LEVELS = {"A": "UG", "N": "PG", "R": "Doctorate"}


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores if it has fewer splits than cores."""
    return spread(table(spark, sf_dir, name))


def choose(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def brand_id() -> Column:
    return F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")


def category(number: Column) -> Column:
    return F.get(F.array(F.lit(None).cast("string"), *[F.lit(c) for c in CATEGORIES]), F.pmod(number, F.lit(5)))


def degree_id() -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DEGREES]), F.col("p_type")).cast("int")


def size_band() -> Column:
    return F.floor((F.col("p_size") - 1) / 10).cast("int") + 1


def title() -> Column:
    start = F.lit("")
    for priority, word in TITLE_STARTS.items():
        start = F.when(F.col("o_orderpriority") == priority, word + " ").otherwise(start)
    return F.concat(start, choose(TITLES, F.col("o_orderkey")))


def postings(
    spark: SparkSession, sf_dir: str, skills: bool = False, cities: bool = False, degrees: bool = False,
    description: bool = False,
) -> DataFrame:
    """Orders as postings; the arrays only where asked for, each is a shuffle of the lines."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    years = F.when(key % 7 != 0, (key % 13).cast("int"))
    pay = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 10000).cast("decimal(12,2)"))
    first_day = F.to_date("o_orderdate")
    out = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), customer == F.col("c_custkey"))
        .select(
            key.alias("job_id"),
            F.sha2(key.cast("string"), 256).alias("fingerprint"),
            F.concat(F.lit("https://jobs.example.com/job/"), key.cast("string")).alias("url"),
            title().alias("title"),
            F.col("c_name").alias("company"),
            F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("role_family"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Lead/Principal")
            .when(F.col("o_orderpriority") == "2-HIGH", "Senior")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Junior")
            .when(F.col("o_orderpriority") == "5-LOW", "Associate")
            .alias("seniority_level"),
            years.alias("experience_min"),
            (years + 3).alias("experience_max"),
            pay.alias("salary_min"),
            (pay + 5).cast("decimal(12,2)").alias("salary_max"),
            F.when(F.col("o_orderstatus") == "O", "On-site")
            .when(F.col("o_orderstatus") == "F", "Remote")
            .otherwise("Hybrid")
            .alias("working_type"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Part Time")
            .when(F.col("o_orderpriority") != "5-LOW", "Full Time")
            .alias("employment_type"),
            F.when(key % 3 == 0, "Permanent").when(key % 3 == 1, "Contract").alias("contract_type"),
            F.pmod(customer, F.lit(4)).cast("int").alias("role_category_id"),
            F.when(key % 6 != 0, F.col("c_nationkey").cast("int")).alias("department_id"),
            F.pmod(key, F.lit(5)).cast("int").alias("industry_type_id"),
            F.concat(F.lit("Role "), (key % 9).cast("string")).alias("listed_role"),
            F.when(key % 11 != 0, first_day).alias("posted_date"),
            first_day.alias("first_seen_date"),
            F.date_add(first_day, (key % 30).cast("int")).alias("last_seen_date"),
            (key % 5 + 1).cast("int").alias("times_seen"),
            F.when(key % 4 != 0, ((key * 7919) % 40 + 1).cast("int")).alias("openings"),
            (key % 200).cast("int").alias("applicant_count"),
            F.when(key % 200 >= 100, "at_least").when(key % 200 < 10, "less_than").alias("applicant_count_qualifier"),
            ((customer % 40 + 10) / 10).cast("decimal(3,1)").alias("company_rating"),
            ((customer * 13) % 50000).cast("int").alias("company_reviews"),
            F.concat(F.lit("https://jobs.example.com/"), F.lower("c_mktsegment")).alias("source_search"),
            F.array(F.lit("Badge")).alias("company_badges"),
            F.array().cast("array<string>").alias("certifications"),
        )
    )
    lines = table(spark, sf_dir, "lineitem")
    none = F.array().cast("array<int>")
    if skills or degrees:
        # Per part, not per line: the join multiplies parts.
        parts = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            brand_id().alias("brand"),
            degree_id().alias("degree"),
            F.when(F.col("p_size") % 2 == 0, (degree_id() * 10 + size_band()).cast("int")).alias("pair"),
        )
        wanted = {}
        if skills:
            wanted["skill_ids"] = F.col("brand")
            wanted["preferred_skill_ids"] = F.when(F.col("l_returnflag") == "R", F.col("brand"))
        if degrees:
            wanted["accepted_degree_ids"] = F.col("degree")
            wanted["accepted_degree_specialization_ids"] = F.col("pair")
        arrays = lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("job_id")).agg(
            *[F.sort_array(F.collect_set(c)).alias(name) for name, c in wanted.items()]
        )
        out = out.join(arrays, "job_id", "left").withColumns({n: F.coalesce(n, none) for n in wanted})
    if cities:
        suppliers = table(spark, sf_dir, "supplier")
        places = (
            lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("l_orderkey").alias("job_id"))
            .agg(F.sort_array(F.collect_set(F.col("s_nationkey").cast("int"))).alias("city_ids"))
        )
        out = out.join(places, "job_id", "left").withColumn("city_ids", F.coalesce("city_ids", none))
    if description:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("description"))
        out = out.join(docs, "job_id", "left")
    return out


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        brand_id().alias("skill_id"), F.col("p_brand").alias("skill_name"), category(brand_id()).alias("category")
    ).distinct()


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("int").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("state")
    )


def named_regions(spark: SparkSession, sf_dir: str, id_col: str, name: str = "name") -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias(id_col), F.col("r_name").alias(name))


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("department_id"), F.col("n_name").alias("name")
    )


def level(flag: Column) -> Column:
    chain = F
    for value, name in LEVELS.items():
        chain = chain.when(flag == value, name)
    return chain


def qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F")
    return in_small_tasks(stated, "l_orderkey").groupBy(F.col("l_orderkey").alias("job_id"), level(F.col("l_returnflag")).alias("level")).agg(
        F.concat(F.lit("Any "), F.min("l_linenumber").cast("string")).alias("field_of_study")
    )


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_type").distinct()
    levels = F.get(F.array(F.lit("UG"), F.lit("PG"), F.lit("Doctorate")), F.pmod(degree_id(), F.lit(3)))
    return names.select(degree_id().alias("degree_id"), F.col("p_type").alias("degree_name"), levels.alias("level"))


def specializations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "part").select(size_band().alias("specialization_id")).distinct()
    return bands.withColumn("specialization_name", F.concat(F.lit("Band "), F.col("specialization_id").cast("string")))


def degree_specializations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(degree_id().alias("degree_id"), size_band().alias("specialization_id")).distinct()
    return pairs.select(
        (F.col("degree_id") * 10 + F.col("specialization_id")).cast("int").alias("degree_specialization_id"),
        "degree_id",
        "specialization_id",
    )


def blocklist(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(b,) for b in BLOCKED], "skill string")


def event_key() -> Column:
    return F.get_json_object("props", "$.k")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        F.to_date("ts").alias("snapshot_date"), event_key().alias("skill")
    ).agg(F.count_distinct("event_id").alias("posting_count"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of events: event types as fields, plus one field that fails every ninth day."""
    day = F.to_date("ts")
    number = (F.datediff(day, F.lit("2024-01-01").cast("date")) + 1).cast("long")
    low = (event_key().cast("int") < 50) & (number % 9 != 0)
    kinds = ["view", "signup", "click", "error", "purchase"]
    per_day = table(spark, sf_dir, "events").groupBy(number.alias("run_id")).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
        F.count(F.lit(1)).cast("int").alias("postings_scraped"),
        F.count_distinct("user_id").cast("int").alias("postings_written"),
        *[F.count_if(F.col("event_type") == k).cast("int").alias(k) for k in kinds],
        F.count_if(low).cast("int").alias("low_key"),
    )
    found = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in [*kinds, "low_key"]])
    ok = F.col("run_id") % 10 != 0
    return per_day.select(
        "run_id",
        F.concat(F.lit("https://jobs.example.com/feed/"), F.col("run_id").cast("string")).alias("search_url"),
        "started_at",
        "finished_at",
        F.col("postings_scraped").alias("postings_found"),
        "postings_scraped",
        "postings_written",
        F.map_from_entries(F.filter(found, lambda e: e["n"] > 0)).alias("field_found_counts"),
        ok.alias("storage_ok"),
        F.when(~ok, "disk full").alias("error_message"),
    )


class StandIns:
    """The model's tables by name, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, **arrays: bool):
        self._source, self._arrays = (spark, sf_dir), arrays

    @cached_property
    def postings(self) -> DataFrame:
        return postings(*self._source, **self._arrays)

    @cached_property
    def skills(self) -> DataFrame:
        return skills(*self._source)

    @cached_property
    def cities(self) -> DataFrame:
        return cities(*self._source)

    @cached_property
    def states(self) -> DataFrame:
        return named_regions(*self._source, "state_id", "state_name")

    @cached_property
    def qualifications(self) -> DataFrame:
        return qualifications(*self._source)

    @cached_property
    def degrees(self) -> DataFrame:
        return degrees(*self._source)

    @cached_property
    def specializations(self) -> DataFrame:
        return specializations(*self._source)

    @cached_property
    def degree_specializations(self) -> DataFrame:
        return degree_specializations(*self._source)

    @cached_property
    def role_categories(self) -> DataFrame:
        return named_regions(*self._source, "role_category_id")

    @cached_property
    def departments(self) -> DataFrame:
        return departments(*self._source)

    @cached_property
    def industry_types(self) -> DataFrame:
        return named_regions(*self._source, "industry_type_id")

    @cached_property
    def blocklist(self) -> DataFrame:
        return blocklist(self._source[0])

    @cached_property
    def daily_counts(self) -> DataFrame:
        return daily_counts(*self._source)

    @cached_property
    def runs(self) -> DataFrame:
        return runs(*self._source)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text of each order, for the single cleaning steps."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    a, b = (key % 9).cast("string"), (key % 9 + 4).cast("string")
    years = choose(EXPERIENCE, key)
    years = F.replace(F.replace(years, F.lit("{a}"), a), F.lit("{b}"), b)
    pay = F.floor(F.col("o_totalprice") / 10000).cast("string")
    return texts(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        title().alias("title"),
        F.concat(F.lit("  Company  "), (customer % 50).cast("string"), F.lit(" Ltd ")).alias("company"),
        years.alias("experience"),
        F.when(F.col("o_orderstatus") == "P", "Not Disclosed")
        .otherwise(F.concat(pay, F.lit("-"), pay, F.lit(".75 Lacs P.A.")))
        .alias("salary"),
        F.concat_ws(", ", choose(PLACES, key), choose(PLACES, key + customer), choose(PLACES, customer * 3)).alias("location"),
        choose(EMPLOYMENT, key).alias("employment_type"),
        choose(WORK_MODES, customer).alias("working_type"),
        choose(POSTED, key).alias("posted_raw"),
        F.when(key % 4 == 0, F.concat((key % 200).cast("string"), F.lit(" Applicants")))
        .when(key % 4 == 1, F.concat((key % 200).cast("string"), F.lit("+ Applicants")))
        .when(key % 4 == 2, "Less than 10 Applicants")
        .otherwise("Applicants")
        .alias("applicants_raw"),
        F.when(key % 3 == 0, F.concat((key % 90).cast("string"), F.lit(".5K Reviews")))
        .when(key % 3 == 1, F.concat((key % 9).cast("string"), F.lit(".2M")))
        .otherwise(F.concat((key % 900).cast("string"), F.lit(" Reviews")))
        .alias("reviews_raw"),
        choose(UG_TEXT, key).alias("ug"),
        choose(PG_TEXT, customer).alias("pg"),
        F.when(key % 2 == 0, "not found").otherwise(F.concat(F.lit("Category "), (customer % 6).cast("string"))).alias("role_category"),
        F.when(key % 5 == 0, "-").otherwise(F.concat(F.lit("Dept "), (customer % 8).cast("string"))).alias("department"),
        F.concat(F.lit("Industry "), (key % 7).cast("string")).alias("industry_type"),
        F.concat(((customer % 40 + 10) / 10).cast("decimal(3,1)").cast("string")).alias("company_rating"),
        F.to_date("o_orderdate").alias("seen_on"),
    )


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw posting records, with tags from their lines and text from the documents."""
    base = raw_text(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), choose(TAGS, brand_id()).alias("tag")
    )
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    per_line = F.struct("l_linenumber", "l_partkey", "tag", F.col("l_returnflag").alias("flag"))
    tags = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sort_array(F.collect_list(per_line)).alias("lines"))
    odd = F.filter("lines", lambda l: l["l_linenumber"] % 2 == 1)
    even = F.filter("lines", lambda l: l["l_linenumber"] % 2 == 0)
    starred = F.filter("lines", lambda l: l["flag"] == "R")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("description"))
    count = F.regexp_extract("applicants_raw", "[0-9]+", 0)
    return (
        base.join(tags, "job_id", "left")
        .join(docs, "job_id", "left")
        .select(
            F.concat(F.lit("https://jobs.example.com/job/"), F.col("job_id").cast("string")).alias("url"),
            "title", "company", "experience", "location", "salary",
            F.transform(odd, lambda l: l["tag"]).alias("key_skills"),
            F.transform(even, lambda l: l["tag"]).alias("tech_in_description"),
            F.transform(starred, lambda l: l["tag"]).alias("preferred_key_skills"),
            F.array(F.lit("Badge")).alias("company_badges"),
            "employment_type", "working_type", "role_category",
            F.lit("not found").alias("listed_role"),
            "industry_type", "department",
            F.col("seen_on").cast("string").alias("posted_date"),
            "posted_raw",
            (F.col("job_id") % 40).cast("string").alias("openings"),
            F.when(count != "", count).otherwise("not found").alias("applicant_count"),
            F.lit("not found").alias("applicant_count_qualifier"),
            "company_rating",
            (F.col("job_id") % 5000).cast("string").alias("company_reviews"),
            F.create_map(F.lit("UG"), F.col("ug"), F.lit("Post Graduate"), F.col("pg")).alias("education"),
            "description",
            F.lit("https://jobs.example.com/search").alias("source_search"),
            F.col("job_id").alias("batch_pos"),
        )
    )


# A page of nested elements; names in braces are columns.
PAGE = """<html><head><script>var d = "</div>";</script></head><body><h1 class="job title">Post {o_orderkey}</h1>
<div class="card company"><div>Firm {o_custkey}<div>unit <b>{unit}</b></div></div></div>
<ul><li><a class="chip top"><i class="icon star"></i><span>Tool{tool}</span></a></li><li><a class="chip"><span>Big <span>Tool{other}</span></span></a></ul>
<span class="badge"><span>B{unit}</span> of <b>{tool}</b></span><!-- </span> --><span class="badge">Last</span>
<div><label>Department:</label> <span><a href="/d">Dept {unit}</a>, <span><a href="/u">Unit {other}</a></span></span></div>
<div><label>Openings:</label><span>{tool}</span></div></section>
<section class="education"><div><label>UG:</label><span>B.Sc in <span>Field {unit}</span></span></div><div><label>None:</label></div></section>
<div class="description"><div><p>Text {o_orderkey}<p>more<br>lines</div><div>end <ul><li>a<ul><li>b</ul></ul></div></div><div class="description">other</div>"""
PAGE_TOOLS, PAGE_UNITS = 40, 7


def posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages whose fields hold nested elements; every tenth has no description."""
    orders = texts(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_custkey") % PAGE_UNITS).alias("unit"),
        (F.col("o_orderkey") % PAGE_TOOLS).alias("tool"), (F.col("o_custkey") % PAGE_TOOLS).alias("other"),
    )
    html = F.lit(PAGE)
    for name in orders.columns:
        html = F.replace(html, F.lit("{" + name + "}"), F.col(name).cast("string"))
    html = F.when(F.col("o_orderkey") % 10 == 0, F.replace(html, F.lit("description"), F.lit("advert"))).otherwise(html)
    return orders.select(F.concat(F.lit("https://pages.example.net/"), F.col("o_orderkey").cast("string")).alias("url"), html.alias("html"))
