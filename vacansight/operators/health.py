"""Feed health: what each run found, against recent runs; and the table checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacansight.schemas import Tables
from vacansight.session import with_dense_ids
from vacansight.vocab import CONTRACT_TYPES, EMPLOYMENT_TYPES, MISSING, WORKING_TYPES


def _is_found(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(value) > 0
    if isinstance(kind, T.StringType):
        return value.isNotNull() & ~value.isin(MISSING, "[]", "{}")
    return value.isNotNull()


def field_fill_counts(raw: DataFrame, fields: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Rows per field that hold a value, as ``map<field, count>``; fields never found have no entry.

    One pass over the data; the counts combine before the shuffle.
    """
    counts = [F.count_if(_is_found(raw, f)).alias(f) for f in fields]
    per_group = raw.groupBy(*(group_cols or [])).agg(F.count(F.lit(1)).alias("postings_scraped"), *counts)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("found")) for f in fields])
    return per_group.select(
        *(group_cols or []),
        "postings_scraped",
        F.map_from_entries(F.filter(entries, lambda e: e["found"] > 0)).alias("field_found_counts"),
    )


def found_counts(json_text: Column) -> Column:
    """The counts of a run that were logged as a JSON object."""
    return F.from_json(json_text, "map<string,int>")


def run_list(runs: DataFrame, lookback: int = 20) -> DataFrame:
    """Latest runs with their duration in seconds."""
    return (
        runs.orderBy(F.desc("started_at"), F.desc("run_id"))
        .limit(lookback)
        .select(
            "run_id", "search_url", "started_at", "finished_at", "postings_found", "postings_scraped",
            "postings_written", "storage_ok", "error_message",
            F.expr("timestampdiff(MICROSECOND, started_at, finished_at)").alias("_micros"),
        )
        .withColumn("duration_seconds", F.col("_micros") / 1e6)
        .drop("_micros")
    )


def _warnings(history: DataFrame, current: DataFrame) -> DataFrame:
    """Fields whose usual rate is above 0.3 and whose current rate is under half of it.

    A field the current run did not find at all counts as rate 0, so it is flagged.
    """
    usual = (
        history.select("target_run", F.explode("field_found_counts").alias("field", "found"), "postings_scraped")
        .groupBy("target_run", "field")
        .agg(F.avg(F.col("found") / F.col("postings_scraped")).alias("usual"))
    )
    now = current.select(
        F.col("run_id").alias("target_run"),
        F.col("postings_scraped").alias("scraped"),
        F.col("field_found_counts").alias("found_now"),
    )
    rated = usual.join(now, "target_run").withColumn(
        "current", F.coalesce(F.try_element_at("found_now", F.col("field")), F.lit(0)) / F.col("scraped")
    )
    return rated.filter((F.col("usual") > 0.3) & (F.col("current") < F.col("usual") * 0.5)).select(
        F.col("target_run").alias("run_id"),
        "field",
        F.round("current", 3).alias("current_rate"),
        F.round("usual", 3).alias("historical_avg_rate"),
    )


def field_health(runs: DataFrame, run_id: int, lookback: int = 10) -> DataFrame:
    """One run against the ``lookback`` latest other runs that scraped anything."""
    usable = runs.filter(F.col("field_found_counts").isNotNull() & (F.col("postings_scraped") > 0))
    history = (
        usable.filter(F.col("run_id") != run_id)
        .orderBy(F.desc("started_at"), F.desc("run_id"))
        .limit(lookback)
        .withColumn("target_run", F.lit(run_id).cast(runs.schema["run_id"].dataType))
    )
    return _warnings(history, usable.filter(F.col("run_id") == run_id))


def field_health_history(runs: DataFrame, lookback: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Every run against the ``lookback`` runs before it (per ``keys``).

    Runs get dense numbers in their order; the runs before one are then found by an equi join on their numbers, so no
    task holds the history of all runs.
    """
    keys = keys or []
    usable = runs.filter(F.col("field_found_counts").isNotNull() & (F.col("postings_scraped") > 0))
    numbered = with_dense_ids(usable, "_n", [*keys, "started_at", "run_id"])
    same = [F.col(k) for k in keys]
    earlier = numbered.select(*keys, (F.col("_n")).alias("_before"), "field_found_counts", "postings_scraped")
    wanted = numbered.select(*same, F.col("run_id").alias("target_run"), F.explode(F.sequence(F.col("_n") - lookback, F.col("_n") - 1)).alias("_before"))
    past = wanted.join(earlier, [*keys, "_before"]).select("target_run", "field_found_counts", "postings_scraped")
    return _warnings(past, usable)


def constraint_report(t: Tables) -> DataFrame:
    """Number of rows that break each rule of the model."""
    c = F.col
    values = {
        "working_type": WORKING_TYPES,
        "employment_type": sorted(set(EMPLOYMENT_TYPES.values())),
        "contract_type": sorted(set(CONTRACT_TYPES.values())),
    }
    checks = [F.count_if(~c(name).isin(allowed)).alias(f"{name}_value") for name, allowed in values.items()]
    checks.append(
        F.count_if(F.size(F.array_except("preferred_skill_ids", "skill_ids")) > 0).alias("preferred_not_in_skills")
    )
    wide = t.postings.agg(*checks)
    names = [f"{name}_value" for name in values] + ["preferred_not_in_skills"]
    stacked = wide.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c(n).alias("violations")) for n in names])).alias("r")
    ).select("r.rule", "r.violations")

    def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
        extra = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
        return extra.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    parts = [
        stacked,
        repeated(t.postings, ["fingerprint"], "fingerprint_repeated"),
        repeated(t.qualifications, ["job_id", "level"], "qualification_repeated"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: References of a posting: where they stand, and the dictionary and id they point to.
FACT_REFERENCES = {
    "skill_ids": ("skills", "skill_id"),
    "preferred_skill_ids": ("skills", "skill_id"),
    "city_ids": ("cities", "city_id"),
    "accepted_degree_ids": ("degrees", "degree_id"),
    "accepted_degree_specialization_ids": ("degree_specializations", "degree_specialization_id"),
    "role_category_id": ("role_categories", "role_category_id"),
    "department_id": ("departments", "department_id"),
    "industry_type_id": ("industry_types", "industry_type_id"),
}
#: References of the other tables: name, table, column, and the dictionary and id they point to.
OTHER_REFERENCES = [
    ("qualification_job_id", "qualifications", "job_id", "postings", "job_id"),
    ("pair_degree_id", "degree_specializations", "degree_id", "degrees", "degree_id"),
    ("pair_specialization_id", "degree_specializations", "specialization_id", "specializations", "specialization_id"),
    ("city_state", "cities", "state", "states", "state_name"),
]
CORE_REFERENCES = ["skill_ids", "city_ids", "role_category_id", "department_id", "industry_type_id", "qualification_job_id"]


def orphan_report(t: Tables, references: list[str] | None = None) -> DataFrame:
    """References without a target, per reference, array elements included; all references, or those named.

    References and the entries of the dictionaries are the same kind of row (reference, id): a posting gives all
    of its own in one array, so the fact is read once. Counting per (reference, id) tells which ids were defined;
    it combines in the map tasks, so a hot id is a row per task, and nothing is joined.
    """
    wanted = references or [*FACT_REFERENCES, *(r[0] for r in OTHER_REFERENCES)]
    c = F.col

    def tagged(kind: str, value: Column, refs: int, id_type: str = "bigint") -> Column:
        return F.struct(F.lit(wanted.index(kind)).alias("kind"), value.cast(id_type).alias("id"), F.lit(refs).alias("refs"))

    def all_in(name: str) -> Column:
        if not isinstance(t.postings.schema[name].dataType, T.ArrayType):
            return F.array(tagged(name, c(name), 1))
        return F.coalesce(F.transform(c(name), lambda x: tagged(name, x, 1)), F.array().cast("array<struct<kind:int,id:bigint,refs:int>>"))

    own = [all_in(name) for name in FACT_REFERENCES if name in wanted]
    if "qualification_job_id" in wanted:
        own.append(F.array(tagged("qualification_job_id", c("job_id"), 0)))
    of_type: dict[str, list[DataFrame]] = {"bigint": [t.postings.select(F.explode_outer(F.concat(*own)).alias("r"))]}
    entries: dict[tuple[str, str], list[str]] = {}
    for kind, (table, column) in [*FACT_REFERENCES.items(), *((r[0], r[3:]) for r in OTHER_REFERENCES)]:
        if kind in wanted and table != "postings":
            entries.setdefault((table, column), []).append(kind)
    stated = [(table, column, [kind], 1) for kind, table, column, *_ in OTHER_REFERENCES if kind in wanted]
    for table, column, kinds, refs in [*stated, *((*at, kinds, 0) for at, kinds in entries.items())]:
        rows = getattr(t, table)
        id_type = "string" if rows.schema[column].dataType == T.StringType() else "bigint"
        tags = F.array(*[tagged(k, c(column), refs, id_type) for k in kinds])
        of_type.setdefault(id_type, []).append(rows.select(F.explode(tags).alias("r")))

    def lost(parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts).select("r.*").filter(c("id").isNotNull())
        per_id = rows.groupBy("kind", "id").agg(F.sum("refs").alias("refs"), F.min("refs").alias("least"))
        return per_id.groupBy("kind").agg(F.sum(F.when(c("least") > 0, c("refs")).otherwise(0)).alias("orphans"))

    found = reduce(DataFrame.unionByName, [lost(parts) for parts in of_type.values()])
    every = found.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in wanted])).alias("kind", "reference"))
    return every.join(found, "kind", "left").select("reference", F.coalesce("orphans", F.lit(0).cast("long")).alias("orphans"))
