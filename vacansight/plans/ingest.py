"""One batch of raw records from reading to the daily snapshot."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.functions.skills import skill_category
from vacansight.operators.dictionaries import new_entries
from vacansight.operators.health import field_fill_counts
from vacansight.operators.merge import batch_counts, first_sightings, merge_batch, new_job_ids
from vacansight.operators.trends import snapshot, upsert_counts
from vacansight.plans.clean import clean_postings, unreadable
from vacansight.schemas import RAW_FIELDS
from vacansight.session import cut_lineage, small_table
from vacansight.sources.raw import write_aside
from vacansight.sources.store import Change, Store

_DIMENSIONS = (
    ("role_categories", "role_category_id", "role_category"),
    ("departments", "department_id", "department"),
    ("industry_types", "industry_type_id", "industry_type"),
)


def _enter(change: Change, table: str, names: DataFrame, keys: list[str], id_col: str, extra: dict[str, Column] | None = None) -> None:
    """Adds the names a dictionary does not have yet, with ids after the highest one of the manifest."""
    dictionary, highest = change.read(table), change.next.highest.get(id_col, 0)
    unknown = names.select(*keys).dropna(subset=keys).distinct().join(dictionary.select(*keys), keys, "left_anti")
    if unknown.isEmpty():
        return
    added = new_entries(dictionary, unknown, keys, id_col, extra, highest)
    change.append(table, added)
    change.next.highest[id_col] = max(highest, added.agg(F.max(id_col)).first()[0] or 0)


def _register(change: Change, batch: DataFrame) -> None:
    """Adds the batch's new names to the dictionaries."""
    names = batch.select(F.explode("skills").alias("skill_name"))
    _enter(change, "skills", names, ["skill_name"], "skill_id", {"category": skill_category(F.col("skill_name"))})
    for table, id_col, column in _DIMENSIONS:
        _enter(change, table, batch.select(F.col(column).alias("name")), ["name"], id_col)

    degrees = _degree_rows(batch)
    of_level = degrees.select(F.nullif("degree_name", F.lit("")).alias("degree_name"), "level")
    _enter(change, "degrees", of_level, ["degree_name", "level"], "degree_id")
    named = degrees.select("degree_name", "level", F.explode("specializations").alias("specialization_name"))
    _enter(change, "specializations", named.filter("specialization_name != ''"), ["specialization_name"], "specialization_id")
    pairs = (
        named.distinct()
        .join(change.read("degrees"), ["degree_name", "level"])
        .join(change.read("specializations"), "specialization_name")
    )
    _enter(change, "degree_specializations", pairs, ["degree_id", "specialization_id"], "degree_specialization_id")


def _degree_rows(batch: DataFrame) -> DataFrame:
    return batch.select("fingerprint", F.explode("qualification_degrees").alias("d")).select(
        "fingerprint", F.col("d.degree").alias("degree_name"), "d.level", "d.specializations"
    )


def _with_ids(store: Change, batch: DataFrame) -> DataFrame:
    """Names replaced by ids: sorted, distinct id arrays and the single-valued ids."""
    none = F.array().cast("array<int>")
    mentions = batch.select(
        "fingerprint", "preferred_skills", F.explode("skills").alias("skill_name")
    ).join(store.read("skills"), "skill_name")
    starred = F.array_contains("preferred_skills", F.col("skill_name"))
    skill_ids = mentions.groupBy("fingerprint").agg(
        F.sort_array(F.collect_set("skill_id")).alias("skill_ids"),
        F.sort_array(F.collect_set(F.when(starred, F.col("skill_id")))).alias("preferred_skill_ids"),
    )
    degrees = _degree_rows(batch).join(store.read("degrees"), ["degree_name", "level"])
    pairs = (
        degrees.select("fingerprint", "degree_id", F.explode_outer("specializations").alias("specialization_name"))
        .join(store.read("specializations"), "specialization_name", "left")
        .join(store.read("degree_specializations"), ["degree_id", "specialization_id"], "left")
    )
    degree_ids = pairs.groupBy("fingerprint").agg(
        F.sort_array(F.collect_set("degree_id")).alias("accepted_degree_ids"),
        F.sort_array(F.collect_set("degree_specialization_id")).alias("accepted_degree_specialization_ids"),
    )
    out = batch.join(skill_ids, "fingerprint", "left").join(degree_ids, "fingerprint", "left")
    for table, id_col, column in _DIMENSIONS:
        out = out.join(store.read(table).withColumnRenamed("name", column), column, "left")
    arrays = ["skill_ids", "preferred_skill_ids", "accepted_degree_ids", "accepted_degree_specialization_ids"]
    return out.withColumns({a: F.coalesce(a, none) for a in arrays})


def _touched_buckets(batch: DataFrame) -> list[int]:
    """The batch's buckets; at most as many as the store has."""
    return [row["bucket"] for row in batch.select("bucket").distinct().collect()]


def _levels(batch: DataFrame) -> DataFrame:
    """One row per posting and level. Texts of a level that is stated twice are joined in their order."""
    each = batch.select("fingerprint", F.posexplode("qualifications").alias("at", "q")).select("fingerprint", "at", "q.*")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "field_of_study"))), lambda x: x["field_of_study"])
    return each.groupBy("fingerprint", "level").agg(F.array_join(texts, ", ").alias("field_of_study"))


def ingest_batch(store: Store, raw: DataFrame, as_of: date, batch_id: int) -> DataFrame:
    """Cleans, merges and snapshots one batch; returns its new and repeat counts.

    All tables change together, when the manifest is published: a batch that broke off has changed nothing, and one
    that is in the batch table is passed over. Only the rows of the batch's own postings are written. ``raw`` carries
    ``batch_pos``.
    """
    change = store.begin()
    if not change.read("batches").filter(F.col("batch_id") == batch_id).isEmpty():
        return batch_counts(change.read("postings"), batch_id)
    today = F.lit(as_of).cast("date")
    cleaned = clean_postings(raw, change.read("cities"))
    first = first_sightings(cleaned, ["fingerprint"], ["batch_pos"])
    batch = cut_lineage(first.withColumn("bucket", store.bucket(F.col("fingerprint"))))

    _register(change, batch)
    touched = change.read("postings", _touched_buckets(batch))
    current = cut_lineage(touched.join(batch.select("fingerprint"), "fingerprint", "left_semi"))
    highest = change.next.highest.get("job_id", 0)
    ids = new_job_ids(current, batch, "fingerprint", ["batch_pos"], F.lit(highest).cast("long"))
    merged = change.write("postings", merge_batch(current, _with_ids(change, batch), ids, today, batch_id))
    change.next.highest["job_id"] = max(highest, merged.agg(F.max("job_id")).first()[0] or 0)

    mine = merged.select("job_id", "fingerprint", "bucket")
    change.write("qualifications", mine.join(_levels(batch), "fingerprint").select("job_id", "level", "field_of_study", "bucket"))
    snapshot_today(change, as_of)
    change.append("batches", small_table(store.spark, [(batch_id, as_of)], "batch_id long, as_of date"))
    change.publish()
    return batch_counts(merged, batch_id)


def snapshot_today(change: Change, as_of: date) -> None:
    """Counts of the postings seen today into today's partition."""
    today = F.lit(as_of).cast("date")
    counts = snapshot(change.read("postings"), change.read("skills"), today)
    day = change.read("daily_counts").filter(F.col("snapshot_date") == today)
    change.replace_days(upsert_counts(day, counts))


def run(store: Store, raw: DataFrame, as_of: date, batch_id: int, search_url: str, aside: str) -> DataFrame | None:
    """A whole run with its log row; records that cannot be stored are kept as JSON."""
    started = datetime.now()
    fill = field_fill_counts(raw, RAW_FIELDS)
    counts, error = None, None
    try:
        counts = ingest_batch(store, raw, as_of, batch_id)
        odd = unreadable(raw)
        if not odd.isEmpty():
            write_aside(odd, f"{aside}/unreadable/batch={batch_id}")
    except Exception as problem:  # the run must still be logged
        error = str(problem)
        write_aside(raw, f"{aside}/unsaved/batch={batch_id}")
    found = fill.first()
    written = sum(counts.first()) if counts is not None else 0
    store.log_run(
        search_url=search_url,
        started_at=started,
        finished_at=datetime.now(),
        postings_found=found["postings_scraped"],
        postings_scraped=found["postings_scraped"],
        postings_written=written,
        field_found_counts=found["field_found_counts"],
        storage_ok=error is None,
        error_message=error,
    )
    return counts
