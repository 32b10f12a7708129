"""The versioned store: what readers see when writes fail, repeat, pile up or meet."""

from datetime import date
from pathlib import Path

import pytest

from test_pipeline import batch, posting, state_of
from vacansight.plans.ingest import ingest_batch
from vacansight.sources.store import Change, Store

DAYS = [date(2024, 3, d) for d in range(1, 9)]


def firm(n, **changes):
    return posting(company=f"Firm {n}", **changes)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=4)
    s.seed()
    return s


def size_of(store, version):
    return sum(f.stat().st_size for f in Path(store.root).glob(f"*/version={version}/**/*.parquet"))


def test_a_failed_publish_changes_nothing_and_is_repaired_after_a_later_batch(spark, tmp_path, store, monkeypatch):
    one = batch(spark, tmp_path, "one", [firm(1), firm(2)])
    two = batch(spark, tmp_path, "two", [firm(1, education={}), firm(3)])
    three = batch(spark, tmp_path, "three", [firm(2)])
    ingest_batch(store, one, DAYS[0], 1)
    before, held = state_of(store), store.manifest()

    with monkeypatch.context() as broken:
        broken.setattr(Change, "publish", lambda self: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            ingest_batch(store, two, DAYS[1], 2)
    assert state_of(store) == before and store.manifest() == held

    ingest_batch(store, three, DAYS[2], 3)
    ingest_batch(store, two, DAYS[3], 2)
    times = {r["company"]: (r["job_id"], r["times_seen"], r["last_batch_id"]) for r in store.read("postings").collect()}
    assert times == {"Firm 1": (1, 2, 2), "Firm 2": (2, 2, 3), "Firm 3": (3, 1, 2)}
    levels = {r["job_id"] for r in store.read("qualifications").collect()}
    assert levels == {2, 3}
    after = state_of(store)
    for raw, day, number in ((one, DAYS[4], 1), (two, DAYS[5], 2)):
        ingest_batch(store, raw, day, number)
    assert state_of(store) == after
    # a reader that began with an older manifest still reads what it names
    assert {r["company"] for r in store.read("postings", held).collect()} == {"Firm 1", "Firm 2"}


def test_bytes_written_follow_the_batch_and_nothing_new_writes_no_dictionary(spark, tmp_path, store):
    ingest_batch(store, batch(spark, tmp_path, "big", [firm(n, description="long text " * 200 + str(n)) for n in range(400)]), DAYS[0], 1)
    big = store.manifest().version
    ingest_batch(store, batch(spark, tmp_path, "small", [firm(5, description="long text"), firm(5)]), DAYS[1], 2)
    small = store.manifest().version
    assert store.read("postings").count() == 400
    assert size_of(store, small) < size_of(store, big) / 3
    written = {p.parent.name for p in Path(store.root).glob(f"*/version={small}")}
    assert written == {"postings", "qualifications", "daily_counts", "batches", "manifest"}


def test_compaction_goes_bucket_by_bucket_and_changes_no_result(spark, tmp_path, store):
    ingest_batch(store, batch(spark, tmp_path, "all", [firm(n) for n in range(12)]), DAYS[0], 1)
    for i in range(2, 5):
        ingest_batch(store, batch(spark, tmp_path, f"b{i}", [firm(0, salary=f"{i} - 9 Lacs P.A.", education={} if i == 4 else {"UG": "MCA"})]), DAYS[i], i)
    before, versions = state_of(store), store.manifest().buckets["postings"]
    hot = [b for b, v in versions.items() if len(v) == 4]
    assert len(hot) == 1 and store.compact(3) == hot
    now = store.manifest()
    assert {b: len(v) for b, v in now.buckets["postings"].items()} == {b: 1 for b in versions}
    assert all(now.buckets["postings"][b] == v for b, v in versions.items() if b not in hot)
    assert state_of(store) == before and store.compact(3) == []

    gone = store.vacuum(keep=1)
    assert any(g.startswith("postings/") for g in gone) and state_of(store) == before
    assert list(store._manifests()) == [now.version] and store.vacuum(keep=1) == []
    ingest_batch(store, batch(spark, tmp_path, "more", [firm(0), firm(99)]), DAYS[6], 9)
    got = {r["company"]: (r["job_id"], r["times_seen"]) for r in store.read("postings").collect()}
    assert got["Firm 0"] == (1, 5) and got["Firm 99"] == (13, 1)


def test_a_second_writer_of_a_version_is_refused(spark, store):
    first, second = store.begin(), store.begin()
    first.publish()
    with pytest.raises(RuntimeError, match="another writer"):
        second.publish()


def test_base_rows_are_not_moved_when_versions_are_few(spark, tmp_path, store):
    ingest_batch(store, batch(spark, tmp_path, "x", [firm(n) for n in range(5)]), DAYS[0], 1)
    assert "Exchange" not in store.read("postings")._jdf.queryExecution().executedPlan().toString()
    ingest_batch(store, batch(spark, tmp_path, "y", [firm(1)]), DAYS[1], 2)
    plan = store.read("postings")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_empty_batch_and_empty_store(spark, tmp_path, store):
    assert store.read("postings").count() == 0 and store.read("daily_counts").count() == 0
    nothing = batch(spark, tmp_path, "none", [firm(1)]).limit(0)
    assert tuple(ingest_batch(store, nothing, DAYS[0], 1).first()) == (0, 0)
    assert store.read("postings").count() == 0 and store.read("batches").count() == 1


def test_sightings_are_cleaned_on_every_core(spark, sf):
    from vacansight.plans import stored

    assert stored.sightings(spark, sf, 0).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
