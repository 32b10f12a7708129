"""The model's tables as a log of immutable versions.

A change writes only what it adds, each table into a folder of its own version, and becomes visible by
one last step: a manifest that names the folders a reader has to look at. A change that breaks
off before that has changed nothing, and is written again over its remains. Readers hold on to the
manifest they began with.

- Postings and their qualification rows lie in hash buckets of the fingerprint. A change adds the whole new
  row of each posting it touches; the newest row of a key counts. Qualification rows count
  if they come with the newest row of their posting, so a posting that lost its
  education leaves no rows behind.
- A day of daily counts is replaced as a whole: the manifest names its newest version.
- Dictionaries and logs are only added to. The highest ids are in the manifest, so no table is read to find them.

``compact`` rewrites single buckets that have gathered many versions; ``vacuum`` deletes folders that
no recent manifest names. One writer at a time: a second one that publishes the same version is told so.
"""

from __future__ import annotations

import copy
import json
import re
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansight import schemas
from vacansight.operators.dictionaries import seed
from vacansight.schemas import Tables
from vacansight.session import small_table
from vacansight.sources import seeds

BUCKETED = {"postings": schemas.POSTING, "qualifications": schemas.QUALIFICATION}
PLAIN = {
    "skills": schemas.SKILL,
    "cities": schemas.CITY,
    "states": schemas.STATE,
    "degrees": schemas.DEGREE,
    "specializations": schemas.SPECIALIZATION,
    "degree_specializations": schemas.DEGREE_SPECIALIZATION,
    "role_categories": schemas.ROLE_CATEGORY,
    "departments": schemas.DEPARTMENT,
    "industry_types": schemas.INDUSTRY_TYPE,
    "blocklist": schemas.BLOCKLIST,
    "runs": schemas.RUN,
    "batches": "batch_id long, as_of date",
}
DAYS = "daily_counts"
#: Versions of a bucket or plain table from which on ``compact`` rewrites it.
MANY_VERSIONS = 8


@dataclass
class Manifest:
    """What a reader looks at: the versions of each bucket (the first is the base), of each day and of each plain table."""

    version: int = 0
    writer: str = ""
    buckets: dict[str, dict[int, list[int]]] = field(default_factory=lambda: {name: {} for name in BUCKETED})
    days: dict[str, int] = field(default_factory=dict)
    plain: dict[str, list[int]] = field(default_factory=dict)
    highest: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Manifest:
        found = json.loads(text)
        found["buckets"] = {t: {int(b): v for b, v in own.items()} for t, own in found["buckets"].items()}
        return Manifest(**found)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # --- manifests ----------------------------------------------------------------------

    def _manifests(self) -> dict[int, str]:
        """Published versions and the file of each."""
        try:
            files = self.spark.read.text(self.path("manifest")).inputFiles()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {int(re.search(r"/version=([0-9]+)/", f)[1]): f for f in files}

    def manifest(self) -> Manifest:
        """The newest published manifest."""
        published = self._manifests()
        return self._manifest_of(published, max(published)) if published else Manifest()

    def _manifest_of(self, published: dict[int, str], version: int) -> Manifest:
        return Manifest.parse(self.spark.read.text(published[version], wholetext=True).select("value").first()[0])

    # --- reading ------------------------------------------------------------------------

    def _scan(self, name: str, layout: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], layout)
        base = self.path(name)
        return self.spark.read.schema(layout).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])

    def read(self, name: str, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as the manifest has it, by default the newest; bucketed tables can be read in part."""
        m = manifest or self.manifest()
        if name in PLAIN:
            return self._scan(name, PLAIN[name] + ", version long", [f"version={v}" for v in m.plain.get(name, [])]).drop("version")
        if name == DAYS:
            layout = schemas.DAILY_COUNT + ", version long"
            return self._scan(name, layout, [f"version={v}/snapshot_date={d}" for d, v in sorted(m.days.items())]).drop("version")
        return self._newest(name, m, buckets).drop("version")

    def _parts(self, name: str, m: Manifest, buckets: list[int] | None) -> tuple[DataFrame, DataFrame]:
        """The rows of the base versions of the buckets, and those of the versions after."""
        layout = BUCKETED[name] + ", bucket int, version long"
        first = {b: versions[0] for b, versions in m.buckets["postings"].items()}
        of = [(b, v) for b, versions in m.buckets[name].items() for v in versions if buckets is None or b in buckets]
        scan = lambda own: self._scan(name, layout, [f"version={v}/bucket={b}" for b, v in own])
        return scan([x for x in of if x[1] == first[x[0]]]), scan([x for x in of if x[1] != first[x[0]]])

    def _newest(self, name: str, m: Manifest, buckets: list[int] | None) -> DataFrame:
        """Base rows whose key no later version has, and the newest later rows.

        Only keys and versions of the later rows are compared; where these are few, Spark
        sends them to the base, which is not moved.
        """
        base, later = self._parts(name, m, buckets)
        if not any(len(v) > 1 for v in m.buckets["postings"].values()):
            return base
        _, touched = self._parts("postings", m, buckets)
        key = "fingerprint" if name == "postings" else "job_id"
        newest = touched.groupBy(key).agg(F.max("version").alias("version"))
        later = later.join(newest, [key, "version"], "left_semi").select(base.columns)
        return base.join(newest.select(key), key, "left_anti").select(base.columns).unionByName(later)

    def tables(self) -> Tables:
        m = self.manifest()
        return Tables(**{name: self.read(name, m) for name in Tables.__dataclass_fields__})

    # --- changing -----------------------------------------------------------------------

    def begin(self) -> Change:
        return Change(self)

    def seed(self) -> None:
        """Loads the fixed dimensions; entries that exist stay untouched."""
        change = self.begin()
        for name, rows, keys in (
            ("states", seeds.states(self.spark), ["state_name"]),
            ("cities", seeds.cities(self.spark), ["city_name"]),
            ("blocklist", seeds.blocklist(self.spark), ["skill"]),
        ):
            change.append(name, seed(change.read(name), rows, keys).coalesce(1))
        change.publish()

    def log_run(self, **values: object) -> None:
        """Appends one run with the next run id."""
        change = self.begin()
        run_id = change.next.highest.get("run_id", 0) + 1
        fields = [line.strip().split(" ", 1)[0] for line in schemas.RUN.replace("map<string,int>", "map").split(",")]
        row = self.spark.createDataFrame([tuple((values | {"run_id": run_id}).get(f) for f in fields)], schemas.RUN)
        change.append("runs", row)
        change.next.highest["run_id"] = run_id
        change.publish()

    def compact(self, many: int = MANY_VERSIONS) -> list[int]:
        """Rewrites the buckets, and the plain tables, that have ``many`` versions or more; returns the buckets. No result changes."""
        change = self.begin()
        m = change.before
        full = [b for b, versions in m.buckets["postings"].items() if len(versions) >= many]
        if full:
            for name in BUCKETED:
                rows = self.read(name, m, full)
                for b in full:
                    change.next.buckets[name].pop(b, None)
                change.write(name, rows)
        for name, versions in m.plain.items():
            if len(versions) >= many:
                rows = self.read(name, m)
                change.next.plain[name] = []
                change.append(name, rows.coalesce(1))
        if change.changed:
            change.publish()
        return full

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes version folders that none of the ``keep`` newest manifests names, and older manifests; returns what went.
        Versions that are not published yet are left alone."""
        published = self._manifests()
        kept = sorted(published)[-keep:]
        named: set[tuple[str, int]] = set()
        for v in kept:
            m = self._manifest_of(published, v)
            named |= {(t, v) for t, own in m.buckets.items() for versions in own.values() for v in versions}
            named |= {(t, v) for t, versions in m.plain.items() for v in versions} | {(DAYS, v) for v in m.days.values()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for name in [*BUCKETED, *PLAIN, DAYS, "manifest"]:
            at = hadoop.Path(self.path(name))
            for status in fs.listStatus(at) if fs.exists(at) else []:
                found = re.fullmatch(r"version=([0-9]+)", status.getPath().getName())
                version = int(found[1]) if found else None
                old = version is not None and version <= kept[-1]
                if old and ((name, version) not in named if name != "manifest" else version not in kept):
                    fs.delete(status.getPath(), True)
                    gone.append(f"{name}/{status.getPath().getName()}")
        return gone


class Change:
    """What one writer adds: folders of the next version, and the manifest that will name them."""

    def __init__(self, store: Store):
        self.store, self.before = store, store.manifest()
        self.next = copy.deepcopy(self.before)
        self.next.version, self.next.writer = self.before.version + 1, uuid4().hex
        self.changed = False

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table with what this change has written so far."""
        return self.store.read(name, self.next, buckets)

    def _put(self, rows: DataFrame, name: str, by: str | None) -> DataFrame:
        """Rebalanced, not repartitioned: adaptive execution splits a large bucket over several
        tasks and files and puts small ones together."""
        path = f"{self.store.path(name)}/version={self.next.version}"
        if by:
            rows.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)
        self.changed = True
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds whole rows of touched keys (with their ``bucket``); returns them as written."""
        written = self._put(rows, name, "bucket")
        for row in written.select("bucket").distinct().collect():  # at most as many as the store has buckets
            self.next.buckets[name].setdefault(row["bucket"], []).append(self.next.version)
        return written

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a plain table, once per change; no rows, no files."""
        if not rows.isEmpty():
            self._put(rows, name, None)
            self.next.plain.setdefault(name, []).append(self.next.version)

    def replace_days(self, rows: DataFrame) -> None:
        """Days of daily counts in place of what they were."""
        written = self._put(rows, DAYS, "snapshot_date")
        for row in written.select("snapshot_date").distinct().collect():  # the days of one batch
            self.next.days[row["snapshot_date"].isoformat()] = self.next.version

    def publish(self) -> None:
        """The one step that readers see."""
        spark, target = self.store.spark, f"{self.store.path('manifest')}/version={self.next.version}"
        if self.next.version in self.store._manifests():
            raise RuntimeError(f"version {self.next.version} was published by another writer")
        small_table(spark, [(json.dumps(asdict(self.next)),)], "value string").coalesce(1).write.mode("overwrite").text(target)
        if self.store.manifest().writer != self.next.writer:
            raise RuntimeError(f"version {self.next.version} was published by two writers")
