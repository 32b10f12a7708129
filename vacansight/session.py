"""Session settings and the few physical-layout helpers the jobs share."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", app: str = "vacansight", **conf: str) -> SparkSession:
    """A session for local runs: few shuffle partitions, and small ones kept apart so
    that all cores work. On a cluster use its own session; the jobs set nothing
    that lasts."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows as a local relation: its size is known, and no Python worker is needed."""
    names = [part.split()[0] for part in schema.split(",")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, columns)}), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset gets a folder of its own; on a cluster that would be a folder
    the other machines cannot read, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="vacansight-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark deletes the shuffle files of an action at its end; else they stay until the driver happens to collect its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, read by at most ``tasks`` tasks if given.

    The shuffle files that led to them go at once. The session's own setting holds again afterwards.
    """
    conf = df.sparkSession.conf
    shared_dir(df.sparkSession)
    before = conf.get(FILES_GO, None)
    conf.set(FILES_GO, "true")
    try:
        made = df.select("*").checkpoint(eager=True)  # a frame keeps the setting under which it was made
    finally:
        conf.unset(FILES_GO) if before is None else conf.set(FILES_GO, before)
    return made if tasks is None else made.coalesce(tasks)


ROWS_PER_TASK = 2_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that read a checkpoint of what ``rows`` rows lead to, two per core at least.

    A checkpoint has a file per shuffle partition and, unlike a table, each is read in a task of its own. Where the
    session has many more partitions than the rows need, these tasks, their shuffle files and what the driver keeps of
    each are most of the work. Many rows give more tasks than there are partitions, and nothing changes.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain scan at least one partition per core before CPU-heavy text work.

    A large table already has more splits than cores and is left alone: no shuffle
    of whole texts. Only a scan with too few splits (one small file) is spread.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def in_small_tasks(df: DataFrame, key: str) -> DataFrame:
    """Rows by a key with many values, before they are grouped by it, in as many tasks as the session shuffles into, or
    eight per split of a larger table.

    Adaptive execution joins partitions by their compressed bytes. Narrow rows are
    compressed so well that such a task would hold millions of groups; a number that is asked for is kept.
    """
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(asked, 8 * df.rdd.getNumPartitions()), key)


def unfolded(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of a computed array.

    ``explode`` makes Spark infer a filter on the array, which computes it again;
    the outer form does not, and the empty rows are dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def with_dense_ids(df: DataFrame, id_col: str, order_cols: list[str], start: Column | int = 0) -> DataFrame:
    """Number rows 1..n after ``start`` in ``order_cols`` order, without a global window.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the row counts of the partitions before it. The one-row-per-
    partition offset table is the only thing that is ever in one place. The
    sorted rows are checkpointed so that both uses see the same partitions.
    """
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order_cols])
        .sortWithinPartitions(*order_cols)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_place"), 33)
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_before"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.withColumn("_part", part)
        .join(before, "_part")
        .withColumn(id_col, (first + F.col("_before") + within + 1).cast("long"))
        .drop("_part", "_place", "_before")
    )
