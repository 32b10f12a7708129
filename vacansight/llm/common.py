"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacansight.session import cut_lineage, shared_dir

ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
    "array<array<bigint>>": pa.list_(pa.list_(pa.int64())),
}


_APART = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_MARKS = "\u00a0\u2019\u2018\u201c\u201d\u201e\u00ab\u00bb\u2013\u2014\u2026\u3000\u3001\u3002\u00bf\u00a1"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: what stands between ASCII characters that are no letter, digit or underscore, and the usual other marks."""
    low = (text or "").lower()
    if not low.isascii():
        for c in _MARKS:
            if c in low:
                low = low.replace(c, " ")
    return low.encode("utf-8", "replace").translate(_APART).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, text_col: str, fields: dict[str, str], start: Callable[[], Callable]) -> DataFrame:
    """``df`` with columns computed from one text column, batch by batch, without a shuffle.

    ``start()`` runs once per task and gives a function from a list of texts (or None)
    to one list of values per new column. A column of ``df`` that has the name of a
    new one is replaced; all others pass through unread.
    """
    keep = [f for f in df.schema.fields if f.name not in fields]
    kinds = [ARROW[k] for k in fields.values()]
    schema = T.StructType(keep + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()])
    names = [f.name for f in keep]
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(v, kind) for v, kind in zip(made, kinds)], names + list(fields)
            )

    return source.mapInArrow(run, schema)


def set_aside(docs: DataFrame, names: Collection[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with those of its columns renamed that have one of ``names``, and the columns that bring all of it back."""
    hidden = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(hidden), [F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: smaller than a checkpoint, and only the columns in use are read."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SALTS = 8


def dealt_join(many: DataFrame, one: DataFrame, on: list[str], spread_by: str, how: str = "left") -> DataFrame:
    """Join where ``one`` has at most one row per key and a key may hold a third of ``many``: the row is
    copied ``SALTS`` times and the many are dealt out over the copies by another column."""
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(F.lit(17), F.col(spread_by)), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (a, b): the least node it is linked to, directly or not.

    Each round takes the least label among neighbours and then the label of that label, so
    long chains shrink by half; labels are tables, never collected. Each is read by at most ``tasks`` tasks if given.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tasks)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), tasks)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("around"))
        nearer = labels.join(seen, "node").select("node", "root", F.least("root", "around").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("further"))
        new = cut_lineage(nearer.join(jump, "low", "left").select("node", F.col("root").alias("_old"), F.least("low", F.coalesce("further", "low")).alias("root")), tasks)
        labels = new.drop("_old")
        if new.where("_old <> root").isEmpty():
            return labels
