"""Merkle manifest of a dataset, by sibling-shift self-joins.

A leaf is the digest of a row. The leaves of a source stand in order of ``doc_id``; at every level
each node equijoins the nodes at its computed sibling places (slot offsets within its run of ``fan``), and the
rows in slot zero emit the parents. The tops of the sources form a second tree, whose top is the
root. Going down again, every node takes its own siblings and then those of its parent, so each leaf
ends up with its proof; no task ever holds a source.

Defined results: a null in any column is written ``-``. A null source is a source of its own and comes first; null
ids come first in their source. Rows with one id are ordered by their leaf; rows that repeat have equal leaves
in adjoining places. A source of one row has its leaf as top. An empty table has no rows and no root. Other columns
are neither hashed nor kept; texts of any length are one digest each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.llm.common import stored

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so written that no two rows read alike: its size in bytes, a colon, itself."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    return digest(*[field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS])


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) among the ``n`` of their key, in ``order``.

    Rows are dealt by range and sorted, so a key with a third of all rows lies in many
    partitions. Only counts per (partition, key) are brought together; they come back by both.
    """
    one_by_one = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows, too, can lie in several partitions
    lined = one_by_one.repartitionByRange(F.col(key), *[F.col(c) for c in order], F.col("_tie"))
    lined = stored(lined.sortWithinPartitions(key, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    lined = lined.withColumn("_part", F.shiftright("_at", 33))
    held = lined.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of_key = Window.partitionBy(key)
    before = F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("_part", key, "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_key).alias("n"))
    pos = F.col("_before") + F.col("_at") - F.col("_first")
    return lined.join(held, ["_part", key]).withColumn("pos", pos).drop("_part", "_at", "_first", "_before")


def with_siblings(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """``nodes`` (key, pos, n, h) with ``before`` and ``after``: the digests of the others of their run, joined left to right."""
    slot = F.col("pos") % fan
    shifted = nodes
    for d in range(1, fan):
        sibling = nodes.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("h").alias(f"_h{d}"))
        place = F.col("pos") - slot + (slot + d) % fan
        shifted = shifted.join(sibling, (F.col("key") == F.col("_key")) & (place == F.col("_pos")), "left").drop("_key", "_pos")
    others = F.array(*[F.struct(((slot + d) % fan).alias("slot"), F.coalesce(f"_h{d}", F.lit("")).alias("h")) for d in range(1, fan)])
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.filter(others, keep)), lambda x: x["h"]), "")
    return shifted.select(
        *nodes.columns, joined(lambda x: x["slot"] < slot).alias("before"), joined(lambda x: x["slot"] > slot).alias("after")
    )


def grow(nodes: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees of all keys from the leaves up, and their tops (key, level, h)."""
    levels: list[DataFrame] = []
    tops: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most:
        tops.append(nodes.where("n = 1").select("key", F.lit(len(levels)).alias("level"), "h"))
        if most == 1:
            break
        level = stored(with_siblings(nodes.where("n > 1"), fan))
        levels.append(level)
        up = lambda c: ((c - c % fan) / fan).cast("long")
        first = level.where(F.col("pos") % fan == 0)
        nodes = first.select("key", up(F.col("pos")).alias("pos"), up(F.col("n") + fan - 1).alias("n"), digest(F.col("h"), F.col("after")).alias("h"))
        most = -(-most // fan)
    return levels, stored(reduce(DataFrame.unionByName, tops)) if tops else nodes.select("key", F.lit(0).alias("level"), "h")


PROOF = "array<struct<before:string,after:string>>"


def proofs(levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """Every leaf of ``levels`` (and every top that is a leaf) with the siblings of its way up; ``tops`` has what lies above each."""
    own = lambda at: tops.where(F.col("level") == at).select("key", F.lit(0).cast("long").alias("pos"), "proof")
    above = own(len(levels))
    for at in reversed(range(len(levels))):
        parents = above.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("proof").alias("_above"))
        met = levels[at].join(parents, (F.col("key") == F.col("_key")) & (((F.col("pos") - F.col("pos") % fan) / fan).cast("long") == F.col("_pos")))
        proof = F.concat(F.array(F.struct("before", "after")), F.col("_above"))
        above = met.select("key", "pos", proof.alias("proof")).unionByName(own(at))
        if at:
            above = stored(above)
    return above


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, x: digest(x["before"], acc, x["after"]))


def manifest(docs: DataFrame, changed: Column | None = None, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, its proof, and the root folded from the leaf of the row as
    it is now: with the text ``changed`` where that is given, otherwise as it was.

    ``fan`` nodes make a run; 2 gives a binary tree.
    """
    source = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    now = leaf(changed) if changed is not None else leaf()
    rows = stored(docs.select(source.alias("key"), "doc_id", leaf().alias("h"), now.alias("_now")))
    leaves = stored(placed(rows, "key", ["doc_id", "h"]))
    levels, tops = grow(leaves.select("key", "pos", "n", "h"), fan)

    ordered = placed(tops.select(F.lit("").alias("key"), F.col("key").alias("_source"), "h"), "key", ["_source"])
    ordered = stored(ordered)
    upper, root = grow(ordered.select("key", "pos", "n", "h"), fan)
    top = root.first()
    root_proof = root.withColumn("proof", F.array().cast(PROOF))
    above = ordered.join(proofs(upper, root_proof, fan), ["key", "pos"]).select(F.col("_source").alias("key"), "proof")
    way = proofs(levels, tops.join(above, "key"), fan)

    known = leaves.join(way, ["key", "pos"]).join(tops.select("key", F.col("h").alias("subroot")), "key")
    made = known.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", F.lit(top["h"] if top else None).cast("string").alias("root"), "proof", folded(F.col("_now"), F.col("proof")).alias("folded_root")
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without its line breaks where 2 divides the checksum of the id; ids that are null keep theirs."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


SQL = f"""
WITH RECURSIVE bits AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT *, row_number() OVER () AS id, CAST(doc_id AS VARCHAR) AS said FROM documents),
sums AS (SELECT id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(said, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM d, tab),
e AS (SELECT d.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2 FROM d LEFT JOIN sums USING (id)),
x AS (SELECT id, doc_id, source,
    {" || ".join(f"coalesce(concat(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)), '-')" for c in FIELDS[:-1])} AS head, text, text2 FROM e),
leaf AS (SELECT id, doc_id, coalesce('+' || source, '') AS key,
    {", ".join(f"sha256(head || coalesce(concat(CAST(strlen({c}) AS VARCHAR), ':', {c}), '-')) AS {h}" for c, h in (("text", "h"), ("text2", "h2")))} FROM x),
lined AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h, id) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaf),
tree AS (SELECT key, 0 AS level, pos, n, h FROM lined
  UNION ALL SELECT key, level + 1, pos // {FAN}, CAST(ceil(any_value(n) / {FAN}) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY key, level, pos // {FAN}),
top AS (SELECT key, level, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, pos, n, h FROM top
  UNION ALL SELECT level + 1, pos // {FAN}, CAST(ceil(any_value(n) / {FAN}) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos))
  FROM crown WHERE n > 1 GROUP BY level, pos // {FAN}),
root AS (SELECT h AS root FROM crown WHERE n = 1),
nodes AS (SELECT false AS upper, key, level, pos, n, h FROM tree UNION ALL SELECT true, '', level, pos, n, h FROM crown),
sib AS (SELECT a.upper, a.key, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.upper = b.upper AND a.key = b.key AND a.level = b.level AND a.pos // {FAN} = b.pos // {FAN} WHERE a.n > 1 GROUP BY ALL),
way AS (SELECT lined.id, lined.key, lined.h2 AS h, lined.pos, 0 AS level, false AS upper, '' AS said, lined.n FROM lined
  UNION ALL SELECT w.id, w.key, CASE WHEN s.pos IS NULL THEN w.h ELSE sha256(before || w.h || after) END, CASE WHEN s.pos IS NULL THEN t.pos ELSE w.pos // {FAN} END,
    CASE WHEN s.pos IS NULL THEN 0 ELSE w.level + 1 END, w.upper OR s.pos IS NULL, w.said || coalesce(before || after, ''),
    CASE WHEN s.pos IS NULL THEN t.n ELSE CAST(ceil(w.n / {FAN}) AS BIGINT) END
  FROM way w JOIN top t ON t.key = w.key LEFT JOIN sib s ON w.n > 1 AND s.upper = w.upper AND s.level = w.level AND s.pos = w.pos AND s.key = CASE WHEN w.upper THEN '' ELSE w.key END
  WHERE NOT (w.upper AND w.n = 1))
SELECT doc_id, lined.h AS leaf, top.h AS subroot, root, sha256(way.said) AS proof_sha256, way.h AS folded_root, way.h = root AS verified
FROM way JOIN lined ON lined.id = way.id JOIN top ON top.key = lined.key, root WHERE way.upper AND way.n = 1
"""
