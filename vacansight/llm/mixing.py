"""Mixing documents of overlapping sources to target weights, by a min-cost flow.

Documents are first added up by *membership pattern*, the set of sources a document
belongs to. On that small table a flow routes words from patterns to source quotas; using
a pattern a second and third time costs more and more, so nothing is repeated while unused
words remain. The flow says how many words of each pattern the mix takes; documents
are then chosen in the order of a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.llm.maxflow import Flow
from vacansight.session import cut_lineage, small_table, tasks_for

WEIGHTS = (5, 2, 1)  #: dealt to the sources in turn
REPEATS = 3  #: times a document is used at most
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4  #: hexadecimal digits of the hash that make a bucket
MOST_PATTERNS = 100_000


@dataclass
class Plan:
    targets: dict[str | None, float]
    sizes: dict[str | None, int]
    taken: dict[tuple, int]  #: words the mix takes of each pattern
    routed: dict[tuple[tuple, str | None], int]  #: of these, for which source


def by_code_point(names) -> list[str | None]:
    return sorted((n for n in names if n is not None)) + [n for n in names if n is None]


def targets_of(sizes: dict[str | None, int], weights=WEIGHTS, most: int = REPEATS) -> dict[str | None, float]:
    """Shares of all words by weight. A target over ``most`` times its source is cut to that and the excess
    dealt out anew by weight among the others, until none is above."""
    order = by_code_point(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    while rest := [s for s in order if s not in out]:
        share = (sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if share * weight[s] > most * sizes[s]]
        out |= {s: float(most * sizes[s]) for s in above} if above else {s: share * weight[s] for s in rest}
    return {s: round(out[s], 6) for s in order}


def plan(patterns: dict[tuple, int], targets: dict[str | None, float], most: int = REPEATS) -> Plan:
    """Route the words of the patterns to the sources' quotas at the least cost of repetition.

    The k-th use of a pattern costs more than the one before, so the cheapest flow is the one
    that fills the quotas as far as it can with first uses, then with second ones, and so on:
    the capacities grow in rounds and the flow goes on from where it stood.
    """
    keys, names = list(patterns), list(targets)
    flow = Flow(2 + len(keys) + len(names))
    first, arcs = [], {}
    for i, p in enumerate(keys):
        first.append(flow.edge(0, 2 + i, 0))
        for s in p:
            arcs[p, s] = flow.edge(2 + i, 2 + len(keys) + names.index(s), most * patterns[p])
    for j, s in enumerate(names):
        flow.edge(2 + len(keys) + j, 1, round(targets[s]))
    for _ in range(most):
        for i, p in enumerate(keys):
            flow.left[first[i]] += patterns[p]
        flow.run(0, 1)
    sizes: dict[str | None, int] = dict.fromkeys(names, 0)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    return Plan(targets, sizes, {p: flow.left[first[i] ^ 1] for i, p in enumerate(keys)}, {k: flow.left[e ^ 1] for k, e in arcs.items()})


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def prefix(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` with ``_full`` and ``_more``, 1 for those that come before the running sum of their pattern, in the order of the hash, exceeds its rest."""
    # the sums of the hash buckets tell which buckets are in, which out, and the one in which the rest ends
    bucket = F.substring("_h", 1, BUCKETS)
    per = rows.groupBy("_p", bucket.alias("_b")).agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(asked, "_p")
    cut = cut.where(F.col("_before") <= F.col("_rest")).where(F.col("_before") + F.col("_n") > F.col("_rest")).groupBy("_p").agg(F.max("_b").alias("_edge"), F.max_by("_before", "_b").alias("_base"))
    ends = cut_lineage(asked.join(cut, "_p", "left"))
    ends = small_table(rows.sparkSession, [tuple(r) for r in ends.collect()], "_p string, _full bigint, _rest bigint, _edge string, _base bigint")

    placed = rows.join(F.broadcast(ends), "_p").withColumn("_b", bucket)
    # only rows of a pattern's last bucket need an order among themselves
    edge = placed.where(F.col("_b") == F.col("_edge"))
    order = Window.partitionBy("_p").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = edge.withColumn("_at", F.col("_base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = inside.withColumn("_more", (F.col("_at") + F.col("size") <= F.col("_rest")).cast("long"))
    others = placed.where(F.col("_edge").isNull() | (F.col("_b") != F.col("_edge")))
    # without an edge all rows together stay within the rest
    others = others.withColumn("_more", F.coalesce(F.col("_b") < F.col("_edge"), F.lit(True)).cast("long"))
    keep = [*rows.columns, "_full", "_more"]
    return others.select(*keep).unionByName(inside.select(*keep))


def mix(docs: DataFrame, sources: Column, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", weights=WEIGHTS, most: int = REPEATS) -> DataFrame:
    """One row per document: id, ``size`` in words, its ``pattern`` (sorted array of sources, null last) and ``taken``,
    the words the mix takes of it, whole copies of the document.

    ``sources`` is an array. Of each pattern every document is used as often as the flow's words
    allow; the rest is filled in the order of md5(seed:id) by each document that still fits, and by the
    one document whose size comes nearest to what is then missing. A null text has size 0 and takes nothing; a document without sources is
    in none and takes nothing; rows that repeat are documents of their own.
    """
    missing = F.exists(sources, lambda x: x.isNull())
    tidy = F.array_sort(F.array_distinct(F.filter(sources, lambda x: x.isNotNull())))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            word_count(F.col(text_col)).alias("size"),
            F.coalesce(F.when(missing, F.concat(tidy, F.array(F.lit(None).cast("string")))).otherwise(tidy), F.array().cast("array<string>")).alias("pattern"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_h"),
        ).withColumns({"_p": F.to_json("pattern"), "_row": F.monotonically_increasing_id()})
    )
    spark = docs.sparkSession
    sums = rows.groupBy("_p", "pattern").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    tasks = tasks_for(spark, sum(r["docs"] for r in sums))
    patterns = {tuple(r["pattern"]): r["n"] for r in sums}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    made = plan(patterns, targets_of(sizes, weights, most), most)
    uses = []
    for r in sums:
        words, n = made.taken[tuple(r["pattern"])], r["n"]
        full = min(most, floor(words / n)) if n else 0
        uses.append((r["_p"], full, int(words - full * n)))
    asked = small_table(spark, uses, "_p string, _full bigint, _rest bigint")

    chosen = cut_lineage(prefix(rows, asked), tasks)
    sums_of = lambda df: {r["_p"]: r["n"] for r in df.groupBy("_p").agg(F.sum(F.col("size") * F.col("_more")).alias("n")).collect()}
    have = sums_of(chosen)
    gaps = {p: rest - have.get(p, 0) for p, _, rest in uses}
    # the gap only shrinks, so what does not fit into it now never will
    parts, pool = [], chosen
    while True:
        still = [(p, full, gaps[p]) for p, full, _ in uses if gaps[p] > 0 and full < most]
        gap = small_table(spark, still, "_p string, _full bigint, _rest bigint")
        pool = pool.join(F.broadcast(gap.select("_p", F.col("_rest").alias("_gap"))), "_p", "left")
        fits = F.coalesce((F.col("_more") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("_gap")), F.lit(False))
        parts.append(pool.where(~fits).drop("_gap"))
        again = pool.where(fits)
        if not still or again.isEmpty():
            chosen = reduce(DataFrame.unionByName, parts).coalesce(tasks)
            break
        pool = cut_lineage(prefix(again.select(*rows.columns), gap), tasks)
        for p, n in sums_of(pool).items():
            gaps[p] -= n

    # what is still missing goes to the one document whose size comes nearest, if that is nearer than none
    missed = small_table(spark, list(gaps.items()), "_p string, _gap bigint")
    left = chosen.where((F.col("_more") == 0) & (F.col("_full") < most)).join(F.broadcast(missed), "_p")
    left = left.withColumn("_off", F.abs(F.col("_gap") - F.col("size"))).where(F.col("_off") < F.col("_gap"))
    best = left.groupBy("_p").agg(F.min(F.struct("_off", "_h", "size", "_row")).alias("b")).collect()
    # by the number of its row: others may have the same id and size
    last = small_table(spark, [(r["_p"], r["b"]["_row"]) for r in best], "_p string, _row bigint")
    out = chosen.join(F.broadcast(last.withColumn("_last", F.lit(1))), ["_p", "_row"], "left")
    uses_ = F.col("_full") + F.col("_more") + F.coalesce(F.col("_last"), F.lit(0))
    return out.select("doc_id", "size", "pattern", (F.col("size") * F.least(uses_, F.lit(most))).alias("taken"))


def mix_single(docs: DataFrame, source_col: str = "source", **how) -> DataFrame:
    """The mix of documents that have one source each, null being a source of its own: with the
    source's words, ``source_size``, and its ``target``."""
    out = cut_lineage(mix(docs, F.array(F.col(source_col)), **how))
    sizes = {r["s"]: r["n"] for r in out.groupBy(F.col("pattern")[0].alias("s")).agg(F.sum("size").alias("n")).limit(MOST_PATTERNS).collect()}
    goals = targets_of(sizes, how.get("weights", WEIGHTS), how.get("most", REPEATS))
    rows = small_table(docs.sparkSession, [(s, sizes[s], goals[s]) for s in goals], "source string, source_size bigint, target double")
    named = out.withColumn("_s", F.col("pattern")[0])
    return named.join(F.broadcast(rows), named["_s"].eqNullSafe(rows["source"])).select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (
  SELECT source, sum(size) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (SELECT *, 3 * n AS cap, row_number() OVER (ORDER BY 3 * n / CAST(w AS DOUBLE), source NULLS LAST) AS k FROM s),
c AS (
  SELECT *, CAST((sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT min_by(level, k) AS level FROM c WHERE level * w <= cap),
t AS (SELECT source, n, round(least(CAST(cap AS DOUBLE), w * v.level), 6) AS target FROM c, v),
g AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
u AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE quota // n END AS uses FROM g),
p AS (
  SELECT i, d.doc_id, d.source, d.size, u.n, u.target, u.uses, u.quota - u.uses * u.n AS rest, h,
    row_number() OVER (PARTITION BY d.source ORDER BY h, d.size, i) AS k
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
e AS (  -- from place ``since`` on every document of at most ``room`` words is taken, up to the first for which they do not suffice together
  SELECT DISTINCT source, CAST(rest AS HUGEINT) AS room, CAST(0 AS BIGINT) AS since FROM p
  UNION ALL
  SELECT source, room - coalesce(sum(size) FILTER (WHERE upto <= room), 0), min(k) FILTER (WHERE upto > room) FROM (
    SELECT e.source, e.room, p.k, p.size, sum(p.size) OVER (PARTITION BY e.source ORDER BY p.k) AS upto
    FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND p.k > e.since AND p.size > 0 AND p.size <= e.room)
  GROUP BY source, room HAVING min(k) FILTER (WHERE upto > room) IS NOT NULL),
f AS (SELECT *, lead(since) OVER (PARTITION BY source ORDER BY since) AS till FROM e),
m AS (
  SELECT p.*, CASE WHEN size <= room THEN 1 ELSE 0 END AS more FROM p LEFT JOIN f
  ON p.source IS NOT DISTINCT FROM f.source AND p.k > f.since AND p.k < coalesce(f.till, p.k + 1)),
q AS (SELECT *, rest - sum(size * more) OVER (PARTITION BY source) AS gap FROM m),
l AS (
  SELECT source, min((abs(gap - size), h, size, i)) AS best FROM q
  WHERE more = 0 AND uses < 3 AND abs(gap - size) < gap GROUP BY source)
SELECT doc_id, q.source AS source, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(size * least(3, uses + more + CASE WHEN (abs(gap - size), h, size, i) = best THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q LEFT JOIN l ON q.source IS NOT DISTINCT FROM l.source
"""
