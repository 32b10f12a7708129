"""How far the sources of a language lie apart, by run-length columns of term counts.

Every (language, source) group has a column: its count of each kept term of the language. The
vocabulary is put in an order that brings equal counts together (size class of the term, then
its counts in the largest sources), the columns are cut into blocks of ``BLOCK`` terms and run-length
encoded, and two columns are compared run by run: where their boundaries are intersected, the
divergence ``f`` of a term is multiplied by the length of the piece. The order only makes runs
longer; no result depends on it.

Defined results: a null text, language or source reads as ''. Rows that repeat are documents of
their own; other columns are not read. A language without a kept term gives its pairs the value 0
and no terms. An empty table gives no rows. Values that tie are ranked by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.llm.common import dealt_join, stored
from vacansight.session import with_dense_ids

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Terms of a block: the most that one encoded piece of a column can hold.
BLOCK = 8192
#: Sources in a tile: two tiles of one block are the most that meet in a task.
TILE = 32
#: Largest sources of a language whose counts order the vocabulary.
ORDERING = 6
#: Distinct (language, source, term) that a task holds before it hands its counts on.
HELD = 150_000

#: A to Z lower-cased, what is in no term a blank.
_FOLDED = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_COUNTED = "lang string, source string, term binary, n long, df long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term per group; a row with a null term says that the group exists."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    seen: set[tuple] = set()

    def rows_of(group: tuple, terms: Sequence[bytes | None], n: Sequence[int], df: Sequence[int]) -> pa.RecordBatch:
        names = [pa.repeat(pa.scalar(g, pa.string()), len(terms)) for g in group]
        return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["lang", "source", "term", "n", "df"])

    def hand_on() -> Iterator[pa.RecordBatch]:
        """What is held, group by group."""
        while held:
            group, (n, df) = held.popitem()
            yield rows_of(group, list(n), list(n.values()), [df[term] for term in n])

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for group, text in zip(zip(langs, sources), batch.column(2)):
            seen.add(group)
            if words := (text.as_py() or b"").translate(_FOLDED).split():
                n, df = held.get(group) or held.setdefault(group, (Counter(), Counter()))
                n.update(words)
                df.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from hand_on()
    yield from hand_on()
    for group in seen:
        yield rows_of(group, [None], [0], [0])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: counts added up in the tasks that read, then by whole key, so a frequent term is a row per task."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    parts = rows.mapInArrow(_count, _COUNTED)
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return stored(summed.withColumn("term", F.col("term").cast("string")))


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (size + 2 terms)), exact for every count a long can hold."""
    above = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(11,0)")
    below = (size + 2 * terms).cast("decimal(20,0)")
    return (F.call_function("div", above, below) + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, total``: terms in at least ``least`` documents of their language."""
    by_term = counts.where(F.col("term").isNotNull()).groupBy("lang", "term")
    return by_term.agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")


def ordered_vocabulary(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, term, pos``: places 0.. in each language, terms with like counts side by side."""
    largest = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    first = groups.withColumn("_r", F.row_number().over(largest)).where(F.col("_r") <= ORDERING).select("lang", "source", "_r")
    # at most ORDERING cells of a term are gathered
    near = cells.join(first, ["lang", "source"]).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("_r", "n"))).alias("_like"))
    keyed = kept.withColumn("_class", -F.floor(F.log2(F.col("total") + 1))).join(near, ["lang", "term"], "left")
    placed = with_dense_ids(stored(keyed.drop("total")), "_id", ["lang", "_class", "_like", "term"])
    placed = stored(placed.select("lang", "term", "_id"))
    firsts = placed.groupBy("lang").agg(F.min("_id").alias("_from"))
    return placed.join(firsts, "lang").select("lang", "term", (F.col("_id") - F.col("_from")).alias("pos"))


_ENCODED = "lang string, source string, block long, ends array<int>, p array<bigint>"


def encode(width: int, places: np.ndarray, counts: np.ndarray, size: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal shares over ``width`` terms of which only the given places have a count: ends (exclusive) and share of each."""
    column = np.zeros(width, np.int64)
    column[places] = counts
    last = np.append(np.flatnonzero(np.diff(column)), width - 1) if width else np.empty(0, np.int64)
    p = [1 + UNIT * (int(n) + 2) // (size + 2 * terms) for n in column[last]]
    return (last + 1).astype(np.int32), np.array(p, np.int64)


def run_sum(ends_a: np.ndarray, p_a: np.ndarray, ends_b: np.ndarray, p_b: np.ndarray) -> int:
    """Sum of f over all terms of two encoded pieces: one value per piece between boundaries of either, times its length."""
    ends = np.union1d(ends_a, ends_b)
    p, q = p_a[np.searchsorted(ends_a, ends)], p_b[np.searchsorted(ends_b, ends)]
    return int(((p - q) ** 2 // (p + q) * np.diff(ends, prepend=0)).sum())


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, shares = [], []
        for width, size, terms, cells in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
            at = np.array([c["pos"] for c in cells or ()], np.int64)
            e, p = encode(width, at, np.array([c["n"] for c in cells or ()], np.int64), size, terms)
            ends.append(e)
            shares.append(p)
        made = [pa.array(ends, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(batch.columns[:3] + made, ["lang", "source", "block", "ends", "p"])


def run_columns(cells: DataFrame, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, block, ends, p``: every column in run-length pieces of ``BLOCK`` terms, one empty piece where there is no term."""
    block, within = F.floor(F.col("pos") / BLOCK), (F.col("pos") % BLOCK).cast("int")
    full = cells.join(vocabulary, ["lang", "term"]).groupBy("lang", "source", block.alias("block"))
    full = full.agg(F.collect_list(F.struct(within.alias("pos"), "n")).alias("_cells"))
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("terms") - 1) / BLOCK), F.lit(0)))
    width = F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).cast("int")
    every = groups.select("lang", "source", "size", "terms", F.explode(blocks).alias("block"))
    pieces = every.join(full, ["lang", "source", "block"], "left")
    return pieces.select("lang", "source", "block", width, "size", "terms", "_cells").mapInArrow(_encode, _ENCODED)


def _tile_sums(group: pa.Table) -> pa.Table:
    """Both tiles of one block: the sum over the block of every pair across the tiles, or within the one tile."""
    lang, block = group.column("lang")[0].as_py(), group.column("block")[0].as_py()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    of = {i: [], j: []}
    for source, tile, ends, p in zip(*(group.column(c) for c in ("source", "tile", "ends", "p"))):
        of[tile.as_py()].append((source.as_py(), ends.values.to_numpy(), p.values.to_numpy()))
    rows = [
        (min(a, b), max(a, b), run_sum(ends_a, p_a, ends_b, p_b))
        for k, (a, ends_a, p_a) in enumerate(of[i])
        for b, ends_b, p_b in (of[j] if i != j else of[i][k + 1 :])
    ]
    a, b, value = zip(*rows) if rows else ((), (), ())
    n = len(rows)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "block": pa.array([block] * n, pa.int64()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` once per pair of sources of a language.

    The sources of a language are dealt into tiles, and each piece goes once to every pair of
    tiles that its own is part of: a task holds two tiles of one block, never a whole language.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_tiles"))
    dealt = columns.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("_tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))
    met = dealt.withColumn("_other", other).select(
        "lang", "source", "block", "ends", "p", "tile", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j")
    )
    sums = met.groupBy("lang", "block", "i", "j").applyInArrow(_tile_sums, "lang string, block long, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language by divergence of all kept terms. Part ``term``: the
    ``top`` terms that the group uses more than its language, by their divergence.
    """
    counts = term_counts(docs)
    kept = stored(kept_terms(counts, least))
    cells = stored(counts.where(F.col("term").isNotNull()).drop("df").join(kept, ["lang", "term"]))
    languages = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("_all")), "lang", "left").na.fill(0)
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(sizes, ["lang", "source"], "left").join(languages, "lang")
    groups = stored(groups.na.fill(0, ["size"]))

    columns = stored(run_columns(cells, ordered_vocabulary(kept, cells, groups), groups))
    pairs = pair_sums(columns, groups)
    ends = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", ends).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("_all"), F.col("terms"))
    shares = dealt_join(cells, groups, ["lang", "source"], "term", "inner").select("lang", "source", F.col("term").alias("item"), p.alias("_p"), q.alias("_q"))
    terms = shares.where(F.col("_p") > F.col("_q")).select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("_p"), F.col("_q")).alias("value"))

    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(best)


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS id FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
cell AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS size FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
gs AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN cell USING (lang, source) GROUP BY lang, source),
full_column AS (SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + 2)) // (gs.size + 2 * v) AS p, 1 + ({UNIT}::HUGEINT * (total + 2)) // (l.size + 2 * v) AS q
  FROM gs JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN cell USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM full_column a JOIN full_column b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every_term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM full_column WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM every_term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
