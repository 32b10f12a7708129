"""Fingerprints of documents by signed votes, and all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words; a term weighs as much as it has characters and is
counted as often as it occurs. Each of the 64 bits of a term's hash votes with that weight for
or against the bit of the fingerprint. Search cuts fingerprints into blocks: two that differ in
at most ``radius`` bits agree in some ``BLOCKS - radius`` whole blocks, so one table per choice
of that many blocks, joined on their bits, finds every such pair. All is DataFrame
expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.session import cut_lineage, with_dense_ids

BITS = 64
RADIUS = 3
BLOCKS = 6
SPLIT = r"[^\p{L}\p{N}]+"
HALF = 32  #: two sums travel in one long


def terms(text: Column) -> Column:
    """Hash and weight of each pair of neighbouring words; of the word itself where there is only one.

    The word array is bound once, by a one-element transform, so that no step splits the text again.
    """
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")

    def pairs(w):
        two = lambda i: F.struct(
            F.xxhash64(F.get(w, i - 1), F.get(w, i)).alias("h"), (F.char_length(F.get(w, i - 1)) + F.char_length(F.get(w, i))).cast("long").alias("w")
        )
        one = F.transform(w, lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).cast("long").alias("w")))
        return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), two)).otherwise(one)

    return F.transform(F.array(words), pairs)[0]


def fingerprints(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """``key``, ``copies`` (rows with that key) and ``fp``, the 64-bit fingerprint. Rows with one key must have one text.

    Votes are added up in the map tasks as the terms of a document come along; one row per
    document meets the others. Bits without a majority are 0, and so are all bits of a
    text without words.
    """
    rows = texts.select(*key, F.posexplode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "t"))
    rows = rows.select(*key, (F.coalesce(F.col("pos"), F.lit(0)) == 0).cast("long").alias("first"), F.col("t.h").alias("h"), F.coalesce(F.col("t.w"), F.lit(0).cast("long")).alias("w"))
    bit = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long"))
    sums = [F.sum(F.col("w") * (bit(i) + F.shiftleft(bit(i + HALF), HALF))).alias(f"s{i}") for i in range(HALF)]
    voted = rows.groupBy(*key).agg(F.sum("first").alias("copies"), F.sum("w").alias("all"), *sums)
    low = F.lit((1 << HALF) - 1)
    won = lambda c: (c * 2 > F.col("all")).cast("long")
    fp = F.lit(0).cast("long")
    for i in range(HALF):
        s = F.coalesce(F.col(f"s{i}"), F.lit(0).cast("long"))
        fp = fp.bitwiseOR(F.shiftleft(won(s.bitwiseAND(low)), i)).bitwiseOR(F.shiftleft(won(F.shiftrightunsigned(s, HALF)), i + HALF))
    return voted.select(*key, "copies", fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def near(queries: DataFrame, all_: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, other) of the distinct values of ``fp`` within ``radius`` bits, equal ones included.

    Each table holds the bits of one choice of blocks. A pair that agrees in several is
    kept only in the first, which its differing bits tell, so nothing has to be made distinct.
    """
    bounds = block_bounds(blocks)
    masks = [sum(((1 << (b - a)) - 1) << a for a, b in pick) for pick in combinations(bounds, blocks - radius)]
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(
        name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("_t", "_k")
    )
    differ = F.col("query").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(masks)])
    q, o = keyed(queries, "query"), keyed(all_, "other").withColumnsRenamed({"_t": "_u", "_k": "_l"})
    return q.join(o, (F.col("_t") == F.col("_u")) & (F.col("_k") == F.col("_l")) & (F.bit_count(differ) <= radius) & (first == F.col("_t"))).select("query", "other")


def edited(docs: DataFrame) -> DataFrame:
    """``id``, ``text``, ``n_chars``, ``next`` (the next id in ascending order, after the last the first) and ``changed``: the
    text whose last quarter is replaced by the beginning of the next document.

    Texts move once, by id, and only the beginnings that are needed move to the document before. Where an
    id has several texts, the next document is the smallest of them. A row without id has no
    next document, and its last quarter is dropped.
    """
    every = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = every.where("id is not null")  # in both joins below, so that they share one exchange of the texts
    sizes = text.select("id", F.char_length("text").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    ranked = cut_lineage(with_dense_ids(sizes, "rank", ["id"]))
    last = ranked.agg(F.max("rank")).first()[0] or 1
    after = ranked.select(F.col("id").alias("next"), F.col("rank").alias("_r"))
    circle = ranked.withColumn("_r", F.col("rank") % last + 1)
    follows = circle.join(after, "_r").select("id", "next", F.floor(F.col("n") / 4).cast("int").alias("need"))
    begins = text.join(follows.select(F.col("id").alias("before"), F.col("next").alias("id"), "need"), "id")
    begins = begins.groupBy("before").agg(F.min(F.expr("substring(text, 1, need)")).alias("begin"))
    out = text.join(begins.select(F.col("before").alias("id"), "begin"), "id", "left").join(follows.select("id", "next"), "id", "left")
    alone = every.where("id is null").withColumns({"begin": F.lit(""), "next": F.lit(None).cast(out.schema["next"].dataType)})
    out = out.unionByName(alone)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    out = out.withColumn("n_chars", n.cast("long")).withColumn("_q", quarter).withColumn("begin", F.coalesce("begin", F.lit("")))
    return out.select("id", "next", "text", "n_chars", F.expr("concat(substring(text, 1, cast(n_chars as int) - _q), substring(begin, 1, _q))").alias("changed"))


def compare(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, how alike these are and how like the next document's,
    and, for ids divisible by ``every``, how many other documents lie within ``radius`` bits.

    A null text counts as empty. Rows with the same id and text are answered alike, each. A row
    without id has neither ``near_next`` nor ``n_near``.
    """
    rows = edited(docs)
    both = rows.select(
        "id", "next", "n_chars", F.xxhash64("text").alias("th"), F.unhex(F.sha2(F.encode("changed", "UTF-8"), 256)).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("changed").alias("t")))).alias("x"),
    ).select("id", "next", "n_chars", "th", "edited_sha256", "x.v", "x.t")
    key = ["id", "next", "n_chars", "th", "edited_sha256"]
    made = fingerprints(both, [*key, "v"], "t")
    pairs = made.groupBy(*key).agg(F.max(F.when(F.col("v") == 0, F.col("copies"))).alias("copies"), F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited"))
    done = cut_lineage(pairs)
    follow = done.where("id is not null").groupBy("id").agg(F.min("fp").alias("next_fp")).withColumnRenamed("id", "next")
    per_fp = done.groupBy("fp").agg(F.sum("copies").alias("n"))
    asked = done.where(F.col("id") % every == 0)
    around = near(asked, per_fp, radius).join(per_fp.withColumnRenamed("fp", "other"), "other").groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("n_near"))
    out = done.join(follow, "next", "left").join(around, "fp", "left").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("id") % every == 0, F.col("n_near")).alias("n_near"),
    )
