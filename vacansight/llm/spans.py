"""Repeated passages, by sliding sentence spans.

Every run of ``RUN_SENTENCES`` consecutive sentences is hashed, whatever its length; a document with fewer
is one run, and a single sentence of ``LONG_WORDS`` words is a run by itself besides. Longer repeats are
covered by the runs inside them. Hashes meet globally: a run that occurs before, in an earlier document or
earlier in the same one, takes its sentences out of the document.

Each run travels once, to the place of its hash. A run so frequent that it would fill a good part of a task there
is found in a sample of the documents beforehand and dealt out over several tasks; their firsts are compared afterwards.
Which runs are dealt out does not change the result.
"""

from __future__ import annotations

import re
from struct import unpack

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansight.llm.common import mapped
from vacansight.session import cut_lineage

RUN_WORDS = 0  #: a run of several sentences goes on until it has so many words; 0 is no floor
RUN_SENTENCES = 2
LONG_WORDS = 40
SAMPLED = 32  #: one of so many documents is looked at for frequent runs
END = re.compile(r"[.!?]++[\"')\]]*+(?=\s)[^\S\n]*+\n*+|\n++")


def sentences(text: str) -> list[str]:
    """Pieces that end at a full stop, question or exclamation mark before white space, or at a line break; joined they are the text."""
    cuts = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def filled(pieces: list[str]) -> list[tuple[int, list[str]]]:
    """Place and words of the pieces that have words."""
    return [(i, w) for i, p in enumerate(pieces) if (w := p.lower().split())]


def runs(counts: list[int], words: int = RUN_WORDS, least: int = RUN_SENTENCES, long_: int = LONG_WORDS) -> list[tuple[int, int]]:
    """(first sentence, sentence after the last) of each run of sentences with ``counts`` words."""
    total = len(counts)
    if 0 < total < least:
        return [(0, total)] if sum(counts) >= words else []
    out, n, b = [], 0, 0
    for a in range(total):
        while b < total and (n < words or b - a < least):  # sentences a to b - 1 have n words
            n += counts[b]
            b += 1
        if counts[a] >= long_:
            out.append((a, a + 1))
        if n >= words and b - a >= least and (b - a > 1 or counts[a] < long_):
            out.append((a, b))
        n -= counts[a]
    return out


def hashed(text: str, **how) -> list[tuple[int, int]]:
    """128 bits for each run of a text, as two signed numbers. White space and case do not count."""
    marks, counts = [], []
    for _, w in filled(sentences(text)):
        counts.append(len(w))
        marks.append(xxhash.xxh3_128_digest(" ".join(w)))
    return [unpack("<qq", xxhash.xxh3_128_digest(b"".join(marks[a:b]))) for a, b in runs(counts, **how)]


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, row key and ``again``: which of the document's runs, in order, repeat an earlier one."""

    def start():
        def work(texts):
            found = [hashed(t or "", **how) for t in texts]
            return [None] * len(texts), [[x[0] for x in f] for f in found], [[x[1] for x in f] for f in found]

        return work

    def each(rows):
        made = mapped(rows, "_text", {"_text": "string", "k1": "array<bigint>", "k2": "array<bigint>"}, start)
        zipped = made.select("id", "row", F.posexplode(F.arrays_zip("k1", "k2")).alias("at", "x"))
        return zipped.select("id", "row", "at", "x.k1", "x.k2")

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("_text"))
    place = F.struct(F.col("id").isNull().alias("void"), "id", "row", "at")
    # frequent: more than a quarter of what a shuffle partition holds, by the sample; fewer than ``share`` runs can be that
    share = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = each(rows.where(F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(SAMPLED)) == 0)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"))
    sample = cut_lineage(sample.where("c > 1"))
    total = sample.agg(F.sum("c")).first()[0] or 0
    often = sample.where(F.col("c") * share > total).select("k1", "k2", F.ceil(F.col("c") * share / F.lit(max(total, 1))).alias("parts"))
    # a frequent run is dealt out over parts by its documents; the firsts of the parts, a few rows, are compared afterwards
    dealt = each(rows).join(F.broadcast(often), ["k1", "k2"], "left").withColumn("part", F.pmod(F.xxhash64(F.lit(17), "row"), "parts"))
    again = lambda *key: ~place.eqNullSafe(F.min(place).over(Window.partitionBy(*key)))
    # one number for both uses: a filter on the part alone would go below the window, and the runs would be made twice
    seen = dealt.withColumn("state", again("k1", "k2", "part").cast("int") * 2 + F.col("part").isNotNull().cast("int"))
    firsts = seen.where("state = 1").withColumn("state", again("k1", "k2").cast("int") * 2)
    later = seen.where("state >= 2").select("id", "row", "at").unionByName(firsts.where("state >= 2").select("id", "row", "at"))
    return later.groupBy("id", "row").agg(F.collect_set("at").alias("again"))


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the text that is left, ``n_sentences`` and ``n_removed``.

    Documents come in the order of their ids, null last, then of a hash of the text. Rows with the
    same id and text are one document, so neither takes sentences from the other. A null or empty
    text has no sentences and stays as it is; columns with the names of the new ones are replaced,
    any others keep their names and values.
    """
    gone = repeated(docs, id_col, text_col, **how).select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), "again")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("own"), F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    joined = rows.join(gone, (F.col("row") == F.col("gone_row")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    # the numbers travel to the text as one string, so that text stays the only column read there
    again = F.coalesce(F.array_join("again", ","), F.lit(""))
    joined = joined.select("own", F.when(F.col("text").isNotNull(), F.concat(again, F.lit("\n"), F.col("text"))).alias("text"))

    def start():
        def work(texts):
            kept, total, removed = [], [], []
            for t in texts:
                head, _, body = (t or "").partition("\n")
                pieces, out = sentences(body), set()
                if head:
                    full = filled(pieces)
                    known = runs([len(w) for _, w in full], **how)
                    for n in head.split(","):
                        a, b = known[int(n)]
                        out.update(range(full[a][0], full[b - 1][0] + 1))
                kept.append(None if t is None else "".join(p for i, p in enumerate(pieces) if i not in out))
                total.append(len(pieces))
                removed.append(len(out))
            return kept, total, removed

        return work

    made = mapped(joined, "text", {"text": "string", "n_sentences": "bigint", "n_removed": "bigint"}, start)
    back = [F.col("text").alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return made.select(*back, "n_sentences", "n_removed")
