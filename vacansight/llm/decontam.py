"""Test passages in training texts, by spaced seeds.

A seed is a mask over consecutive words that ignores some places, so a hit survives
substituted words there. Seeds of the test items and of the documents meet by hash; around a hit
the item is laid along the document: if enough of all its words match there, they are the overlap,
otherwise the best-scoring stretch is, a point for a match and one off for a substitution. Test items are taken in blocks of bounded size,
each of which goes to all tasks, so documents are never shuffled.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansight.llm.common import mapped, set_aside, words_of

#: Places that count (1) and are ignored (0); together they bear a substitution in every third, fourth or fifth word.
MASKS = ("1110111", "11011011", "111101111", "1101011011")
#: For items of ``WHOLE`` to ``OVERLAP`` - 1 words: shorter ones, of which any that leaves the words asked for is hit.
SHORT_MASKS = ("1111", "11011", "11101", "10111", "110011", "110101", "110000011")
OVERLAP = 13  #: matching words in a stretch that make an overlap
SHARE = 0.5  #: or this share of an item's words, 8 at least
SHORT_SHARE = 2 / 3  #: this share of an item that has fewer than ``OVERLAP`` words
WHOLE = 8  #: an item with fewer words must match whole
BLOCK_WORDS = 500_000  #: words of test items that are sent out together


class Seeds:
    """Seed tables of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, words_of(t)) for i, t in items]
        self.vocab: dict[bytes, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)) for i, ws in split if ws]
        rng = np.random.default_rng(5)
        self.number = np.concatenate([[0], rng.integers(1, 2**62, len(self.vocab))]).astype(np.uint64)
        self.power = (rng.integers(1, 2**62, 64) * 2 + 1).astype(np.uint64)
        short = sorted({len(ws) for _, ws in self.items if len(ws) < min(map(len, MASKS))})
        some = SHORT_MASKS if any(WHOLE <= len(ws) < OVERLAP for _, ws in self.items) else ()
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in (*MASKS, *some)] + [np.arange(n) for n in short]
        self.tables = []
        for at, mask in enumerate(self.masks):
            keys, where = [], []
            for j, (_, ids) in enumerate(self.items):
                if len(MASKS) <= at < len(MASKS) + len(some) and not WHOLE <= len(ids) < OVERLAP:
                    continue
                hashed = self.hashed(self.weighted(ids), mask)
                keys.append(hashed)
                where += [(j, a) for a in range(len(hashed))]
            keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            marks = np.zeros(1 << 18, bool)  # a first look by 18 bits of the hash
            marks[keys >> np.uint64(46)] = True
            self.tables.append((keys[order], np.array(where, np.int64).reshape(-1, 2)[order], marks))

    def weighted(self, ids: np.ndarray) -> list[np.ndarray]:
        """Each word's number times the factor of each place of a mask; words of no item are 0."""
        value = self.number[ids]
        return [value * p for p in self.power[: max(len(m) for m in self.masks)]]

    def hashed(self, weighted: list[np.ndarray], mask: np.ndarray) -> np.ndarray:
        """Hashes of a mask laid on at every place."""
        n = len(weighted[0]) - int(mask[-1])
        if n <= 0:
            return np.empty(0, np.uint64)
        total = weighted[0][mask[0] : mask[0] + n].copy()
        for j in range(1, len(mask)):
            total += weighted[j][mask[j] : mask[j] + n]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return total

    def diagonals(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, place of its first word) of every seed hit."""
        found, weighted = set(), self.weighted(ids)
        for mask, (keys, where, marks) in zip(self.masks, self.tables):
            hashed = self.hashed(weighted, mask)
            at = np.flatnonzero(marks[hashed >> np.uint64(46)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, hashed[at]), np.searchsorted(keys, hashed[at], "right")
            real = hi > lo
            for a, b, place in zip(lo[real].tolist(), hi[real].tolist(), at[real].tolist()):
                found.update((j, place, k) for j, k in where[a:b].tolist())
        return found

    def overlap(self, ids: np.ndarray, j: int, offset: int) -> tuple[int, int, int]:
        """(first word, word after the last, matches) along a diagonal: of the whole item if its share matches, or of the best stretch."""
        item = self.items[j][1]
        a, b = max(0, offset), min(len(ids), offset + len(item))
        same = ids[a:b] == item[a - offset : b - offset]
        places = np.flatnonzero(same)
        if len(item) < OVERLAP or len(places) >= self.share(j):
            return a + int(places[0]), a + int(places[-1]) + 1, len(places)
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
        low = np.minimum.accumulate(score)
        end = int(np.argmax(score - low))
        start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
        return a + start, a + end, int(same[start:end].sum())

    def share(self, j: int) -> int:
        """Matching words, anywhere in the item, that are enough."""
        n = len(self.items[j][1])
        if n < OVERLAP:
            return n if n < WHOLE else ceil(SHORT_SHARE * n)
        return max(8, ceil(SHARE * n))

    def enough(self, j: int, matches: int) -> bool:
        return matches >= min(OVERLAP, self.share(j))

    def hits(self, texts: list[str | None], together: int = 200_000) -> list[list[list[int]]]:
        """For each text (item, first word, word after the last, matches) of each overlap, the best one per item.

        Texts are laid end to end, ``together`` words at a time, so that short ones cost no call of their own.
        """
        out: list[list[list[int]]] = [[] for _ in texts]
        known, ids, starts = self.vocab.get, [], []

        def run() -> None:
            row, at = np.array(ids, np.int64), np.array([s for _, s, _ in starts])
            best: dict[tuple[int, int], tuple] = {}
            tried = set()
            for j, place, k in sorted(self.diagonals(row)):
                d = int(np.searchsorted(at, place, "right")) - 1
                i, start, size = starts[d]
                if place >= start + size or (d, j, place - k) in tried:
                    continue
                tried.add((d, j, place - k))
                a, b, n = self.overlap(row[start : start + size], j, place - k - start)
                if self.enough(j, n):
                    key = i, self.items[j][0]
                    best[key] = max(best.get(key, (0,)), (n, -a, b))
            for (i, item), x in sorted(best.items()):
                out[i].append([item, -x[1], x[2], x[0]])
            ids.clear()
            starts.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            if words and self.items:
                starts.append((i, len(ids), len(words)))
                ids += [known(w, 0) for w in words]
                if len(ids) >= together:
                    run()
        if ids:
            run()
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_WORDS) -> list[Seeds]:
    """The test items in blocks of at most ``most`` words, or of one item. Items without id or text have no seeds.

    The benchmark is the stated query set; it comes to the driver item by item, one block at a time.
    """
    out, items, size = [], [], 0
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).orderBy(id_col, text_col)
    for item, text in rows.toLocalIterator():
        n = len(words_of(text))
        if items and size + n > most:
            out.append(Seeds(items))
            items, size = [], 0
        items.append((item, text))
        size += n
    return [*out, Seeds(items)] if items else out


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep_text: bool = False, **how) -> DataFrame:
    """``docs`` with ``hits``, an array of (item, first word, word after the last, matching words), one per item.

    Null and empty texts have none; repeated rows are answered alike; a column of that name is replaced.
    """
    out = docs
    made = blocks(benchmark, **how)
    spark = docs.sparkSession
    if not made:
        out = docs.withColumn("hits", F.array().cast("array<array<bigint>>"))
    for i, seeds in enumerate(made):
        sent = spark.sparkContext.broadcast(seeds)

        def start(sent=sent):
            table = sent.value

            def work(texts):
                found = table.hits(texts)
                return (found,) if keep_text or i < len(made) - 1 else ([None] * len(texts), found)

            return work

        drop = {} if keep_text or i < len(made) - 1 else {text_col: "string"}
        out = mapped(out, text_col, drop | {f"_hits{i}" if len(made) > 1 else "hits": "array<array<bigint>>"}, start)
    if len(made) > 1:
        out = out.withColumn("hits", F.concat(*[f"_hits{i}" for i in range(len(made))])).drop(*[f"_hits{i}" for i in range(len(made))])
    return out


def pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, first_word, last_word (exclusive), n_match."""
    found = hits(docs.select(id_col, text_col), benchmark, text_col, **how).select(F.col(id_col).alias("doc_id"), F.explode("hits").alias("h"))
    return found.select("doc_id", *[F.col("h")[i].alias(c) for i, c in enumerate(("item_id", "first_word", "last_word", "n_match"))])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that overlap with a test item; columns of any name stay as they are."""
    own, back = set_aside(docs, {c for c in docs.columns if re.fullmatch("hits|_hits[0-9]+", c)})
    return hits(own, benchmark, text_col, keep_text=True, **how).where(F.size("hits") == 0).select(*back)
