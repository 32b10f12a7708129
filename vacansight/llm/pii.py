"""Personal data, by weak supervision.

Several labelers look at every candidate span and vote yes, no or nothing: a strict
pattern, a gazetteer, the words before it and what touches it. Votes and a few features
make up a *cell*; the cells of all candidates of the corpus are counted by Spark, which
leaves a table of at most a few thousand rows however large the corpus is. On it
expectation-maximisation estimates how reliable each labeler is for each kind, and a
logistic classifier is trained on the resulting probabilities. Spans of the base patterns
always count; other candidates count where the classifier says so.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansight.llm.common import mapped

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ZONE = re.compile(r"[0-9(+][0-9 .()+-]*+")
SPELT_MARK = re.compile(r"[\[({] ?at ?[\])}]", re.I)
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?dot ?[\])}] ?|\.)[A-Za-z0-9-]{1,63})+", re.I)
NATIONAL = re.compile(r"(?<![0-9+.])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")

ENDINGS = frozenset("com org net edu gov io info eu de fr es uk us it nl ch at be".split())
CODES = ("1", "33", "34", "49", "44", "39", "41", "43", "31", "32", "7", "81", "86", "91", "55", "52")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
CUES = {
    "email": "mail e-mail email contact write courriel correo kontakt schreiben".split(),
    "ip": "ip host server address adresse serveur servidor login".split(),
    "card": "card visa mastercard amex karte carte tarjeta credit payment".split(),
    "phone": "phone tel call mobile fax telefon téléphone teléfono telephone appelez llame anrufen".split(),
}
AGAINST = frozenset("version isbn order invoice id ref no page build release commande pedido bestellung".split())
WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base matches that hold and of those that fail their check.

    Linear in the text, with the answer of the plain patterns: numbers are looked for only in
    stretches made of the characters such a match can have.
    """
    found, failed, done = [], [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    for zone in number_zones(text):
        for m in IP.finditer(text, *zone):
            good = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (found if good else failed).append((1, *m.span()))
        for m in CARD.finditer(text, *zone):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() > 12 else ""
            if 13 <= len(digits) <= 19:
                (found if luhn(digits) else failed).append((2, *m.span()))
        for m in PHONE.finditer(text, *zone):
            if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found, failed


def number_zones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ZONE.finditer(text) if m.end() - m.start() > 6]


def candidates(text: str) -> tuple[list, list]:
    """Base spans, and the other spans that labelers are asked about. Of these none overlaps a base span or an earlier one."""
    base, more = base_spans(text)
    if SPELT_MARK.search(text):
        more += [(0, *m.span()) for m in SPELT.finditer(text)]
    more += [(3, *m.span()) for zone in number_zones(text) for m in NATIONAL.finditer(text, *zone)]
    taken, free = sorted((s, e) for _, s, e in base), []
    if more:
        more.sort(key=lambda x: (x[1], x[0]))
        i, end = 0, 0
        for k, s, e in more:
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if s >= end and (i == len(taken) or taken[i][0] >= e):
                free.append((k, s, e))
                end = e
    return base, free


def cell(text: str, kind: int, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """kind, four votes (1 yes, 2 no, 0 nothing), length class, separator class."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:
        known = 1 if span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower().strip(")]}") in ENDINGS else 2
    elif kind == 1:
        known = 2 if span.startswith(("0.", "255.", "127.")) else 0
    elif kind == 2:
        known = 1 if digits.startswith(ISSUERS) else 2
    else:
        known = (1 if digits.startswith(CODES) else 2) if span[0] == "+" else 0
    before = {w.lower() for w in WORD.findall(text[max(0, start - 32) : start])}
    said = 1 if before.intersection(CUES[name]) else 2 if before & AGAINST else 0
    touched = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    strict = 1 if is_base else 2 if kind in (1, 2) else 0
    return kind, strict, known, said, 2 if touched else 1, min(3, (end - start) // 8), 0 if span.isalnum() else 1 if " " in span else 2


def features(c: tuple[int, ...]) -> list[int]:
    """Places of the ones in a cell's feature vector."""
    kind, *votes, length, sep = c
    return [kind] + [4 + 3 * i + v for i, v in enumerate(votes)] + [16 + 12 * kind + 3 * i + v for i, v in enumerate(votes)] + [64 + length, 68 + sep]


WIDTH = 71


def reliabilities(cells: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation per kind: the probability of each cell, from the counts of the votes."""
    out = {}
    for kind in range(len(KINDS)):
        rows = sorted(c for c in cells if c[0] == kind)
        if not rows:
            continue
        n = np.array([cells[c] for c in rows], float)
        votes = np.array([c[1:5] for c in rows])
        # to begin with, votes count for what a sober reader gives them; the pattern most
        weight = np.array([4.0, 1.0, 1.5, 0.5])
        p = 1 / (1 + np.exp(-((votes == 1) @ weight - (votes == 2) @ weight)))
        for _ in range(rounds):
            prior = ((p * n).sum() + 1) / (n.sum() + 2)
            logit = np.full(len(rows), np.log(prior / (1 - prior)))
            for j in range(4):
                yes = np.array([(p * n * (votes[:, j] == v)).sum() for v in range(3)]) + 1
                no = np.array([((1 - p) * n * (votes[:, j] == v)).sum() for v in range(3)]) + 1
                logit += (np.log(yes / yes.sum()) - np.log(no / no.sum()))[votes[:, j]] * (0.5 if j else 1)
                logit += ((votes[:, j] == 1) * 1.0 - (votes[:, j] == 2)) * weight[j] / 4  # a labeler is never worse than chance
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out |= dict(zip(rows, p.tolist()))
    return out


def classifier(cells: dict[tuple[int, ...], int], p: dict[tuple[int, ...], float], steps: int = 400) -> np.ndarray:
    """Weighted logistic regression of the estimated probabilities on the features."""
    rows = sorted(cells)
    x = np.zeros((len(rows), WIDTH))
    for i, c in enumerate(rows):
        x[i, features(c)] = 1
    y, n = np.array([p[c] for c in rows]), np.sqrt([cells[c] for c in rows])
    n, w = n / max(n.sum(), 1), np.zeros(WIDTH)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ w))
        w -= 4 * (x.T @ ((q - y) * n) + 1e-4 * w)
    return w


def cell_counts(docs: DataFrame, text_col: str = "text") -> dict[tuple[int, ...], int]:
    """How often each cell occurs in all texts. The result has at most 4 * 3**4 * 12 rows."""

    def start():
        def work(texts):
            made = []
            for t in texts:
                base, more = candidates(t or "")
                made.append([list(cell(t, *s, True)) for s in base] + [list(cell(t, *s, False)) for s in more])
            return (made,)

        return work

    rows = mapped(docs.select(text_col), text_col, {text_col: "string", "_cells": "array<array<bigint>>"}, lambda: (lambda f: lambda ts: ([None] * len(ts), *f(ts)))(start()))
    return {tuple(r["c"]): r["n"] for r in rows.select(F.explode("_cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights of the span classifier, from all texts."""
    cells = cell_counts(docs, text_col)
    return classifier(cells, reliabilities(cells))


def spans_of(text: str, weights: np.ndarray, threshold: float = 0.5) -> tuple[list, list]:
    """Base spans and all spans, both by kind and start."""
    base, more = candidates(text)
    bar = np.log(threshold / (1 - threshold))
    added = [s for s in more if weights[features(cell(text, *s, False))].sum() > bar]
    return sorted(base), sorted(base + added)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def annotate(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the number of base spans of each kind, their digest and all spans.

    Positions are code points, ends exclusive. A null or empty text has no spans. Columns
    with the names of the new ones are replaced; repeated rows are answered alike.
    """
    fields = {f"n_{k}": "bigint" for k in KINDS} | {"base_sha256": "string", "spans": "string"}

    def start():
        def work(texts):
            out = [[] for _ in fields]
            for t in texts:
                base, every = spans_of(t or "", weights)
                row = [sum(s[0] == k for s in base) for k in range(4)]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)]
                for column, v in zip(out, row):
                    column.append(v)
            return out

        return work

    if keep_text:
        return mapped(docs, text_col, fields, start)
    bare = {text_col: "string"}
    return mapped(docs, text_col, bare | fields, lambda: (lambda f: lambda ts: ([None] * len(ts), *f(ts)))(start())).drop(text_col)


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span written as ``[KIND]``; overlapping spans become one, named after the first.

    A text without spans, null included, stays as it is. The size column, if there is one, follows the text.
    """

    def start():
        def work(texts):
            out = []
            for t in texts:
                parts, at = [], 0
                for k, s, e in sorted(spans_of(t or "", weights)[1], key=lambda x: (x[1], -x[2], x[0])):
                    if s >= at:
                        parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append("".join(parts) + t[at:] if parts else t)
            return (out,)

        return work

    done = mapped(docs, text_col, {text_col: "string"}, start)
    if size_col in docs.columns:
        done = done.withColumn(size_col, F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast(docs.schema[size_col].dataType))
    return done.select(*docs.columns)
