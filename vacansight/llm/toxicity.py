"""Toxicity categories by a chain of classifiers.

Each category has a linear model over the words and stems of a text, and the models stand in a row: each also
gets the probabilities of all categories before it. While training these are out-of-fold
predictions, so that a later model learns from what an earlier one would say of a text it has not
seen. The last link is toxicity as a whole, from the labels; the ones before it are kinds of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansight.llm.common import mapped, set_aside, words_of
from vacansight.session import cut_lineage

#: Kinds of toxicity, each named by a few words. A row labelled toxic is of a kind if it has one of its words.
KINDS = {
    "insult": "idiot moron stupid loser clown fool dumb imbécile idiota dummkopf".split(),
    "contempt": "worthless pathetic disgusting trash garbage useless vermin filth inútil wertlos".split(),
    "threat": "kill hurt destroy beat die tuer matar töten burn shoot".split(),
}
SAMPLE = 8_000  #: labelled rows that training takes, in the order of a hash of their id
MARKS = 300  #: words and stems that become features
STEMS = range(4, 9)  #: bytes of a stem
LEAST_Z = 4.0  #: how far a mark's share among toxic rows must lie from that among others
FOLDS = 5


def marks_of(words: list[bytes]) -> set[bytes]:
    """The words, and each beginning that two or three different longer words share: the inflected forms of one stem."""
    distinct, shared = set(words), {}
    for w in distinct:
        for k in STEMS:
            if len(w) <= k:
                break
            stem = w[:k]
            shared[stem] = shared.get(stem, 0) + 1
    out = {b"=" + w for w in distinct}
    for stem, n in shared.items():
        if n > 1:
            out.add(stem + b"*2")
            if n > 2:
                out.add(stem + b"*3")
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 2e-5) -> np.ndarray:
    """Accelerated gradient descent; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros(x.shape[1], np.float32)
    rate = 4 / max(float((x * x).sum(axis=1).mean()), 1.0)
    ahead, before = w.copy(), w
    for i in range(steps):
        new = ahead - rate * (x.T @ (sigmoid(x @ ahead) - y) / len(y) + ridge * ahead)
        ahead, before = new + i / (i + 3) * (new - before), new
    return before


@dataclass
class Chain:
    names: list[str]
    vocab: dict[bytes, int]
    weights: list[np.ndarray]  #: of marks, then of earlier links, then the bias

    def probabilities(self, words: list[bytes]) -> list[float]:
        places = [self.vocab[w] for w in marks_of(words) & self.vocab.keys()]
        out: list[float] = []
        n = len(self.vocab)
        for w in self.weights:
            out.append(float(sigmoid(w[places].sum() + np.dot(w[n:-1], out) + w[-1])))
        return out


def train(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """labels: (rows, links). One weight vector per link."""
    weights, earlier = [], np.empty((len(x), 0), np.float32)
    for c in range(labels.shape[1]):
        both, y = np.concatenate([x, earlier], axis=1), labels[:, c].astype(np.float32)
        weights.append(logistic(both, y))
        unseen = np.zeros(len(x), np.float32)
        for k in range(FOLDS):
            test = fold == k
            if test.any() and not test.all():
                w = logistic(both[~test], y[~test])
                unseen[test] = sigmoid(both[test] @ w[:-1] + w[-1])
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, kinds: dict[str, list[str]] = KINDS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, marks: int = MARKS
) -> Chain | None:
    """Learn from ``sample`` labelled rows. Labels without id or value and documents without text take
    no part; of an id labelled twice the larger label counts. None if there is nothing to learn from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id", F.desc("y")).limit(sample).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def start():
        def work(rows):
            return [None] * len(rows), [sorted(w.decode("latin-1") for w in marks_of(words_of(t))) for t in rows]

        return work

    # the picked rows are at most ``sample`` ids and labels
    rows = cut_lineage(mapped(texts.join(F.broadcast(picked), "id"), "text", {"text": "string", "words": "array<string>"}, start).select("id", "y", "words"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    n1, n0 = total.get(1, 0), total.get(0, 0)
    per = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    share = (F.col("c1") + F.col("c0")) / (n1 + n0)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    best = per.where(F.col("c1") + F.col("c0") >= 5).where(share < 1).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(marks).collect()
    vocab = {r["w"].encode("latin-1"): i for i, r in enumerate(best)}
    names = {k: frozenset("=" + w.encode().decode("latin-1") for w in v) for k, v in kinds.items()}

    def places(row_words: list[str]) -> tuple[list[int], list[int]]:
        return [vocab[m] for w in row_words if (m := w.encode("latin-1")) in vocab], [int(not v.isdisjoint(row_words)) for v in names.values()]

    wanted = sorted({r["w"] for r in best} | set().union(*names.values()))
    few = rows.select("id", "y", F.array_intersect("words", F.array(*[F.lit(w) for w in wanted])).alias("words")).collect()
    few.sort(key=lambda r: str(r["id"]))
    x, y = np.zeros((len(few), len(vocab)), np.float32), np.zeros((len(few), len(names) + 1), np.float32)
    for i, r in enumerate(few):
        at, of = places(r["words"])
        x[i, at] = 1
        y[i] = [*(r["y"] * k for k in of), r["y"]]
    return Chain([*names, label_col], vocab, train(x, y, np.arange(len(few)) % FOLDS))


def score(docs: DataFrame, chain: Chain | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the probability of each link as ``p_<name>``; the last is that of being toxic.

    A null or empty text scores 0 throughout, and so does every text where there was nothing to learn
    from. Columns with these names are replaced; repeated rows are answered alike.
    """
    if chain is None:
        return docs.withColumns({f"p_{k}": F.lit(0.0) for k in [*KINDS, "toxic"]})
    fields = {f"p_{k}": "double" for k in chain.names}

    def start():
        def work(texts):
            rows = [chain.probabilities(w) if (w := words_of(t)) else [0.0] * len(chain.names) for t in texts]
            columns = [[round(x, 6) for x in c] for c in zip(*rows)] if rows else [[] for _ in chain.names]
            return columns if keep_text else [[None] * len(texts), *columns]

        return work

    return mapped(docs, text_col, fields if keep_text else {text_col: "string"} | fields, start).drop(*[] if keep_text else [text_col])


def acceptable(docs: DataFrame, chain: Chain | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that are toxic with at least the threshold's probability; columns of any name stay as they are."""
    names = chain.names if chain else [*KINDS, "toxic"]
    own, back = set_aside(docs, {f"p_{k}" for k in names})
    return score(own, chain, text_col).where(F.col(f"p_{names[-1]}") < threshold).select(*back)
