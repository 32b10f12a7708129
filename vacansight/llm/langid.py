"""Language of a text, by a bidirectional gated recurrent network over its bytes.

Every byte of a text is labelled: two recurrent passes over a stretch of ``STRETCH``
bytes, one from each end, and a softmax over the learned languages at each position.
A document's probability is the mean over all its positions. Stretches are cut one
after the other over the whole text, so a text of any length takes memory for one
block of stretches only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacansight.llm.common import mapped

STRETCH = 128
BLOCK = 2048  #: stretches that are run together
UNKNOWN = "und"


class ByteNet:
    """Weights and both passes. Gates are ``(x / (1 + |x|) + 1) / 2``, the candidate state is ``x / (1 + |x|)``."""

    def __init__(self, labels: list[str], hidden: int, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.labels, self.h = labels, h
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, (2 * h, len(labels))), "bias": np.zeros(len(labels))}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 0.5, (256, 3 * h))
            self.p[f"rec_{d}"] = rng.normal(0, h**-0.5, (h, 3 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, ids: np.ndarray, mask: np.ndarray | None, d: str, keep: bool = False):
        """ids, mask: (time, batch); no mask: nothing is padded. States at every position; with
        ``keep`` also what the way back needs. Each gate has arrays of its own, so that they stay contiguous."""
        steps, n = ids.shape
        h, parts = self.h, lambda w: [np.ascontiguousarray(w[:, i * self.h : (i + 1) * self.h]) for i in range(3)]
        (w_z, w_r, w_c), (u_z, u_r, u_c) = parts(self.p[f"in_{d}"]), parts(self.p[f"rec_{d}"])
        out, state, trace = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32), [None] * steps

        def gate(x, low):
            np.abs(x, out=low)
            low += 1
            x /= low
            x += 1
            x *= 0.5
            return x

        low = np.empty((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z, r, cand, a = w_z.take(ids[t], axis=0), w_r.take(ids[t], axis=0), w_c.take(ids[t], axis=0), state @ u_c
            z += state @ u_z
            r += state @ u_r
            pre = (z.copy(), r.copy()) if keep else None
            gate(z, low), gate(r, low)
            cand += a * r
            np.abs(cand, out=low)
            low += 1
            cand /= low
            new = np.subtract(state, cand, out=out[t])
            new *= z
            new += cand
            if mask is not None:
                new *= mask[t].repeat(h).reshape(n, h)
            if keep:
                trace[t] = (state, a, np.concatenate(pre, axis=1), np.concatenate([z, r], axis=1), cand, low.copy())
            state = new
        return (out, trace) if keep else out

    def probabilities(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """(labels, positions)"""
        w, h = self.p["out"].T, self.h
        p = w[:, :h] @ ahead.reshape(-1, h).T
        p += w[:, h:] @ behind.reshape(-1, h).T
        p += self.p["bias"][:, None]
        np.exp(p, out=p)  # states lie within -1 and 1, so this stays in range
        p /= p.sum(axis=0)
        return p

    def position_sums(self, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Sum of the label probabilities over the positions of each stretch: (batch, labels)."""
        p = self.probabilities(self.states(ids, mask, "f"), self.states(ids, mask, "b")).reshape(-1, *ids.shape)
        return (p if mask is None else p * mask).sum(axis=1).T

    def gradients(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean cross-entropy over all positions."""
        steps, n = ids.shape
        h, g = self.h, {}
        passes = {d: self.states(ids, mask, d, keep=True) for d in "fb"}
        both = np.concatenate([passes["f"][0], passes["b"][0]], axis=2)
        p = np.ascontiguousarray(self.probabilities(passes["f"][0], passes["b"][0]).T)
        m, y = mask.reshape(-1), np.tile(label, steps)
        loss = float(-(np.log(p[np.arange(len(y)), y] + 1e-9) * m).sum() / m.sum())
        p[np.arange(len(y)), y] -= 1
        p *= (m / m.sum())[:, None]
        g["out"], g["bias"] = both.reshape(-1, 2 * h).T @ p, p.sum(axis=0)
        back = (p @ self.p["out"].T).reshape(steps, n, 2 * h)
        for d in "fb":
            rec, trace = self.p[f"rec_{d}"], passes[d][1]
            g_in, g_rec = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(rec)
            carry = np.zeros((n, h), np.float32)
            mine = back[:, :, :h] if d == "f" else back[:, :, h:]
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                state, a_n, pre, gate, cand, low = trace[t]
                z, r = gate[:, :h], gate[:, h:]
                up = (mine[t] + carry) * mask[t][:, None]
                d_cand = up * (1 - z) / low**2
                d_gate = np.concatenate([up * (state - cand), d_cand * a_n], axis=1) * 0.5 / (np.abs(pre) + 1) ** 2
                d_a = np.concatenate([d_gate, d_cand * r], axis=1)
                carry = up * z + d_a @ rec.T
                g_rec += state.T @ d_a
                np.add.at(g_in, ids[t], np.concatenate([d_gate, d_cand], axis=1))
            g[f"in_{d}"], g[f"rec_{d}"] = g_in, g_rec
        return g, loss

    def fit(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, steps: int, batch: int = 128, rate: float = 0.02) -> float:
        """Adam over seeded batches; returns the last loss."""
        rng, loss = np.random.default_rng(11), 0.0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(label), batch)
            grads, loss = self.gradients(np.ascontiguousarray(ids[pick].T), np.ascontiguousarray(mask[pick].T), label[pick])
            now = rate * min(1, 2 * (1 - (i - 1) / steps))
            for k, v in grads.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss


def stretches(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, mask = np.zeros((len(data), width), np.uint8), np.zeros((len(data), width), np.float32)
    for i, b in enumerate(data):
        ids[i, : len(b)] = np.frombuffer(b, np.uint8)
        mask[i, : len(b)] = 1
    return ids, mask


def pooled(net: ByteNet, texts: list[str | None]) -> np.ndarray:
    """Mean label probabilities of each text over all its bytes; zeros for one without bytes."""
    total = np.zeros((len(texts), len(net.labels)))
    size = np.zeros(len(texts))

    def pieces() -> Iterator[tuple[int, bytes]]:
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "replace")
            size[i] = len(data)
            for at in range(0, len(data), STRETCH):
                yield i, data[at : at + STRETCH]

    def run(block: list[tuple[int, bytes]], width: int) -> None:
        ids, mask = stretches([b for _, b in block], width)
        sums = net.position_sums(np.ascontiguousarray(ids.T), None if mask.all() else np.ascontiguousarray(mask.T))
        np.add.at(total, [i for i, _ in block], sums)
        block.clear()

    whole: list[tuple[int, bytes]] = []
    rest: list[tuple[int, bytes]] = []  # the last, shorter stretch of each text
    for piece in pieces():
        block = whole if len(piece[1]) == STRETCH else rest
        block.append(piece)
        if len(block) == BLOCK:
            run(block, STRETCH)
    for block in (whole, rest):
        if block:
            run(block, STRETCH)
    return total / np.maximum(size, 1)[:, None]


def train(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
    per_label: int = 400, cuts: int = 3, width: int = 64, hidden: int = 6, steps: int = 400,
) -> ByteNet | None:
    """Fit on a bounded sample: ``cuts`` stretches of ``width`` characters from each of ``per_label``
    documents of a label, in the order of a hash of the id. Rows without label, id or letter take
    no part. None if nothing is left to learn from."""
    known = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("id is not null and label is not null")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ids = known.select("id", "label").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).select("id", "label").distinct()
    start = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.greatest(F.char_length("text") - width + 1, F.lit(1))).cast("int") + 1
    picked = known.join(F.broadcast(ids), ["id", "label"], "left_semi").where(F.col("text").rlike(r"\p{L}"))
    cut = picked.select("id", "label", *[F.col("text").substr(start(i), F.lit(width)).alias(f"t{i}") for i in range(cuts)])
    rows = sorted(cut.collect(), key=lambda r: (r["label"], str(r["id"]), r["t0"]))
    if not rows:
        return None
    labels = sorted({r["label"] for r in rows})
    # a language with few documents counts as much as one with many
    share = {k: [r for r in rows if r["label"] == k] for k in labels}
    most = max(map(len, share.values()))
    even = [share[k][i % len(share[k])] for k in labels for i in range(most)]
    data = [(r[f"t{i}"].encode("utf-8", "replace")[:width], labels.index(r["label"])) for r in even for i in range(cuts)]
    data = [x for x in data if x[0]]
    ids_, mask = stretches([b for b, _ in data], width)
    net = ByteNet(labels, hidden)
    net.fit(ids_, mask, np.array([y for _, y in data]), steps)
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, its pooled probability.

    A text that is null, empty or has no letter is ``und`` with score 0, and so is every
    text if there is no network. Columns of these two names are replaced; the language,
    source and id of a row are not looked at.
    """
    if net is None:
        bare = docs if keep_text else docs.drop(text_col)
        return bare.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    rows = docs.withColumn("_letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def start():
        def work(texts):
            p = pooled(net, texts)
            best = p.argmax(axis=1)
            made = [net.labels[i] for i in best], [round(float(x), 5) for x in p[np.arange(len(best)), best]]
            return made if keep_text else ([None] * len(texts), *made)

        return work

    fields = ({} if keep_text else {text_col: "string"}) | {"lang_pred": "string", "score": "double"}
    named = mapped(rows, text_col, fields, start)
    named = named if keep_text else named.drop(text_col)
    return named.withColumns(
        {
            "lang_pred": F.when(F.col("_letter"), F.col("lang_pred")).otherwise(UNKNOWN),
            "score": F.when(F.col("_letter"), F.col("score")).otherwise(0.0),
        }
    ).drop("_letter")
