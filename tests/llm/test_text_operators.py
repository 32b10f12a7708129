"""Operators that answer row by row, against plain versions and made-up edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacansight.llm import decontam, htmlcut, langid, pii, toxicity
from vacansight.llm.common import words_of

ODD = [None, "", " \n ", "...", "x" * 50_000]
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [
                lambda: True,
                lambda: all(int(x) <= 255 for x in m[0].split(".")),
                lambda: 13 <= len(digits) <= 19 and pii.luhn(digits),
                lambda: 9 <= len(digits) <= 15,
            ][k]()
            if good:
                out.append((k, *m.span()))
    return sorted(out)


def rows(spark, texts, extra="lang string, score string", more=("xx", "s")):
    return spark.createDataFrame([(i, t, *more) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    bits = ["1", "25", "300", "4111111111111111", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "\n", "@x.yz", "_%"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert sorted(pii.base_spans(text)[0]) == plain_spans(text), text


def test_personal_data_query_keeps_base_spans_and_adds_others(spark):
    texts = [*ODD, "mail jo@a.org, ip 10.0.0.1 or call +49 30 1234567 now", "write to jane.doe [at] mail [dot] com", "card 4111 1111 1111 1111", "4111111111111112", *["mail to a%d@b.com" % i for i in range(40)]]
    docs = rows(spark, texts, "n_email string, spans string")
    out = {r["doc_id"]: r for r in pii.annotate(docs, pii.fit(docs)).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert out[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        assert set(filter(None, said.split(","))) <= set(out[i]["spans"].split(","))
    assert out[6]["spans"] == "email:9:37"
    assert out[8]["spans"] == ""


def test_redaction_covers_spans_and_leaves_other_texts(spark):
    docs = rows(spark, ["to a@b.org now", None, "clean", ""], "n_chars long", (3,))
    out = {r["doc_id"]: r for r in pii.redact(docs, pii.fit(docs)).collect()}
    assert [out[i]["text"] for i in range(4)] == ["to [EMAIL] now", None, "clean", ""]
    assert out[0]["n_chars"] == 14 and pii.redact(docs, np.zeros(pii.WIDTH)).columns == docs.columns


def test_language_gradients_are_those_of_the_loss():
    net = langid.ByteNet(["a", "b"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, mask = langid.stretches([b"hello", b"welt"], 5)
    ids, mask, y = ids.T.copy(), mask.T.copy(), np.array([0, 1])
    grads, _ = net.gradients(ids, mask, y)
    for k, at in (("rec_f", (1, 2)), ("rec_b", (0, 7)), ("in_f", (ord("l"), 4)), ("in_b", (ord("e"), 1)), ("out", (2, 1)), ("bias", (0,))):
        kept = net.p[k][at]
        low, high = (net.gradients(ids, mask, y)[1] for net.p[k][at] in (kept - 1e-2, kept + 1e-2))
        net.p[k][at] = kept
        assert grads[k][at] == pytest.approx((high - low) / 2e-2, abs=2e-3)


def test_language_of_held_out_texts_and_of_odd_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    net = langid.train(docs.where(~fold), steps=150)
    good = langid.identify(docs.where(fold & (F.length("text") > 100)), net).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert good.agg(F.avg("ok")).first()[0] > 0.9
    out = {r["doc_id"]: r for r in langid.identify(rows(spark, [*ODD, "12 34"]), net).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3, 5)] == ["und"] * 5 and out[0]["score"] == 0
    assert 0 <= out[4]["score"] <= 1 and out[4]["lang"] == "xx"
    assert langid.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(rows(spark, ODD), None).collect()} == {"und"}


def brute_overlap(item, doc):
    """Matching words of the best stretch along any diagonal, a point a match and two off a substitution."""
    best = 0
    for off in range(-len(item) + 1, len(doc)):
        score = matches = 0
        for i, w in enumerate(item):
            if 0 <= i + off < len(doc):
                same = doc[i + off] == w
                score, matches = score + (1 if same else -2), matches + same
                if score <= 0:
                    score = matches = 0
                best = max(best, matches if same else 0)
    return best


def test_contaminated_pairs_with_substitutions(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(14, 40)))) for i in range(12)] + [(90, "tiny item here"), (91, None), (None, "no id"), (92, "")]
    texts = list(ODD)
    for i in range(12):
        inside = [("zz" if j % 5 == 4 else w) for j, w in enumerate(items[i][1].split())]
        texts.append(" ".join(rng.choices(words, k=60) + inside + rng.choices(words, k=60)))
    texts += ["A TINY, item here!", " ".join(items[0][1].split()[:6]), " ".join(rng.choices(words, k=300))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.pairs(rows(spark, texts, "hits string, item_id long", ("h", 1)), bench).collect()}
    want = {(5 + i, i) for i in range(12)} | {(17, 90)}
    assert got == want
    small = {(r["doc_id"], r["item_id"]) for r in decontam.pairs(rows(spark, texts), bench, most=50).collect()}
    assert small == want
    for d, i in want - {(17, 90)}:
        assert brute_overlap(words_of(items[i][1]), words_of(texts[d])) >= 11
    kept = {r["doc_id"] for r in decontam.clean(rows(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.clean(rows(spark, texts), bench.limit(0)).count() == len(texts)


def substituted(rng, words, places):
    return [f"zz{rng.randrange(10**9)}" if j in places else w for j, w in enumerate(words)]


def test_passages_with_many_substitutions(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, rng.choices(words, k=n)) for i, n in enumerate([45, 45, 30, 12, 10, 9, 8, 8, 7])]
    texts = [" ".join(rng.choices(words, k=50) + substituted(rng, ws, range(2, len(ws), 3)) + rng.choices(words, k=50)) for _, ws in items]
    texts.append(" ".join(rng.choices(words, k=50) + substituted(rng, items[7][1], (1, 4, 7))))  # 5 of 8 words are too few
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"], r["n_match"]) for r in decontam.pairs(rows(spark, texts), bench).collect()}
    want = {}
    for i, ws in items[:8]:
        good = [j for j in range(len(ws)) if j % 3 != 2]
        want[i, i] = (50, 50 + good[-1] + 1, len(good))
    assert got == want


def test_what_the_seeds_find_is_kept_up_to_three_substitutions_in_ten():
    rng = random.Random(23)
    for n, rate in ((30, 0.2), (30, 0.25), (45, 0.3), (9, 0.2), (12, 0.3)):
        found = seen = 0
        for _ in range(200):
            item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            gone = {j for j in range(n) if rng.random() < rate}
            seeds = decontam.Seeds([(1, " ".join(item))])
            text = " ".join(f"o{rng.randrange(10**9)}" for _ in range(20)) + " " + " ".join(substituted(rng, item, gone))
            hit = bool(seeds.diagonals(np.array([seeds.vocab.get(w, 0) for w in words_of(text)], np.int64)))
            if n - len(gone) >= max(13, n / 2) if n >= 13 else n - len(gone) >= 2 * n / 3:
                seen += hit
                found += bool(seeds.hits([text])[0])
                assert hit or n >= 13
        assert found == seen > 100


PAGE = """<html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice"><p>We use cookies, as all do. Fine?</p></div><article><h1>Big  news &amp; more</h1><p>One long paragraph, with
words enough to count. It goes on.<aside>Read this too</aside><p>Next &eacute;ntry<br>line.<div class='ad'>Buy</div></article>
<section id="comments"><p>I liked this very much, thank you all.</p></section><form><label>Mail</label></form><footer>(c)</footer></body>"""


def test_page_text_and_cut(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<p>cut &am", "x"), (4, "u", "<p>cut &am", "x")], "page_id long, url string, html string, text string")
    out = sorted(map(tuple, htmlcut.extract(pages, htmlcut.fit(pages)).select("page_id", "text", "n_chars").collect()))
    main = "Big news & more\nOne long paragraph, with words enough to count. It goes on.\nNext éntry line."
    assert out == [(1, main, len(main)), (2, "", 0), (3, "", 0), (4, "cut &am", 7), (4, "cut &am", 7)]


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(60):
        blocks = [("w " * rng.randint(1, 30) + "x", rng.choice(["p", "li", "div"]), frozenset(rng.sample(["article", "side", "main"], rng.randint(0, 1))), rng.randint(0, 2), rng.random()) for _ in range(rng.randint(1, 8))]
        weights = np.array([htmlcut.PRIOR[f] * rng.random() * 0.4 for f in htmlcut.FEATURES])
        want = [float(np.dot(htmlcut.vector(b), weights)) for b in blocks]

        def cost(keep):
            total = sum(max(w, 0) for w, k in zip(want, keep) if not k) + sum(max(-w, 0) for w, k in zip(want, keep) if k)
            total += sum(htmlcut.NEAR for a, b in zip(keep, keep[1:]) if a != b)
            last = {}
            for i, b in enumerate(blocks):
                total += htmlcut.SAME * (b[3] in last and keep[last[b[3]]] != keep[i])
                last[b[3]] = i
            return total

        least = min(cost([n >> i & 1 for i in range(len(blocks))]) for n in range(1 << len(blocks)))
        assert cost(htmlcut.labelled(blocks, weights)) == pytest.approx(least)


def test_toxicity_chain(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(400):
        bad = i % 8 == 0
        texts.append(" ".join(rng.choices(plain, k=40) + (rng.sample(["idiot", "worthless", "moron", "stupid"], 2) if bad else [])))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    docs = rows(spark, texts, "p_toxic string, lang string")
    chain = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert all((out[i]["p_toxic"] >= 0.5) == bool(y) for i, y in marks) and out[0]["lang"] == "s"
    kept = toxicity.acceptable(docs.unionByName(docs.limit(1)), chain)
    assert kept.columns == docs.columns and kept.count() in (350, 351)
    odd = toxicity.score(rows(spark, ODD), chain).collect()
    assert all(r["p_toxic"] < 0.5 for r in odd)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.acceptable(docs, None).count() == 400
