"""Divergence audit, Merkle manifest and chat formatting, against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacansight.llm import chat, divergence, manifest


def odd_docs(spark, rows):
    """Documents with columns that have the names of internal ones."""
    return spark.createDataFrame([(*r, 1, "x", 7, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, key string, pos int, term string")


def audit_brute(rows, least=10, top=10):
    groups, df = {}, collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.setdefault((lang, source), collections.Counter()).update(words)
        df[lang].update(set(words))
    out = set()
    for (lang, source), counts in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        ofs = {s: c for (x, s), c in groups.items() if x == lang}
        ofs[None] = sum(ofs.values(), collections.Counter())
        size = {s: sum(c[t] for t in kept) for s, c in ofs.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (size[s] + 2 * len(kept)) for t in kept} for s, c in ofs.items()}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        pairs = [(-sum(f(source, s, t) for t in kept), s.encode(), s) for s in ofs if s is not None and s != source]
        terms = [(-f(source, None, t), t.encode(), t) for t in kept if counts[t] and p[source][t] > p[None][t]]
        for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(found), 1)}
    return out


def audit_rows():
    rng = random.Random(5)
    words = ["Wörter", "ßtraße", "the", "of", "日本", "Éa"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 25), weights=[1 + 200 // (j + 1) for j in range(len(words))]))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice([None, "", "hot", "hot", "hot", *"abcdefgh"])))
    rows += [rows[3]] * 12 + [(None, None, "xx", "one"), (1, "", "xx", "two"), (2, "rare", "xx", None), (3, "the " * 5000, "en", "long")]
    return [(*r, 3) for r in rows]


@pytest.mark.parametrize("block, tile", [(8192, 32), (7, 2)])
def test_divergence_is_that_of_whole_columns(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = audit_rows()
    got = divergence.audit(odd_docs(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == audit_brute(rows)
    assert ("xx", "one", "pair", "", 0, 1) in got  # no kept term: value 0, items by their bytes


def plain_counts(batch):
    """Occurrences and documents of each term, one Python step per word."""
    held = {}
    for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
        in_text = {}
        for word in re.findall(rb"[a-z\x80-\xff]+", text.lower()):
            in_text[word] = in_text.get(word, 0) + 1
        for word, n in in_text.items():
            entry = held.setdefault((lang, source, word), [0, 0])
            entry[0] += n
            entry[1] += 1
    return {k: tuple(v) for k, v in held.items()}


def test_terms_are_counted_without_a_step_per_word():
    rng = random.Random(8)
    texts = ["".join(map(chr, range(0x300))).encode(), b"", b"Zz \xc2\x85a\xc2\xa0b\x7fA\x00[a]`{"]
    texts += [" ".join(rng.choices(["The", "of", "Wörter", "日本", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))], k=200)).encode() for _ in range(3000)]
    batch = pa.record_batch([pa.array([rng.choice("ab") for _ in texts]), pa.array([rng.choice("cd") for _ in texts]), pa.array(texts)], ["lang", "source", "text"])

    def timed(count):
        began = time.process_time()
        return count(), time.process_time() - began

    got, want = ([timed(f) for _ in range(3)] for f in (lambda: list(divergence._count(iter([batch]))), lambda: plain_counts(batch)))
    counted = [r for b in got[0][0] for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {r[:3]: r[3:] for r in counted if r[2] is not None} == want[0][0]
    assert len(counted) == len(want[0][0]) + 4  # and a row without a term for each group
    assert min(s for _, s in got) < 0.8 * min(s for _, s in want)  # as long or longer with a step per word


def test_divergence_of_nothing(spark):
    assert divergence.audit(odd_docs(spark, audit_rows()).limit(0)).count() == 0


def test_shares_are_exact_beyond_double(spark):
    rng = random.Random(1)
    cases = [(rng.randrange(10**15), 10**15 + rng.randrange(10**15), rng.randrange(1, 10**9)) for _ in range(300)] + [(9 * 10**17, 9 * 10**17, 1), (0, 0, 1)]
    df = spark.createDataFrame(cases, "n long, size long, v long")
    got = [tuple(r) for r in df.select("n", "size", "v", divergence.share(F.col("n"), F.col("size"), F.col("v"))).collect()]
    assert all(p == 1 + 10**9 * (n + 2) // (size + 2 * v) for n, size, v, p in got)


def test_run_lengths_give_the_plain_sum():
    rng = random.Random(2)
    for _ in range(50):
        width = rng.randrange(1, 60)
        columns = [[rng.choice([0, 0, 0, 1, 5]) for _ in range(width)] for _ in range(2)]
        runs, plain = [], []
        for c in columns:
            size = sum(c)
            at = [i for i, n in enumerate(c) if n]
            runs += divergence.encode(width, at, [c[i] for i in at], size, width)
            plain.append([1 + 10**9 * (n + 2) // (size + 2 * width) for n in c])
        assert len(runs[0]) == 1 + sum(a != b for a, b in zip(columns[0], columns[0][1:]))
        assert divergence.run_sum(*runs) == sum((p - q) ** 2 // (p + q) for p, q in zip(*plain))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(hashes, fan):
    """Top, and for each leaf the (before, after) of every level."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + fan] for i in range(0, len(hashes), fan)]
        for w, i in zip(ways, at):
            w.append(("".join(runs[i // fan][: i % fan]), "".join(runs[i // fan][i % fan + 1 :])))
        hashes, at = [sha(*r) for r in runs], [i // fan for i in at]
    return hashes[0], ways


def manifest_brute(rows, fan, changed):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, *tree_of([leaf_of(r) for r in own], fan))
    root, upper = tree_of([trees[s][1] for s in sources], fan)
    out = []
    for s, above in zip(sources, upper):
        own, top, ways = trees[s]
        for r, way in zip(own, ways):
            h = leaf_of(changed(r))
            for before, after in way + above:
                h = sha(before, h, after)
            out.append((r[0], leaf_of(r), top, root, sha(*(a + b for a, b in way + above)), h, h == root))
    return out


def tampered(row):
    doc_id, text, *rest = row
    return (doc_id, text.replace("\n", "") if text and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text, *rest)


@pytest.mark.parametrize("fan", [2, 3, 4])
def test_manifest_is_that_of_whole_trees(spark, fan):
    rng = random.Random(fan)
    rows = [(rng.choice([i, i, None, 5]), rng.choice([f"a\nb{i}", None, "", "ü\n日" * 40]), rng.choice(["en", None]), rng.choice(["hot", "hot", "s", "", None, "é"]), rng.choice([i, None])) for i in range(90)]
    rows += [rows[0]] * 5 + [(7, "alone\n", "en", "one", 6)] + [(1000 + i, "\n", "en", "big", i) for i in range(3**3)]
    docs = odd_docs(spark, rows)
    made = manifest.manifest(docs, manifest.tampered_text(F.col("doc_id"), F.col("text")), fan)
    got = made.withColumn("proof", manifest.proof_digest(F.col("proof")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    key = lambda r: tuple(str(x) for x in r)
    want = manifest_brute(rows, fan, tampered)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    docs = odd_docs(spark, [(3, None, None, None, None)])
    row = manifest.manifest(docs).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf_of((3, None, None, None, None)) and row["proof"] == [] and row["verified"]
    assert manifest.manifest(docs.limit(0)).count() == 0


LOG = "conv_id long, msg long, seq long, kind string, role string, text string"


def replayed(events):
    """Final messages of one conversation by replaying its events in time; events of one time in order of message."""
    live = {}
    for msg, _, kind, role, text in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "open":
            live[msg] = [role or "", ""]
            continue
        state = live.setdefault(msg, ["", ""])
        if kind == "delta":
            state[1] += text or ""
        elif kind == "edit":
            state[1] = text or ""
        else:
            state[1] = ""
            for later in [m for m in live if m > msg]:
                del live[later]
    return [(m, *live[m]) for m in sorted(live)]


def test_logs_fold_like_a_replay(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(60):
        events = []
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choices(["open", "delta", "edit", "regenerate"], [3, 8, 1, 1])[0]
            events.append((rng.randrange(6), seq, kind, rng.choice(["user", "assistant", None, "to\nol>\\"]) if kind == "open" else None, rng.choice(["a", "</turn>\n", "\\", "<turn x>\n", "é\n", None])))
        want[conv] = replayed(events)
        rows += [(conv, *e) for e in events]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, LOG).withColumn("cut", F.lit(1)).withColumn("formatted", F.lit("x"))
    rendered = chat.turns(log)
    got = collections.defaultdict(list)
    for r in rendered.collect():
        got[r["conv_id"]].append((r["msg"], r["role"], r["text"]))
    assert dict(got) == {c: m for c, m in want.items() if m}

    whole = {r["conv_id"]: r for r in chat.conversations(rendered).collect()}
    for r in chat.read_back(rendered).collect():
        messages = want[r["conv_id"]]
        loss = [t for _, role, t in messages if role == "assistant"]
        text = whole[r["conv_id"]]["formatted"]
        assert r["n_turns"] == len(messages) and r["formatted_chars"] == len(text)
        assert r["turns_sha256"] == sha(*(f"{role}\n{t}\n" for _, role, t in messages))
        assert r["loss_sha256"] == sha(*loss) and r["loss_chars"] == sum(map(len, loss))
        assert [chat.unescape(text[s["start"] : s["end"]]) for s in whole[r["conv_id"]]["loss"]] == loss


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choices(["\\", "<turn", "</turn", ">", "\n", "n", "a", "<", "/"], k=rng.randrange(9)))
        assert chat.unescape(chat.escape(t)) == t and chat.role_in(chat.role_out(t)) == t
        assert not re.search(r"(?<!\\)</?turn", chat.escape(t))
        r = chat.Reader()
        turn, start, end = chat.render(t, t)
        r.feed(turn, [(start, end)])
        assert r.result() == (1, sha(f"{t}\n{t}\n"), len(t), sha(t), len(turn))


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, None, "user", "a"), (2, 0, "assistant", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(0))
    got = {r["conv_id"]: r for r in chat.read_back(chat.turns(chat.log_of(frame))).collect()}
    assert got[None]["turns_sha256"] == sha("\n\nassistant\n\n") and got[None]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == sha("user\na\nuser\nb\nuser\nb\n")
    assert got[2]["loss_chars"] == 100_000 and got[2]["loss_sha256"] == sha("x" * 100_000)
    assert chat.read_back(chat.turns(chat.log_of(frame.limit(0)))).count() == 0
    bad = spark.createDataFrame([(1, 1, 1, "vote", None, None)], LOG)
    with pytest.raises(Exception, match="unknown kind"):
        chat.turns(bad).collect()


def test_one_conversation_with_a_third_of_all_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(3000)] + [(100 + i, 0, "user", "hi") for i in range(6000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.turns(chat.log_of(frame))).collect()}
    assert len(got) == 6001 and got[1]["n_turns"] == 3000
    assert got[1]["loss_sha256"] == sha(*(f"t{t}" for t in range(1, 3000, 2)))


def test_repeated_rows_of_a_mix_are_taken_one_by_one(spark):
    from test_corpus_operators import duck
    from vacansight.llm import mixing

    hundred = "word " * 100
    rows = [(5, hundred, "b")] * 10 + [(i, hundred, "a") for i in range(10)] + [(None, hundred, "c")] * 10 + [(i, "one two", "a") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_single(docs)
    _, want = duck(spark, docs, mixing.SQL)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    for source in "abc":
        own = [r for r in got.collect() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 100 and len(own) == (15 if source == "a" else 10)


def test_stages_keep_user_columns_with_their_own_names(spark):
    from vacansight.llm import decontam, toxicity

    item = "the old mill by the river grinds barley for the whole valley every single autumn morning"
    rows = [(1, "a quiet note about looms", 7.5, "mine", "x"), (2, f"before {item} after", 8.5, "ours", "y"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double, hits string, _hits0 string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(tuple, toxicity.acceptable(docs, None).collect())) == sorted(rows)
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
