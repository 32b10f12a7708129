"""The registered queries of these operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansight.llm import chat, decontam, divergence, htmlcut, langid, ledger, manifest, mixing, ordermin, pii, simhash, spans, toxicity
from vacansight.llm.common import table
from vacansight.session import small_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    net = langid.train(docs.where(fold != 2))
    rows = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, net, keep_text=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.annotate(docs, pii.fit(docs))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.strip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(table(spark, sf_dir, "documents"))


def op6_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlcut.extract(pages, htmlcut.fit(pages))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain, keep_text=False)
    return scored.select("doc_id", *[c for c in scored.columns if c.startswith("p_")], (F.col("p_toxic") >= 0.5).alias("toxic"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_single(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.scan(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = manifest.manifest(docs, manifest.tampered_text(F.col("doc_id"), F.col("text")))
    return made.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = small_table(spark, chat.PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.turns(chat.log_of(rows.unionByName(probe))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_pii, op3_sentence_spans, op4_decontamination, op5_simhash,
        op6_html_cut, op7_toxicity, op8_mixing, op9_secrets, op10_order_minhash,
        op11_divergence, op12_manifest, op13_chat_log,
    )
}

SQL: dict[str, str] = {
    "op8_mixing": mixing.SQL, "op9_secrets": ledger.SQL,
    "op11_divergence": divergence.SQL, "op12_manifest": manifest.SQL, "op13_chat_log": chat.SQL,
}
