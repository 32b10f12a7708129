"""Secrets in every version of a text, by an incremental ledger of blobs.

A text is named by the digest of its content. The ledger holds what each rule version
found in each blob. A scan reads only blobs that have no entry yet for the version of the
rules, once each however many paths hold them, and adds its findings; afterwards findings
are joined back to all paths. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansight.llm.common import dealt_join
from vacansight.session import shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where it may begin, its pattern, and what must hold of a match."""

    kind: str
    hint: str
    pattern: str
    least: int = 0  #: characters of ``group``
    group: int = 0


def any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN_HEAD = rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?"
BASE = [
    Rule("assign", rf"({NAMES})[\"']?\x20*[:=]", ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}"),
]
#: What the method finds beyond the base.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", any_case("bearer") + r"\x20", any_case("bearer") + r"\x20+[A-Za-z0-9._~+/-]{16,}=*"),
]
RULES = BASE + MORE
VERSION = 1
SPAN = "struct<start:int,ord:int,kind:string,stop:int>"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule in code points. The pieces between matches and the matches themselves give the places."""
    empty = F.array().cast(f"array<{SPAN}>")
    pieces, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(f"(?:{rule.pattern})"), F.lit(0))
    sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("len"), m.alias("m")))
    span = lambda at, x: F.struct(
        (at + x["gap"]).cast("int").alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (at + x["gap"] + x["len"]).cast("int").alias("stop")
    )
    if rule.group:
        inner = lambda x: F.char_length(x["m"]) - F.char_length(F.regexp_extract(x["m"], f"^{ASSIGN_HEAD}", 0))
        good = lambda x: inner(x) >= rule.least
    else:
        good = lambda x: x["len"] >= rule.least
    # a running place over the pairs of gap and match
    walked = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).cast("int").alias("at"), F.when(good(x), F.concat(acc["out"], F.array(span(acc["at"], x)))).otherwise(acc["out"]).alias("out")),
    )["out"]
    return F.when(text.rlike(rule.hint), walked).otherwise(empty)


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries so far: blob, rules version, findings. A folder that is not there yet is an empty ledger."""
    schema = f"blob string, version int, found array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def scan_new(versions: DataFrame, ledger: str, version: int = VERSION, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan the blobs without an entry for ``version`` and add them to the ledger folder; returns path and blob of every row.

    Only the digest and the path travel to find out what is new and which path
    stands for it; a text is sent on only to meet that answer.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(id_col).alias("path"), F.col(text_col).alias("text")).withColumn("blob", blob_of(F.col("text")))
    paths = rows.select("path", "blob")
    known = read_ledger(spark, ledger).where(F.col("version") == version).select("blob")
    fresh = paths.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    on = (rows["blob"] == fresh["blob"]) & rows["path"].eqNullSafe(fresh["path"])
    unseen = rows.join(fresh, on, "left_semi")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[matches(text, r, i) for i, r in enumerate(rules or RULES)])
    entries = unseen.select("blob", F.lit(version).alias("version"), F.array_sort(found).alias("found"))
    # a path that holds a blob twice yields two equal entries
    entries.groupBy("blob", "version").agg(F.first("found").alias("found")).write.mode("append").parquet(ledger)
    return paths


def findings(paths: DataFrame, ledger: str, version: int = VERSION) -> DataFrame:
    """Each row of ``paths`` with what the ledger has for its blob, blobs in a third of all rows included: their entry is
    one row that is copied, and their paths are dealt out over the copies. Entries without findings do not travel."""
    entries = read_ledger(paths.sparkSession, ledger).where((F.col("version") == version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    joined = dealt_join(paths, entries, ["blob"], "path")
    return joined.withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))


def digest(found: DataFrame, base: list[Rule] | None = None) -> DataFrame:
    """Per path the number of findings of each base rule, the digest of the base spans and all spans by start, then kind."""
    kinds = [r.kind for r in base or BASE]
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    only = F.filter("found", lambda x: x["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in kinds], F.sha2(F.encode(said(only), "UTF-8"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), "blob"
    )


def scan(docs: DataFrame, ledger: str | None = None, **how) -> DataFrame:
    """Every document with its secrets; texts that the ledger knows are not scanned again.

    A null text counts as empty. Rows that repeat are answered each. Without a folder a new ledger
    is begun beside the checkpoints.
    """
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/ledger-{uuid4().hex}"
    return digest(findings(scan_new(docs, ledger, **how), ledger, how.get("version", VERSION)))


def _duck(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    head = f"^{ASSIGN_HEAD}".replace("'", "''")
    size = f"length(m) - length(regexp_extract(m, '{head}'))" if rule.group else "length(m)"
    return f"""SELECT blob, {order} AS ord, '{rule.kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT blob, m, coalesce(sum(length(g) + length(m)) OVER (PARTITION BY blob ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(g) AS start
      FROM (SELECT blob, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT blob, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM b)))
      WHERE {size} >= {rule.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
b AS (SELECT blob, any_value(text) AS text FROM d GROUP BY blob),
f AS ({" UNION ALL ".join(_duck(r, i) for i, r in enumerate(RULES))}),
x AS (SELECT blob, {", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)},
  coalesce(string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}), '') AS base,
  string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, ord) AS spans FROM f GROUP BY blob)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, d.blob AS blob
FROM d LEFT JOIN x ON d.blob = x.blob
"""
