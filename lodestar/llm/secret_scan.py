"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger says which rule versions have seen which blob and what they found; a run scans only pairs of blob and rule version that it lacks, one text for each blob, and joins the findings back to every path that has or had that blob.

Nulls count as the empty text. Repeated rows stay repeated. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow, batches, bloom, bloom_hit, maybe_in, written


@dataclass(frozen=True)
class Rule:
    """kind names the rule, version changes whenever its pattern does. group: the part that must have least characters. words: the text holds one of them in lower case, or the rule can't match."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    words: tuple[str, ...] = ()
    exact: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 12, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 18, exact="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),  # greedy runs: the same matches as [0-9a-f]+ of 16 or more
)
#: Formats with a fixed lead that the base rules see in part or not at all.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", exact="PRIVATE KEY-----"),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", exact="gh"),
    Rule("chat", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", exact="xox"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", exact="eyJ"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping for each rule, then those too short dropped."""
    found, low = [], text.lower()
    for r in rules:
        if (r.exact and r.exact not in text) or (r.words and not any(w in low for w in r.words)):
            continue
        for m in re.finditer(r.pattern, text, r.flags):
            if m.end(r.group) - m.start(r.group) >= r.least:
                found.append((r.kind, m.start(), m.end()))
    return found


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rules array<string>, spans {SPANS}")


def address(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds blob, the content address of each text."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Rows to add to the ledger: (blob, rules, spans), for blobs whose pairs with the rules' versions it lacks.

    Which pairs are unseen is found from addresses alone. Texts of unseen blobs are then shuffled once, copies being dropped before that; a Bloom filter of fixed size keeps those that the ledger knows where they are.
    """
    named = F.array(*(F.lit(r.id) for r in rules))
    blobs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    if ledger is None:
        todo = blobs.dropDuplicates(["blob"]).withColumn("rules", named)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        lacking = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(named, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
        lacking = written(lacking)
        bits = docs.sparkSession.sparkContext.broadcast(bloom(lacking, "blob"))

        @F.pandas_udf("boolean")
        def unseen(p: pd.Series, q: pd.Series) -> pd.Series:
            return pd.Series(bloom_hit(bits.value, p.to_numpy(), q.to_numpy()))

        todo = blobs.where(unseen(*maybe_in("blob"))).dropDuplicates(["blob"]).join(lacking, "blob")
    by_id = {r.id: r for r in rules}
    schema = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow(schema, ((b, ids, [dict(zip(("kind", "start", "end"), x, strict=True)) for x in find(t, tuple(by_id[i] for i in ids))]) for b, t, ids in batches(it, "blob", "text", "rules")))

    return todo.select("blob", "text", "rules").mapInArrow(scan, f"blob string, rules array<string>, spans {SPANS}")


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, once: bool = False) -> DataFrame:
    """paths (with column blob, see address()) and their spans, in order of start, then of the rules. Rule versions of the past don't count. once: the ledger has a single row for each blob; then Spark can split the join where one blob has many paths."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    # of a ledger row the spans of rules whose version is today's
    ids = F.array(*(F.lit(r.id) for r in rules))
    current = F.transform(F.array_intersect("rules", ids), lambda r: F.substring_index(r, "@", 1))
    now = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(current, s["kind"])).alias("spans")).where(F.size("spans") > 0)
    if not once:
        now = now.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    order = lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(F.array_position(kinds, x["kind"]) - F.array_position(kinds, y["kind"]))).cast("int")
    return paths.join(now, "blob", "left").withColumn("spans", F.array_sort(F.coalesce("spans", F.array().cast(SPANS)), order))


def digest(found: DataFrame) -> DataFrame:
    """The columns n_assign, n_access, n_hex, base_sha256 and spans (a string)."""
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE)))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("*", *(count(r.kind) for r in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans_text")).drop("spans").withColumnRenamed("spans_text", "spans")


def without(text: str, spans, mark: str) -> str:
    """text with mark in place of each span; overlapping or touching spans as one. spans: (kind, start, end) in order of start."""
    out, at, open_ = [], 0, None
    for s in spans:
        start, end = s["start"], s["end"]
        if open_ is not None and start <= open_:
            open_ = max(open_, end)
            continue
        if open_ is not None:
            at = open_
        out += [text[at:start], mark]
        open_ = end
    return "".join(out) + text[open_ or 0 :]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, mark: str = "[REDACTED]", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with every found span of the text replaced by mark (overlapping spans as one), and chars, if there is such a column, brought up to date. Other columns stay as they are. A text is shuffled once to be scanned and once to meet its findings, and only if it has any; it is cut in one pass over its spans."""
    new = scan_new(docs, ledger, rules, text)
    all_rows = new if ledger is None else ledger.unionByName(new)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("blob"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s, mark) if t is not None and s is not None and len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    old, some = F.col("_row")[text], F.size("spans") > 0
    clean = findings(held, all_rows, rules, ledger is None).withColumn("_clean", cut(F.when(some, old), "spans"))
    changed = {text: F.when(some, F.col("_clean")).otherwise(old), chars: F.when(some, F.length("_clean").cast("long")).otherwise(F.col("_row")[chars]) if chars in docs.columns else None}
    return clean.select(*((changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns))
