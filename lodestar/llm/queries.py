"""The queries of this package, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import ann, bpe, conversation_repair, fingerprint, jaccard_join, lattice_lm, packing, quality, repeats, secret_scan, token_alignment, toxicity, url_filter
from lodestar.llm.common import written
from lodestar.llm.secret_scan import Rule


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.scan_new(docs)
    return secret_scan.digest(secret_scan.findings(secret_scan.address(docs).drop("text"), ledger, once=True)).drop("blob")


#: The hex rule as it was before: only runs of 32 digits or more.
BEFORE = tuple(Rule("hex", 0, r"[0-9a-f]{32,}") if r.kind == "hex" else r for r in secret_scan.RULES)


def ledger_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by increments: a stored ledger of all documents under an older version of one rule, and a scan of the pairs of blob and rule version that it lacks. n_rescanned: how many rules the second scan ran on the document's text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = written(secret_scan.scan_new(docs, secret_scan.empty_ledger(spark), BEFORE))
    new = written(secret_scan.scan_new(docs, ledger))
    paths = secret_scan.address(docs).drop("text").join(new.select("blob", F.size("rules").alias("n_rescanned")), "blob", "left")
    return secret_scan.digest(secret_scan.findings(paths, ledger.unionByName(new))).drop("blob")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"), parts=4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents."""
    return quality.Resampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drawn().where("selected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.compare(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_jaccard_join, op3_bpe, op4_toxicity, op5_ann, op6_repeats, op7_fingerprint, op8_url_filter, op9_quality, op10_packing, op11_lattice_lm, op12_conversation_repair, op13_token_alignment, ledger_rescan)}
SQL: dict[str, str] = {"op5_ann": ann.SQL, "op8_url_filter": url_filter.SQL, "op12_conversation_repair": conversation_repair.SQL}
