"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests and precedence. DataFrame functions only.

A null url, or one without "://", has an empty host and path and no rule. Repeated rows stay repeated; other columns stay, but columns named host, path, rule or verdict are replaced. A null in a rule's host or path makes it fit nothing; an empty table of rules judges all by the default.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import spread

#: (verdict, host, path) of the default list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hex digits of the digest that the join compares: 32 bits.
PREFIX = 8
#: The verdict where no rule fits.
OTHERWISE = "allow"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def split_url(url) -> tuple:
    """Columns host and path."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule (host and path) wins, then allow before block, then the lesser text. A rule's expression is its host and its path up to the last "/", so a url needs one expression for each of its host suffixes and directories; those deeper than any rule are left out, and distinct urls are judged once. Expressions meet rules by the first 32 bits of their SHA-256; equal full digests and the rule's whole path decide.
    """
    named = rules.where("rule_host is not null and rule_path is not null").withColumn("folder", F.regexp_extract("rule_path", "(?s)^(.*/)", 1))
    keyed = named.withColumn("digest", F.sha2(F.concat("rule_host", "folder"), 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    depth = named.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"), F.coalesce(F.max(F.length("folder") - F.length(F.replace("folder", F.lit("/"), F.lit("")))), F.lit(0)).alias("folders")).first()
    parts = pages.select(F.col(f"`{url}`").alias("_url")).where("_url is not null").distinct().select("_url", *(c.alias(n) for c, n in zip(split_url(F.col("_url")), ("host", "path"), strict=True))).where("host <> ''")
    labels, folders = F.split("host", r"\."), F.split("path", "/")
    hosts = parts.select("_url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth["labels"], 1)))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))).alias("suffix"))
    # of the path a/b/c the folders are "", "a/", "a/b/": the pieces before the last slash
    cuts = F.sequence(F.lit(0), F.least(F.size(folders) - 1, F.lit(depth["folders"])))
    every = hosts.select("_url", "path", "suffix", F.explode(F.transform(cuts, lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folders, 1, k), "/"), F.lit("/"))))).alias("lead"))
    asked = every.withColumn("full", F.sha2(F.concat("suffix", "lead"), 256)).withColumn("short", F.substring("full", 1, PREFIX))
    met = asked.join(keyed, "short").where("full = digest and startswith(path, rule_path)")
    name = F.concat("rule_host", "rule_path")
    best = met.groupBy("_url").agg(F.min(F.struct((-F.length(name)).alias("o"), "verdict", name.alias("rule"))).alias("b")).select("_url", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("_verdict"))
    given = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("_row"), F.col(f"`{url}`").alias("_url"))
    # nulls meet nothing: they don't go to one task; a url of very many rows is dealt over several
    judged = spread(rows.where("_url is not null"), best, "_url", "left").unionByName(rows.where("_url is null").withColumns({"rule": F.lit(None).cast("string"), "_verdict": F.lit(None).cast("string")}))
    host, path = split_url(F.col("_url"))
    return judged.select("_row.*", host.alias("host"), path.alias("path"), "rule", F.coalesce("_verdict", F.lit(otherwise)).alias("verdict"))


SQL = r"""
with u as (select page_id, coalesce(url, '') as url from pages),
s as (select page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path from u),
r(verdict, rule_host, rule_path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
t as (select s.*, (select list_extract(array_agg([rule_host || rule_path, verdict] order by length(rule_host || rule_path) desc, verdict, rule_host || rule_path), 1) from r
  where (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)) as best from s)
select page_id, host, path, best[1] as rule, coalesce(best[2], 'allow') as verdict from t
"""
