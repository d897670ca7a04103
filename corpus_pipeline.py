"""A corpus pipeline: quality, near duplicates, repeated passages, secrets, packing. Counted as part of lodestar.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import jaccard_join, packing, quality, repeats, secret_scan
from lodestar.llm.common import forget, written
from lodestar.llm.queries import table, vocabulary


#: Tables that the frame of the first stage reads; they go when the next stage begins.
_read: list[DataFrame] = []


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go."""
    drawing = quality.Resampler(docs, table(spark, sf_dir, "labels"), carry=True)
    _read.append(drawing.weighed)
    return drawing.draw()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more tie together, the one with the least id stays."""
    while _read:  # the stage before is written by now
        forget(_read.pop())
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a lesser id has are cut out of the text."""
    return repeats.without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("secret scans", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models fitted on labels, links of shingles and packing are beyond SQL; tests/llm compares each operator and stage with a plain version.
ORACLE_SQL = None
