"""Document fingerprints: a threshold-scaled sketch keeps every shingle hash below a fixed fraction of the hash range.

Sketches merge by union and estimate containment between documents of very unequal length, since either is the same sample of the hash range. A text without any hash below the threshold has an empty sketch in that sense; its fingerprint then names its least hash, which only tells it from other such texts: merged with a sketch it goes. No words give an empty fingerprint.

Nulls are the empty text. The key is a bigint. Rows with the same key are in order of their text; a null key comes first. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WordHashes, arrow, batches, shingles

#: One of FRACTION shingles is kept: a fingerprint has about 16 hex digits for each FRACTION words, a sixth of its text.
FRACTION = 16


def sketch(text: str | None, hashes: WordHashes, fraction: int = FRACTION) -> np.ndarray:
    """Sorted kept hashes."""
    s = shingles(text, hashes)
    kept = s[s < np.uint64((1 << 64) // fraction)]
    return kept if len(kept) else s[:1]


def as_text(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def from_text(said: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(said), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64((1 << 64) // fraction)]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's shingles that b has, estimated; two empty sketches are alike."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity, estimated."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", fraction: int = FRACTION) -> DataFrame:
    """(key, fingerprint) of each row."""
    schema = pa.schema([(key, pa.int64()), ("fingerprint", pa.string())])

    def run(it):
        hashes = WordHashes()
        for k, t in batches(it, key, text):
            yield k, as_text(sketch(t, hashes, fraction))

    return docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it), 500), f"{key} bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of text's code points replaced by as many of the first of following (all, if it has fewer)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str, text: str, use, schema: pa.Schema, ddl: str, parts: int) -> DataFrame:
    """use(k, text, next text) for each row and the one after it in order of key; after the last comes the first.

    Rows go to ranges of the key, whose bounds are percentiles; a range's last row needs the first of the next range, which is sent to both. So a text is shuffled once, and no task needs more than two texts.
    """
    spark = docs.sparkSession
    bounds = sorted(set((docs.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or [])))

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(bounds, np.int64), k.fillna(-(1 << 63)).to_numpy(np.int64), "right")
        return pd.Series(at.astype(np.int32))

    rows = docs.select(key, F.coalesce(text, F.lit("")).alias(text))
    firsts = rows.select(place(F.col(key)).alias("part"), key).groupBy("part").agg(F.min_by(F.struct(key), F.coalesce(key, F.lit(-(1 << 63)))).alias("k")).collect()  # one row for each range
    firsts = sorted((r["part"], r["k"][0]) for r in firsts)
    tails = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]
    ends = F.broadcast(spark.createDataFrame(tails, "tail int, first bigint"))  # no more rows than ranges
    dealt = (
        rows.join(ends, rows[key].eqNullSafe(ends["first"]), "left")
        .withColumn("part", place(F.col(key)))
        .select(key, text, F.explode(F.when(F.col("tail").isNull(), F.array(F.struct("part", F.lit(False).alias("tail")))).otherwise(F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(F.col("tail").alias("part"), F.lit(True).alias("tail"))))).alias("x"))
        .select(key, text, "x.part", "x.tail")
        .repartition("part")
        .sortWithinPartitions("part", "tail", F.col(key).asc_nulls_first(), text)
    )

    def run(it) -> Iterator[tuple]:
        before, open_tail = None, False
        for k, t, part, tail in batches(it, key, text, "part", "tail"):
            if before is not None and before[2] == part and not open_tail:
                yield use(before[0], before[1], t)
            if tail:
                open_tail = True
            else:
                open_tail = False
                before = k, t, part
        return

    return dealt.mapInArrow(lambda it: arrow(schema, run(it), 500), ddl)


def compared(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text", fraction: int = FRACTION) -> DataFrame:
    """Each document's sketch against those of its edited text and of the next document. near_*: share of the smaller sketch that the larger one has; jaccard_*: resemblance."""
    schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("jaccard_edited", pa.float64()), ("jaccard_next", pa.float64())])
    ddl = f"{key} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    hashes = WordHashes()
    last: dict = {}

    def use(k, t: str, after: str) -> tuple:
        own = last.pop("s") if last.get("t") is t else sketch(t, hashes, fraction)
        new = edited(t, after)
        e, nxt = sketch(new, hashes, fraction), sketch(after, hashes, fraction)
        last.update(t=after, s=nxt)
        near = lambda a, b: max(containment(a, b), containment(b, a)) if len(a) and len(b) else containment(a, b)
        return k, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(e), near(own, e), near(own, nxt), resemblance(own, e), resemblance(own, nxt)

    return with_next(docs, key, text, use, schema, ddl, parts)
