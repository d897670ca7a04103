"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of the target (labelled good documents), one of the raw corpus, give each document the log of how much likelier the target makes it. Summed over a text that ratio grows with the text's length and no noise of order one would ever change a draw; so it is taken per n-gram and divided by TEMPERATURE. That is the log of the importance weight: the ratio of the two models and nothing else, no label of another kind has a part in it. Weight plus Gumbel noise, and the largest k of that, are a sample without replacement in proportion to the weights.

k is how many documents lie where target documents do: those whose ratio is at least the lower quartile of held-out target documents less FENCE times the range of their middle half. Documents of the target's kind weigh about the same and nearly all are drawn; others are drawn as rarely as their weight says.

n-grams: words and marks in lower case, pairs of them, and the shapes of words (case, digits, marks, said again) with pairs of shapes. All documents count in the raw model and all are weighed: two passes over the texts, since every weight needs the counts of all. The target model is fitted on at most LABELLED labelled rows (those least by a hash of their id), half of which say where target documents lie.

Null or empty texts have no n-grams; their ratio is 0. Rows tied with the k-th are all drawn. Repeated rows are weighed each, with the same noise for the same id. The key is a bigint. Extra columns stay. An empty table gives an empty result; without labelled target documents on both sides every document is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Cache, arrow, batches, mix, written

#: Buckets of the models, labelled rows at most, added count of each bucket.
BUCKETS, LABELLED, SMOOTH = 1 << 14, 20_000, 1.0
#: n-grams of ratio 0 that every text has besides its own, so that a few words alone say little.
PRIOR = 8
#: Ratio per n-gram that counts as one unit of Gumbel noise; how many ranges of the middle half below it a document may lie and still count in k.
TEMPERATURE, FENCE = 0.05, 6.0
#: Rows at which the search for the k-th largest key ends on the driver.
FEW = 4096

_TOKEN = regex.compile(r"\w+|[^\w\s]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "0"
    return "a" if token.islower() else "Aa" if token.istitle() else "A" if token.isupper() else "aA"


def _pair(raw: str) -> bytes:
    """Hashes of a raw word's tokens and of their shapes, one after the other."""
    out = np.array([[xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(_shape(t), 1)] for t in _TOKEN.findall(raw)], np.uint64)
    return out.tobytes()


class Grams:
    """The buckets of a text's n-grams. Holds a bounded cache of words."""

    def __init__(self):
        self.words = Cache(_pair, 32 << 20)

    def __call__(self, text: str | None) -> np.ndarray:
        both = np.frombuffer(b"".join(map(self.words.__getitem__, (text or "").split())), np.uint64).reshape(-1, 2)
        if not len(both):
            return np.zeros(0, np.int64)
        word, shape = both[:, 0], both[:, 1].copy()
        shape[1:] += (word[1:] == word[:-1]) * np.uint64(12345)
        grams = np.concatenate([word, mix(word[:-1] * _MUL + word[1:]), mix(shape), mix(shape[:-1] * _MUL + shape[1:] + np.uint64(1))])
        return (mix(grams) >> np.uint64(64 - 14)).astype(np.int64)


def sample_labels(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """(id, y): at most most labelled rows, the least by a hash of their id; an id with both labels counts as 0."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(most)


def count_grams(docs: DataFrame, labelled: dict[int, int], key: str, text: str) -> dict[str, np.ndarray]:
    """Counts by bucket: of all documents and of the target's. Each task sends one row for each bucket at most."""
    schema = pa.schema([("model", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    given = docs.sparkSession.sparkContext.broadcast(labelled)

    def run(it) -> Iterator[tuple]:
        grams, known = Grams(), given.value
        sums = {m: np.zeros(BUCKETS, np.int64) for m in ("raw", "target")}
        for k, t in batches(it, key, text):
            n = np.bincount(grams(t), minlength=BUCKETS)
            sums["raw"] += n
            if known.get(k) == 1:
                sums["target"] += n
        for m, s in sums.items():
            at = np.flatnonzero(s)
            yield from zip([m] * len(at), at.tolist(), s[at].tolist(), strict=True)

    got = docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it), 20_000), "model string, bucket bigint, n bigint").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = {m: np.full(BUCKETS, SMOOTH) for m in ("raw", "target")}
    for m, b, n in zip(*(got.column(c).to_pylist() for c in ("model", "bucket", "n")), strict=True):
        out[m][b] += n
    return out


def average(grams: np.ndarray, ratio: np.ndarray) -> float:
    return float(ratio[grams].sum() / (len(grams) + PRIOR))


def weigher(spark: SparkSession, ratio: np.ndarray):
    """A function of the text column: how much likelier the target makes its n-grams, on average."""
    given = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def weigh(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams()
        for texts in it:
            # one text's n-grams at a time: those of a batch would be several times its size
            yield pd.Series([average(grams(t), given.value) for t in texts], dtype="float64")

    return weigh


def fence(ratios: np.ndarray, wide: float = FENCE) -> float:
    """The least ratio at which a document still lies where these do; none below without any."""
    if not len(ratios):
        return float("-inf")
    low, high = np.quantile(ratios, (0.25, 0.75))
    return float(low - wide * max(high - low, 1e-9))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: a histogram of 1024 bars narrows the range until few rows are left."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while n > FEW and lo < hi:
        step = (hi - lo) / 1024
        bar = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(step)), F.lit(1023)).alias("bar")
        bars = df.where(F.col(column).between(lo, hi)).groupBy(bar).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bar")).collect()
        for b in bars:
            if k <= b["n"]:
                break
            k -= b["n"]
        if (b["lo"], b["hi"]) == (lo, hi):
            break
        lo, hi, n = b["lo"], b["hi"], b["n"]
    if lo == hi:
        return lo
    return sorted((r[0] for r in df.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)[k - 1]


def noise(key: str, seed: int):
    """Gumbel noise, the same for an id whatever the partitioning."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


class Resampler:
    """Fitted on the corpus when made; then drawn() or draw(). carry: columns to keep beside the key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED, seed: int = 17, carry: bool = False, temperature: float = TEMPERATURE):
        self.key, self.text, self.columns = key, text, docs.columns
        spark = docs.sparkSession
        rows = {r["id"]: r["y"] for r in sample_labels(labels, key, label, most).collect()}
        fold = {i: xxhash.xxh3_64_intdigest(str(i)) % 2 for i in rows}
        counts = count_grams(docs, {i: y for i, y in rows.items() if fold[i] == 0}, key, text)
        ratio = np.log(counts["target"] / counts["target"].sum()) - np.log(counts["raw"] / counts["raw"].sum())
        if not any(y == 1 for i, y in rows.items() if fold[i] == 0):
            ratio = np.zeros(BUCKETS)
        weigh = weigher(spark, ratio)
        kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if carry else F.lit(0).alias("row")
        # a table of the weighed rows: what is drawn is read from it, not hashed again
        self.weighed = weighed = written(docs.select(F.col(key).alias("id"), weigh(F.col(text)).alias("ratio"), kept))
        held = spark.createDataFrame([(i,) for i, y in rows.items() if fold[i] == 1 and y == 1], "id bigint")
        # one row for each labelled id, however often the corpus repeats it
        found = weighed.join(F.broadcast(held), "id").groupBy("id").agg(F.avg("ratio").alias("ratio")).toArrow().column("ratio").to_numpy()  # LABELLED at most
        n, self.k = weighed.agg(F.count(F.lit(1)), F.count_if(F.col("ratio") >= fence(found))).first()
        scores = weighed.withColumn("log_weight", F.col("ratio") / temperature)
        self.scores = scores.withColumn("drawing_key", F.col("log_weight") + noise("id", seed))
        self.bar = float("-inf") if self.k >= n else kth_largest(self.scores, "drawing_key", self.k)

    def drawn(self) -> DataFrame:
        """(key, log_weight, drawing_key, selected) of each row."""
        return self.scores.select(F.col("id").alias(self.key), "log_weight", "drawing_key", F.coalesce(F.col("drawing_key") >= self.bar, F.lit(self.bar == float("-inf"))).alias("selected"))

    def draw(self) -> DataFrame:
        """The drawn rows, with their columns. Needs carry."""
        return self.scores.where(F.coalesce(F.col("drawing_key") >= self.bar, F.lit(self.bar == float("-inf")))).select(*(F.col("row")[c].alias(c) for c in self.columns))
