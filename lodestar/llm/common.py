"""What several operators share: written tables, shingles, a fixed-size Bloom filter, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.scratch import remove, scratch

#: Words of a shingle.
SHINGLE_WORDS = 5
#: Bits of the Bloom filter over ids: 2^25 bits are 4 MB, however large the input is.
BLOOM_BITS = 25
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again. A lost executor costs the tasks that read it, not what was before. What a returned frame reads stays until the driver ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lodestar_path = path
    return out


def written_counting(df: DataFrame, *sums: Column) -> tuple[DataFrame, tuple]:
    """written(df), and aggregates over it that the same job has gathered."""
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(f"_{k}") for k, c in enumerate(sums))))
    got = seen.get
    return out, tuple(got[f"_{k}"] for k in range(len(sums)))


def forget(df: DataFrame) -> None:
    """Removes the files of a table that written() made, once nothing reads them any more."""
    remove(df.sparkSession, df.lodestar_path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which stay until the driver's JVM collects their handles. A frame that was itself written or collected, and is still held by a name, keeps its files."""
    for _ in range(3):  # a stage's broadcast holds its shuffle: one goes first, then the other
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def hashable(df: DataFrame) -> list[Column]:
    """The columns that have a hash: maps and variants have none."""
    return [F.col(f"`{f.name}`") for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def spread(left: DataFrame, right: DataFrame, key: str, how: str = "inner", n: int | None = None, most: int = 1000) -> DataFrame:
    """left joined with right on key, where any number of left's rows may share a key. A key of more than 1/most of left's rows is dealt over several tasks, each with its own copy of right's row; there are fewer than most such keys, so the driver may know them whatever the input. Keys that are null meet nothing and are dealt too. left is read twice: hand in a written table. n: its rows, where they are known."""
    bar = max((left.count() if n is None else n) // most, 16)
    dealt: dict[int, list] = {}
    for r in left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > bar).collect():  # fewer than most rows
        dealt.setdefault(-(-r["count"] // bar), []).append(r[key])
    times = F.lit(1)
    for t, keys in dealt.items():
        times = F.when(F.col(key).isin(keys), t).otherwise(times)
    dice = F.pmod(F.xxhash64(*hashable(left)), F.when(F.col(key).isNull(), most).otherwise(times)).cast("int")
    one = left.withColumn("_salt", dice)
    two = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), times - 1))) if dealt else right.withColumn("_salt", F.lit(0))
    return one.join(two, [key, "_salt"], how).drop("_salt")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def weight(x) -> int:
    """About how many bytes a string, number, or list of them takes."""
    if isinstance(x, (str, bytes)):
        return 60 + len(x) * (1 if isinstance(x, bytes) or x.isascii() else 2)
    return 60 + sum(map(weight, x)) if isinstance(x, (list, tuple)) else 32


class Cache(dict):
    """make(key) for each key, kept until they weigh limit bytes; then all are dropped, so a worker's memory stays bounded. What weighs a sixteenth of the limit or more is not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        size = 220 + 2 * len(key) + (len(value) if type(value) is bytes else weight(value))
        if size < self.limit >> 4:
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self[key] = value
            self.held += size
        return value


class Recent(Cache):
    """A Cache in two halves: when the newer one weighs half the limit, it becomes the older one, and that is dropped. What is met again meanwhile stays. weigh: about how many bytes a value takes."""

    def __init__(self, make, limit: int, weigh=len):
        super().__init__(make, limit)
        self.weigh, self.older = weigh, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = 220 + 2 * len(key) + self.weigh(value)
        if size < self.limit >> 4:
            if self.held + size > self.limit >> 1:
                self.older = self.copy()
                self.clear()
                self.held = 0
            self[key] = value
            self.held += size
        return value


class WordHashes(dict):
    """64-bit hashes of words, as a Cache of bytes."""

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        size = len(word) + 170
        if self.held + size > self.limit:
            self.clear()
            self.held = 0
        if size < self.limit >> 4:
            self[word] = h
            self.held += size
        return h


def shingles(text: str | None, hashes: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles. Only A-Z are lower-cased; words are runs without blank and U+0009 to U+000D, which is what bytes.lower() and bytes.split() do. Fewer words than width: the whole sequence is one shingle; none: nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    s = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        s = mix(s * _MUL + h[k : len(h) - n + 1 + k])
    return np.unique(mix(s))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batches(it: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, some hundreds of rows at a time."""
    for b in it:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)
    pa.default_memory_pool().release_unused()  # a worker is used again, and keeps what it does not give back


def arrow(schema: pa.Schema, rows: Iterable[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most size rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def frequent(counts: DataFrame, n: str, most: int) -> int:
    """A count that at most most rows reach or pass, close to as many as that: from a histogram of four bars for each doubling."""
    bars = counts.groupBy(F.floor(F.log2(n) * 4).alias("bar")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("low"), F.max(n).alias("high")).orderBy(F.desc("bar")).collect()  # 256 at most
    bar = bars[0]["high"] + 1 if bars else 1
    for b in bars:
        most -= b["rows"]
        if most < 0:
            break
        bar = b["low"]
    return bar


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter over a long column as 2^BLOOM_BITS bits. What comes to the driver is bounded by its size; more ids only make it let more through."""
    spots = [F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(k)), 64 - BLOOM_BITS) for k in (1, 2)]
    words = (
        ids.select(F.explode(F.array(*spots)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    ).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def maybe_in(column: str) -> tuple:
    """The two spots of an id, as columns to hand to bloom_hit()."""
    return tuple(F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(k)), 64 - BLOOM_BITS).alias(f"_p{k}") for k in (1, 2))


def bloom_hit(bits: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    hit = lambda x: (bits[x >> 6] >> (x & 63)) & 1
    return (hit(p) & hit(q)).astype(bool)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): component is the least node that links reach. edges: columns a, b.

    Alternates large-star and small-star steps until the edges stay the same: each turns a tree into a star at its least node, and each only needs a minimum per node (combined before the shuffle) and a join in which a node of very many links is dealt over several tasks. If rounds is given and the edges still change after them, it raises.
    """
    sums = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    e, before = written_counting(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), *sums)
    done, k = not before[0], 0
    while not done:
        if k == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        k += 1
        # every link seen from its larger end, and each node's least neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a link is hung where its lesser end's least neighbour is: b is the hub that may have very many links
        large = spread(e.select("b", F.col("a").alias("x")), least.withColumnRenamed("a", "b"), "b", n=before[0]).select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        after, now = written_counting(small, *sums)
        done = now == before
        old, e, before = e, after, now
        forget(old)
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
