"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's offset from the mean is rotated at random; of each component only the sign is kept, packed into bits, with two scalars: the offset's length and how well the signs match it. From these the inner product with any query is estimated without bias, and an error bound follows from the match (EPS standard errors). In each shard a query's candidates are those whose upper bound reaches the K-th largest lower bound; they are reranked with the original vectors, in double precision.

Queries are a stated part of the rows (ids divisible by EVERY), against all rows, in blocks: each shard of about SHARD_BYTES of vectors meets all queries, block by block, and hands on K rows for each, of which each task that combines keeps K. No bucket is skipped, so recall depends on the bounds alone. Parts round a centre could be skipped only where |query| * radius + query * centre stays below what a query has already; vectors of length 1 that are spread over the sphere leave nearly all parts (README).

Vectors that are null, zero, not finite, or not of the most frequent length take no part, nor do those without an id. Of rows with one id the least vector counts. Ties go to the smaller id. The key is a bigint. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import arrow, written

K, EVERY, EPS, SHARD_BYTES, LEAST_SHARD, BLOCK = 20, 20, 2.5, 32 << 20, 2048, 64


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed codes of a shard's vectors."""

    def __init__(self, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        n, dim = vectors.shape
        self.wide = -(-dim // 8) * 8
        rest = np.zeros((n, self.wide))
        rest[:, :dim] = vectors - mean
        self.length = np.linalg.norm(rest, axis=1)
        unit = (rest / np.where(self.length > 0, self.length, 1)[:, None]) @ turn.T
        self.bits = np.packbits(unit > 0, axis=1)
        #: inner product of the unit offset and its code
        self.match = np.maximum(np.abs(unit).sum(1) / np.sqrt(self.wide), 1e-9)
        self.mean, self.turn = mean, turn

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries by vectors) and the half width of their bounds. A byte of a code looks up the sum of its signs times the query's components."""
        q = np.zeros((len(queries), self.wide))
        q[:, : queries.shape[1]] = queries
        q = (q @ self.turn.T).reshape(len(queries), -1, 8)
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
        sums = (q @ signs.T).astype(np.float32)
        total = np.zeros((len(queries), len(self.bits)), np.float32)
        for byte in range(sums.shape[1]):
            total += sums[:, byte][:, self.bits[:, byte]]
        scale = (self.length / self.match / np.sqrt(self.wide)).astype(np.float32)
        norm = np.linalg.norm(queries, axis=1).astype(np.float32)
        wide = (self.length * np.sqrt(np.maximum(1 - self.match**2, 0)) / self.match * EPS / np.sqrt(max(self.wide - 1, 1))).astype(np.float32)
        return total * scale + (queries @ self.mean).astype(np.float32)[:, None], norm[:, None] * wide


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components."""
    out = np.zeros(len(vectors))
    for d in range(len(query)):
        out += query[d] * vectors[:, d]
    return out


def search(codes: Codes, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's k best in the shard."""
    for at in range(0, len(queries), BLOCK):
        block = queries[at : at + BLOCK]
        guess, err = codes.estimate(block)
        for j, (qid, q) in enumerate(zip(query_ids[at : at + BLOCK], block, strict=True)):
            other = ids != qid
            low = np.where(other, guess[j] - err[j], -np.inf)
            bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            near = np.flatnonzero(other & (guess[j] + err[j] >= bar))
            if len(near) > 4 * k:
                rough = vectors[near] @ q
                near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())]
            score = exact(q, vectors[near])
            best = np.lexsort((ids[near], -score))[:k]
            yield int(qid), ids[near][best], score[best]


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, written, and their dimension."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    ok = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(fine)
    dims = ok.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = dims["dim"] if dims else 0
    return written(ok.where(F.size(vector) == dim).groupBy(F.col(key).alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))), dim


def average(vectors: DataFrame, dim: int) -> np.ndarray:
    """The mean of all vectors: each task hands the driver one sum."""
    schema = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64()))])

    def run(it):
        n, s = 0, np.zeros(dim)
        for b in it:
            v = b.column("v").flatten().to_numpy().reshape(-1, dim)
            n, s = n + len(v), s + v.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64()))], schema=schema)

    sums = vectors.select("v").mapInArrow(run, "n bigint, s array<double>").groupBy().agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dim))).first()
    return np.array([sums[f"s{d}"] or 0.0 for d in range(dim)]) / max(sums["n"] or 0, 1)


def neighbours(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with key divisible by every."""
    spark = rows.sparkSession
    vectors, dim = usable(rows, key, vector)
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = vectors.count()
    shards = max(-(-n * dim * 8 // SHARD_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD)))
    given = spark.sparkContext.broadcast((average(vectors, dim), rotation(-(-dim // 8) * 8)))
    dealt = vectors.select(F.lit(0).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    asked = vectors.where(F.col("id") % every == 0).select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(it) -> Iterator[tuple]:
        mean, turn = given.value
        shard, held, codes, ids, own = None, [], None, None, None
        for b in it:
            s, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            i, v = b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(-1, dim)
            cut = np.flatnonzero(np.r_[True, (np.diff(s) != 0) | (np.diff(kind) != 0), True])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if s[lo] != shard:
                    shard, held, codes = s[lo], [], None
                if kind[lo] == 0:
                    held.append((i[lo:hi], v[lo:hi].copy()))
                    continue
                if codes is None:
                    if not held:
                        continue
                    ids, own = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                    codes = Codes(own, mean, turn)
                for qid, near, score in search(codes, ids, own, i[lo:hi], v[lo:hi], k):
                    yield from ((qid, y, x) for x, y in zip(score.tolist(), near.tolist(), strict=True))

    found = dealt.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda it: arrow(schema, run(it), 5000), "query_id bigint, vec_id bigint, score double")
    # Spark limits a ranked window's groups before it shuffles them
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with e as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
