"""Packing of documents into sequences of at most SEQUENCE tokens: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids, with an end mark, give full sequences of their own; what remains goes into bins. Documents are dealt by a hash to partitions and packed in groups of at most GROUP, each on its own, so nothing grows with the input but the number of groups. After first-fit decreasing, the emptiest bins of a group are cut up to fill the others, and the last one becomes sequences of powers of two: these need no padding.

Null texts are empty: the end mark alone. Repeated rows are packed each. The key is a bigint. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bpe import WordBpe, split_raw
from lodestar.llm.common import Recent, arrow, batches

SEQUENCE, END, GROUP = 2048, 1, 4096
#: Bytes of remaining ids at which a group ends early.
GROUP_BYTES = 32 << 20


class Tournament:
    """Bins in order of opening; finds the first that has room for a size in O(log n). Each inner node holds the larger capacity of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [capacity] * (2 * self.leaves)
        for k in range(self.leaves + bins, 2 * self.leaves):
            self.best[k] = 0
        for k in range(self.leaves - 1, 0, -1):
            self.best[k] = max(self.best[2 * k], self.best[2 * k + 1])

    def place(self, size: int) -> int:
        best, k = self.best, 1
        while k < self.leaves:
            k = 2 * k if best[2 * k] >= size else 2 * k + 1
        found = k - self.leaves
        best[k] -= size
        while k > 1:
            k >>= 1
            best[k] = max(best[2 * k], best[2 * k + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Items (by index) of each bin."""
    tree, bins = Tournament(len(sizes), capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = tree.place(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def fill(bins: list[list[int]], sizes: list[int], capacity: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, start, length): the emptiest bins are cut to fill the others' gaps; the last one that is not full is cut into powers of two."""
    held = sorted(([[k, 0, sizes[k]] for k in b] for b in bins), key=lambda b: -sum(p[2] for p in b))
    room = [capacity - sum(p[2] for p in b) for b in held]
    lo, hi = 0, len(held) - 1
    while lo < hi:
        if not room[lo]:
            lo += 1
        elif not held[hi]:
            hi -= 1
        else:
            k, start, n = held[hi][-1]
            take = min(n, room[lo])
            held[lo].append([k, start + n - take, take])
            room[lo] -= take
            room[hi] += take
            if take == n:
                held[hi].pop()
            else:
                held[hi][-1][2] = n - take
    out = [[tuple(p) for p in b] for b in held if b]
    if out and (left := sum(p[2] for p in out[-1])) < capacity:
        rest = out.pop()
        while left:
            want, part = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                k, start, n = rest.pop()
                take = min(n, want)
                part.append((k, start, take))
                want -= take
                if take < n:
                    rest.append((k, start + take, n - take))
            out.append(part)
    return out


_made: dict[str, Recent] = {}


def _known(path: str) -> Recent:
    """Ids of words and of raw parts of texts as little-endian unsigned 16-bit bytes; the library's own model does the merging."""
    if path not in _made:
        from tokenizers import Tokenizer

        bpe, model = WordBpe(path), Tokenizer.from_file(path).model
        symbol = bpe.symbol

        def merged(word: str) -> bytes:
            shown = word if word.isascii() and word.isprintable() else "".join([symbol[b] for b in word.encode("utf-8", "surrogatepass")])
            return np.array([t.id for t in model.tokenize(shown)], "<u2").tobytes()

        def make(part: str) -> bytes:
            found = bpe.pieces(part)
            if "<|" in part:  # a special token, or a word that looks like one
                return b"".join([w.to_bytes(2, "little") if isinstance(w, int) else merged(w) for w in found])
            return merged(part) if found == [part] else b"".join([known[w] for w in found])

        known = _made[path] = Recent(make, 128 << 20)
    return _made[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset). Only what does not fill a sequence is shuffled, as 16-bit ids."""
    coded = pa.schema([(key, pa.int64()), ("total", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.binary())])
    done = pa.schema([(key, pa.int64()), *((n.split()[0], pa.int64()) for n in PIECES.split(", "))])

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = _known(path)
        for k, t in batches(it, key, text):
            ids = np.frombuffer(b"".join(map(known.__getitem__, split_raw(t or ""))) + END.to_bytes(2, "little"), "<u2")
            whole = len(ids) // SEQUENCE * SEQUENCE
            yield k, len(ids), [crc(ids[a : a + SEQUENCE]) for a in range(0, whole, SEQUENCE)], ids[whole:].tobytes()

    def group(rows: list[tuple], following: Iterator[int]) -> Iterator[tuple]:
        rest = []
        for k, total, crcs, ids in rows:
            for j, c in enumerate(crcs):
                yield k, j * SEQUENCE, SEQUENCE, c, total, next(following), 0
            if ids:
                rest.append((k, total, len(crcs) * SEQUENCE, np.frombuffer(ids, "<u2")))
        sizes = [len(x[3]) for x in rest]
        for b in fill(first_fit_decreasing(sizes), sizes):
            s, at = next(following), 0
            for i, start, n in b:
                k, total, base, ids = rest[i]
                yield k, base + start, n, crc(ids[start : start + n]), total, s, at
                at += n

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        following = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))
        held, size = [], 0
        for row in batches(it, key, "total", "crcs", "rest"):
            held.append(row)
            size += len(row[3]) + 8 * len(row[2])
            if len(held) >= GROUP or size >= GROUP_BYTES:
                yield from group(held, following)
                held, size = [], 0
        yield from group(held, following)

    ids = docs.select(key, text).mapInArrow(lambda it: arrow(coded, code(it), 500), f"{key} bigint, total bigint, crcs array<bigint>, rest binary")
    # the order within a partition is fixed, so that a task that runs again packs the same
    dealt = ids.withColumn("_h", F.xxhash64(key, "total", "rest")).repartition("_h").sortWithinPartitions("_h", key, "total").drop("_h")
    return dealt.mapInArrow(lambda it: arrow(done, deal(it), 5000), f"{key} bigint, {PIECES}")
