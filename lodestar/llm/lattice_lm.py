"""Scoring by a subword lattice: a text's probability is the sum over all its segmentations into pieces of a published vocabulary.

The vocabulary is fixed; each piece has a unigram probability. They start from the published scores (ranks, so a piece's share falls as one over its rank) and are fitted to the training documents by expectation and maximisation: each round, every distinct training word sends the expected uses of pieces over its lattice, and the published shares count as PRIOR further uses. A word's lattice has an arc for each piece that its bytes hold, bytes themselves included, so every text has a probability. No piece goes on behind a blank, so the lattice of a text is that of its words one after another, and the forward recursion (in log space) runs once for each distinct word of a batch.

A word of the training documents is one more segmentation of itself, a single arc over its whole lattice, discounted: with count n it has (n - d) / (N + 1), d from the counts of counts; what is discounted goes to the pieces, as does one further token, and what of it is not the end (END of it) is dealt by the lattice. These probabilities sum to one at most over all texts. lattice_score is the score by the pieces alone.

Words are runs without blank and U+0009 to U+000D, only A-Z lower-cased; a word's first piece begins with the blank before it. The base score is that of single words with 0.1 added to every count.

At scale: words are counted in tasks before they are shuffled. A pass over all texts scores the words itself; counts come from a broadcast of the FREQUENT most frequent words of at most SHORT bytes, and for all other words from a join with one row for each word and batch of documents. What the driver holds is bounded by the vocabulary and by FREQUENT.

A document is held out if crc32 of its key as text is a multiple of 10 (a null key: of no text, so it is). Null texts are empty: the end alone. Repeated rows are scored each. Without training documents the pieces keep their published shares and the base score is 0. The key is a bigint; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow, batches, frequent, written, written_counting

#: Rounds of fitting, uses that the published shares stand for, share of the end among tokens that no count foretells.
ROUNDS, PRIOR, END = 3, 30_000.0, 0.01
#: Words that are broadcast, and how long they may be.
FREQUENT, SHORT = 1 << 18, 48
#: Lattices of longer words go one by one.
LONG = 64
#: Words that a task counts before it sends them on, and bytes of them.
COUNTED, COUNTED_BYTES = 400_000, 24 << 20
_LN10 = math.log(10)


class Pieces:
    """A published vocabulary as bytes: which piece is which string, and their published shares."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids: dict[bytes, int] = {}
        share: list[float] = []

        def add(string: bytes, part: float) -> None:
            if string in ids:
                share[ids[string]] += part  # two pieces of the same bytes are two arcs
            else:
                ids[string] = len(share)
                share.append(part)

        size = model.get_piece_size()
        for i in range(size):
            if model.is_byte(i):
                add(bytes([int(model.id_to_piece(i)[1:-1], 16)]), 1 / size)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                string = model.id_to_piece(i).replace("▁", " ")
                if " " in string[1:]:
                    continue  # runs of blanks lie in no word
                add(string.encode(), 1 / (1 - model.get_score(i)))
        self.share = np.array(share) / sum(share)
        # the trie as a hash table over (node, byte)
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for string, i in ids.items():
            at = 0
            for b in string:
                if (at, b) not in nodes:
                    nodes[at, b] = len(piece)
                    piece.append(-1)
                at = nodes[at, b]
            piece[at] = i
        self.piece = np.array(piece, np.int32)
        self.longest = max(map(len, ids))
        keys = np.fromiter((n << 8 | b for n, b in nodes), np.int64, len(nodes))
        self.bits = len(nodes).bit_length() + 2
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.full(1 << self.bits, -1, np.int32)
        spot = self._spot(keys)
        for k, s, n in zip(keys.tolist(), spot.tolist(), nodes.values(), strict=True):
            while self.keys[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.next[s] = k, n

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node by a byte, -1 where there is none."""
        keys = node.astype(np.int64) << 8 | byte
        spot = self._spot(keys)
        found = self.keys[spot]
        out = np.where(found == keys, self.next[spot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[spot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.next[spot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def arcs(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, pieces) of the pieces in data; ends: for each byte, where its word ends."""
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        for n in range(1, self.longest + 1):
            node = self.step(node, data[at + n - 1])
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = self.piece[node]
            full = piece >= 0
            if full.any():
                yield n, at[full], piece[full]
            more = at + n < ends[at]
            at, node = at[more], node[more]
            if not len(at):
                return


class Lattices:
    """The lattices of a batch of words, each a blank and its bytes. Short ones advance together: for each place in a word and each length of a piece there is at most one arc a word."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.data = np.frombuffer(b"".join([b" " + w for w in words]), np.uint8)
        last = np.cumsum(sizes)
        self.sizes, self.first = sizes, last - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        arcs = list(pieces.arcs(self.data, last[word])) if len(words) else []
        start = np.concatenate([a for _, a, _ in arcs]) if arcs else np.zeros(0, np.int64)
        self.piece = np.concatenate([p for *_, p in arcs]) if arcs else np.zeros(0, np.int32)
        length = np.repeat(np.array([n for n, *_ in arcs], np.int64), [len(a) for _, a, _ in arcs]) if arcs else start
        # a place for each byte and one at each word's end
        self.of = word[start]
        self.start = start + self.of
        self.stop = self.start + length
        place = start - self.first[self.of] + length
        long = sizes[self.of] > LONG
        self.long = np.flatnonzero(long)
        # by place, then length
        key = np.where(long, 0, place * 64 + length).astype(np.uint16)
        self.order = np.argsort(key, kind="stable")[len(self.long) :]
        key = key[self.order]
        self.cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else np.zeros(1, np.int64)
        self.places = int(sizes.sum()) + len(words)
        self.heads = self.first + np.arange(len(words))
        self.tails = self.heads + sizes

    def _runs(self) -> list[np.ndarray]:
        return [self.order[a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of all ways from a word's begin to each place."""
        out = np.full(self.places, -np.inf)
        out[self.heads] = 0.0
        score = logs[self.piece]
        for run in self._runs():
            to = self.stop[run]
            out[to] = np.logaddexp(out[to], out[self.start[run]] + score[run])
        self._singly(out, score, self.start, self.stop, self.long[np.argsort(self.stop[self.long], kind="stable")])
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """The same from each place to the word's end."""
        out = np.full(self.places, -np.inf)
        out[self.tails] = 0.0
        score = logs[self.piece]
        for run in reversed(self._runs()):
            # arcs that end at one place, of one length: one a word
            to = self.start[run]
            out[to] = np.logaddexp(out[to], out[self.stop[run]] + score[run])
        self._singly(out, score, self.stop, self.start, self.long[np.argsort(-self.start[self.long], kind="stable")])
        return out

    @staticmethod
    def _singly(out: np.ndarray, score: np.ndarray, start: np.ndarray, stop: np.ndarray, arcs: np.ndarray) -> None:
        """Long words, place by place."""
        if not len(arcs):
            return
        to = stop[arcs]
        cuts = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)].tolist()
        held: dict[int, float] = {}
        begins, values, to = start[arcs].tolist(), score[arcs].tolist(), to.tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ways = [(held[p] if (p := begins[k]) in held else float(out[p])) + values[k] for k in range(a, b)]
            most = max(ways)
            held[to[a]] = most if len(ways) == 1 or most == -math.inf else most + math.log(sum([math.exp(w - most) for w in ways]))
        out[list(held)] = list(held.values())

    def marginal(self, logs: np.ndarray) -> np.ndarray:
        """Each word's log probability, summed over its segmentations."""
        return self.forward(logs)[self.tails]

    def expected(self, logs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, each word once."""
        to, back = self.forward(logs), self.backward(logs)
        uses = np.exp(to[self.start] + logs[self.piece] + back[self.stop] - to[self.tails][self.of])
        return np.bincount(self.piece, uses, len(logs))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(key: int | None) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


_made: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


def portions(words: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words in portions of so many bytes."""
    held, n = [], 0
    for w in words:
        held.append(w)
        n += len(w) + 1
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the training documents; the empty word is the end of a text."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(it) -> Iterator[tuple]:
        counts: Counter = Counter()
        since = 0
        for k, t in batches(it, key, text):
            if not held_out(k):
                words = words_of(t)
                counts.update(words)
                counts[b""] += 1
                since += len(words)
                if since > COUNTED and (len(counts) > COUNTED or sum(map(len, counts)) > COUNTED_BYTES) or len(t or "") > COUNTED_BYTES:
                    yield from counts.items()
                    counts, since = Counter(), 0
                elif since > COUNTED:
                    since = 0
        yield from counts.items()

    return docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it), 20_000), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, fitted to the distinct words of counts (the lattice is for what has not been seen, so a word weighs as often as it was new: once). Each round collects one number a piece."""
    share, spark = pieces_of(path).share, counts.sparkSession
    logs = np.log(share)
    schema = pa.schema([("piece", pa.int64()), ("uses", pa.float64())])

    def expect(it, given) -> Iterator[tuple]:
        own, uses = pieces_of(path), np.zeros(len(given.value))
        for words in portions(w for (w,) in batches(it, "word") if w):
            uses += Lattices(own, words).expected(given.value)
        at = np.flatnonzero(uses)
        yield from zip(at.tolist(), uses[at].tolist(), strict=True)

    for _ in range(rounds):
        given = spark.sparkContext.broadcast(logs)
        got = counts.select("word").mapInArrow(lambda it, given=given: arrow(schema, expect(it, given), 40_000), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = PRIOR * share
        uses[got.column("piece").to_numpy()] += got.column("uses").to_numpy()
        logs = np.log(uses / uses.sum())
        given.unpersist()
    return logs


COLUMNS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def score(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, *COLUMNS) of each document; scores are log10 probabilities."""
    spark = docs.sparkSession
    one = F.lit(1).cast("bigint")
    counts, (distinct, total, once, twice, ends) = written_counting(count_words(docs, key, text), F.count(one), *(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), F.when(F.col("n") == 1, one), F.when(F.col("n") == 2, one), F.when(F.length("word") == 0, F.col("n")))))
    logs = fit(counts, path, rounds)
    less = once / (once + 2 * twice) if once else 0.5
    spare = less * distinct + 1
    dealt = math.log10((1 - END) * spare / (total + 1))
    floor = math.log10(total + 0.1 * (distinct + 1))
    end = math.log10(ends + 0.1), math.log10((max(ends - less, 0) + END * spare) / (total + 1)), int(ends > 0)
    known_as = pa.schema([("word", pa.binary()), ("base", pa.float64()), ("score", pa.float64()), ("lattice", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("lattice", pa.float64()), ("word", pa.binary()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def marginals(words: Iterable[bytes]) -> Iterator[tuple[bytes, float]]:
        own = pieces_of(path)
        for part in portions(words):
            yield from zip(part, (Lattices(own, part).marginal(logs) / _LN10).tolist(), strict=True)

    def weigh(it) -> Iterator[tuple]:
        for b in it:
            words, n = b.column("word").to_pylist(), b.column("n").to_pylist()
            for (w, x), c in zip(marginals(words), n, strict=True):
                yield w, math.log10(c + 0.1), math.log10((c - less) / (total + 1) + 10 ** (dealt + x)), x

    def batch(rows: list[tuple], known: dict[bytes, tuple[float, float, float]]) -> Iterator[tuple]:
        """A row for each document with what its frequent words give, and one for each other word of the batch with the documents that have it."""
        heads, others = [], {}
        for k, t in rows:
            words = words_of(t)
            h = xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63)
            base, scored, n_known = end
            lattice = scored
            for w, n in Counter(words).items():
                if (got := known.get(w)) is not None:
                    base += n * got[0]
                    scored += n * got[1]
                    lattice += n * (got[2] + dealt)
                    n_known += n
                else:
                    others.setdefault(w, []).append((len(heads), n))
            heads.append([k, h, len(words) + 1, n_known, base, scored, lattice])
        for w, x in marginals(others):
            for d, n in others[w]:
                heads[d][6] += n * (x + dealt)
            yield None, None, None, None, None, None, x, w, [heads[d][0] for d, _ in others[w]], [heads[d][1] for d, _ in others[w]], [n for _, n in others[w]]
        for x in heads:
            yield *x, None, None, None, None

    def run(it) -> Iterator[tuple]:
        words, *values = given.value
        known = dict(zip(words, zip(*values, strict=True), strict=True))
        held, size = [], 0
        for k, t in batches(it, key, text):
            held.append((k, t))
            size += len(t or "")
            if size > 32 << 20 or len(held) >= 20_000:
                yield from batch(held, known)
                held, size = [], 0
        yield from batch(held, known)

    short = counts.where((F.length("word") <= SHORT) & (F.length("word") > 0))
    top = short.where((F.col("n") >= frequent(short, "n", FREQUENT)) & (F.col("n") > less)).mapInArrow(lambda it: arrow(known_as, weigh(it), 5000), "word binary, base double, score double, lattice double").toArrow()  # FREQUENT short words at most
    given = spark.sparkContext.broadcast([top.column(c).to_pylist() for c in known_as.names])
    both = written(docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it), 2000), "id bigint, text_hash bigint, tokens bigint, known bigint, base double, score double, lattice double, word binary, ids array<bigint>, hashes array<bigint>, times array<int>"))
    none = F.lit(0).cast("bigint")
    heads = both.where("word is null").select("id", "text_hash", one.alias("rows"), "tokens", "known", "base", "score", "lattice")
    # one row a word and batch, so no word is hot; counted words meet their count
    n = F.coalesce("n", none)
    pieces = F.lit(dealt) + F.col("lattice")
    scored = F.when(n > less, F.log10((n - less) / (total + 1) + F.pow(F.lit(10.0), pieces))).otherwise(pieces)
    each = both.where("word is not null").join(counts, "word", "left").select(n.alias("n"), scored.alias("scored"), F.explode(F.arrays_zip("ids", "hashes", "times")).alias("x"))
    rest = each.select("x.ids", "x.hashes", none, none, F.when(F.col("n") > 0, F.col("x.times").cast("bigint")).otherwise(none), F.col("x.times") * F.log10(F.col("n") + 0.1), F.col("x.times") * F.col("scored"), F.lit(0.0))
    sums = heads.union(rest).groupBy("id", "text_hash").agg(*(F.sum(c).alias(c) for c in heads.columns[2:]))
    # rows of one key and text are the same row again: each gets its share
    share = lambda c: F.col(c) / F.col("rows")
    out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return sums.select(
        F.col("id").alias(key),
        out.alias("held_out"),
        F.round(share("tokens")).cast("bigint").alias("n_tokens"),
        F.round(share("known")).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (share("base") - share("tokens") * F.lit(floor)).alias("base_score"),
        share("score").alias("score"),
        share("lattice").alias("lattice_score"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_again"),
    ).drop("_again")
