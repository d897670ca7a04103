"""Cross-tokenizer alignment: which tokens of two vocabularies overlap in a text, by pandas merge_asof per batch, keyed by document.

A is a byte-level vocabulary, B one of pieces with byte fallback; both read the text with a blank before it. In a batch each token start finds the other side's covering token (the last that starts there or before, in the same document), once in each direction; the union of both directions is all overlaps, and overlaps whose ends are equal close a group.

Encoding: neither vocabulary has a token that goes on from a character that is no white space to a blank behind it, and A's pattern always cuts there. So a text's tokens are those of its parts between such places, and a task encodes each part that it meets once, as long as its memory of parts is not full. A document of very many parts goes through in several portions, cut at such a place, where both sides end a token.

Counts: how many links of the corpus hold a pair of ids. A document's pairs are written with their times in it; tasks sum them before they are shuffled. The FREQUENT most frequent pairs are broadcast with their counts, all others meet theirs in a join with one row for each pair and batch. The highest count of each B id is a table no longer than B's vocabulary.

Texts that are null, empty, or hold U+2581 (which B reads as a blank), or that either side does not give back byte for byte, have no tokens. Repeated rows are aligned each. The key is a bigint; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bpe import byte_symbols
from lodestar.llm.common import arrow, batches, forget, frequent, written

#: Pairs that are broadcast, parts aligned at a time, parts and tokens that a task remembers.
FREQUENT, PORTION, PARTS, TOKENS = 1 << 19, 120_000, 250_000, 4_000_000
#: Pairs that a task sums at a time.
SUMMED = 3_000_000

_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s |\s\Z")


class Parts:
    """Tokens of parts of texts, each a blank and what follows: ids and byte lengths on both sides, in flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        strings = self.a.get_vocab()
        self.bytes_a: list[bytes] = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.bytes_a[i] = bytes(map(byte.get, s)) if all(c in byte for c in s) else s.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.blank = self.b.piece_to_id("▁")
        # ids in decimal, with what follows them: the next of the side, the other side or the next group, nothing
        self.said_a = np.array([f"{i}{x}" for i in range(len(self.bytes_a)) for x in ",|"], object)
        self.said_b = np.array([f"{i}{x}" for i in range(len(self.bytes_b)) for x in (",", ";", "")], object)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first = array("q", [0]), array("q", [0])
        self.ids = array("H"), array("H")
        self.sizes = array("I"), array("I")
        self.whole = array("b")

    def learn(self, parts: list[str]) -> None:
        """Encodes parts that are not known yet."""
        b_of = self.b.encode([p[1:] for p in parts])
        for p, a, b in zip(parts, self.a.encode_batch(parts, add_special_tokens=False), b_of, strict=True):
            raw, b = p.encode(), b if len(p) > 1 else [self.blank]
            got_a, got_b = [self.bytes_a[i] for i in a.ids], [self.bytes_b[i] for i in b]
            self.at[p] = len(self.whole)
            self.whole.append(b"".join(got_a) == raw == b"".join(got_b))
            for side, ids, got in ((0, a.ids, got_a), (1, b, got_b)):
                self.ids[side].extend(ids)
                self.sizes[side].extend(map(len, got))
                self.first[side].append(len(self.ids[side]))

    def known(self, parts: list[str]) -> np.ndarray:
        """Where the parts' tokens are."""
        at = self.at
        new = [p for p in dict.fromkeys(parts) if p not in at]
        if new and (len(at) + len(new) > PARTS or len(self.ids[0]) > TOKENS):
            self.clear()
            at, new = self.at, list(dict.fromkeys(parts))
        if new:
            self.learn(new)
        return np.fromiter(map(at.__getitem__, parts), np.int64, len(parts))

    def tokens(self, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte lengths, place among the parts) of the parts' tokens, in order."""
        first = np.array(self.first[side])
        n = first[at + 1] - first[at]
        stop = np.cumsum(n)
        where = np.repeat(first[at] - (stop - n), n) + np.arange(int(n.sum()))
        return np.array(self.ids[side])[where], np.array(self.sizes[side])[where], np.repeat(np.arange(len(at)), n)


def cut(text: str) -> list[str]:
    """A text with a blank before it, cut at blanks behind what is no white space."""
    spaced = f" {text}"
    if _ODD.search(spaced):
        return _CUT.split(spaced)
    return [f" {p}" for p in text.split(" ")]


class Aligned:
    """What a batch's tokens give: for each document its numbers of tokens, groups and links, and its links as a<<15|b."""

    def __init__(self, parts: Parts, at: np.ndarray, doc: np.ndarray, docs: int, going_on: np.ndarray):
        """at, doc: each part's place in parts and its document; going_on: whether a document has more parts after this batch."""
        if not len(at):
            self.n_a = self.n_b = self.n_groups = self.n_links = np.zeros(docs, np.int64)
            self.links, self.said, self.cuts = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(docs + 1, np.int64)
            return
        frames, ids, ends, docs_of = [], [], [], []
        for side in (0, 1):
            i, size, part = parts.tokens(at, side)
            of, stop = doc[part], np.cumsum(size, dtype=np.int64)
            ids.append(i)
            ends.append(stop)
            docs_of.append(of)
            frames.append(pd.DataFrame({"start": stop - size, "doc": of, ("a", "b")[side]: np.arange(len(i))}))
        a, b = frames
        # both sides cover the same bytes, so the last start at or before is the token that covers
        by_a = pd.merge_asof(a, b, on="start", by="doc")
        by_b = pd.merge_asof(b, a, on="start", by="doc")
        start_a = a["start"].to_numpy()
        own = start_a[by_b["a"].to_numpy()] != by_b["start"].to_numpy()  # equal starts have been found from a
        link_a = np.concatenate([by_a["a"].to_numpy(), by_b["a"].to_numpy()[own]])
        link_b = np.concatenate([by_a["b"].to_numpy(), by_b["b"].to_numpy()[own]])
        of = docs_of[0][link_a]
        self.n_a, self.n_b, self.n_links = (np.bincount(x, minlength=docs) for x in (docs_of[0], docs_of[1], of))
        same = ends[0][link_a] == ends[1][link_b]
        last_a, last_b = np.sort(link_a[same]), np.sort(link_b[same])
        self.n_groups = np.bincount(docs_of[0][last_a], minlength=docs)
        self.links = of.astype(np.int64) << 31 | ids[0][link_a].astype(np.int64) << 15 | ids[1][link_b].astype(np.int64)
        # in the order of groups: a group's tokens of A, then of B
        group_a, group_b = (np.repeat(np.arange(len(x)), np.diff(x, prepend=-1)) for x in (last_a, last_b))
        said = np.empty(len(ids[0]) + len(ids[1]), object)
        before_b = np.r_[0, last_b + 1]
        ends_a, ends_b = np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64)
        ends_a[last_a] = 1
        ends_b[last_b] = 1
        final = np.r_[np.flatnonzero(np.diff(docs_of[1])), len(ids[1]) - 1]
        ends_b[final[~going_on[docs_of[1][final]]]] = 2
        said[np.arange(len(ids[0])) + before_b[group_a]] = parts.said_a[ids[0].astype(np.int64) * 2 + ends_a]
        said[np.arange(len(ids[1])) + last_a[group_b] + 1] = parts.said_b[ids[1].astype(np.int64) * 3 + ends_b]
        self.said, self.cuts = said, np.r_[0, np.cumsum(self.n_a + self.n_b)]

    def groups(self, doc: int) -> str:
        return "".join(self.said[self.cuts[doc] : self.cuts[doc + 1]].tolist())


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its times."""
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


_made: dict[tuple[str, str], Parts] = {}


def _parts(path_a: str, path_b: str) -> Parts:
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Parts(path_a, path_b)
    return _made[path_a, path_b]


class Document:
    """A document while its portions go through."""

    __slots__ = ("key", "hash", "n", "sha", "pairs", "times", "whole")

    def __init__(self, key: int | None, text: str | None):
        self.key, self.hash = key, xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)
        self.n, self.sha, self.whole = np.zeros(4, np.int64), hashlib.sha256(), True
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, n: list[int], said: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.n += n
        self.sha.update(said.encode())
        self.pairs, self.times = summed(np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])) if len(self.pairs) else (pairs, times)

    def row(self) -> tuple:
        if not self.whole or not self.n[0]:
            return self.key, self.hash, 0, 0, 0, 0, "", b"", b""
        return self.key, self.hash, *self.n.tolist(), self.sha.hexdigest(), self.pairs.astype("<u4").tobytes(), self.times.astype("<u4").tobytes()


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row: pairs of ids that are linked in it as 32-bit numbers a<<15|b in order, and how often."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def portions(it) -> Iterator[list[tuple[Document, list[str], bool]]]:
        """(document, parts, whether more follow) until PORTION parts are together."""
        held, n = [], 0
        for k, t in batches(it, key, text):
            doc = Document(k, t)
            doc.whole = bool(t) and "▁" not in t
            parts = cut(t) if doc.whole else []
            at = 0
            while True:
                room = PORTION - n
                held.append((doc, parts[at : at + room], at + room < len(parts)))
                n += len(held[-1][1]) + 1
                at += room
                if n >= PORTION:
                    yield held
                    held, n = [], 0
                if at >= len(parts):
                    break
        if held:
            yield held

    def run(it) -> Iterator[tuple]:
        known = _parts(path_a, path_b)
        for held in portions(it):
            at = known.known([p for _, parts, _ in held for p in parts])
            sizes = [len(parts) for _, parts, _ in held]
            of = np.repeat(np.arange(len(held)), sizes)
            spoilt = np.unique(of[np.array(known.whole)[at] == 0]) if len(at) else of
            for k in spoilt.tolist():
                held[k][0].whole = False
            fine = ~np.isin(of, spoilt)
            at, of = at[fine], of[fine]
            got = Aligned(known, at, of, len(held), np.array([more for *_, more in held]))
            links, times = np.unique(got.links, return_counts=True)
            cuts = np.searchsorted(links, np.arange(len(held) + 1, dtype=np.int64) << 31).tolist()
            n = np.c_[got.n_a, got.n_b, got.n_groups, got.n_links].tolist()
            for k, (doc, _, more) in enumerate(held):
                if doc.whole:
                    doc.take(n[k], got.groups(k), links[cuts[k] : cuts[k + 1]] & 0x7FFFFFFF, times[cuts[k] : cuts[k + 1]])
                if not more:
                    yield doc.row()

    return docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it), 500), "id bigint, text_hash bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of all pairs of a batch."""
    pairs, times = b.column("pairs").to_pylist(), b.column("times").to_pylist()
    return np.repeat(np.arange(len(pairs)), [len(p) // 4 for p in pairs]), np.frombuffer(b"".join(pairs), "<u4").astype(np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold each pair of ids, and whether its B id has no pair of more."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(it) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            pairs, times = summed(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(pairs), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 20_000]), pa.array(times[k : k + 20_000])], schema=schema)

        for b in it:
            _, pairs, times = _lists(b)
            held.append(summed(pairs, times))
            n += len(held[-1][0])
            if n > SUMMED:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > SUMMED // 2:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(0x7FFF)
    counts = written(counts.withColumn("b", b))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row a B id: 32,768 at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def compare(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document. n_best: links whose pair is its B id's most frequent; count_sum: over links, how many links of the corpus hold the same pair."""
    aligned = written(align(docs, path_a, path_b, key, text))
    counts = written(count_pairs(aligned))
    top = counts.where(F.col("n") >= frequent(counts, "n", FREQUENT)).toArrow().sort_by("pair")  # FREQUENT at most
    given = docs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    plain = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), *plain, ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", pa.int64()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(it) -> Iterator[tuple]:
        pair, n, best = given.value
        for b in it:
            row, pairs, times = _lists(b)
            rows = list(batches([b], *schema.names[:7]))
            spot = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            hit = pair[spot] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at = spot[hit]
            cuts = np.searchsorted(row[hit], np.arange(len(rows) + 1)).tolist()
            good, weight = (np.r_[0, np.cumsum(times[hit] * x[at])] for x in (best, n))
            for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True):
                yield *r, int(good[z] - good[a]), int(weight[z] - weight[a]), None, None, None, None
            order = np.flatnonzero(~hit)
            order = order[np.argsort(pairs[order], kind="stable")]
            cuts = np.r_[0, np.flatnonzero(np.diff(pairs[order])) + 1, len(order)].tolist() if len(order) else [0]
            of, own, often = row[order].tolist(), pairs[order].tolist(), times[order].tolist()
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield *[None] * 9, own[a], [rows[r][0] for r in of[a:z]], [rows[r][1] for r in of[a:z]], often[a:z]

    shape = "id bigint, text_hash bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pair bigint, ids array<bigint>, hashes array<bigint>, times array<bigint>"
    both = written(aligned.mapInArrow(lambda it: arrow(schema, run(it), 2000), shape))
    forget(aligned)
    # one row a pair and batch, so no pair is hot
    each = both.where("pair is not null").join(counts, "pair").select("n", "best", F.explode(F.arrays_zip("ids", "hashes", "times")).alias("x"))
    none = F.lit(0).cast("bigint")
    heads = both.where("pair is null").select(*schema.names[:9], F.lit(1).alias("rows"))
    rest = each.select("x.ids", "x.hashes", *(F.lit(None).cast(t) for t in ("bigint",) * 4 + ("string",)), F.when(F.col("best"), F.col("x.times")).otherwise(none), F.col("x.times") * F.col("n"), F.lit(0))
    one = heads.union(rest).groupBy("id", "text_hash").agg(*(F.max(c).alias(c) for c, _ in plain), *(F.sum(c).alias(c) for c in ("n_best", "count_sum", "rows")))
    # rows of one key and text are the same row again: each gets its share
    return one.select(F.col("id").alias(key), *(c for c, _ in plain[:4]), F.expr("n_best div rows").alias("n_best"), F.expr("count_sum div rows").alias("count_sum"), "groups_sha256", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_again")).drop("_again")
