"""Removal of repeated passages by prefix-free parsing.

A rolling hash over 24 bytes marks triggers: in each window of SPAN bytes the least hash wins. So every string of SPAN bytes has one trigger, told by its content alone, and the strings with the same trigger place form a phrase, their text together. Phrases overlap by SPAN - 1 bytes, no phrase is a proper prefix of the next, and every string of SPAN bytes lies in exactly one phrase of each text.

The dictionary holds each distinct phrase, the parse is each text as a sequence of phrases. Corpus order lists all strings of SPAN bytes in the order of their text, equal ones by document; those that share SPAN leading bytes are a run, and all but those of a run's least document are repeats. It is put together from two suffix arrays:

- of the parse: its entries by phrase, then document. Since a string never leaves its phrase, one phrase of depth settles every run. An occurrence of a phrase whose least document is another is covered entirely and goes no further; so however often a phrase occurs, only its first document's entries do.
- of the dictionary: the suffixes of SPAN bytes or more of phrases that share their trigger with another phrase, sorted by their leading SPAN bytes (suffix_array), with the lengths of common prefixes telling where a run ends. Equal strings have equal triggers, so each trigger's phrases are one part of the dictionary and no part needs another.

Where very many phrases share one trigger (the edges of a line that most documents have), their suffixes are dealt by their own hash instead, so no part grows with them. Which triggers are known beforehand to be so is found in a sample of at most SAMPLE bytes; that changes where work is done, not the result.

Nulls are the empty text. A row whose key is null neither loses nor causes anything. Rows with equal keys don't remove from each other. Repeated rows stay. The key is a bigint. Extra columns are not read. An empty table gives an empty result. Triggers, phrases and rows with one key are told apart by 64-bit hashes (rows: 32 bits besides the key); suffixes are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import arrow, batches, forget, mix, release, written

SPAN, TRIGGER = 50, 24
#: Bytes of text that a task parses before it hands on what it has found.
BATCH = 16 << 20
#: Bytes of text for each part of the dictionary.
PART_BYTES = 24 << 20
#: Phrases that share a trigger from which on their suffixes are dealt singly; bytes of the sample, and its share of the corpus at most, in which such triggers are looked for; phrases there that make one.
CROWD, SAMPLE, SHARE, CROWD_THERE = 4096, 32 << 20, 32, 48

#: Places of a text in the low bits of its trigger hashes: Spark has no text of 2^31 bytes.
_PLACE = np.uint64((1 << 31) - 1)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64, False)
_BASE = int(_rng.integers(0, 1 << 63)) * 8 + 3 & (1 << 64) - 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1 << max(n - 1, 1).bit_length(), np.uint64)
        step, k = base, 1
        while k < len(out):
            out[k : 2 * k] = out[:k] * np.uint64(step)
            step, k = step * step & (1 << 64) - 1, 2 * k
        _powers[base] = have = out
    return have[:n]


class Parse:
    """One text's phrases. first: where each starts; count: how many strings of SPAN bytes it has; trigger, phrase: hashes of its trigger and of its text."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        self.n, self.sums = n, np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * _power(_BASE, n), out=self.sums[1:])
        starts = np.arange(n - TRIGGER + 1)
        h = self.hashed(starts, starts + TRIGGER)
        low = (h & ~_PLACE) | starts.astype(np.uint64)
        wide, have = SPAN - TRIGGER + 1, 1
        while 2 * have <= wide:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if wide > have:
            low = np.minimum(low[: have - wide], low[wide - have :])
        at = (low & _PLACE).astype(np.int64)
        self.first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.count = np.diff(np.r_[self.first, len(at)])
        self.trigger = h[at[self.first]]
        self.phrase = self.hashed(self.first, self.first + self.count + SPAN - 1)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(_UNBASE, self.n + 1)[start] + (end - start).astype(np.uint64))

    def strings(self, phrases: np.ndarray) -> np.ndarray:
        """Where the strings of SPAN bytes of these phrases start."""
        return runs(self.first[phrases], self.count[phrases])


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then the same for the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def joined(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as runs: starts and lengths."""
    new = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    return at[new], np.diff(np.r_[new, len(at)])


#: Rows that tasks hand each other: part: whom it goes to; the rest: arrays as bytes. ids, texts: a document's key and a hash of its text, which only tells rows with one key apart; doc: index into those for each entry. Arrays of small numbers take two bytes each.
_FIELDS = [("kind", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("texts", pa.binary()), ("doc", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_NAMES = [n for n, _ in _FIELDS]
_BLOB, _BLOB_DDL = pa.schema(_FIELDS), "kind int, part int, ids binary, texts binary, doc binary, a binary, b binary, c binary"
#: Kinds: entries of the dictionary (a: trigger, b: phrase, c: number of the phrase in its text), and those of crowded triggers; places covered (a: start, b: length); phrases to be sorted by suffix, as a whole or string by string (a: number); phrases with their text (a: place, b: length, c: bytes).
ENTRY, CROWDED, COVERED, SORT, SORT_SINGLY, PHRASE = range(6)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as two bytes each, or four; a first byte tells which."""
    return b"\2" + x.astype(np.uint16).tobytes() if not len(x) or x.max() < 1 << 16 else b"\4" + x.astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if data[:1] == b"\2" else np.uint32, offset=1) if data else np.zeros(0, np.uint16)


def parted(kind: int, part: np.ndarray, doc: np.ndarray, ids: np.ndarray, texts: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """A row for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = order[lo:hi]
        docs, index = np.unique(doc[own], return_inverse=True)
        yield (kind, int(part[own[0]]), ids[docs].tobytes(), texts[docs].tobytes(), packed(index), *(x[own].tobytes() if x.dtype == np.uint64 or x.dtype == np.uint32 else packed(x[own]) for x in arrays), *[b""] * (3 - len(arrays)))


def together(rows: list[tuple], *kinds: type | None) -> tuple[np.ndarray, ...]:
    """ids, texts, doc and the arrays of several rows of one kind as one. A kind of None is a packed array."""
    ids = [np.frombuffer(r[0], np.int64) for r in rows]
    shift = np.cumsum([0, *(len(x) for x in ids)])
    doc = np.concatenate([unpacked(r[2]).astype(np.int64) + s for r, s in zip(rows, shift, strict=False)])
    arrays = (np.concatenate([np.frombuffer(r[3 + k], t) if t else unpacked(r[3 + k]).astype(np.int64) for r in rows]) for k, t in enumerate(kinds))
    return np.concatenate(ids), np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows]), doc, *arrays


def by_part(it, *kinds: int) -> Iterator[tuple[int, list[tuple], tuple | None]]:
    """Of a sorted partition the rows of these kinds, those of a part and kind together, and with None before them every other row as it is."""
    now, held = None, []
    for k, p, *row in batches(it, *_NAMES):
        if k not in kinds:
            yield k, [], (k, p, *row)
            continue
        if (p, k) != now and held:
            yield now[1], held, None
            held = []
        now = p, k
        held.append(row)
    if held:
        yield now[1], held, None


def home(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document."""
    return (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int32)


def text_hash(data: bytes) -> int:
    return xxhash.xxh32_intdigest(data)


def _settle(ids, texts, doc, trigger, phrase, number, parts: int, crowded, crowd: int = CROWD) -> Iterator[tuple]:
    """The parse in order: entries by phrase, then document. What is covered is settled; the rest of a task's entries goes on to its part of the dictionary. crowded: sorted triggers that are known to be so; None: these are all entries of their triggers, and what shares its trigger goes on to be sorted; True: of crowded triggers."""
    order = np.lexsort((ids[doc], phrase, trigger))
    t, p, d = trigger[order], phrase[order], ids[doc[order]]
    new_t = np.r_[True, t[1:] != t[:-1]]
    new = new_t | np.r_[True, p[1:] != p[:-1]]
    least = d[new][np.cumsum(new) - 1]
    covered = d > least
    at = order[covered]
    yield from parted(COVERED, home(ids, parts)[doc[at]], doc[at], ids, texts, number[at])
    if crowded is True:
        own = order[~covered]
        yield from parted(SORT_SINGLY, home(ids, parts)[doc[own]], doc[own], ids, texts, number[own])
    elif crowded is None:
        group, first = np.cumsum(new_t) - 1, np.flatnonzero(new_t)
        low, high = np.minimum.reduceat(d, first)[group], np.maximum.reduceat(least, first)[group]
        many = np.add.reduceat(new.astype(np.int64), first)[group] > crowd
        for kind, which in ((SORT, ~many), (SORT_SINGLY, many)):
            own = order[~covered & (low < high) & which]
            yield from parted(kind, home(ids, parts)[doc[own]], doc[own], ids, texts, number[own])
    else:
        at = order[~covered]
        spot = np.minimum(np.searchsorted(crowded, trigger[at]), max(len(crowded) - 1, 0))
        known = crowded[spot] == trigger[at] if len(crowded) else np.zeros(len(at), bool)
        for kind, own, deal in ((ENTRY, at[~known], trigger), (CROWDED, at[known], phrase)):
            yield from parted(kind, (deal[own] % np.uint64(parts)).astype(np.int32), doc[own], ids, texts, (trigger[own] // np.uint64(parts)).astype(np.uint32), phrase[own], number[own])


def _parse(it, parts: int, crowded: np.ndarray) -> Iterator[tuple]:
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[tuple]:
        if held:
            counts = [len(x[2]) for x in held]
            ids, texts = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint32)
            yield from _settle(ids, texts, np.repeat(np.arange(len(held)), counts), np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), np.concatenate([np.arange(c) for c in counts]), parts, crowded)

    for k, t in batches(it, "_key", "_text"):
        data = (t or "").encode("utf-8", "surrogatepass")
        if k is None or len(data) < SPAN:
            continue
        p = Parse(data)
        held.append((k, text_hash(data), p.trigger, p.phrase))
        size += len(data)
        if size >= BATCH:
            yield from flush()
            held, size = [], 0
    yield from flush()


def crowded_triggers(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted triggers that many different phrases of a sample of documents share: fewer than the sample's bytes over CROWD_THERE."""
    schema = pa.schema([("trigger", pa.int64()), ("phrases", pa.int64())])
    share = max(SHARE, -(-size // SAMPLE))

    def count(it) -> Iterator[tuple]:
        found = [np.zeros((0, 2), np.uint64)]
        for (t,) in batches(it, "_text"):
            if len(data := (t or "").encode("utf-8", "surrogatepass")) >= SPAN:
                p = Parse(data)
                found.append(np.c_[p.trigger, p.phrase])
        names, n = np.unique(np.unique(np.concatenate(found), axis=0)[:, 0], return_counts=True)
        yield from zip(names[n > 1].view(np.int64).tolist(), n[n > 1].tolist(), strict=True)

    some = rows.where(F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(share)) == 0).select("_text")
    got = some.mapInArrow(lambda it: arrow(schema, count(it)), "trigger bigint, phrases bigint").groupBy("trigger").agg(F.sum("phrases").alias("n")).where(F.col("n") >= CROWD_THERE).toArrow()
    return np.sort(got.column("trigger").to_numpy().view(np.uint64))


def _dictionary(it, parts: int, crowd: int) -> Iterator[tuple]:
    for kind, rows, other in by_part(it, ENTRY, CROWDED):
        if other:
            yield other
        else:
            ids, texts, doc, trigger, phrase, number = together(rows, np.uint32, np.uint64, None)
            yield from _settle(ids, texts, doc, trigger, phrase, number, parts, True if kind == CROWDED else None, crowd)


def _with_text(it, *more: str) -> Iterator[tuple]:
    """(key, text, bytes, replies, columns more) for each text of a partition in which each part's replies come before its texts. replies: the arrays a and b of each kind that the text got."""
    part, got = None, {}
    for p, k, t, kind, ids, texts, doc, a, b, *own in batches(it, "part", "_key", "_text", "kind", "ids", "texts", "doc", "a", "b", *more):
        if p != part:
            part, got = p, defaultdict(list)
        if kind < 0:
            data = (t or "").encode("utf-8", "surrogatepass")
            yield k, t, data, got.get((k, text_hash(data)), []) if k is not None else [], own
            continue
        ids, texts = np.frombuffer(ids, np.int64), np.frombuffer(texts, np.uint32)
        doc, a, b = unpacked(doc), unpacked(a), unpacked(b)
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(len(ids) + 1))
        for j in range(len(ids)):
            entries = order[cut[j] : cut[j + 1]]
            got[ids[j].item(), texts[j].item()].append((kind, a[entries], b[entries] if len(b) else b))


def _phrases(it, parts: int) -> Iterator[tuple]:
    """From the replies of the dictionary: places covered, and the texts of phrases to be sorted by suffix."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[tuple]:
        if not held:
            return
        ids, texts = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint32)
        data = np.concatenate([np.frombuffer(x[2], np.uint8) for x in held])
        base = np.cumsum([0, *(len(x[2]) for x in held)])
        column = lambda k: (np.repeat(np.arange(len(held)), [len(x[k]) for x in held]), np.concatenate([x[k] for x in held]), np.concatenate([x[k + 1] for x in held]))
        doc, start, length = column(3)
        yield from parted(COVERED, home(ids, parts)[doc], doc, ids, texts, start, length)
        doc, place, length = column(5)
        yield from _with_bytes(np.concatenate([x[7] for x in held]), doc, place, length, ids, texts, data, base)
        # strings of crowded triggers: of those that this task has twice, the least document's stands for the others
        doc, place, h = column(8)
        order = np.lexsort((ids[doc], h))
        s, d = h[order], ids[doc[order]]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        repeat = d > d[new][np.cumsum(new) - 1]
        yield from _places(order[repeat], doc, place, ids, texts, parts)
        own = order[~repeat]
        yield from _with_bytes((h[own] % np.uint64(parts)).astype(np.int32), doc[own], place[own], np.full(len(own), SPAN), ids, texts, data, base)

    for k, _, data, replies, _ in _with_text(it):
        if not replies:
            continue
        p = Parse(data)
        number = {kind: np.unique(np.concatenate([np.zeros(0, np.int64), *(a for x, a, _ in replies if x == kind)])) for kind in (COVERED, SORT, SORT_SINGLY)}
        start, length = joined(p.strings(number[COVERED])) if len(number[COVERED]) else (np.zeros(0, np.int64),) * 2
        sort, at = number[SORT], p.strings(number[SORT_SINGLY])
        held.append((k, text_hash(data), data, start, length, p.first[sort], p.count[sort] + SPAN - 1, (p.trigger[sort] % np.uint64(parts)).astype(np.int32), at, p.hashed(at, at + SPAN)))
        size += len(data)
        if size >= BATCH:
            yield from flush()
            held, size = [], 0
    yield from flush()


def _with_bytes(part, doc, place, length, ids, texts, data, base) -> Iterator[tuple]:
    """A row of phrases, with their bytes, for each part."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(order) else []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = order[lo:hi]
        docs, index = np.unique(doc[own], return_inverse=True)
        said = data[runs(base[doc[own]] + place[own], length[own])]
        yield PHRASE, int(part[own[0]]), ids[docs].tobytes(), texts[docs].tobytes(), packed(index), packed(place[own]), packed(length[own]), said.tobytes()


def _places(at, doc, place, ids, texts, parts: int) -> Iterator[tuple]:
    """Entries at as covered runs."""
    if len(at):
        at = at[np.lexsort((place[at], doc[at]))]
        new = np.flatnonzero(np.r_[True, (np.diff(doc[at]) != 0) | (np.diff(place[at].astype(np.int64)) != 1)])
        first = at[new]
        yield from parted(COVERED, home(ids, parts)[doc[first]], doc[first], ids, texts, place[first], np.diff(np.r_[new, len(at)]))


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data that begin at starts, sorted by their leading depth bytes: their order, and for each in that order whether it shares less than depth bytes with the one before it.

    Suffixes that share a prefix so far hold one rank, their first place in the order; a round sorts those of shared ranks by the next few bytes, until a rank is one suffix's own or depth is reached.
    """
    n = len(starts)
    rank, active, at = np.zeros(n, np.int64), np.arange(n), 0
    room = max(64 - int(n).bit_length(), 8) // 8
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    while at < depth and len(active):
        take = min(8 if at == 0 else room, depth - at)
        word = np.ascontiguousarray(eight[starts[active] + at]).view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - 8 * take)
        key = word if at == 0 else (rank[active].astype(np.uint64) << np.uint64(8 * take)) | word
        order = np.argsort(key)
        key, active = key[order], active[order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(active)])
        before = rank[active]
        old = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        within = np.arange(len(active)) - np.repeat(old, np.diff(np.r_[old, len(active)]))
        rank[active] = before + np.repeat(within[first], size)
        active = active[np.repeat(size > 1, size)]
        at += take
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.r_[True, ranked[1:] != ranked[:-1]] if n else np.zeros(0, bool)


def _corpus_order(it, parts: int) -> Iterator[tuple]:
    """A part of the dictionary: its suffix array, with each phrase's document, gives its runs in corpus order."""
    for _, rows, other in by_part(it, PHRASE):
        if other:
            yield other
            continue
        ids, texts, doc, place, length = together(rows, None, None)
        data = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
        base, count = np.cumsum(length) - length, length - SPAN + 1
        starts, entry = runs(base, count), np.repeat(np.arange(len(doc)), count)
        order, new = suffix_array(data, starts)
        d = ids[doc[entry[order]]]
        least = np.minimum.reduceat(d, np.flatnonzero(new))
        repeat = order[d > least[np.cumsum(new) - 1]]
        yield from _places(repeat, doc[entry], place[entry] + starts - base[entry], ids, texts, parts)


def covered(n: int, replies: list[tuple]) -> np.ndarray:
    """For each byte whether a repeated string covers it."""
    change = np.zeros(n + 1, np.int64)
    for _, start, length in replies:
        np.add.at(change, start.astype(np.int64), 1)
        np.add.at(change, start.astype(np.int64) + length + SPAN - 1, -1)
    return np.cumsum(change)[:n] > 0


def _meet(rows: DataFrame, replies: DataFrame, parts: int) -> DataFrame:
    """Texts and what is known of them in the same partitions, replies first."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(home(k.fillna(0).to_numpy(np.int64), parts))

    left = rows.withColumn("kind", F.lit(-1)).withColumn("part", place("_key"))
    return left.unionByName(replies, allowMissingColumns=True).repartitionById(parts, "part").sortWithinPartitions("part", F.col("kind").desc())


def repeats(docs: DataFrame, out: pa.Schema, ddl: str, use, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), crowd: int = CROWD) -> DataFrame:
    """use(key, text, bytes, mask of covered bytes, kept columns) for each row. Each step's result is written to the shared folder."""
    spark = docs.sparkSession
    more = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, more, strict=True)))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    blobs = lambda df, f: df.mapInArrow(lambda it: arrow(_BLOB, f(it), 16), _BLOB_DDL)
    dealt = lambda df: df.repartitionById(parts, "part").sortWithinPartitions("part", "kind")

    crowded = spark.sparkContext.broadcast(crowded_triggers(rows.select("_key", "_text"), size))
    parsed = blobs(rows.select("_key", "_text"), lambda it: _parse(it, parts, crowded.value))
    settled = written(blobs(dealt(parsed), lambda it: _dictionary(it, parts, crowd)))
    release(spark)
    phrases = blobs(_meet(rows.select("_key", "_text"), settled, parts), lambda it: _phrases(it, parts))
    found = written(blobs(dealt(phrases), lambda it: _corpus_order(it, parts)))
    forget(settled)
    release(spark)

    def finish(it) -> Iterator[tuple]:
        for k, t, data, replies, own in _with_text(it, *more):
            yield use(k, t, data, covered(len(data), replies), own)

    return _meet(rows, found, parts).mapInArrow(lambda it: arrow(out, finish(it), 500), ddl)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def use(k, t, data, mask, more):
        left = np.frombuffer(data, np.uint8)[~mask].tobytes()
        return k, len(data), int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()), hashlib.sha256(left).hexdigest()

    return repeats(docs, schema, f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", use, key, text, crowd=crowd)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages cut out of text and n_chars brought up to date. A character goes only if all of its bytes are covered. A document of which nothing but white space is left goes, unless nothing was cut from it."""
    kept = tuple(c for c in docs.columns if c not in (key, text))
    fields = [f for f in docs.schema if f.name in kept]
    gone = "_gone"
    while gone in docs.columns:
        gone += "_"
    schema = pa.schema([(key, pa.int64()), (text, pa.string()), (gone, pa.bool_()), *((f.name, to_arrow_type(f.dataType)) for f in fields)])
    where = {c: i for i, c in enumerate(kept)}

    def use(k, t, data, mask, more):
        empty = False
        if mask.any():
            b = np.frombuffer(data, np.uint8)
            first = np.flatnonzero((b & 0xC0) != 0x80)
            whole = np.minimum.reduceat(mask, first)
            t = b[np.repeat(~whole, np.diff(np.r_[first, len(b)]))].tobytes().decode("utf-8", "surrogatepass")
            more = list(more)
            if "n_chars" in where:
                more[where["n_chars"]] = len(t)
            empty = not t.strip()
        return k, t, empty, *more

    ddl = ", ".join([f"`{key}` bigint", f"`{text}` string", f"`{gone}` boolean", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)])
    return repeats(docs, schema, ddl, use, key, text, kept).where(~F.col(gone)).select(*(F.col(f"`{c}`") for c in docs.columns))
