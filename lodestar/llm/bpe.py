"""BPE encoding and decoding with a published vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the merge rank of each neighbouring pair. The least rank is taken off, its pair becomes one symbol, and the new neighbours' ranks go in; an entry whose pair has changed meanwhile is stale and skipped. Ids become text again by concatenating vocabulary strings.

Null is the empty text: no ids. Every row has its own result. The key is a bigint; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.common import Recent, arrow, batches

#: str.split() also splits at these, which are no white space to the tokenizer.
_NOT_BLANK = regex.compile("[\x1c-\x1f]")
#: The first character that NFC may change or join to the one before.
_COMPOSED = "\u0300"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class WordBpe:
    """The tokenizer of a vocabulary file of kind "BPE with word ends": NFC, white space dropped, lower case, split by the file's pattern, byte symbols, the last with the word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.symbol = byte_symbols()
        self.first = [self.vocab[s] for s in self.symbol]
        self.last = [self.vocab[s + self.end] for s in self.symbol]
        #: pair of ids -> rank, id of the merged symbol, and room for a place: what the queue holds
        self.merges = {self.vocab[a] << 16 | self.vocab[b]: rank << 48 | self.vocab[a + b] << 32 for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word's UTF-8 bytes."""
        ids = [*map(self.first.__getitem__, word)]
        ids[-1] = self.last[word[-1]]
        n, rank = len(ids), self.merges.get
        if n == 1:
            return ids
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # the entry of the pair that begins at each place, -1 if it has none
        held = [rank(ids[i] << 16 | ids[i + 1], -1) | i for i in range(n - 1)]
        queue = [x for x in held if x >= 0]
        held.append(-1)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            if held[i] != top:
                continue  # stale: a neighbour has changed
            j = after[i]
            ids[i] = new = top >> 32 & 0xFFFF
            ids[j] = held[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                held[i] = x = rank(new << 16 | ids[k], -1) | i
                if x >= 0:
                    heappush(queue, x)
            else:
                held[i] = -1
            k = before[i]
            if k >= 0:
                held[k] = x = rank(ids[k] << 16 | new, -1) | k
                if x >= 0:
                    heappush(queue, x)
        return [x for x in ids if x >= 0]

    def pieces(self, raw: str) -> list[str | int]:
        """The words of a text, and the ids of special tokens that it holds."""
        if raw.isascii() or raw and max(raw) < _COMPOSED:  # NFC leaves it as it is, and it has no sigma
            low = raw.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,;:!?":
                return [low[:-1], low[-1]]
        found: list[str | int] = []
        for k, part in enumerate(self.between.split(raw) if "<|" in raw else [raw]):
            if k % 2:
                found.append(self.special[part])
            else:
                # per character, as the tokenizer does: no final sigma
                found += self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return found

    def decode(self, ids) -> str:
        """Vocabulary strings, with a blank between them as decoding without a decoder does."""
        return " ".join(map(self.strings.__getitem__, ids))


def split_raw(text: str) -> list[str]:
    """White-space runs never lie inside a word, so the ids of a text are those of its parts. Texts with characters that only str.split() takes for white space stay whole."""
    return [text] if _NOT_BLANK.search(text) else text.split()


_made: dict[str, Recent] = {}


def _known(path: str) -> Recent:
    """What a worker has met, words and raw parts of texts alike, as (count, ids in decimal, decoded strings)."""
    if path not in _made:
        bpe = WordBpe(path)
        decimal = [*map(str, range(1 << 16))]

        def shown(ids: list[int]) -> tuple[int, str, str]:
            return len(ids), " ".join([decimal[i] for i in ids]), bpe.decode(ids)

        def make(part: str) -> tuple[int, str, str]:
            found = bpe.pieces(part)
            if "<|" in part:  # a special token, or a word that looks like one
                return shown([i for w in found for i in ([w] if isinstance(w, int) else bpe.merge(w.encode("utf-8", "surrogatepass")))])
            if found == [part]:
                return shown(bpe.merge(part.encode("utf-8", "surrogatepass")))
            got = [known[w] for w in found]
            return got[0] if len(got) == 1 else (sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got]))

        known = _made[path] = Recent(make, 224 << 20, lambda x: 120 + len(x[1]) + 2 * len(x[2]))
    return _made[path]


def encode_ids(text: str | None, path: str) -> list[int]:
    """Ids of one text; for tests and small helpers."""
    known = _known(path)
    return [int(i) for p in split_raw(text or "") for i in known[p][1].split()]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of each row."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(it):
        known = _known(path)
        for k, t in batches(it, key, text):
            got = [x for p in split_raw(t or "") if (x := known[p])[0]]
            yield k, [int(i) for x in got for i in x[1].split()], " ".join([x[2] for x in got])

    return docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it), 200), f"{key} bigint, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): what encode() gives, summed up in the task so that ids don't leave it."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()

    def run(it):
        known = _known(path)
        for k, t in batches(it, key, text):
            got = [x for x in map(known.__getitem__, split_raw(t or "")) if x[0]]
            yield k, sum([x[0] for x in got]), sha([x[1] for x in got]), sha([x[2] for x in got])

    return docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it)), f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
