"""Token alignment against whole texts encoded by the libraries and all pairs of tokens compared."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("lodestar.llm.queries")
from lodestar.llm import token_alignment as ta  # noqa: E402
from lodestar.llm.bpe import byte_symbols  # noqa: E402
from lodestar.llm.queries import vocabulary  # noqa: E402

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
NOTHING = (0, 0, 0, [], "")


def tokens(texts):
    """(ids and byte ranges of A, the same of B) of each text, whole; None where a side differs from the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {s: k for k, s in enumerate(byte_symbols())}
    for t in texts:
        if not t:
            yield None
            continue
        raw = f" {t}".encode()
        sides = [
            [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {t}", add_special_tokens=False).ids],
            [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(t) for p in [b.id_to_piece(i)]],
        ]
        if any(b"".join(x for _, x in s) != raw for s in sides):
            yield None
            continue
        out = []
        for s in sides:
            at, placed = 0, []
            for i, x in s:
                placed.append((i, at, at + len(x)))
                at += len(x)
            out.append(placed)
        yield out


def plain(texts):
    found = []
    for both in tokens(texts):
        if both is None:
            found.append(NOTHING)
            continue
        a, b = both
        links = [(i, j) for i, p, q in a for j, x, y in b if p < y and x < q]
        ends = sorted({q for *_, q in a} & {y for *_, y in b})
        said, last = [], 0
        for e in ends:
            said.append("|".join(",".join(str(i) for i, p, q in side if last <= p and q <= e) for side in both))
            last = e
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    counts = Counter(x for f in found for x in f[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for a, b, g, links, sha in found]


def odd_texts():
    rng = random.Random(6)
    bits = ["the", " ", "  ", "\n", "\t", "Straße", "don't", "1234", "日本語", "x́", "…", "<|endoftext|>", "</s>", "<0x41>", "　", "\xa0", " ", "\x1c", "\x00", "\x85", "😀", "ｱ", "e", ",", ".", "'ll", "aaaa", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 8, 30]))) for _ in range(250)]
    return [*texts, None, "", " ", "   ", "a ", " a", "▁", "a▁b", "x" * 500, "of the " * 200, "\n \n  a"]


def test_odd_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(ta, "FREQUENT", 60)  # so that most pairs go by the join
    monkeypatch.setattr(ta, "PORTION", 90)  # so that some texts go in portions
    monkeypatch.setattr(ta, "SUMMED", 200)
    texts = odd_texts()
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no key", "n", 2), (7, "another text", "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string, n_a int").repartition(3)
    got = [tuple(r) for r in ta.compare(docs, A, B).collect()]
    want = [(r[0], *w) for r, w in zip(rows, plain([r[1] for r in rows]), strict=True)]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)
    assert ta.compare(docs.limit(0), A, B).collect() == []


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000")
    rows = docs.select("doc_id", "text").collect()
    want = {r[0]: w for r, w in zip(rows, plain([r[1] for r in rows]), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in ta.compare(docs, A, B).collect()} == want


def test_parts_forget():
    parts = ta.Parts(A, B)
    before, ta.PARTS = ta.PARTS, 20
    try:
        rng = random.Random(1)
        for _ in range(30):
            words = [f" w{rng.randrange(50)}" for _ in range(30)]
            ids, sizes, of = parts.tokens(parts.known(words), 0)
            assert b"".join(parts.bytes_a[i] for i in ids) == "".join(words).encode() and len(parts.at) <= 50
            assert sizes.sum() == len("".join(words).encode()) and of[-1] == 29
    finally:
        ta.PARTS = before
