"""The lattice against sums over all segmentations one by one, scores against a plain version, held-out text against the shares as published."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lodestar.llm.queries")
from lodestar.llm import lattice_lm as lm  # noqa: E402
from lodestar.llm.queries import vocabulary  # noqa: E402

PATH = vocabulary("piece_bpe_32k.model")


def plain_pieces():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = Counter()
    for i in range(m.get_piece_size()):
        s = m.id_to_piece(i)
        if m.is_byte(i):
            out[bytes([int(s[3:5], 16)])] += 1 / m.get_piece_size()
        elif i > 2 and "▁" not in s[1:]:
            out[s.replace("▁", " ").encode()] += 1 / (1 - m.get_score(i))
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def plain_marginal(word, share):
    """Over all 2^n ways to cut a word."""
    word, out = b" " + word, 0.0
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        out += math.prod(share.get(word[a:b], 0.0) for a, b in itertools.pairwise(at))
    return math.log(out)


def plain_uses(word, share):
    word = b" " + word
    uses, total = Counter(), 0.0
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        p = math.prod(share.get(x, 0.0) for x in parts)
        total += p
        for x in parts:
            uses[x] += p
    return {k: v / total for k, v in uses.items() if v}


WORDS = [b"the", b"then", b"nation", b"xq", "été".encode(), "▁x".encode(), "日本".encode(), b"\xed\xa0\x80", b"a"]


def test_marginals_are_sums_over_segmentations():
    share, own = plain_pieces(), lm.pieces_of(PATH)
    logs = np.log(own.share)
    assert np.allclose(lm.Lattices(own, WORDS).marginal(logs), [plain_marginal(w, share) for w in WORDS])
    want = Counter()
    for w in WORDS:
        want.update(plain_uses(w, share))
    got = lm.Lattices(own, WORDS).expected(logs)
    assert math.isclose(got.sum(), sum(want.values())) and np.allclose(sorted(got[got > 0]), sorted(want.values()))
    # long words go singly, with the same result
    long = [b"".join(WORDS[:5]) * 9, b"of" * 500, b"z" * 70]
    before, lm.LONG = lm.LONG, 2000
    together = lm.Lattices(own, long)
    want = together.marginal(logs), together.expected(logs)
    lm.LONG = before
    singly = lm.Lattices(own, long)
    assert np.allclose(singly.marginal(logs), want[0]) and np.allclose(singly.expected(logs), want[1])
    assert len(lm.Lattices(own, []).marginal(logs)) == 0


def rows_for_test():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "the", "of", "naïve", "été", "x1"]) + str(rng.randrange(30)) for _ in range(rng.choice([1, 5, 60]))) for _ in range(60)]
    texts += [None, "", " \n", "word " * 3000, "long" * 20, "only here", "İ ﬁ ▁ 　x"]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "the null key", "z", 2), (3, "another text", "z", 3), (3, None, "z", 4)]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)  # so that most words go by the join
    rows = rows_for_test()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int").repartition(3)
    got = sorted((tuple(r) for r in lm.score(docs, PATH).collect()), key=str)
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({x: " " for x in range(9, 14)}).split(" ")
    tokens = lambda t: [w for w in words(t) if w] + [""]
    out = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 10 == 0
    counts = Counter(w for k, t, *_ in rows if not out(k) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
    less = once / (once + 2 * twice)
    seen = [w.encode() for w in counts if w]
    own = lm.pieces_of(PATH)
    logs = np.log(own.share)
    for _ in range(lm.ROUNDS):
        uses = lm.PRIOR * own.share + lm.Lattices(own, seen).expected(logs)
        logs = np.log(uses / uses.sum())
    piece = lambda w: float(lm.Lattices(own, [w.encode()]).marginal(logs)[0])
    want = []
    for k, t, *_ in rows:
        ws = tokens(t)
        spare = (less * distinct + 1) / (total + 1)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        score = lattice = math.log10(max(counts[""] - less, 0) / (total + 1) + spare * lm.END)
        for w in ws[:-1]:
            p = piece(w)
            lattice += math.log10(spare * (1 - lm.END)) + p / math.log(10)
            own_part = max(counts[w] - less, 0) / (total + 1)
            score += math.log10(own_part + spare * (1 - lm.END) * math.exp(p)) if own_part else math.log10(spare * (1 - lm.END)) + p / math.log(10)
        want.append((k, out(k), len(ws), sum(counts[w] > 0 for w in ws), total, base, score, lattice))
    want.sort(key=str)
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], r[6])) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(docs, PATH).collect() == []
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    docs = spark.createDataFrame([(k, "some text here") for k in held], "doc_id bigint, text string")
    for r in lm.score(docs, PATH).collect():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 4, 0, 0, 0.0)
        assert -60 < r["score"] < 0 and math.isclose(r["score"], r["lattice_score"])


def test_fitting_helps_unseen_text(spark, small):
    """Held-out documents are likelier by the fitted pieces than by the published shares, and likelier still with known words."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from pyspark.sql import functions as F

    score = lambda rounds: lm.score(docs, PATH, rounds=rounds).where("held_out").agg(F.sum("lattice_score"), F.sum("score")).first()
    raw, fitted = score(0), score(lm.ROUNDS)
    assert fitted[0] > 0.8 * raw[0] > raw[0] and fitted[1] > 0.95 * fitted[0]
