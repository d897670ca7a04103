"""Words of the BPE vocabulary: each is merged once while it is met, and odd ones as the library has them."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import numpy as np  # noqa: E402

from lodestar.llm import bpe, packing  # noqa: E402
from lodestar.llm.queries import vocabulary  # noqa: E402

ODD = ["The the THE the. the, theﬁ", "Å K İstanbul ŉ é ẞ ΣΑΣ Σ", "<|endoftext|> <|ENDOFTEXT|> x<|endoftext|>y <|", "it's IT'S a's. 12. é. É, é́.", "\x00a a\x7f \x1ca b\x85c\xa0d", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab " + "thththe" * 40, "日本語。 ok。 ok! !", ""]


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_odd_words_as_the_library_has_them():
    t, dice = library(), random.Random(5)
    texts = ODD + ["".join(dice.choices("aeinortThLß'éÉΣ́İ.!,<|0 \n", k=200)) for _ in range(200)]
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        assert bpe.encode_ids(text, vocabulary()) == want
        assert np.frombuffer(b"".join(map(packing._known(vocabulary()).__getitem__, bpe.split_raw(text))), "<u2").tolist() == want


def test_a_word_that_is_met_again_is_merged_once(monkeypatch):
    monkeypatch.setattr(bpe, "_made", {})
    met, merge = [], bpe.WordBpe.merge
    monkeypatch.setattr(bpe.WordBpe, "merge", lambda self, word: (met.append(word), merge(self, word))[1])
    letters = "abcdefghijklmnopqrst"
    rare = ["".join(letters[n // 20**k % 20] for k in range(5)) for n in range(150_000)]
    for k in range(0, len(rare), 10_000):
        bpe.encode_ids(f"weather{'!' * (k // 10_000 + 2)} {' '.join(rare[k : k + 10_000])}", vocabulary())
    assert met.count(b"weather") == 1
