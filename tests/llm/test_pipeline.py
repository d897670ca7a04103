"""The corpus pipeline: each stage against a plain version, and the whole run against the stages."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402
from test_operators import plain_components, plain_spans  # noqa: E402

from lodestar.llm import repeats  # noqa: E402
from lodestar.llm.common import components, written  # noqa: E402
from lodestar.llm.queries import table  # noqa: E402


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def plain_left(docs):
    first, out = {}, {}
    for k, t in sorted(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], k) < k:
                gone[i : i + 50] = b"\1" * 50
        out[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="replace")
    return out


def test_components_are_never_split_silently(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        components(edges, 1)
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(201)}


def test_places_of_the_longest_text_fit():
    assert int(repeats._PLACE) >= np.iinfo(np.int32).max


def test_stages_and_run(spark, small):
    docs = table(spark, small, "documents")
    good = written(P.keep_good(spark, docs, small))
    given = dict(pairs(docs))
    assert 0 < good.count() < len(given) and all(given[k] == t for k, t in pairs(good))

    apart = written(P.drop_near_copies(spark, good, small))
    wordless = {k for k, t in pairs(good) if not (t or "").split()}
    roots = {int(k) for k, _, c in plain_components(pairs(good)) if int(k) == c}
    assert {k for k, _ in pairs(apart)} - wordless == roots - wordless

    cut = written(P.cut_repeats(spark, apart, small))
    left = plain_left(pairs(apart))
    assert dict(pairs(cut)) == {k: t for k, t in left.items() if t.strip()}

    safe = written(P.redact_secrets(spark, cut, small))
    clear = dict(pairs(safe))
    assert clear.keys() == dict(pairs(cut)).keys()
    for k, t in pairs(cut):
        assert plain_spans(t or "") or "[REDACTED]" in clear[k] or clear[k] == t

    want = sorted(map(str, P.pack(spark, safe, small).collect()))
    assert want and sorted(map(str, P.run(spark, small).collect())) == want
