"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a linear model of which words and word beginnings a text has and of the probabilities of the categories before it. In training those probabilities are out of fold, so a later model learns how far it can trust what it will be fed.

The given labels have one category (toxic). The two before it in the chain are derived from it and from the texts, without word lists: the traits that part toxic from other training texts best are marks; "blatant" are toxic texts with one of the LEAD strongest marks, "dense" those of which at least the median share of words are marks. Traits, marks and derived categories are chosen for each fold from its training rows alone, so what is out of fold has seen nothing of its own row.

Fitted on at most LABELLED labelled documents (least by a hash of their id; of rows with one id the one with the greatest text) and TRAITS traits a fold. The driver gets the chosen traits, and for each labelled document a bit for each of them: LABELLED * (FOLDS + 1) * TRAITS bits at most, however long the texts are. Every document is scored on its whole text.

Null and empty texts have no traits: their probability is the models' base rate. Repeated rows are scored each. A label's row without a document, or a null label, is not used. Without toxic labels nothing is toxic. The key is a bigint. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Cache, arrow, batches, forget, written
from lodestar.llm.quality import sample_labels

LABELLED, TRAITS, FOLDS = 8_000, 256, 5
#: Letters of a word's beginning; marks that make a text blatant; bytes of a worker's cache of words.
BEGIN, LEAD, CACHE = 5, 8, 96 << 20
#: Least difference of shares, in standard errors, and least texts that make a trait.
LEAST_Z, LEAST_TEXTS = 4.0, 3
CHAIN = ("blatant", "dense", "toxic")
_WORD = regex.compile(r"\w+")


def _traits_of(word: str) -> tuple[int, ...]:
    h = lambda x, s: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), s) >> 1
    return (h(word, 0), h(word[:BEGIN], 1)) if len(word) > BEGIN else (h(word, 0),)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def fold_of(key: int) -> int:
    return xxhash.xxh3_64_intdigest(str(key)) % FOLDS


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept, not penalised) by Newton's method; positives and negatives weigh the same in sum. x: float32."""
    out = np.zeros(x.shape[1] + 1)
    if not y.any() or y.all():
        out[-1] = 12.0 if len(y) and y.all() else -12.0
        return out
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = np.r_[np.full(x.shape[1], penalty), 1e-6]
    for _ in range(steps):
        p = sigmoid(x @ out[:-1].astype(np.float32) + out[-1])
        miss, curve = weight * (p - y), (weight * p * (1 - p) + 1e-9).astype(np.float32)
        grad = np.r_[miss.astype(np.float32) @ x, miss.sum()] + ridge * out
        hess = np.zeros((len(out), len(out)))
        for at in range(0, len(x), 1024):  # a block at a time: no second copy of x
            block, c = x[at : at + 1024], curve[at : at + 1024]
            hess[:-1, :-1] += block.T @ (block * c[:, None])
            hess[:-1, -1] += c @ block
        hess[-1, :-1] = hess[:-1, -1]
        hess[-1, -1] = curve.sum()
        hess[np.diag_indices_from(hess)] += ridge
        step = np.linalg.solve(hess, grad)
        out -= step
        if np.abs(step).max() < 1e-5:
            break
    return out


def derived(x: np.ndarray, z: np.ndarray, n_words: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The categories of training rows. x: which traits a row has; z: how strongly each tells of toxic texts."""
    marks = np.flatnonzero(z > 0)
    lead = marks[np.argsort(-z[marks], kind="stable")[:LEAD]]
    share = x[:, marks].sum(1) / np.maximum(n_words, 1)
    middle = np.median(share[toxic]) if toxic.any() else 0.0
    return {"blatant": toxic & (x[:, lead].sum(1) > 0), "dense": toxic & (share >= middle) & (share > 0), "toxic": toxic}


class Chain:
    """The fitted chain. rows: which of the traits each labelled document has, one packed bit each. choices: for each fold, and last for all rows, the places of its traits and their z."""

    def __init__(self, traits: list[int], choices: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, n_words: np.ndarray, toxic: np.ndarray, fold: np.ndarray):
        self.traits = [traits[j] for j in choices[-1][0]]
        of = lambda at: np.unpackbits(rows, axis=1, count=len(traits))[:, at].astype(np.float32)
        self.models: list[np.ndarray] = []
        fed = np.zeros((len(rows), 0), np.float32)
        targets = []
        for k, (at, z) in enumerate(choices):
            train = fold != k
            y = derived(of(at)[train], z, n_words[train], toxic[train])
            targets.append(y)
        for name in CHAIN:
            outside = np.zeros(len(rows), np.float32)
            for k, (at, _) in enumerate(choices):
                inputs, train = np.c_[of(at), fed], fold != k
                w = logistic(inputs[train], targets[k][name])
                if k == FOLDS:
                    self.models.append(w)
                else:
                    outside[~train] = sigmoid(inputs[~train] @ w[:-1] + w[-1])
            fed = np.c_[fed, outside]
        self.bar = self._bar(fed[:, -1], toxic) if len(rows) else 0.5

    @staticmethod
    def _bar(p: np.ndarray, toxic: np.ndarray) -> float:
        """The probability from which on a document is toxic: best F1 out of fold."""
        if not toxic.any():
            return 2.0
        cuts = np.unique(np.r_[0.5, p])
        order = np.sort(p), np.sort(p[toxic])
        hit, all_ = (len(s) - np.searchsorted(s, cuts, "left") for s in order[::-1])
        f1 = 2 * hit / (all_ + toxic.sum())
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        return float(cuts[best[len(best) // 2]])

    def predict(self, found: list[int]) -> list[float]:
        """A probability for each category of the chain. found: places of the traits that a text has."""
        out: list[float] = []
        n = len(self.traits)
        for w in self.models:
            z = w[found].sum() + sum(w[n + j] * p for j, p in enumerate(out)) + w[-1]
            out.append(float(sigmoid(np.array(z))))
        return out


def z_score(toxic: Column, others: Column, n_toxic: int, n_others: int) -> Column:
    """Difference of the shares of toxic and other texts that have a trait, in standard errors."""
    share = (toxic + others) / (n_toxic + n_others)
    return (toxic / n_toxic - others / n_others) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_toxic + 1 / n_others))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> Chain:
    """Tasks count the labelled documents' traits by fold; the driver gets the chosen ones."""
    chosen = F.broadcast(sample_labels(labels, key, label, most))  # most rows at most
    known = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(chosen, "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    known = written(known)

    def count(it) -> Iterator[tuple]:
        cache, sums = Cache(_traits_of, CACHE), Counter()
        for k, y, t in batches(it, "id", "y", "text"):
            f = 2 * fold_of(k) + y
            sums.update((x, f) for x in {x for w in words(t) for x in cache[w]})
            if len(sums) >= 500_000:
                yield from ((x, f, n) for (x, f), n in sums.items())
                sums.clear()
        yield from ((x, f, n) for (x, f), n in sums.items())

    schema = pa.schema([("trait", pa.int64()), ("cell", pa.int32()), ("n", pa.int64())])
    cells = known.mapInArrow(lambda it: arrow(schema, count(it), 20_000), "trait bigint, cell int, n bigint")
    counts = written(cells.groupBy("trait").agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS))).where(" + ".join(f"c{c}" for c in range(2 * FOLDS)) + f" >= {LEAST_TEXTS}"))
    ids = known.select("id", "y").toArrow()  # most rows at most
    fold, toxic = np.array([fold_of(i) for i in ids.column("id").to_pylist()], np.int64), ids.column("y").to_numpy() == 1
    best = []
    for k in range(FOLDS + 1):  # all but fold k; FOLDS: all
        cols = [[F.col(f"c{2 * f + y}") for f in range(FOLDS) if f != k] for y in (1, 0)]
        n = [max(int((toxic[fold != k] == y).sum()), 1) for y in (True, False)]
        z = z_score(sum(cols[0], F.lit(0)), sum(cols[1], F.lit(0)), *n)
        best.append(counts.select(F.lit(k).alias("k"), "trait", z.alias("z")).where((F.abs("z") >= LEAST_Z) & (sum(cols[0] + cols[1], F.lit(0)) >= LEAST_TEXTS)).orderBy(F.desc(F.abs("z")), "trait").limit(TRAITS))
    top = best[0]
    for b in best[1:]:
        top = top.union(b)
    top = top.toArrow()  # (FOLDS + 1) * TRAITS rows at most
    traits = sorted(set(top.column("trait").to_pylist()))
    where = {t: j for j, t in enumerate(traits)}
    choices: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(FOLDS + 1):
        own = sorted((where[t], z) for f, t, z in zip(*(top.column(c).to_pylist() for c in ("k", "trait", "z")), strict=True) if f == k)
        choices.append((np.array([j for j, _ in own], np.int64), np.array([z for _, z in own])))

    def mark(it) -> Iterator[tuple]:
        cache = Cache(lambda w: tuple(where[x] for x in _traits_of(w) if x in where), CACHE)
        for k, y, t in batches(it, "id", "y", "text"):
            own = words(t)
            bits = np.zeros(len(traits), bool)
            bits[list({j for w in own for j in cache[w]})] = True
            yield k, y, len(own), np.packbits(bits).tobytes()

    schema2 = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("n_words", pa.int64()), ("bits", pa.binary())])
    rows = known.mapInArrow(lambda it: arrow(schema2, mark(it)), "id bigint, y int, n_words bigint, bits binary").toArrow().sort_by("id")
    forget(known)
    forget(counts)
    packed = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(rows), -(-len(traits) // 8))
    fold = np.array([fold_of(i) for i in rows.column("id").to_pylist()], np.int64)
    return Chain(traits, choices, packed, rows.column("n_words").to_numpy(), rows.column("y").to_numpy() == 1, fold)


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_ of each category, toxic) of each row."""
    given = docs.sparkSession.sparkContext.broadcast(chain)  # at most TRAITS traits
    schema = pa.schema([(key, pa.int64()), *((f"p_{n}", pa.float64()) for n in CHAIN), ("toxic", pa.bool_())])

    def run(it) -> Iterator[tuple]:
        chain = given.value
        where = {t: j for j, t in enumerate(chain.traits)}
        known = Cache(lambda w: tuple(where[t] for t in _traits_of(w) if t in where), CACHE)
        said: dict[tuple, list[float]] = {}  # what texts without or with few marks share
        for k, t in batches(it, key, text):
            found = tuple(sorted({j for w in words(t) for j in known[w]}))
            p = said.get(found) or chain.predict(list(found))
            if len(found) < 3 and len(said) < 50_000:
                said[found] = p
            yield k, *p, p[-1] >= chain.bar

    return docs.select(key, text).mapInArrow(lambda it: arrow(schema, run(it)), f"{key} bigint, " + ", ".join(f"p_{n} double" for n in CHAIN) + ", toxic boolean")
