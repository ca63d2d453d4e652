"""Toxicity by a factorisation machine over hashed terms (operator 7).

A text's features are its distinct lower-case words and their six-letter beginnings,
hashed. The model has a weight and a short vector for each feature; the score adds
the weights and the products of the vectors of every pair of features present, so
that two harmless terms together can count (an insult with a mention of a group)
where a linear model would miss it.

The model is fitted on the driver from a bounded sample of labelled rows: the
``max_rows`` training rows whose hashed id is smallest. Features come from
the executors; a feature is used if it is in ``MIN_ROWS`` rows and the counts of
the two classes differ by more than chance. Everything else covers all texts.

Null and empty texts have no features and get the score of the bias alone. Labels
that are null are not learnt from; of several labels of a document the highest
counts, and of several texts of one the greatest. Without any labelled row the score is 0.5 less a hair, predicting 0.
Very long texts are read whole; a text's features are distinct, so repetition adds nothing. Repeated rows
score alike, each its own. Only the id and text are read, whatever other columns are called; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.llm.common import Memo, hash_sample, map_batches, texts

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 8_000
BITS = 20
MIN_ROWS, MIN_CHI2 = 3, 6.0
FACTORS, EPOCHS, RATE, DECAY, SEED = 8, 150, 0.1, 1e-3, 7

_words = re.compile(r"[^\W\d_]+").findall


def hashed(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> tuple[int, ...]:
    """The hashed features of a white-space separated lower-case word."""
    out: list[int] = []
    for w in _words(word):
        out.append(hashed(w))
        if len(w) > 6:
            out.append(hashed("^" + w[:6]))
    return tuple(out)


_memo = Memo(word_features, 500_000)


def text_features(text: str) -> list[int]:
    """Distinct hashed features of a whole text, in order."""
    return sorted({i for word in set(text.lower().split()) for i in (_memo[word] if len(word) < 64 else word_features(word))})


class Machine:
    """A fitted factorisation machine; only the features it uses are stored."""

    def __init__(self, bias: float, weights: dict[int, tuple[float, np.ndarray]]):
        self.bias, self.weights = bias, weights

    def score(self, features: list[int]) -> float:
        used = [self.weights[i] for i in features if i in self.weights]
        z = self.bias
        if used:
            v = np.array([x for _, x in used])
            z += sum(w for w, _ in used) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chosen(rows: list[list[int]], labels: np.ndarray) -> list[int]:
    """Features in enough rows whose presence depends on the label (chi-squared of the 2 by 2 table)."""
    size = 1 << BITS
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=size).astype(float)
    toxic = np.bincount(flat, weights=labels[owner], minlength=size)
    n, pos = len(rows), labels.sum()
    expected = seen * pos / n
    spread = seen * (pos / n) * (1 - pos / n) * (1 - seen / n)
    chi2 = np.where(spread > 0, (np.abs(toxic - expected) - 0.5).clip(0) ** 2 / np.maximum(spread, 1e-9), 0)
    return np.flatnonzero((seen >= MIN_ROWS) & (chi2 >= MIN_CHI2)).tolist()


def fit(rows: list[list[int]], labels: list[int]) -> Machine:
    """Fit by Adam over all rows at once; the same rows give the same model."""
    y = np.asarray(labels, dtype=float)
    if not len(rows) or y.min() == y.max():
        return Machine(-1e-3 if not len(rows) else (5.0 if y[0] else -5.0), {})
    columns = {f: k for k, f in enumerate(chosen(rows, y))}
    kept = [[columns[f] for f in r if f in columns] for r in rows]
    feature = np.fromiter((f for r in kept for f in r), dtype=np.int64)
    owner = np.repeat(np.arange(len(kept)), [len(r) for r in kept])
    rng, m, n = np.random.default_rng(SEED), len(columns), len(kept)
    params = [np.array([np.log(y.mean() / (1 - y.mean()))]), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def by(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(keys, weights=values, minlength=size)

    for step in range(1, EPOCHS + 1):
        b, w, v = params
        sums = np.stack([by(owner, v[feature, k], n) for k in range(FACTORS)], 1)
        squares = by(owner, (v[feature] ** 2).sum(1), n)
        z = b[0] + by(owner, w[feature], n) + 0.5 * ((sums**2).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gv = np.stack([by(feature, g[owner] * (sums[owner, k] - v[feature, k]), m) for k in range(FACTORS)], 1)
        grads = [np.array([g.sum()]), by(feature, g[owner], m) + DECAY / n * w, gv + 10 * DECAY / n * v]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    b, w, v = params
    return Machine(float(b[0]), {f: (float(w[k]), v[k]) for f, k in columns.items()})


def held_out(id_col: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 5, is 0 (a null id: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    sample = hash_sample(known, F.xxhash64(id_col), max_rows)  # bounded, so it may be broadcast
    joined = documents.select(id_col, text_col).join(F.broadcast(sample), id_col)

    def make() -> Callable:
        return lambda batch: [[text_features(t) for t in texts(batch, text_col)]]

    # one row a document even where the table repeats its id: the greatest text, so that the driver gets max_rows at most
    joined = joined.groupBy(id_col).agg(F.max(text_col).alias(text_col), F.max("toxic").alias("toxic"))
    found = map_batches(joined, make, [("features", T.ArrayType(T.IntegerType()))], [id_col, "toxic"]).collect()
    rows = sorted((r[id_col], r["features"], r["toxic"]) for r in found)
    return fit([f for _, f, _ in rows], [t for *_, t in rows])


def score(documents: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every text."""

    def make() -> Callable:
        return lambda batch: [[machine.score(text_features(t)) for t in texts(batch, text_col)]]

    scored = map_batches(documents.select(id_col, text_col), make, [("score", T.DoubleType())], [id_col])
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
