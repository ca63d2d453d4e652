"""Quality classifier by weak labels (operator 4).

Heuristic labellers, the overlapping rules of ``quality_rules``, vote on every text.
Expectation-maximisation over the counts of all vote patterns estimates their
accuracies, and each text gets a posterior probability of being clean. The posteriors of
a bounded sample (the ``max_rows`` rows whose hashed key is smallest) are the soft
labels of a linear scorer over hashed features; it scores every text, and also
tells apart texts on which the labellers abstain.

Features are the shapes of a text's words (``Word.`` -> ``Aa.``), hashed, with the root
of their share as value, and the shares of repeated words and lines and the size of the
text. Texts are read once: their numbers and features go to a written table.

Null and empty texts have no words, only the size. Equal rows score alike, count once in the sample, and a score of exactly 0.5
keeps them; where a table is one text over and over, its labellers' posterior decides alone. Only the id and text are read,
whatever other columns are called. A very long text is one row's work, of features bounded by its different word shapes.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.llm import quality_rules as rules
from strataseek.llm.common import Memo, hash_sample, map_batches, texts, written

BITS = 18
#: Rows that the scorer is fitted on, at most.
MAX_ROWS = 8_000
EPOCHS, RATE, DECAY = 300, 0.1, 1e-4

_runs = re.compile(rb"([a-z\x80-\xff]+)|([A-Z]+)|([0-9]+)|(.)\4*", re.DOTALL)


def hashed(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << BITS) - 1)


def shape(word: bytes) -> bytes:
    """Runs of letters, capitals, digits and of any other character, one sign each."""
    signs = {1: b"a", 2: b"A", 3: b"0"}
    return b"".join(signs.get(m.lastindex) or m[4] for m in _runs.finditer(word))


_shapes = Memo(lambda word: hashed(shape(word)), 500_000)


def features(text: str, measured: tuple[int, ...]) -> dict[int, float]:
    """Hashed features of a whole text, from its words and its ``quality_rules.measure``."""
    words = text.encode().split()
    n = len(words)
    lookup = _shapes
    counts = Counter([lookup[w] if len(w) < 64 else hashed(shape(w)) for w in words])
    out = {i: math.sqrt(c / n) for i, c in counts.items()}
    m = dict(zip(rules.BASE + rules.MORE, measured, strict=True))
    own = {b" repeats": m["n_repeat_words"] / max(1, n), b" lines": m["n_dup_lines"] / max(1, m["n_lines"]), b" size %d" % min(6, n.bit_length() // 2): 1.0}
    for name, value in own.items():
        out[hashed(name)] = out.get(hashed(name), 0.0) + value
    return out


class Scorer:
    """A logistic model over hashed features."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def score(self, ids: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` texts whose features lie one after another; ``owner`` tells whose they are."""
        z = self.bias + np.bincount(owner, weights=self.weights[ids] * values, minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(ids: list[list[int]], values: list[list[float]], targets: list[float]) -> Scorer:
    """Fit to soft labels by Adam over all rows at once; the same rows give the same scorer."""
    weights, bias, n = np.zeros(1 << BITS), 0.0, len(targets)
    if not n:
        return Scorer(bias, weights)
    used, column = np.unique(np.fromiter((i for r in ids for i in r), np.int64), return_inverse=True)
    value = np.fromiter((v for r in values for v in r), float)
    owner = np.repeat(np.arange(n), [len(r) for r in ids])
    y = np.array(targets)
    p = np.zeros(len(used) + 1)
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, EPOCHS + 1):
        z = p[-1] + np.bincount(owner, weights=p[column] * value, minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(np.bincount(column, weights=g[owner] * value, minlength=len(used)) + DECAY * p[:-1], g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        p = p - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = p[:-1]
    return Scorer(float(p[-1]), weights)


def described(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labellers' numbers and the hashed features of every text, with a key of the row; written once."""
    fields = [(n, T.LongType()) for n in rules.BASE + rules.MORE] + [("ids", T.ArrayType(T.IntegerType())), ("values", T.ArrayType(T.FloatType()))]

    def make():
        def fn(batch):
            rows = [(t, rules.measure(t)) for t in texts(batch, text_col)]
            found = [features(t, m) for t, m in rows]
            return [*zip(*(m for _, m in rows), strict=True), [list(f) for f in found], [list(f.values()) for f in found]]

        return fn

    keyed = df.select(F.col(id_col).alias("id"), F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    return written(map_batches(keyed, make, fields, ["id", "key"]), "described")


def train(table: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, Scorer]:
    """The table with its weak labels (``weak``), and the scorer fitted on a bounded sample of them."""
    clean, accuracy = rules.fit(table)
    labelled = table.withColumn("weak", rules.posterior(clean, accuracy))
    sample = hash_sample(labelled.select("id", "key", "ids", "values", "weak"), F.col("key"), max_rows).collect()
    return labelled, fit([r["ids"] for r in sample], [r["values"] for r in sample], [r["weak"] for r in sample])


def classify(df: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``weak`` (the labellers' posterior), ``score`` and ``kept`` (a score of 0.5 or more) of every row."""
    labelled, scorer = train(described(df, id_col, text_col), max_rows)

    def make():
        def fn(batch: pa.RecordBatch):
            ids, values = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "values"))
            sizes = ids.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            return [pa.array(scorer.score(ids.flatten().to_numpy(), values.flatten().to_numpy(), owner, len(sizes)))]

        return fn

    scored = map_batches(labelled.select("id", "n_words", "weak", "ids", "values"), make, [("score", T.DoubleType())], ["id", "n_words", "weak"])
    return scored.select(F.col("id").alias(id_col), "n_words", "weak", "score", (F.col("score") >= 0.5).alias("kept"))
