"""Words of Han text by a dictionary: the most probable path through the graph of all words that a run can be cut into.

A run's graph has an edge for each dictionary word in it and for each sign alone; an edge weighs the logarithm of its
word's share of all counts, a sign that is no word less than any. The best path is found from the left, one place after the
other. Pages and queries use one ``Segmenter``, which goes to the executors once, as a dictionary of checked size. The
dictionary is a table of words and counts, given or counted from the corpus (``counted``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, reduce
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.functions.tokens import HAN, HAN_PARTS, RUNS

#: Words that a dictionary may have: it is held by the driver and sent to every executor.
MOST = 1_000_000
#: Signs of a word that is counted from a corpus; times that its parts must stand together oftener than by chance; share of its
#: occurrences inside one longer word from which on it is only part of that.
LONGEST, TOGETHER, INSIDE = 4, 20, 0.9


class Segmenter:
    """A tokenizer: called with a column it gives the array of words, ``terms`` does the same for one text."""

    def __init__(self, counts: dict[str, int]):
        """Words with their counts; words of no count, or with other signs than Han, have no edge."""
        self.counts = {w: n for w, n in counts.items() if n and n > 0 and HAN.fullmatch(w)}

    @classmethod
    def of(cls, words: DataFrame) -> Segmenter:
        """From a table (word, count)."""
        rows = words.groupBy("word").agg(F.sum("count").alias("count")).limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"a dictionary has {MOST} words at most")
        return cls({r["word"]: r["count"] for r in rows if r["word"]})

    @cached_property
    def weights(self) -> dict[str, float]:
        total = sum(self.counts.values()) + 1
        return {w: log(n / total) for w, n in self.counts.items()} | {"": log(1 / total) - 1}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.counts), default=1)

    @property
    def name(self) -> str:
        """Names the dictionary; an index made with one can't be read with another."""
        return hashlib.md5("\n".join(f"{w} {n}" for w, n in sorted(self.counts.items())).encode()).hexdigest()

    def cut(self, run: str) -> list[str]:
        """A run of Han signs as words; of paths of equal weight the one whose last words are longer."""
        weights, none = self.weights, self.weights[""]
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            found, at = float("-inf"), end - 1
            for begin in range(max(0, end - self.longest), end):  # longer words first
                weight = weights.get(run[begin:end], none if begin == end - 1 else None)
                if weight is not None and best[begin] + weight > found:
                    found, at = best[begin] + weight, begin
            best.append(found)
            back.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def terms(self, text: str) -> list[str]:
        out = []
        for run in RUNS.findall((text or "").lower()):
            for part in HAN_PARTS.findall(run):
                out += self.cut(part) if HAN.match(part) else [part]
        return out

    def __call__(self, text: Column) -> Column:
        from pyspark.sql import SparkSession

        held = SparkSession.getActiveSession().sparkContext.broadcast(self.counts)

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def segmented(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Segmenter(held.value)
            for series in texts:
                yield series.map(own.terms)

        return segmented(text)


def counted(pages: DataFrame, least: int = 5) -> DataFrame:
    """``word, count`` of a corpus (body): runs of two to four signs that stand together oftener than chance has it, wherever they are cut.

    Counting is one aggregation, combined before its shuffle; the parts' counts are joined, and nothing is collected.
    """
    runs = pages.select(F.explode(F.regexp_extract_all(F.col("body"), F.lit(rf"({HAN.pattern})"))).alias("run"))
    size = F.char_length("run")

    def of_length(n: int) -> Column:
        places = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring("run", i, F.lit(n)))

    pieces = runs.select(F.explode(F.concat(*(of_length(n) for n in range(1, LONGEST + 2)))).alias("word"))
    counts = pieces.groupBy("word").agg(F.count("*").alias("count"))
    total = counts.where(F.char_length("word") == 1).agg(F.sum("count")).first()[0] or 1
    often = counts.where((F.col("count") >= least) & (F.char_length("word") > 1))
    cuts = often.where(F.char_length("word") <= LONGEST).select("word", "count", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("cut"))
    cuts = cuts.select("word", "count", F.left("word", "cut").alias("left"), F.expr("substring(word, cut + 1)").alias("right"))
    sides = [counts.select(F.col("word").alias(s), F.col("count").alias(f"n_{s}")) for s in ("left", "right")]
    joined = reduce(lambda a, b: a.join(b, b.columns[0]), sides, cuts)
    chance = joined.groupBy("word", "count").agg(F.min(F.col("count") * float(total) / (F.col("n_left") * F.col("n_right"))).alias("together"))
    longer = often.select(F.explode(F.array(F.expr("left(word, char_length(word) - 1)"), F.expr("substring(word, 2)"))).alias("word"), F.col("count").alias("in")).groupBy("word").agg(F.max("in").alias("in"))
    found = chance.where(F.col("together") >= TOGETHER).join(longer, "word", "left")
    return found.where(F.coalesce("in", F.lit(0)) < INSIDE * F.col("count")).select("word", "count")
