"""Quality rules as weak supervision (operator 1).

Each rule votes +1 (clean), -1 (junk) or 0 (abstains) on a text. Expectation-
maximisation over the corpus estimates, for each rule, how often its votes are right
on clean texts and on junk (a rule that knows one kind of junk is seldom right on
junk as a whole, yet its -1 says much), and how common clean texts are; a text's
posterior probability of being clean then decides, in place of a demand that every
rule passes. The statistics are the counts of the vote patterns of all rows: at most 3
to the number of rules, whatever the corpus's size.

A word is ``[^\\x20\\x09-\\x0D]+``. Null text has no words and fails the base rule.
An empty table gives an empty result (the accuracies keep their starting values).
Repeated rows get equal verdicts, each row its own; a posterior of exactly 0.5 keeps a text. Very long texts are measured
whole. Columns named like the numbers give way to them in ``judge`` and stay in ``keep_clean``.

What is assumed, beside the starting values: 1 to 99 % of the texts are clean, and a rule's votes on clean texts are right nine
times in ten at least (rules are written that way; without it, clean and junk could change places). A
corpus that breaks the second needs other rules, not another estimate.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.llm.common import map_batches, texts, unused, written

SPACE = b" \t\n\x0b\f\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = CAPITALS + CAPITALS.lower()
#: ASCII characters of plain prose beside letters and space.
PROSE = b".,;:!?'\"()-0123456789"
_ODD = bytes(c for c in range(33, 127) if c not in LETTERS + PROSE)
_odd_end = re.compile(rb"[^\x80-\xffA-Za-z0-9.,;:!?'\"()\x09-\x0D\x20-](?=[\x20\x09-\x0D]|\Z)").findall

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_marks", "n_capitals", "n_letters", "n_odd_ends", "n_odd_chars", "n_distinct")

#: Starting share of right votes on clean texts and on junk, weight of that belief in votes,
#: starting share of clean texts, rounds of the estimation.
START_CLEAN_RIGHT, START_JUNK_RIGHT, BELIEF, START_CLEAN, ROUNDS = 0.95, 0.3, 10.0, 0.8, 80

#: A rule's shares of right votes, on clean texts and on junk.
Accuracy = tuple[float, float]


def measure(text: str) -> tuple[int, ...]:
    """The numbers that the rules look at, BASE then MORE."""
    data = text.encode()
    words = data.split()  # of bytes: splits at exactly SPACE
    n = len(words)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        n,
        len(text) - count(SPACE),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        data.count(b"!"),
        count(CAPITALS),
        count(LETTERS),
        len(_odd_end(data)),
        count(_ODD),
        len(set(words)),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    inside = bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def features(df: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Append ``measure`` of every whole text, one long column each."""

    def make():
        return lambda batch: list(zip(*(measure(t) for t in texts(batch, text_col)), strict=True))

    columns = list(dict.fromkeys([*keep, text_col]))
    return map_batches(df.select(*columns), make, [(prefix + n, T.LongType()) for n in BASE + MORE], keep)


def votes(prefix: str = "") -> dict[str, Column]:
    """The rules over the features, as columns of -1, 0 and 1."""
    c = {n: F.col(prefix + n) for n in BASE + MORE}

    def rule(junk: Column, clean: Column) -> Column:
        return F.when(junk, -1).when(clean, 1).otherwise(0)

    words, lines = c["n_words"], c["n_lines"]
    return {
        "length": rule(words < 20, words >= 50),
        "symbols": rule(10 * c["n_symbols"] > words, 100 * c["n_symbols"] <= 2 * words),
        "endings": rule(100 * c["n_odd_ends"] > 15 * words, 100 * c["n_odd_ends"] <= 3 * words),
        "characters": rule(100 * c["n_odd_chars"] > 4 * c["word_chars"], 100 * c["n_odd_chars"] <= c["word_chars"]),
        "lines": rule((c["n_dup_lines"] > 2) & (100 * c["n_dup_lines"] > 30 * lines), 100 * c["n_dup_lines"] <= 5 * lines),
        "repeats": rule((c["n_repeat_words"] >= 20) & (100 * c["n_repeat_words"] > 30 * words), 100 * c["n_repeat_words"] <= 10 * words),
        "distinct": rule(F.pow(c["n_distinct"], F.lit(5)) < F.pow(words, F.lit(3)), F.pow(c["n_distinct"], F.lit(10)) >= F.pow(words, F.lit(7))),
        "word_size": rule((c["word_chars"] > 14 * words) | (c["word_chars"] < 2 * words), (c["word_chars"] <= 10 * words) & (c["word_chars"] >= 3 * words)),
        "marks": rule(5 * c["n_marks"] > words, 50 * c["n_marks"] <= words),
        "capitals": rule(2 * c["n_capitals"] > c["n_letters"], 4 * c["n_capitals"] <= c["n_letters"]),
    }


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def weights(accuracy: Accuracy) -> dict[int, float]:
    """What a vote adds to the log odds of a clean text."""
    clean, junk = accuracy
    return {1: math.log(clean / (1 - junk)), 0: 0.0, -1: math.log((1 - clean) / junk)}


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[Accuracy]]:
    """Share of clean texts and accuracies of each rule, by expectation-maximisation over (votes, count)."""
    rules = len(patterns[0][0]) if patterns else len(votes_order())
    clean, accuracy = START_CLEAN, [(START_CLEAN_RIGHT, START_JUNK_RIGHT)] * rules
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if patterns else 0):
        weight = [weights(a) for a in accuracy]
        odds = [log_odds(clean) + sum(w[x] for x, w in zip(v, weight, strict=True)) for v, _ in patterns]
        posterior = [1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) for z in odds]
        clean = min(0.99, max(0.01, sum(n * p for (_, n), p in zip(patterns, posterior, strict=True)) / total))
        for j in range(rules):
            right, cast = [BELIEF * START_CLEAN_RIGHT, BELIEF * START_JUNK_RIGHT], [BELIEF, BELIEF]
            for (v, n), p in zip(patterns, posterior, strict=True):
                if v[j]:
                    for k, share in enumerate((p, 1 - p)):
                        cast[k] += n * share
                        right[k] += n * share * (v[j] == (1, -1)[k])
            on_clean = min(0.999, max(0.9, right[0] / cast[0]))  # rules seldom fire on clean texts
            # a rule is better than chance: it doesn't speak against a text that it votes for
            accuracy[j] = (on_clean, min(0.999, max(1.001 - on_clean, right[1] / cast[1])))
    return clean, accuracy


def votes_order() -> list[str]:
    return ["length", "symbols", "endings", "characters", "lines", "repeats", "distinct", "word_size", "marks", "capitals"]


def fit(measured: DataFrame, prefix: str = "") -> tuple[float, dict[str, Accuracy]]:
    """Estimate from all rows of ``features``; only counts of vote patterns reach the driver."""
    cast = votes(prefix)
    rows = measured.groupBy(*(cast[r].alias(f"v{i}") for i, r in enumerate(votes_order()))).count().collect()
    clean, accuracy = estimate(sorted((tuple(r)[:-1], r["count"]) for r in rows))
    return clean, dict(zip(votes_order(), accuracy, strict=True))


def base_failed(prefix: str = "") -> Column:
    words = F.col(prefix + "n_words")
    return (words < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * words)


def posterior(clean: float, accuracy: dict[str, Accuracy], prefix: str = "") -> Column:
    odds = F.lit(log_odds(clean))
    for name, vote in votes(prefix).items():
        weight = weights(accuracy[name])
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(df: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep``, the base numbers, ``base_failed``, ``kept`` and ``posterior``; the texts are read once."""
    measured = written(features(df, text_col, keep), "quality")
    clean, accuracy = fit(measured)
    held = [c for c in keep if c not in BASE + MORE]
    out = measured.select(*held, *BASE, base_failed().alias("base_failed"), posterior(clean, accuracy).alias("posterior"))
    return out.select(*held, *BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")


def keep_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns. Texts are measured twice and never stored or shuffled."""
    prefix = unused(df, "_quality_")
    clean, accuracy = fit(features(df, text_col, [], prefix), prefix)
    measured = features(df, text_col, df.columns, prefix)
    return measured.where(~base_failed(prefix) & (posterior(clean, accuracy, prefix) >= 0.5)).select(*df.columns)
