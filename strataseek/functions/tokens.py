"""Tokenisers: text to an array of terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = re.compile(r"[^\W_]+")
HAN = re.compile("[㐀-鿿豈-﫿]+")
HAN_PARTS = re.compile(r"[㐀-鿿豈-﫿]+|[^㐀-鿿豈-﫿]+")
_PARTS = r"([㐀-鿿豈-﫿]+|[^㐀-鿿豈-﫿]+)"


def _pairs(part: Column) -> Column:
    last = F.greatest(F.char_length(part) - 1, F.lit(1))
    return F.when(F.regexp_like(part, F.lit(r"^[㐀-鿿豈-﫿]")), F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(part, i, F.lit(2)))).otherwise(F.array(part))


def _runs(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def _parted(spaced: Column) -> Column:
    return F.flatten(F.transform(_runs(spaced), lambda t: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(_PARTS)), _pairs))))


def _folded(text: Column, han: Callable[[Column], Column], plain: Callable[[Column], Column]) -> Column:
    # the array of one binds the text to a name, so that it is folded once
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.array(spaced), lambda s: F.when(F.regexp_like(s, F.lit("[㐀-鿿豈-﫿]")), han(s)).otherwise(plain(s)))[0]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, runs of Han characters as their overlapping pairs; stays in the JVM."""
    return _folded(text, _parted, _runs)


def joined(text: Column) -> Column:
    """``words`` as one text, spaces between them: cheaper to hand to Python, which splits it."""
    return _folded(text, lambda s: F.array_join(_parted(s), " "), lambda s: s)


words.joined = joined


def words_of(text: str) -> list[str]:
    """The driver's reading of ``words``."""
    return segment(text, dictionary=False)


def segment(text: str, dictionary: bool = True) -> list[str]:
    """Words of a text; runs of Han characters by dictionary if that is wanted and one is installed, else as overlapping pairs."""
    jieba = None
    if dictionary:
        try:
            import jieba
        except ImportError:
            jieba = None
    out = []
    for run in RUNS.findall(text.lower()):
        for part in HAN_PARTS.findall(run):
            if not HAN.match(part):
                out.append(part)
            elif jieba:
                out += [w for w in jieba.cut(part) if w.strip()]
            else:
                out += [part[i : i + 2] for i in range(max(1, len(part) - 1))]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def segmented(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As ``words``, with Han runs segmented by a dictionary if one is installed."""
    for series in texts:
        yield series.map(lambda t: segment(t or ""))
