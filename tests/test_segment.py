"""Segmentation by a dictionary against all ways to cut a run, and dictionaries counted from a corpus."""

import random
from math import isclose

import pytest

from strataseek.functions import segment
from strataseek.functions.segment import Segmenter
from strataseek.operators import fulltext
from strataseek.operators.text_index import TextIndex

WORDS = {"中": 3, "中国": 40, "国人": 12, "人民": 30, "民": 2, "中国人": 9, "中国人民": 5, "人": 20, "国": 4}


def cuts(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in cuts(run[k:]):
            yield [run[:k], *rest]


def weight(s, path):
    known = [s.weights.get(w, s.weights[""] if len(w) == 1 else None) for w in path]
    return None if None in known else sum(known)


def test_best_path():
    s, rng = Segmenter(WORDS), random.Random(0)
    for n in range(11):
        for _ in range(6):
            run = "".join(rng.choices("中国人民的", k=n))
            path = s.cut(run)
            assert "".join(path) == run
            best = max(w for p in cuts(run) if (w := weight(s, p)) is not None)
            assert isclose(weight(s, path), best, abs_tol=1e-9)


def test_terms():
    s = Segmenter(WORDS | {"ab": 5, "人x": 3, "": 1, "的": 0})
    assert s.terms("中国人民 Ab_12中国的x") == ["中国", "人民", "ab", "12", "中国", "的", "x"]
    assert s.terms("") == s.terms(None) == [] and Segmenter({}).terms("中国") == ["中", "国"]


def test_pages_and_queries_share_the_dictionary(spark, tmp_path):
    s = Segmenter.of(spark.createDataFrame([*WORDS.items(), ("中国", 1), (None, 4)], "word string, count long"))
    assert s.counts["中国"] == 41
    pages = spark.createDataFrame([(1, 1, "中国人民"), (2, 1, "国人 and more"), (3, 1, None)], "file_id long, location long, body string")
    index = TextIndex.create(pages, str(tmp_path / "ix"), s)
    for rank in (index.rank, lambda q: fulltext.rank(pages, q, s)):
        assert [[r["file_id"] for r in rank(q).collect()] for q in ("国人", "人民", "中国人民")] == [[2], [1], [1]]
    with pytest.raises(ValueError):
        TextIndex(spark, str(tmp_path / "ix"))


def test_counted_words(spark, monkeypatch):
    rng = random.Random(2)
    words = ["检索系统", "文档", "研究生"]
    signs = [chr(0x4E00 + k) for k in range(300)]
    bodies = ["".join(rng.choice(words) if rng.random() < 0.06 else rng.choice(signs) for _ in range(40)) for _ in range(150)]
    found = {r["word"]: r["count"] for r in segment.counted(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert set(words) <= set(found) and "检索" not in found and "索系统" not in found
    assert found["文档"] == sum(b.count("文档") for b in bodies) and len(found) < 30
    monkeypatch.setattr(segment, "MOST", 1)
    with pytest.raises(ValueError):
        Segmenter.of(spark.createDataFrame(list(WORDS.items()), "word string, count long"))
