"""The weak-label classifier: held-out accuracy, agreement across ways to score, awkward tables."""

import numpy as np
from pyspark.sql import functions as F

from strataseek.llm import quality_classifier as C
from strataseek.llm import quality_rules


def test_accuracy_on_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = C.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [not r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.85


def test_shapes():
    assert [C.shape(w) for w in (b"Word.", b"don't", b"AB***", b"a1b22", "É".encode(), b"|", b"x" * 99 + b"!!!")] == [b"Aa.", b"a'a", b"A*", b"a0a0", b"a", b"|", b"a!"]


def test_scores_follow_the_labels():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["plain", "words", "here"], 60)) + (" ***" * 30 if i % 3 == 0 else ".") for i in range(300)]
    found = [C.features(t, quality_rules.measure(t)) for t in texts]
    scorer = C.fit([list(f) for f in found], [list(f.values()) for f in found], [float(i % 3 != 0) for i in range(300)])
    for i, f in enumerate(found):
        n = len(f)
        assert (scorer.score(np.array(list(f)), np.array(list(f.values())), np.zeros(n, int), 1)[0] >= 0.5) == (i % 3 != 0)


def test_tables(awkward):
    rows = C.classify(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    again = C.classify(awkward, max_rows=3)
    assert again.count() == len(rows)  # the bound is on what is learnt from, not on what is scored
    assert C.classify(awkward.limit(0)).isEmpty()


def test_sample_is_bounded(spark, sf):
    table = C.described(spark.read.parquet(f"{sf}/documents.parquet"))
    labelled, scorer = C.train(table, max_rows=50)
    assert labelled.count() == table.count() and np.count_nonzero(scorer.weights)
    assert labelled.where(F.col("weak").isNull()).isEmpty()


def test_a_table_of_copies(spark):
    """Copies say nothing of how hashes spread: the sample is never empty, and a table of one junk text is rejected whole."""
    junk = "*** ### $$$ %%% ||| <<< >>> &&& " * 30
    frame = spark.createDataFrame([(1, junk)], "doc_id long, text string")
    many = spark.range(100_000).select(F.lit(1).alias("doc_id")).join(frame, "doc_id")
    rows = C.classify(many).groupBy("kept").count().collect()
    assert [(r["kept"], r["count"]) for r in rows] == [(False, 100_000)]


def test_hash_sample(spark):
    from strataseek.llm.common import hash_sample

    table = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("x"))
    got = [r["x"] for r in hash_sample(table, F.xxhash64("x"), 50).collect()]
    want = sorted((r["h"], r["x"]) for r in table.distinct().select(F.xxhash64("x").alias("h"), "x").collect())[:50]
    assert sorted(got) == sorted(x for _, x in want)


def test_scores_against_brute_force(spark, sf):
    """Every score of the query's table: the logistic of the weighted sum, feature by feature."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, scorer = C.train(C.described(docs))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in C.classify(docs).collect():
        t = texts[r["doc_id"]]
        z = scorer.bias + sum(float(np.float32(v)) * scorer.weights[i] for i, v in C.features(t, quality_rules.measure(t)).items())
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6 and r["kept"] == (r["score"] >= 0.5)
