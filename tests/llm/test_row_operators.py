"""Quality rules, personal data, toxicity: against brute force, planted cases and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataseek.llm import pii, quality_rules, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measure(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_measure():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b ", "c\n", "é", "#", "\t", "\x0b", "\x1c", "\xa0", " d e f ", "\n\n", "|"], k=rng.randint(0, 40)))
        assert quality_rules.measure(text)[:5] == brute_measure(text), repr(text)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth, n = [(0.95, 0.9), (0.99, 0.8), (0.93, 0.7), (0.97, 0.5), (0.96, 0.3)], 60_000
    clean = rng.random(n) < 0.7
    right = np.stack([rng.random(n) < np.where(clean, a, b) for a, b in truth], 1)
    votes = np.where(rng.random((n, len(truth))) < 0.2, 0, np.where(right, 1, -1) * np.where(clean, 1, -1)[:, None])
    share, accuracy = quality_rules.estimate(list(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.7) < 0.02
    assert np.abs(np.array(accuracy) - truth).max() < 0.03


def test_kinds_of_junk():
    """Two rules know each kind of junk; they convict together, though all others vote for the text."""
    kinds = [(-1, -1, 1, 1, 1, 1), (1, 1, -1, -1, 1, 1), (1, 1, 1, 1, -1, -1)]
    patterns = [((1,) * 6, 9000), *((k, 300) for k in kinds)]
    share, accuracy = quality_rules.estimate(patterns)
    weight = [quality_rules.weights(a) for a in accuracy]
    odds = [quality_rules.log_odds(share) + sum(w[x] for x, w in zip(v, weight, strict=True)) for v, _ in patterns]
    assert odds[0] > 0 > max(odds[1:])


def test_quality_against_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    judged = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50")
    n = {(r["kept"], r["quality"]): r["count"] for r in judged.groupBy("kept", "quality").count().collect()}
    good, bad = n.get((True, 1), 0), n.get((False, 0), 0)
    assert good / (good + n.get((False, 1), 0)) > 0.97
    assert bad / (bad + n.get((True, 0), 0)) > 0.9


def test_quality_tables(awkward):
    rows = quality_rules.judge(awkward).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    assert len(rows) == len(texts)
    found = Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE)) for r in rows)
    assert found == Counter((r["doc_id"], *quality_rules.measure(r["text"] or "")[:5]) for r in awkward.collect())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    kept = quality_rules.keep_clean(awkward)
    assert kept.columns == awkward.columns and kept.where("_quality_n_words <> 12 OR n_words <> 5").isEmpty()
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.judge(awkward.limit(0)).isEmpty() and quality_rules.keep_clean(awkward.limit(0)).isEmpty()


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", "1", "12", "255", "256", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "x@y.zz", "+1 (826) 555-4081", "é", "10.0.0.1", "%", "0000", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        got = [(s.start, s.order, s.end) for s in pii.find(text) if s.base]
        assert got == brute_base(text), repr(text)


def kinds(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find(text)]


def test_added_spans():
    assert kinds("Des +1 (826) 555-4081 190.137.223.20 x") == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.20")]
    assert ("card", "4111111111111111") in kinds("n 17 4111111111111111 2024")
    assert kinds("pay GB82 WEST 1234 5698 7654 32 now")[0] == ("iban", "GB82 WEST 1234 5698 7654 32")
    assert not any(k == "iban" for k, _ in kinds("GB83 WEST 1234 5698 7654 32"))
    assert kinds("ssn 078-05-1120") == [("ssn", "078-05-1120")] and kinds("part 078-05-1120") == []
    near, far = pii.find("card 4111111111111111"), pii.find("zzzz 4111111111111111")
    assert near[0].score > far[0].score
    assert pii.redacted("a x@y.zz b", pii.find("a x@y.zz b")) == "a <EMAIL> b"


@pytest.mark.parametrize("tail", [" BIC COBADEFFXXX", " A", " EUR 250", " 17", " GB82 WEST 1234 5698 7654 32", ""])
def test_account_numbers_before_capitals(tail):
    text = "IBAN DE89 3704 0044 0532 0130 00" + tail
    found = [t for k, t in kinds(text) if k == "iban"]
    assert found == ["DE89 3704 0044 0532 0130 00", *([tail[1:]] if "WEST" in tail else [])]
    assert "3704" not in pii.redacted(text, pii.find(text))


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "AB12" * 50_000, "@" * 100_000):
        pii.find(text)


def test_pii_tables(awkward):
    rows, source = pii.annotate(awkward).collect(), awkward.collect()
    for r, s in zip(rows, source, strict=True):
        base = brute_base(s["text"] or "")
        assert r["doc_id"] == s["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    red = pii.redact(awkward)
    assert red.columns == awkward.columns and red.count() == len(source)
    assert red.where("doc_id = 2 AND text IS NULL").count() == 1
    assert pii.annotate(awkward.limit(0)).isEmpty()


def test_spans_of_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, sf).collect():
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[1] == i for x in brute_base(texts[r["doc_id"]])) for i in range(4)]


def test_interactions_are_learnt():
    """Neither term alone is toxic, both together are; a linear model can't say so."""
    rng = random.Random(0)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"filler{i}" for i in range(30)], k=6) + ["insult"] * a + ["group"] * b
        rows.append(toxicity.text_features(" ".join(words)))
        labels.append(int(a and b))
    machine = toxicity.fit(rows, labels)
    score = lambda t: machine.score(toxicity.text_features(t))
    assert score("insult group filler1") > 0.9 > 0.1 > max(score("insult filler1"), score("group filler2"), score("filler3"))
    assert sum((machine.score(r) >= 0.5) == y for r, y in zip(rows, labels, strict=True)) / len(rows) > 0.99


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.train(documents, labels)
    scored = toxicity.score(documents.join(labels.where(toxicity.held_out(F.col("doc_id"))).select("doc_id"), "doc_id", "left_semi"), machine).join(labels, "doc_id")
    rows = [(r["predicted"], r["toxic"]) for r in scored.where("held_out").collect()]
    hit, missed, wrong = rows.count((1, 1)), rows.count((0, 1)), rows.count((1, 0))
    assert hit / (hit + missed) > 0.8 and wrong <= 0.02 * len(rows)


def test_toxicity_tables(spark, awkward):
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(awkward, labels)
    rows = toxicity.score(awkward, machine).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    empty = toxicity.train(awkward, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(awkward, empty).collect()} == {0}
    assert toxicity.score(awkward.limit(0), empty).isEmpty()
    again = toxicity.train(awkward, labels)
    assert [r["score"] for r in toxicity.score(awkward, again).collect()] == [r["score"] for r in rows]


@pytest.mark.parametrize("doc", [0, 1, 7, 123456789])
def test_held_out_rule(spark, doc):
    import zlib

    assert spark.range(1).select(toxicity.held_out(F.lit(doc))).first()[0] == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_mostly_junk():
    """A corpus of 80 % junk: the share and the verdicts follow the corpus, not a wall."""
    rng = np.random.default_rng(3)
    clean = rng.random(20_000) < 0.2
    right = np.where(clean[:, None], rng.random((20_000, 6)) < 0.97, rng.random((20_000, 6)) < 0.7)
    votes = np.where(right, 1, -1) * np.where(clean, 1, -1)[:, None]
    patterns = list(Counter(map(tuple, votes.tolist())).items())
    share, accuracy = quality_rules.estimate(patterns)
    assert abs(share - 0.2) < 0.03
    weight = [quality_rules.weights(a) for a in accuracy]
    kept = np.array([quality_rules.log_odds(share) + sum(w[x] for x, w in zip(v, weight, strict=True)) >= 0 for v in votes.tolist()])
    assert (kept == clean).mean() > 0.97


def test_scores_against_all_pairs(spark, sf):
    """The machine's score of every text of a table against the plain sum over all pairs of features."""
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    machine = toxicity.train(documents, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.limit(60).collect()}
    for r in toxicity.score(documents, machine).collect():
        if r["doc_id"] in texts:
            used = [machine.weights[i] for i in toxicity.text_features(texts[r["doc_id"]]) if i in machine.weights]
            z = machine.bias + sum(w for w, _ in used)
            z += sum(float(used[i][1] @ used[j][1]) for i in range(len(used)) for j in range(i))
            assert abs(r["score"] - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9


def test_repeated_ids_of_different_texts(spark):
    """Repeats of an id reach the driver once, and which one doesn't depend on the order of rows."""
    rows = [(i % 20, f"text {i} {'vile insult' if i % 20 < 9 else 'kind words'} {i % 7}") for i in range(2000)]
    labels = spark.createDataFrame([(i, 0, int(i < 9)) for i in range(20)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows[::-1]))
    assert a.bias == b.bias and {k: w for k, (w, _) in a.weights.items()} == {k: w for k, (w, _) in b.weights.items()}
