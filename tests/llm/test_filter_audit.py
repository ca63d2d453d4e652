"""The audit of five filters against applying them one after another."""

import re
from collections import defaultdict
from itertools import permutations

from strataseek.llm import filter_audit, queries
from tests.conftest import rows_of

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Every order applied to every part, document by document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        parts[source or ""].append((i, {f for f, x in fails.items() if x}))
    orders = ["".join(p) for p in permutations("ABCDE")]
    out, shapley = [], defaultdict(int)
    for part, rows in parts.items():
        for order in orders:
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in rows)
                shapley[part, f] += len(removed)
                unique = sum(r[1] == {f} for r in rows)
                out.append([part, order, step, len(left), len(removed), failing - len(removed), unique, sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def run(spark, docs, labels):
    frame = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert frame.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r) for r in frame.collect())


def test_awkward(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    docs = [
        (1, " ".join(f"word{k}" for k in range(300)), "a"), (2, " ".join(f"word{k}" for k in range(300)), "b"),
        (2, " ".join(f"word{k}" for k in range(300)), "b"), (3, None, "a"), (4, "", None), (5, "", ""), (3, "", "b"), (None, "", "a"), (None, None, None),
        (6, "A B c " * 100, "a"), (7, "A B c " * 100, None), (8, "x $ y", "b"), (9, long, "a"), (10, long + " % A", "a"), (11, "\x1c one", "a"), (12, "same " * 400, "b"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (6, 0, 1), (7, 1, 1), (12, 1, 1), (None, 1, 1), (99, 1, 1), (3, 1, 0)]
    assert run(spark, docs, labels) == plain(docs, labels)
    assert run(spark, docs, []) == plain(docs, [])


def test_given_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_query(spark, duck, sf):
    assert rows_of(queries.op12_filter_audit(spark, sf).toPandas()) == rows_of(duck.execute(queries.oracle_sql()["op12_filter_audit"]).df())


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == []


def test_transform_is_exact(spark):
    """Cells of every mask come back from their parity sums."""
    rows = [("p", False, False, m, (m * 7919) % 1000 + 1) for m in range(32)]
    frame = filter_audit.parities(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long"))
    assert frame.select(filter_audit.inverted(frame["w"]).alias("c")).first()["c"] == [r[4] for r in rows]
