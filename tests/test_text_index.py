"""The saved index of segments: against a scan of the pages that count, over upserts, compactions and racing writers."""

import random
from datetime import datetime
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.operators import fulltext, inverted, text_index
from strataseek.operators.text_index import TextIndex
from strataseek.schema import WATCH_EVENT
from strataseek.sources import pages as page_sources
from strataseek.sources.versions import Raced
from strataseek.streaming import watch

PAGES = "file_id long, location long, body string"
QUERIES = ("alpha beta", "alpha AND beta", '"alpha beta"', "+gamma -alpha", "(alpha OR delta) AND NOT beta", "al*", "*ta", "g?mma", "*et*", "zzz", "NOT alpha", "文档", "检", "文档检索", "*")


def pages(spark, seed, files, words="alpha beta gamma delta epsilon zeta Alphabet 文档检索 学习文档"):
    rng, words = random.Random(seed), words.split()
    rows = [(i, p, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in files for p in range(1, rng.randrange(2, 4))]
    return spark.createDataFrame([*rows, (-5, 1, " "), (-6, 1, None)], PAGES)


def same(index, current, queries=QUERIES[1:9:3]):
    """Each query gives what a scan of the pages that count gives; one job for each side."""
    def all_of(rank):
        found = [rank(q).select(F.lit(q).alias("q"), "file_id", "location", F.round("score", 9).alias("score")) for q in queries]
        return sorted(map(tuple, reduce(DataFrame.unionByName, found).collect()))

    assert all_of(index.rank) == all_of(lambda q: fulltext.rank(current, q))


def test_upserts_and_compaction(spark, tmp_path):
    """Three rounds of changes, then a compaction: after each, as if all pages that count had been scanned."""
    current = pages(spark, 0, range(-300, 300))
    index = TextIndex.create(current, str(tmp_path / "ix"))
    same(index, current, QUERIES)
    for seed in (1, 2, 3):
        changed = pages(spark, seed, range(seed * 40, seed * 40 + 60)).where("file_id >= 0")
        gone = spark.createDataFrame([(i,) for i in range(-300 + 10 * seed, -295 + 10 * seed)] + [(None,), (10**6,)], "file_id long")
        before = {s: sorted(p.name for p in (tmp_path / "ix" / s / "postings").iterdir()) for s in index.state.segments}
        index.upsert(changed, gone)
        assert before.items() <= {s: sorted(p.name for p in (tmp_path / "ix" / s / "postings").iterdir()) for s in index.state.segments}.items()
        left = current.join(changed.select("file_id").union(gone.where("file_id IS NOT NULL")).distinct(), "file_id", "left_anti")
        current = spark.createDataFrame(left.select("file_id", "location", "body").collect() + changed.collect(), PAGES)
        index = TextIndex(spark, str(tmp_path / "ix"))  # as another process finds it
        assert len(index.state.segments) == seed + 1
        same(index, current)
    assert index.compact(whole=True) and len(index.state.segments) == 1 and not index.state.gone
    same(TextIndex(spark, str(tmp_path / "ix")), current, QUERIES)
    assert sorted(map(tuple, index.pages().select("file_id", "location", "body").collect())) == sorted(map(tuple, current.where(F.trim("body") != "").collect()))


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Texts are cut once and postings made where the pages are read, in portions of any size; a page without a number of its own counts too."""
    odd = [(None, 1, "alpha beta"), (-3, 2, "beta alpha beta"), (-3, 1, "alpha"), (7, 1, "!!!"), (9, 1, "学习文档 alpha")]
    current = spark.createDataFrame([*pages(spark, 4, range(-300, 300, 7)).collect(), *odd], PAGES)
    own = current.where("trim(body) <> ''").select("*", F.expr("file_id - pmod(file_id, 256)").alias("bucket"), text_index.tokens.words(F.col("body")).alias("tokens"))
    plan = text_index.postings_of(own)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    monkeypatch.setattr(inverted, "PORTION", 20)  # buckets in several portions
    rows = [r for b in own.coalesce(1).toArrow().select(["file_id", "location", "bucket", "tokens"]).to_batches() for p in inverted.pages([b]) for r in p.to_pylist()]
    assert len({(r["term"], r["bucket"]) for r in rows}) < len(rows)
    assert all(r["n"] == len(r["entries"]) and r["most"] == max(len(e["positions"]) for e in r["entries"]) and r["shortest"] == min(e["dl"] for e in r["entries"]) for r in rows)
    got = sorted((r["term"], str(e["file_id"]), e["location"], e["dl"], p) for r in rows for e in r["entries"] for p in e["positions"])
    want = sorted((t, str(r["file_id"]), r["location"], len(r["tokens"]), i) for r in own.collect() for i, t in enumerate(r["tokens"]))
    assert got == want and sum(r["occurrences"] for r in rows) == len(want)
    index = TextIndex.create(current, str(tmp_path / "ix"))
    assert index.totals() == (own.count(), len(want))
    ranked = lambda f: sorted((str(r["file_id"]), r["location"], round(r["score"], 9)) for r in f.collect())
    assert ranked(index.rank("beta alpha")) == ranked(fulltext.rank(current, "beta alpha"))


def test_numbers_of_other_widths(spark, tmp_path):
    small = spark.sql("SELECT CAST(id AS INT) AS file_id, 1 AS location, CONCAT('alpha w', id) AS body FROM range(5)")
    assert TextIndex.create(small, str(tmp_path / "ix")).rank("alpha").count() == 5


def test_tiers(spark, tmp_path):
    """Four segments of like size become one; a large one is left as it is."""
    index = TextIndex.create(pages(spark, 9, range(400)), str(tmp_path / "ix"))
    large = next(iter(index.state.segments))
    for k in range(4):
        index.upsert(pages(spark, k, range(1000 + 10 * k, 1010 + 10 * k)))
    index.upsert(None, spark.createDataFrame([(1,), (1005,)], "file_id long"))
    assert index.compact() and large in index.state.segments and len(index.state.segments) == 2
    assert not index.compact()
    whole = spark.createDataFrame(index.pages().select("file_id", "location", "body").collect(), PAGES)
    assert not {1, 1005} & {r["file_id"] for r in whole.collect()}
    same(index, whole)


def test_a_second_writer_fails(spark, tmp_path):
    first = TextIndex.create(pages(spark, 0, range(10)), str(tmp_path / "ix"))
    second = TextIndex(spark, str(tmp_path / "ix"))
    first.upsert(None, spark.createDataFrame([(1,)], "file_id long"))
    with pytest.raises(Raced):
        second.upsert(None, spark.createDataFrame([(2,)], "file_id long"))
    assert {r["file_id"] for r in TextIndex(spark, str(tmp_path / "ix")).pages().collect()} == set(range(10)) - {1}
    with pytest.raises(ValueError):
        TextIndex.create(pages(spark, 0, range(3)), str(tmp_path / "ix"))


def test_empty_index(spark, tmp_path):
    index = TextIndex.create(pages(spark, 0, []), str(tmp_path / "ix"))
    assert index.totals() == (0, 0) and index.rank("alpha").count() == 0 and index.top("alpha").count() == 0
    index.upsert(pages(spark, 1, range(5)))
    assert index.rank("*").count() == index.totals()[0] > 0


def test_best_pages_read_few_blocks(spark, tmp_path):
    """The best pages are those of the full ranking, ties included; buckets that can't hold any of them are not read."""
    rng = random.Random(3)
    rows = []
    for i in range(0, 20_000, 4):
        rare = i // text_index.BUCKET in (3, 40)  # the rare word stands in two buckets
        rows.append((i, 1, " ".join(["common"] * rng.randrange(1, 3) + ["filler"] * rng.randrange(5, 40) + ["rare common"] * rare * rng.randrange(1, 5))))
    frame = spark.createDataFrame(rows, PAGES)
    index = TextIndex.create(frame, str(tmp_path / "ix"))
    for query, limit in (("rare common", 10), ("rare common", 60), ('"rare common"', 10), ("rare AND common", 1), ("ra*e common", 10), ("common", 10), ("+common -rare", 10)):
        want = [(r["file_id"], round(r["score"], 9)) for r in fulltext.top(fulltext.rank(frame, query), limit).collect()]
        assert [(r["file_id"], round(r["score"], 9)) for r in index.top(query, limit).collect()] == want, query
        read, known = index.read
        assert read <= known <= 79 and (query in ("common", "+common -rare") or read <= 16), (query, read, known)


def test_plans_push_terms(spark, tmp_path):
    """Postings are read by equality on terms that the scan is told; no pattern is compared with them."""
    index = TextIndex.create(pages(spark, 0, range(50)), str(tmp_path / "ix"))
    for query in ("al*", "*ta", "g?mma", "alpha beta"):
        plan = index.rank(query)._jdf.queryExecution().executedPlan().toString()
        assert "In(term" in plan or "EqualTo(term" in plan
        assert "rlike" not in plan.lower()
    dictionary = index.matching_terms("^al[\\p{L}\\p{N}]*$")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,al)" in dictionary and "LessThan(term,am)" in dictionary


def test_pattern_bounds():
    assert text_index.pattern_bounds(r"^ab[\p{L}\p{N}]*$") == ("ab", "") and text_index.pattern_bounds(r"^[\p{L}\p{N}]*[\p{L}\p{N}]ab$") == ("", "ab")
    assert text_index.after("ab") == "ac" and text_index.after("a\U0010ffff") == "b" and text_index.after("\U0010ffff") is None and text_index.after("") is None and text_index.after("퟿") == ""


def test_refresh(spark, tmp_path):
    """Files that are new, changed or gone; no contents below an exchange."""
    root = tmp_path / "docs"
    root.mkdir()
    for n, t in {"a.txt": "alpha beta", "b.txt": "beta", "c[1].txt": "gamma"}.items():
        (root / n).write_text(t)
    known = spark.createDataFrame([], "path string, filename string, mtime long, md5 string, file_size long, file_id long")
    index = TextIndex(spark, str(tmp_path / "ix"))
    known = spark.createDataFrame(text_index.refresh(spark, str(root), known, index).collect(), "file_id long, path string, filename string, mtime long, md5 string, file_size long")
    names = lambda q: sorted(r["filename"] for r in index.rank(q).join(known, "file_id").collect())
    assert names("beta") == ["a.txt", "b.txt"] and names("gamma") == ["c[1].txt"]
    (root / "b.txt").write_text("gamma now")
    (root / "a.txt").unlink()
    (root / "d.txt").write_text("delta")
    fulltext.release()
    known = spark.createDataFrame(text_index.refresh(spark, str(root), known, index).collect(), known.schema)
    assert names("beta") == [] and names("gamma") == ["b.txt", "c[1].txt"] and names("delta") == ["d.txt"]
    assert sorted(r["filename"] for r in known.collect()) == ["b.txt", "c[1].txt", "d.txt"]
    before = index.state.version
    text_index.refresh(spark, str(root), known, index)
    assert index.state.version == before  # nothing changed, nothing written


def test_contents_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    disk = page_sources.documents(spark, str(tmp_path))
    own = spark.range(1).select(F.lit("x").alias("path"), F.lit(1).alias("file_id"))
    plan = page_sources.extract(disk.select("path", "content").join(F.broadcast(own.select("path")), "path", "left_semi"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_following_documents(spark, tmp_path):
    """Events of documents keep the index up to date, batch by batch, a restart and a vanished file included."""
    root, names = tmp_path / "docs", "file_id long, path string, filename string, mtime long, md5 string, file_size long"
    (root / "sub").mkdir(parents=True)
    index, tables = TextIndex(spark, str(tmp_path / "ix")), [spark.createDataFrame([], names)]

    def save(files, number):
        tables.append(spark.createDataFrame(files.collect(), names))

    def happen(seq, *events):
        rows = [(100 * seq + i, datetime(2024, 1, 1, seq), f"{root}/{p}", k) for i, (p, k) in enumerate(events)]
        spark.createDataFrame(rows, WATCH_EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        watch.follow_documents(watch.event_stream(spark, f"{tmp_path}/events"), index, lambda: tables[-1], save, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r["filename"] for r in tables[-1].collect())

    found = lambda q: sorted(r["filename"] for r in index.rank(q).join(tables[-1], "file_id").collect())
    for name, text in {"a.txt": "alpha", "sub/b.txt": "beta alpha", "c.bin": "alpha"}.items():
        (root / name).write_text(text)
    assert happen(1, ("a.txt", "added"), ("sub/b.txt", "added"), ("c.bin", "added"), ("gone.txt", "added")) == ["a.txt", "b.txt"]
    assert found("alpha") == ["a.txt", "b.txt"]
    (root / "a.txt").write_text("gamma")
    assert happen(2, ("a.txt", "modified"), ("sub", "removed")) == ["a.txt"]
    assert found("alpha") == [] and found("gamma") == ["a.txt"] and index.totals() == (1, 1)


def test_portions_of_any_batches(spark, tmp_path, monkeypatch):
    """A portion takes rows of several batches and is handed back sorted, in parts; Spark sorts nothing, so that a task needs no more memory than for a portion."""
    monkeypatch.setattr(inverted, "PORTION", 20)
    monkeypatch.setattr(inverted, "HANDED", 3)
    sizes = [3, 0, 5, 12, 1, 25, 2, 2, 30, 30]
    rows = [{"file_id": i, "location": 1, "bucket": i - i % 4, "tokens": [f"w{(i * k) % 7}" for k in range(n)]} for i, n in enumerate(sizes)]
    schema = inverted.pa.schema([("file_id", "int64"), ("location", "int64"), ("bucket", "int64"), ("tokens", inverted.pa.list_(inverted.pa.string()))])
    batches = [inverted.pa.RecordBatch.from_pylist(rows[a:b], schema) for a, b in ((0, 1), (1, 4), (4, 4), (4, 8), (8, 10))]
    assert [b.column("file_id").to_pylist() for b in inverted.portions(batches, "tokens")] == [[0, 1, 2, 3], [4], [5], [6, 7], [8], [9]]
    made = [b for p in inverted.portions(batches, "tokens") for b in inverted.pages([p])]
    assert max(b.num_rows for b in made) <= 3
    got = sorted((r["term"], e["file_id"], p) for b in inverted.pages(batches) for r in b.to_pylist() for e in r["entries"] for p in e["positions"])
    assert got == sorted((t, r["file_id"], i) for r in rows for i, t in enumerate(r["tokens"]))
    for portion in inverted.portions(batches, "tokens"):
        keys = [(r["term"], r["bucket"]) for b in inverted.pages([portion]) for r in b.to_pylist()]
        assert keys == sorted(keys)
    plans = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *c, f=frame.sortWithinPartitions: (plans.append(self.columns), f(self, *c))[1])
    TextIndex.create(pages(spark, 4, range(50)), str(tmp_path / "ix"))
    assert plans and all("entries" not in columns for columns in plans)


def test_buckets_follow_the_pages(spark, tmp_path, monkeypatch):
    """Buckets of postings widen with the pages of an index that is written whole, so that rows don't grow with every few files; upserts keep them, pages keep theirs."""
    assert [text_index.bucket_of(n) for n in (0, 5_000, 33_000, 262_144, 10**9)] == [256, 256, 512, 4096, 4096]
    monkeypatch.setattr(text_index, "SKIPPED", 1)
    current = pages(spark, 2, range(600))
    index = TextIndex.create(current, str(tmp_path / "ix"))
    assert index.state.bucket == 512 and {r[0] for r in index._table("postings", list(index.state.segments), "bucket bigint").select("bucket").distinct().collect()} == {0, 512}
    assert {r[0] for r in index.pages().select("bucket").distinct().collect()} == {0, 256, 512}
    changed = pages(spark, 3, range(500, 900))
    index.upsert(changed)
    index = TextIndex(spark, index.path)
    assert index.state.bucket == 512
    current = spark.createDataFrame(current.where("file_id < 500").collect() + changed.collect(), PAGES)
    same(index, current)
    want = [tuple(r) for r in fulltext.top(fulltext.rank(current, "alpha beta"), 20).select("file_id", "location", F.round("score", 9)).collect()]
    for compacted in (False, True):
        if compacted:
            assert index.compact(whole=True) and index.state.bucket == 1024
        assert [tuple(r) for r in index.top("alpha beta", 20).select("file_id", "location", F.round("score", 9)).collect()] == want
    assert text_index.State(**{"version": 1}).bucket == text_index.BUCKET  # an index of before


def test_joined_words(spark, tmp_path, monkeypatch):
    """An index hands pages to Python as one text each, which gives the postings that lists of words give."""
    texts = ["The cat, the CAT", "  ", "", None, "文档 and 全文搜索x9", "文", "ΣΑΣ été_ß\tİ\n end ", "-- !", "one"]
    table = spark.createDataFrame(list(enumerate(texts)), "file_id bigint, body string").withColumns({"location": F.lit(1).cast("long"), "bucket": F.lit(0).cast("long")})
    made = [
        [r for b in inverted.pages(iter(table.withColumn("tokens", how(F.col("body"))).coalesce(1).toArrow().to_batches())) for r in b.to_pylist()]
        for how in (text_index.tokens.words, text_index.tokens.joined)
    ]
    assert made[0] == made[1] and {"文档", "搜索", "x9"} <= {r["term"] for r in made[1]}
    kinds, real = [], text_index.postings_of
    monkeypatch.setattr(text_index, "postings_of", lambda paged: (kinds.append(paged.schema["tokens"].dataType.typeName()), real(paged))[1])
    index = text_index.TextIndex.create(table.drop("bucket"), str(tmp_path / "joined"))
    assert kinds == ["string"] and [r["file_id"] for r in index.rank("搜索").collect()] == [4]
