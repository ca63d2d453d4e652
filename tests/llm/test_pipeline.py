"""The pipeline against its stages' brute force on the small tables."""

import hashlib

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from strataseek.llm import bpe, common, decontaminate, pii, quality_rules, queries
from tests.llm.test_joins import brute_components
from tests.llm.test_row_operators import brute_base


def test_pipeline(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    kept = {r["doc_id"] for r in quality_rules.judge(documents).where("kept").collect()}
    texts = {d: t for d, t in rows.items() if d in kept}
    texts = {d: texts[d] for d, (_, c) in brute_components(list(texts.items()), 5, 80).items() if c == d}  # the stage's setting: five words, 0.8
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = decontaminate.Index(bench).search(list(texts.values()))
    texts = {d: t for (d, t), hits in zip(texts.items(), leaks, strict=True) if not hits}
    assert not any(item in t for t in texts.values() for _, item in bench)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(texts) and 0 < len(got) < len(rows)
    codec = bpe.load(queries.BYTE_BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for d, t in texts.items():
        red = pii.redacted(t, pii.find(t))
        assert not [x for x in brute_base(red) if x[1] != 2]
        assert got[d]["ids"] == library.encode_ordinary(red)
        assert got[d]["decoded_sha256"] == hashlib.sha256(red.encode()).hexdigest()


def test_stages(spark, sf, awkward):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, awkward, sf).columns == awkward.columns, name
        assert stage(spark, docs.limit(0), sf).isEmpty(), name


def test_near_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {d for d, (_, c) in found.items() if d == c}


def test_workers_hold_little(spark, sf):
    """Stages get Arrow batches of few rows, and a worker lets go of the tokeniser's memos before another operator's work."""
    documents = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        counted = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "doc_id", pa.array([b.num_rows])) for b in batches), docs.schema))
        assert max(r["doc_id"] for r in counted(spark, documents, sf).collect()) == corpus_pipeline.BATCH
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    codec = bpe.load(queries.BYTE_BPE, public_tokenizers.PATTERN)
    assert bpe.load(queries.BYTE_BPE, public_tokenizers.PATTERN) is codec
    assert bpe.encode(documents, queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 5000
    held = common.map_batches(documents, lambda: lambda batch: [[len(common._remembered)] * batch.num_rows], [("held", T.LongType())], [])
    assert held.groupBy("held").count().collect() == [(0, 5000)]
    common.forget()
    assert bpe.load(queries.BYTE_BPE, public_tokenizers.PATTERN) is not codec
