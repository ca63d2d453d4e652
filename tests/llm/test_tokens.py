"""Byte-level BPE and token counts against the libraries that define them."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from strataseek.llm import bpe, queries, token_count

PARTS = [" ", "  ", "\n", "a", "b", "the", " ing", "'s", "'re", "1", "é", "日", "\t", "　", "\xa0", "\U0001f600", "ß", "-", "--", "!", "▁", "<s>", "\x00", "\r\n", "A" * 9, " " * 17, "thing", " Of"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, " " * 300, "ab" * 2000, "é" * 70_000 + " x", "foo  bar\n" * 9000]


@pytest.fixture(scope="module")
def codec():
    return bpe.load(queries.BYTE_BPE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)


def test_merges_are_exact(codec, library, texts):
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_backtracking_equals_plain_merges(codec):
    rng = random.Random(1)
    for _ in range(500):
        data = bytes(rng.choices(b"aeiournst\xc3\xa9 ", k=rng.randint(1, 24)))
        assert codec.encode_piece(data) == codec.merge(data) or data in codec.ranks


def test_counts(pieces, texts):
    machine = token_count.load(queries.PIECE_BPE)
    for t in texts:
        assert machine.count(t) == len(pieces.encode(t))


@pytest.mark.parametrize("size", [1, 2, 7])
def test_chunks_compose(pieces, texts, monkeypatch, size):
    monkeypatch.setattr(token_count, "CHUNK", size)
    machine = token_count.load(queries.PIECE_BPE)
    for t in texts[:400]:
        assert machine.count(t) == len(pieces.encode(t))


def test_maps_compose_without_text(pieces, texts):
    """Chunks over several states before, composed in either order from their maps alone."""
    machine = token_count.load(queries.PIECE_BPE)
    rng = random.Random(2)
    for t in texts[:300]:
        t = "▁" + t.replace(" ", "▁")
        a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
        parts, before, states, spans = (t[:a], t[a:b], t[b:]), "", {0, *(machine.run(0, s)[0] for s in ("▁th", "é", "a", "--"))}, []
        for p in parts:
            spans.append(token_count.Span.of(machine, p, states, before))
            states = {e for _, e in spans[-1].moves.values()}
            before = p[-1:] or before
        x, y, z = spans
        left, right = x.then(y).then(z).moves, x.then(y.then(z)).moves
        assert left == right and set(left) == set(x.moves)
        assert left[0][0] == (len(pieces.encode(t[1:].replace("▁", " "))) if t != "▁" else left[0][0])


def test_states_are_forgotten_safely(pieces, texts):
    machine = token_count.Transducer(queries.PIECE_BPE)
    for t in texts[:100]:
        machine._forget()
        machine.bare.clear()
        machine.after_mark.clear()
        assert machine.count(t) == len(pieces.encode(t))


def test_tables(spark, awkward, library, pieces):
    rows = bpe.round_trip(awkward, queries.BYTE_BPE, public_tokenizers.PATTERN, with_ids=True).collect()
    counts = token_count.token_counts(awkward, queries.PIECE_BPE, 4096).collect()
    source = awkward.collect()
    assert len(rows) == len(counts) == len(source)
    for s, r, c in zip(source, rows, counts, strict=True):
        ids = library.encode_ordinary(s["text"] or "")
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (s["doc_id"], len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((s["text"] or "").encode()).hexdigest()
        n = len(pieces.encode(s["text"] or ""))
        assert (c["n_bytes"], c["n_tokens"], c["over_limit"]) == (len((s["text"] or "").encode()), n, n > 4096)
    assert bpe.round_trip(awkward.limit(0), queries.BYTE_BPE, public_tokenizers.PATTERN).isEmpty()
    assert token_count.token_counts(awkward.limit(0), queries.PIECE_BPE, 4096).isEmpty()


def test_encode_then_decode(awkward):
    ids = bpe.encode(awkward.select("doc_id", "text"), queries.BYTE_BPE, public_tokenizers.PATTERN, keep=["doc_id", "text"])
    back = bpe.decode(ids, queries.BYTE_BPE, public_tokenizers.PATTERN)
    assert back.where(~F.coalesce(F.col("text"), F.lit("")).cast("binary").eqNullSafe(F.col("decoded"))).isEmpty()
