"""Benchmark decontamination (operator 2).

A document is contaminated by a benchmark item if a run of its words is within a
fifth of the item's length in word edits (similarity 0.8). Words are compared in lower
case (A-Z) without punctuation at their ends.

- An item is cut into segments of up to ``SEGMENT`` words and a half: if the item is near, so is one
  of them, so the embedding never has to follow a long run of edits.
- A window as long as the segment is looked at where a document shares a seed with it.
  Of a segment with e edits allowed, e + 1 seeds of three words that don't overlap are chosen,
  those that the fewest items hold. This loses nothing, as e edits leave one of them whole,
  and passages that many items share place windows only where a segment has nothing else.
- The CGK random walk embeds window and segment: at step j it writes the word it
  stands on and moves on if a random bit of (word, j) is set, so few edits become
  few differing places.
- Bit sampling: a repetition reads ``SAMPLES`` places of the embedding; window and
  segment meet if all agree. ``REPETITIONS`` independent walks reach the wanted recall. A window
  is embedded once for all segments of its length, however many there are.
- Items whose segments meet are verified by exact edit distance, with the best run of
  words around the window. Items of fewer than ``MIN_WORDS`` words, which allow one edit or none, are
  verified wherever a seed (of one to three words) is shared.

The index of the benchmark has a checked size; a larger benchmark is taken in
blocks, one after another, each against all documents. Null and empty texts hold no words, on
either side; a repeated row gets its own results, and so does an item that the benchmark repeats. Empty
tables give no rows, or leave the documents as they are. A very long text is searched whole, by itself: batches are
bounded by the bytes of their texts. Columns other than the id and text are not read, whatever their names. Of several runs at the same distance the first counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strataseek.llm.common import forget, portions, texts, written

SIMILARITY = 0.8
#: Words of a seed, at most; words from which on an item goes through the embedding; words of a segment.
GRAM, MIN_WORDS, SEGMENT = 3, 6, 30
REPETITIONS, SAMPLES, SEED = 16, 2, 11
#: Text bytes of the benchmark that one index may hold.
MAX_INDEX_BYTES = 8 << 20
#: Rows whose words a task holds at once.
HELD, HELD_BYTES = 1024, 2 << 20
#: Bits of the table that says where a word run may be a seed.
FILTER_BITS = 21

_ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_PAD = np.uint64(0x27D4EB2F165667C5)


def words_of(text: str) -> list[bytes]:
    return [w.strip(_ENDS) for w in text.encode().lower().split()]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def grams(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * _MIX[0] + codes[i : i + n] * _MIX[1]
    return out ^ (out >> np.uint64(29))


def allowed(n_words: int) -> int:
    """Edits that leave the similarity at SIMILARITY."""
    return int((1 - SIMILARITY) * n_words + 1e-9)


def embedded(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The words that a CGK walk over each window writes at its sampled places (places: windows by SAMPLES), as one key a window."""
    at = np.zeros(len(starts), np.int64)
    key = np.zeros(len(starts), np.uint64)
    last = len(codes) - 1
    for j in range(int(places.max(initial=-1)) + 1):
        word = np.where(at < lengths, codes[np.minimum(starts + at, last)], _PAD)
        for k in range(places.shape[1]):
            here = places[:, k] == j
            if here.any():
                key[here] += (word[here] ^ (word[here] >> np.uint64(29))) * _MIX[k]
        at += (((word ^ moves[j]) * _MIX[0]) >> np.uint64(63)).astype(np.int64)
    return key


def edit_distance_within(item: list[bytes], region: list[bytes]) -> tuple[int, int]:
    """Least word edits between the item and any run of the region, and the run's end; bit-parallel, exact."""
    m = len(item)
    masks: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(region):
        eq = masks.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & full, (left << 1) & full
        up = left | (full & ~(diagonal | right))
        down = right & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def segments(n: int) -> list[tuple[int, int]]:
    """Start and length of the segments of ``n`` words: of nearly equal length."""
    parts = max(1, round(n / SEGMENT))
    edges = [i * n // parts for i in range(parts + 1)]
    return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]


def seeds(held: list[int], count: int, size: int) -> list[int]:
    """Starts of ``count`` runs of ``size`` words that don't overlap, so that the sum of ``held`` at them is least."""
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] * (len(held) + size)  # of the words up to each place
    for _ in range(count):
        new: list[tuple[int, tuple[int, ...]] | None] = [None] * len(best)
        for end in range(size, len(best)):
            new[end] = new[end - 1]
            before = best[end - size]
            if before is not None and (new[end] is None or before[0] + held[end - size] < new[end][0]):
                new[end] = (before[0] + held[end - size], (*before[1], end - size))
        best = new
    return list(best[-1][1])


class Index:
    """A block of the benchmark: seeds that place windows, and the sampled embeddings of its segments."""

    def __init__(self, items: list[tuple[int, str]]):
        found = [(i, w) for i, w in ((i, words_of(t or "")) for i, t in items) if w]
        self.ids = [i for i, _ in found]
        self.words = [w for _, w in found]
        parts = [(item, at, n) for item, w in enumerate(self.words) for at, n in segments(len(w))]
        self.item, self.offset, lengths = (np.array([p[k] for p in parts], np.int64) for k in range(3))
        rng = np.random.default_rng(SEED)
        self.moves = rng.integers(0, 1 << 63, (REPETITIONS, 2 * int(lengths.max(initial=1))), dtype=np.uint64)
        self.fractions = rng.random((REPETITIONS, SAMPLES))
        codes = [hashes(w) for w in self.words]
        held = Counter(g for c in codes for g in np.unique(grams(c)).tolist())
        rows: dict[int, set[tuple[int, int, int, int]]] = {k: set() for k in range(1, GRAM + 1)}
        for part, (item, at, n) in enumerate(parts):
            count = allowed(n) + 1
            size = min(GRAM, n // count)
            runs = grams(codes[item][at : at + n], size).tolist()
            starts = seeds([held[g] for g in runs], count, size) if size == GRAM else [k * size for k in range(count)]
            # segments that the embedding finds need no name: a window serves all of its length
            rows[size] |= {(runs[o], o, n, -1 if len(self.words[item]) >= MIN_WORDS else part) for o in starts}
        self.tables = []
        for size, found_rows in rows.items():
            if found_rows:
                listed = sorted(found_rows)
                gram = np.array([r[0] for r in listed], np.uint64)
                known = np.zeros(1 << FILTER_BITS, bool)
                known[gram >> np.uint64(64 - FILTER_BITS)] = True
                self.tables.append((size, gram, np.array([r[1:] for r in listed], np.int64), known))
        flat = np.concatenate([np.empty(0, np.uint64), *codes])
        first = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)[self.item] + self.offset if parts else np.empty(0, np.int64)
        self.keys = [defaultdict(list) for _ in range(REPETITIONS)]  # (length, key) -> segments
        for r in range(REPETITIONS if parts else 0):
            for part, key in enumerate(embedded(flat, first, lengths, self.places(r, lengths), self.moves[r])):
                self.keys[r][int(lengths[part]), int(key)].append(part)
        self.key_sets = [np.unique(np.array([k for _, k in t], np.uint64)) for t in self.keys]

    def places(self, r: int, lengths: np.ndarray) -> np.ndarray:
        """Sampled steps of repetition r; a walk needs about two steps a word."""
        return (self.fractions[r][None, :] * 2 * lengths[:, None]).astype(np.int64)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Start, length and segment (or -1) of the windows to look at: a run of words at p that is a segment's seed at o puts one at p - o."""
        out = [np.empty((0, 3), np.int64)]
        for size, gram, rows, known in self.tables:
            runs = grams(codes, size)
            at = np.flatnonzero(known[runs >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(gram, runs[at], "left"), np.searchsorted(gram, runs[at], "right")
            n = high - low
            if n.sum():
                which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
                found = rows[which]
                out.append(np.stack([np.repeat(at, n) - found[:, 0], found[:, 1], found[:, 2]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def search(self, documents: list[str]) -> list[list[tuple[int, int, int, int, float]]]:
        """For each text its (item id, distance, first word, words, similarity), best run of each item."""
        words = [words_of(t) for t in documents]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        codes = hashes([w for ws in words for w in ws])
        out: list[list] = [[] for _ in documents]
        starts, lengths, part = self.windows(codes).T
        if not len(starts):
            return out
        # the run that placed a window lies in one document; a window that leaves it is cut off there
        middle = np.clip(starts + lengths // 2, 0, len(codes) - 1)
        owner = np.searchsorted(ends, middle, "right")
        first = np.maximum(starts, ends[owner] - sizes[owner])
        span = np.minimum(starts + lengths, ends[owner]) - first
        able = span >= lengths - np.array([allowed(n) for n in range(int(lengths.max()) + 1)])[lengths]
        starts, lengths, part, owner, first, span = (x[able] for x in (starts, lengths, part, owner, first, span))
        met: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in np.flatnonzero(part >= 0).tolist():
            met[int(owner[i]), int(self.item[part[i]])].add(int(starts[i]))
        many = part < 0
        starts, lengths, owner, first, span = (x[many] for x in (starts, lengths, owner, first, span))
        for r in range(REPETITIONS if len(starts) else 0):
            keys = embedded(codes, first, span, self.places(r, lengths), self.moves[r])
            for i in np.flatnonzero(np.isin(keys, self.key_sets[r])).tolist():
                for p in self.keys[r].get((int(lengths[i]), int(keys[i])), ()):
                    met[int(owner[i]), int(self.item[p])].add(int(starts[i] - self.offset[p]))
        for (d, item), places in met.items():
            if best := self.verified(words[d], item, sorted(p - int(ends[d] - sizes[d]) for p in places)):
                out[d].append((self.ids[item], *best, 1 - best[0] / len(self.words[item])))
        return [sorted(x, key=lambda hit: (hit[0] is None, hit)) for x in out]

    def verified(self, words: list[bytes], item: int, places: list[int]) -> tuple[int, int, int] | None:
        """The nearest run of words around any of the windows, if it is near enough."""
        target, size, slack = self.words[item], len(self.words[item]), allowed(len(self.words[item]))
        best = None
        i = 0
        while i < len(places):
            low = high = places[i]
            while i < len(places) and places[i] <= high + slack:
                high = places[i]
                i += 1
            a, b = max(0, low - 2 * slack), min(len(words), high + size + 2 * slack)
            near = set(words[a:b])
            if sum(w not in near for w in target) > slack:  # an edit for each at least
                continue
            distance, end = edit_distance_within(target, words[a:b])
            if distance <= slack and (best is None or distance < best[0]):
                _, back = edit_distance_within(target[::-1], words[a : a + end][::-1])
                best = (distance, a + end - back, back)
        return best


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> Iterator[tuple[bool, Index]]:
    """Indexes of the benchmark's blocks, each of about ``max_bytes`` of text (one item at least), made when asked for; and whether it is the last."""
    size = benchmark.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    n = max(1, -(-size // max_bytes))
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == b).select(id_col, text_col).collect()
        yield b == n - 1, Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """A row for each document and item found in it: ``id_col``, item_id, distance, start_word, n_words, similarity. Clean documents have none.

    The results of all blocks but the last are written, so that one index at a time is held and sent.
    """
    schema = T.StructType([documents.schema[id_col], T.StructField("item_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("distance", "start_word", "n_words")), T.StructField("similarity", T.DoubleType())])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def found_by(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in (p for b in batches for p in portions(b, HELD, HELD_BYTES)):
                ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
                found = index.search(texts(batch, text_col))
                rows = [(d, *hit) for d, hits in zip(ids, found, strict=True) for hit in hits]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return documents.select(id_col, text_col).mapInArrow(run, schema)

    parts = [found_by(index) if last else written(found_by(index), "matches") for last, index in blocks(benchmark, max_bytes=max_bytes)]
    return reduce(DataFrame.unionByName, parts)


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, with their own columns; written after each block but the last."""

    def clean(documents: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in (p for b in batches for p in portions(b, HELD, HELD_BYTES)):
                found = index.search(texts(batch, text_col))
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        return documents.mapInArrow(run, documents.schema)

    for last, index in blocks(benchmark, max_bytes=max_bytes):
        documents = clean(documents, index)
        if not last:
            documents = written(documents, "clean")
    return documents
