"""Byte-level BPE encoding and decoding (operator 8).

A piece's bytes are read as Latin-1 text so that one ``pyahocorasick`` automaton
finds every vocabulary token in it. Encoding walks left to right, takes the
longest token that is compatible with the token before it, and steps back when a
position is a dead end; each position is declared dead at most once, so the work
is linear in the piece. Two adjacent tokens are compatible when merging their
joined bytes by rank gives the same two tokens back; these answers are memoised.
A sequence whose neighbours are all compatible is the one the merges produce.

Null text counts as empty and gives no ids. Empty tables give empty tables.
Repeated rows are encoded alike. Columns other than the id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataseek.llm.common import Memo, map_batches, remembered, texts


#: Words that a worker process remembers, where a caller names no number.
MEMO = 400_000


class ByteBPE:
    """The merges of a rank file, by longest match and backtracking. ``memo``: words whose ids are remembered, some 500 bytes each with their parts."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.length = {i: len(b) for b, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.split = regex.compile(pattern).findall
        self.compatible = Memo(self._compatible, memo * 5 // 4)
        self.piece_ids = Memo(lambda piece: tuple(self.encode_piece(piece.encode())), memo // 2)
        self.segment_ids = Memo(self._segment, memo)

    def merge(self, data: bytes) -> list[int]:
        """Plain merges by rank, lowest and leftmost first; quadratic, for short input."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        starting: list[list[int]] = [[] for _ in range(n)]  # tokens by start, short to long
        for last, token in self.automaton.iter(data.decode("latin-1")):
            starting[last + 1 - self.length[token]].append(token)
        dead = bytearray(n + 1)
        ids: list[int] = []
        untried: list[int] = [len(starting[0])]  # for each open position, how many tokens are left to try
        at = 0
        while at < n:
            tokens, k = starting[at], untried[-1]
            before = ids[-1] if ids else None
            while k:
                k -= 1
                token = tokens[k]
                end = at + self.length[token]
                if not dead[end] and (before is None or self.compatible[before, token]):
                    untried[-1] = k
                    ids.append(token)
                    at = end
                    untried.append(len(starting[at]) if at < n else 0)
                    break
            else:
                dead[at] = 1
                untried.pop()
                at -= self.length[ids.pop()]
        return ids

    def _segment(self, segment: str) -> tuple[int, ...]:
        pieces = self.split(segment)
        if len(pieces) == 1:  # remembered as a segment already
            return tuple(self.encode_piece(pieces[0].encode()))
        lookup = self.piece_ids
        return tuple(chain.from_iterable([lookup[p] if len(p) < 64 else self.encode_piece(p.encode()) for p in pieces]))

    _inner = regex.compile(r"\s\s").search
    _cuts = regex.compile(r"(?<=\S)(?= \S)").split

    def encode(self, text: str) -> list[int]:
        """The ids of a text.

        A match of the pattern never runs across a single space between two
        non-spaces, so the text is cut there and the segments are memoised.
        """
        if not text:
            return []
        segments = self._cuts(text) if self._inner(text) else self._plain(text)
        lookup = self.segment_ids
        return list(chain.from_iterable([lookup[s] if len(s) < 64 else self._segment(s) for s in segments]))

    @staticmethod
    def _plain(text: str) -> list[str]:
        """Cuts of a text that has no two white-space characters in a row."""
        first, *rest = text.split(" ")
        if rest and not first:  # a leading space belongs to the word after it
            first, *rest = [" " + rest[0], *rest[1:]]
        out = [first, *[" " + w for w in rest]]
        return out if out[0] else out[1:]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load(path: str, pattern: str, memo: int = MEMO) -> ByteBPE:
    """One codec a worker process; tasks that follow reuse its memo, until another operator's come."""
    return remembered((ByteBPE, path, pattern, memo), lambda: ByteBPE(path, pattern, memo))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids array<int>`` of the whole text to the ``keep`` columns (all but the text)."""

    def make():
        codec = load(path, pattern)
        return lambda batch: [[codec.encode(t) for t in texts(batch, text_col)]]

    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), make, [("ids", T.ArrayType(T.IntegerType()))], keep, remembers=True)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append ``decoded binary``, the bytes of ``ids_col`` (null ids: no bytes)."""

    def make():
        codec = load(path, pattern)
        return lambda batch: [[codec.decode(ids or []) for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]]

    keep = [c for c in df.columns if c != ids_col] if keep is None else keep
    return map_batches(df.select(*dict.fromkeys([*keep, ids_col])), make, [("decoded", T.BinaryType())], keep, remembers=True)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] = ("doc_id",), with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, digests of the ids and of the decoded bytes, and the ids if asked.

    A worker that serves other operators too should get a smaller ``memo``: it is kept between tasks.
    """
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def make():
        codec = load(path, pattern, memo)
        shown = {i: str(i) for i in codec.bytes_of}.__getitem__

        def fn(batch):
            rows = [codec.encode(t) for t in texts(batch, text_col)]
            out = [
                [len(r) for r in rows],
                [hashlib.sha256(" ".join(map(shown, r)).encode()).hexdigest() for r in rows],
                [hashlib.sha256(codec.decode(r)).hexdigest() for r in rows],
            ]
            return out + [rows] * with_ids

        return fn

    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), make, fields, keep, remembers=True)
