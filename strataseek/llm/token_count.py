"""Token counts by a compiled finite-state transducer (operator 6).

The vocabulary and merge scores of a piece model are compiled into a deterministic
transducer over characters. After reading a prefix, what later tokens depend on is
finite: for every suffix that begins some piece, the trie node it has reached, the
last token before it and the difference of token counts. Those triples are a state;
a transition reads a character and emits the change of the prefix's token count, so
the sum of the emissions is the number of tokens. States and transitions are built
when first met and kept.

A word mark after another character is a synchronising symbol (no piece runs
across it): every state goes to the start state. Words between such marks are
therefore composed transitions of their own and are memoised. A chunk of text is
the map "state before -> (tokens, state after)" over the states it may be met in; maps compose
associatively (``Span.then``), without the text, and long texts are counted by a pairwise scan over their chunks.
The states kept grow with what has been read and are forgotten between texts beyond a bound.

Null and empty texts have no tokens. Repeated rows count alike, each its own. Only the id and text are read, whatever other
columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataseek.llm.common import Memo, map_batches, texts

MARK = "▁"
#: Characters of a text that are counted as one chunk.
CHUNK = 1 << 16
#: Characters before a chunk that its state before is guessed from; a wrong guess is put right.
LOOK = 48


class Transducer:
    """A piece model with byte fallback, compiled state by state."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece runs across a word mark; this compilation needs marks to synchronise")
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: dict[int, str] = {}
        for piece in self.score:
            node = 0
            for c in piece:
                node = self.trie[node].setdefault(c, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
            self.piece_at[node] = piece
        self.reachable = Memo(lambda piece: self.merge(piece) == [piece])
        self.compatible = Memo(lambda pair: self.merge(pair[0] + pair[1]) == list(pair), 1_000_000)
        self._forget()
        self.after_mark = Memo(lambda word: self.run(0, MARK + word)[1])
        self.bare = Memo(lambda word: self.run(0, word)[1])

    def _forget(self) -> None:
        self.states = [((0, "", 0),)]
        self.ids = {self.states[0]: 0}
        self.step: dict[tuple[int, str], tuple[int, int]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merges, best score and leftmost first; for the short strings that compilation asks about."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition of ``state`` on ``c``: next state, emitted tokens."""
        if c not in self.trie[0]:  # bytes of its own; nothing merges across it
            return 0, len(c.encode())
        suffixes, last, emitted = [], None, 0
        for node, before, behind in self.states[state]:
            child = self.trie[node].get(c)
            if child is None:
                continue
            piece = self.piece_at.get(child)
            if piece is not None and last is None and self.reachable[piece] and (not before or self.compatible[before, piece]):
                last, emitted = piece, behind + 1
            if self.trie[child]:
                suffixes.append((child, before, behind))
        if last is None:
            raise AssertionError("no token ends here")
        key = (*((n, b, d - emitted) for n, b, d in suffixes), (0, last, 0))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key], emitted

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State after ``text`` and the tokens emitted."""
        total, step = 0, self.step
        previous = ""
        for c in text:
            if c == MARK and previous not in ("", MARK):
                state = 0
            move = step.get((state, c))
            if move is None:
                move = step[state, c] = self._compile(state, c)
            state = move[0]
            total += move[1]
            previous = c
        return state, total

    _runs = re.compile(f"{MARK}*[^{MARK}]*").findall

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(self.step) > 1_500_000:
            self._forget()
        text = MARK + text.replace(" ", MARK)
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        before = ["", *(c[-1] for c in chunks)]
        # a chunk's likely state before: that after the end of the chunk before it, read from the start state
        spans = [Span.of(self, c, {0 if not k else self.run(0, chunks[k - 1][-LOOK:])[0]}, before[k]) for k, c in enumerate(chunks)]
        state = 0
        for k, c in enumerate(chunks):
            if state not in spans[k].moves:
                spans[k].moves |= Span.of(self, c, {state}, before[k]).moves
            state = spans[k].moves[state][1]
        while len(spans) > 1:
            spans = [a.then(b[0]) if b else a for a, *b in (spans[i : i + 2] for i in range(0, len(spans), 2))]
        return spans[0].moves[0][0]

    def words(self, text: str) -> int:
        """Tokens of a text that starts at the start state and ends before a synchronising mark."""
        total = 0
        lines = text.split("\n")
        for line in lines:
            first, *rest = line.split(MARK)
            if first:
                total += self.bare[first] if len(first) < 64 else self.run(0, first)[1]
            if rest:
                if "" in rest:
                    total += sum(self.run(0, run)[1] for run in self._runs(line[len(first) :]) if run)
                else:
                    lookup = self.after_mark
                    total += sum([lookup[w] if len(w) < 64 else self.run(0, MARK + w)[1] for w in rest])
        return total + len(lines) - 1  # each line feed is a byte token


class Span:
    """A chunk's map: state before -> (tokens, state after), over the states it may be met in."""

    __slots__ = ("moves",)

    def __init__(self, moves: dict[int, tuple[int, int]]):
        self.moves = moves

    _first = re.compile(f"[^{MARK}]{MARK}").search

    @classmethod
    def of(cls, machine: Transducer, text: str, states: set[int], before: str = "") -> Span:
        """The map over ``states`` of a text that follows the character ``before``. All states become one at the first synchronising mark."""
        if before not in ("", MARK) and text.startswith(MARK):
            cut = 0
        elif found := cls._first(text):
            cut = found.start() + 1
        else:
            return cls({s: machine.run(s, text)[::-1] for s in states})
        end = len(text.rstrip(MARK)) if text.endswith(MARK) else text.rfind(MARK)
        while end > cut and text[end - 1] == MARK:
            end -= 1
        end = max(end, cut)
        after, tail = machine.run(0, text[end:])
        inner = machine.words(text[cut:end]) if end > cut else 0
        return cls({s: (machine.run(s, text[:cut])[1] + inner + tail, after) for s in states})

    def then(self, other: Span) -> Span:
        """The map of this chunk followed by ``other``: of what ``other`` knows, nothing but the map is needed."""
        return Span({s: (n + other.moves[e][0], other.moves[e][1]) for s, (n, e) in self.moves.items() if e in other.moves})


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """One transducer a worker process, so that what one task compiles serves the next."""
    return Transducer(path)


def token_counts(df: DataFrame, path: str, limit: int, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text, beside the ``keep`` columns."""

    def make():
        machine = load(path)

        def fn(batch):
            rows = texts(batch, text_col)
            tokens = [machine.count(t) for t in rows]
            return [[len(t.encode()) for t in rows], tokens, [n > limit for n in tokens]]

        return fn

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), make, fields, keep)
