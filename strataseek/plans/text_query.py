"""The full-text query language: words, "phrases", wildcards, AND, OR, NOT, + and -, parentheses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_TOKEN = re.compile(r'\s*(?:(?P<mark>[()])|(?P<sign>[+-])(?=\S)|"(?P<phrase>[^"]*)"?|(?P<word>[^\s()"]+))')


@dataclass(frozen=True)
class Leaf:
    """A word, phrase or wildcard: the terms to find side by side."""

    terms: tuple[str, ...]
    pattern: str | None = None


@dataclass(frozen=True)
class Node:
    """``must`` all, ``must_not`` any, and if there is nothing that must, at least one of ``should``."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


class TextQuery:
    """Reads a query. Words that stand side by side are alternatives; AND binds closer than OR."""

    def __init__(self, text: str, tokenize: Callable[[str], list[str]], plain: bool = False):
        """``plain`` takes AND, OR and NOT for ordinary words, in any case."""
        self.tokenize, self.plain = tokenize, plain
        self.items = [m for m in _TOKEN.finditer(text) if m.group().strip()]
        self.at = 0
        self.root = self._either()

    def _peek(self) -> tuple[str, str] | None:
        if self.at >= len(self.items):
            return None
        m = self.items[self.at]
        kind = m.lastgroup
        value = m[kind]
        if kind == "word" and value in ("AND", "OR", "NOT") and not self.plain:
            kind = "operator"
        return kind, value

    def _take(self) -> tuple[str, str]:
        item = self._peek()
        self.at += 1
        return item

    def _either(self) -> Node:
        must, should, must_not = [], [], []
        while (item := self._peek()) and item != ("mark", ")"):
            if item == ("operator", "OR"):
                self._take()
                continue
            if item[0] == "sign":
                self._take()
                part = self._unit()
                if part is not None:
                    (must if item[1] == "+" else must_not).append(part)
                continue
            chain = [self._negatable()]
            while self._peek() == ("operator", "AND"):
                self._take()
                chain.append(self._negatable())
            chain = [c for c in chain if c is not None]
            if len(chain) == 1:
                part, negated = chain[0]
                (must_not if negated else should).append(part)
            elif chain:
                should.append(Node(must=tuple(p for p, n in chain if not n), must_not=tuple(p for p, n in chain if n)))
        return Node(tuple(must), tuple(should), tuple(must_not))

    def _negatable(self) -> tuple[object, bool] | None:
        negated = False
        while self._peek() == ("operator", "NOT"):
            self._take()
            negated = not negated
        part = self._unit()
        return None if part is None else (part, negated)

    def _unit(self) -> Leaf | Node | None:
        if self._peek() is None or self._peek()[0] == "operator":
            return None
        kind, value = self._take()
        if (kind, value) == ("mark", "("):
            inner = self._either()
            if self._peek() == ("mark", ")"):
                self._take()
            return inner
        if kind in ("mark", "sign"):
            return None
        if kind == "word" and ("*" in value or "?" in value):
            body = "".join({"*": r"[\p{L}\p{N}]*", "?": r"[\p{L}\p{N}]"}.get(c) or (c if c.isalnum() else "") for c in value.lower())
            return Leaf((), f"^{body}$")
        terms = tuple(self.tokenize(value))
        if len(terms) == 1 and len(value) == 1 and "㐀" <= value <= "﫿":
            return Leaf((), value)  # pages hold pairs of such characters
        return Leaf(terms) if terms else None

    def leaves(self) -> list[Leaf]:
        """All leaves, in order, each once."""
        out: list[Leaf] = []

        def walk(x) -> None:
            if isinstance(x, Leaf):
                out.append(x)
            else:
                for part in (*x.must, *x.should, *x.must_not):
                    walk(part)

        walk(self.root)
        return list(dict.fromkeys(out))
