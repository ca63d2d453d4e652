"""Personal data in texts (operator 3).

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97
for account numbers, ranges for addresses, digit counts for phones), and words near
a span raise its score. The base spans of the contract always stay; the method adds

- cards and phones inside a base match that failed as a whole, because a neighbouring
  number ran into it (``+1 (826) 555-4081 190.137.223.20``),
- account numbers (kind ``iban``) that pass mod 97,
- numbers written as ddd-dd-dddd (kind ``ssn``) where a context word stands near.

Offsets are code points, the end exclusive. Null text counts as empty (and stays null when redacted). Searching
is linear in the text, however long: patterns are anchored so that no run is scanned twice. Repeated rows are treated alike, each
its own. Columns of other names are not read; an input column named like a result gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataseek.llm.common import map_batches, texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

#: Characters on either side of a span in which context words count, and what one adds to a score.
NEAR, CONTEXT = 40, 0.3
#: An added span needs this score; base spans stay whatever theirs is.
ADDED_SCORE = 0.5
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
_context = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.IGNORECASE).search for k, v in WORDS.items()}

_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])").search
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])").finditer
_word = re.compile(r"[^ ]+").finditer
_digit = re.compile(r"[0-9]").search


class Span(NamedTuple):
    start: int
    order: int
    end: int
    score: float
    base: bool

    @property
    def kind(self) -> str:
        return KINDS[self.order]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether a string of ASCII digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces passes the mod-97 check."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: each @ is tried once, from the left edge of the run before it."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        found = _domain(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def card_ok(s: str) -> bool:
    number = digits(s)
    return 12 <= len(number) <= 19 and luhn(number)


def inner_cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Cards among the space-separated parts of a failed match: a part of 13 to 19 digits, or four parts of four."""
    parts = [(start + m.start(), start + m.end()) for m in _word(text[start:end])]
    out, i = [], 0
    while i < len(parts):
        a, b = parts[i]
        if 13 <= len(digits(text[a:b])) <= 19 and luhn(digits(text[a:b])):
            out.append((a, b))
        elif i + 3 < len(parts) and all(y - x == 4 for x, y in parts[i : i + 4]) and luhn(digits(text[a : parts[i + 3][1]])):
            out.append((a, parts[i + 3][1]))
            i += 3
        i += 1
    return out


def inner_phone(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The longest beginning of a failed match that ends before a space and has 9 to 15 digits."""
    best, n = None, 0
    for part in _word(text[start:end]):
        n += len(digits(part.group()))
        if n > 15:
            break
        if n >= 9 and "0" <= part.group()[-1] <= "9":
            best = (start, start + part.end())
    return best


def accounts(text: str) -> list[tuple[int, int]]:
    """Account numbers: of each match the longest beginning, whole or up to a space, that passes mod 97."""
    out, at = [], 0
    while m := _iban(text, at):
        start, end = m.span()
        at = start + 1
        while len(account := text[start:end].replace(" ", "")) >= 15:
            if mod97(account):
                out.append((start, end))
                at = end
                break
            end = text.rfind(" ", start, end)
            if end < 0:
                break
    return out


def find(text: str) -> list[Span]:
    """All spans of a text, by start, then kind as listed."""
    out: list[Span] = []

    def add(kind: str, start: int, end: int, score: float, base: bool = True) -> None:
        if score < 1 and _context[kind](text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]):
            score = min(1.0, score + CONTEXT)
        if base or score >= ADDED_SCORE:
            out.append(Span(start, KINDS.index(kind), end, round(score, 2), base))

    for start, end in emails(text):
        add("email", start, end, 0.9)
    if not _digit(text):
        return sorted(out)
    if "." in text:
        for m in _ip(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                add("ip", m.start(), m.end(), 0.6)
    for m in _card(text):
        if m.end() - m.start() < 12:
            continue
        if card_ok(m.group()):
            add("card", m.start(), m.end(), 0.7)
        else:
            for start, end in inner_cards(text, m.start(), m.end()):
                add("card", start, end, 0.6, False)
    if "+" in text:
        for m in _phone(text):
            if 9 <= len(digits(m.group())) <= 15:
                add("phone", m.start(), m.end(), 0.7)
            elif inner := inner_phone(text, m.start(), m.end()):
                add("phone", *inner, 0.6, False)
    for start, end in accounts(text):
        add("iban", start, end, 0.8, False)
    for m in _ssn(text):
        add("ssn", m.start(), m.end(), 0.3, False)
    return sorted(out)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, done = [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def annotate(df: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """Append the base counts, ``base_sha256``, ``spans``, and ``scores`` (of the spans, in their order)."""

    def make():
        def fn(batch):
            found = [find(t) for t in texts(batch, text_col)]
            base = [[s for s in spans if s.base] for spans in found]
            counts = [[sum(s.kind == k for s in spans) for spans in base] for k in BASE_KINDS]
            return [
                *counts,
                [hashlib.sha256(",".join(map(str, spans)).encode()).hexdigest() for spans in base],
                [",".join(map(str, spans)) for spans in found],
                [[s.score for s in spans] for spans in found],
            ]

        return fn

    fields = [(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType()), ("scores", T.ArrayType(T.DoubleType()))]
    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), make, fields, keep)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its texts redacted; a null text stays null."""

    def make():
        def fn(batch):
            column = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            return [[t and redacted(t, find(t)) for t in column]]

        return fn

    return map_batches(df, make, [(text_col, df.schema[text_col].dataType)], df.columns).select(*df.columns)
