"""Cells of the old binary spreadsheets (BIFF8 in a compound file), sheet by sheet.

A compound file is a small file system of sectors; its stream ``Workbook`` is a sequence
of records (kind, length, data). Only records that hold sheets' places, the shared
strings and cell values are read. Dates are numbers, as the file stores them; errors are blank.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

_MARK = bytes.fromhex("d0cf11e0a1b11ae1")
_END = 0xFFFFFFFC  # sector numbers from here on are marks
# kinds of records, fixed values
BOUNDSHEET, SST, CONTINUE, EOF, BOF, FILEPASS = 0x85, 0xFC, 0x3C, 0x0A, 0x809, 0x2F
LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207

Value = str | float | int | bool | None


def _chain(table: list[int], at: int) -> list[int]:
    out = []
    while at < len(table) and len(out) <= len(table):
        out.append(at)
        at = table[at]
    return out


def workbook_stream(data: bytes) -> bytes:
    """The workbook's stream of a compound file."""
    if data[:8] != _MARK:
        raise ValueError("not a binary spreadsheet")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, limit, mini_at, _, more_at, more = struct.unpack_from("<I4xIIIII", data, 48)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    tables = list(struct.unpack_from("<109I", data, 76))
    for _ in range(more):
        *part, more_at = numbers(sector(more_at))
        tables += part
    table = [x for t in tables if t < _END for x in numbers(sector(t))]
    whole = lambda at: b"".join(sector(n) for n in _chain(table, at))
    entries = whole(directory)
    found, root = None, None
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "ignore")
        start, bytes_ = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = start
        elif kind == 2 and name.lower() in ("workbook", "book") and (found is None or name.lower() == "workbook"):
            found = start, bytes_
    if found is None:
        raise ValueError("no workbook in the file")
    start, bytes_ = found
    if bytes_ >= limit:
        return whole(start)[:bytes_]
    parts, minis = whole(root) if root is not None else b"", numbers(whole(mini_at))
    return b"".join(parts[n * small : (n + 1) * small] for n in _chain(minis, start))[:bytes_]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Parts:
    """The data of a record and those that continue it; where characters go on in the next, their width is told anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def left(self) -> int:
        while self.i < len(self.parts) and self.at >= len(self.parts[self.i]):
            self.i, self.at = self.i + 1, 0
        return len(self.parts[self.i]) - self.at if self.i < len(self.parts) else 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and (have := self.left()):
            part = self.parts[self.i][self.at : self.at + min(n, have)]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def string(self, form: str = "<H") -> str:
        n, flags = self.number(form), self.number("<B")
        runs = self.number("<H") if flags & 8 else 0
        extra = self.number("<I") if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            have = self.left()
            if not have:
                break
            if out:
                wide, have = self.number("<B") & 1, have - 1
            k = min(n, have // (1 + wide))
            out.append(self.take(k * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "ignore"))
            n -= k
            if not k:
                break
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(x: int) -> float:
    """A number packed in 32 bits: a whole number or the upper half of a double, perhaps times 100."""
    value = float((x >> 2) - ((x & 0x80000000) >> 1)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


def sheets(data: bytes) -> list[list[list[Value]]]:
    """The used range of every worksheet, row by row; cells without a value are None."""
    stream = workbook_stream(data)
    places: list[int] = []
    shared: list[str] = []
    held = records(stream)
    pending: list[bytes] = []
    for kind, body in held:
        if pending and kind != CONTINUE:
            shared, pending = _strings(pending), []
        if kind == FILEPASS:
            raise ValueError("the file is encrypted")
        if kind == BOF and not places and struct.unpack_from("<H", body)[0] != 0x600:
            raise ValueError("a version before BIFF8")
        if kind == BOUNDSHEET:
            place, _, what = struct.unpack_from("<IBB", body)
            places.append(place if what == 0 else -1)
        elif kind == SST or (kind == CONTINUE and pending):
            pending.append(body)
        elif kind == EOF:
            break
    return [_sheet(stream, place, shared) if place >= 0 else [] for place in places]


def _strings(parts: list[bytes]) -> list[str]:
    reader = _Parts(parts)
    reader.take(4)
    return [reader.string() for _ in range(reader.number("<I"))]


def _sheet(stream: bytes, place: int, shared: list[str]) -> list[list[Value]]:
    cells: dict[tuple[int, int], Value] = {}
    formula, depth = None, 0
    for kind, body in records(stream, place):
        if kind == BOF:
            depth += 1  # a chart within the sheet has records of its own
        elif kind == EOF:
            depth -= 1
            if not depth:
                break
        if depth > 1 or (len(body) < 6 and kind != STRING):
            continue
        at = struct.unpack_from("<HH", body) if kind != STRING else (0, 0)
        if kind == LABELSST:
            cells[at] = shared[struct.unpack_from("<I", body, 6)[0]]
        elif kind in (LABEL, RSTRING):
            cells[at] = _Parts([body[6:]]).string()
        elif kind == NUMBER:
            cells[at] = struct.unpack_from("<d", body, 6)[0]
        elif kind == RK:
            cells[at] = _rk(struct.unpack_from("<I", body, 6)[0])
        elif kind == MULRK:
            for i in range((len(body) - 6) // 6):
                cells[at[0], at[1] + i] = _rk(struct.unpack_from("<I", body, 6 + 6 * i)[0])
        elif kind == BOOLERR:
            value, error = body[6:8]
            cells[at] = None if error else bool(value)
        elif kind == FORMULA:
            if body[12:14] != b"\xff\xff":
                cells[at] = struct.unpack_from("<d", body, 6)[0]
            elif body[6] == 0:  # its text is in the next record
                formula = at
            elif body[6] == 1:
                cells[at] = bool(body[8])
        elif kind == STRING and formula is not None:
            cells[formula], formula = _Parts([body]).string(), None
    if not cells:
        return []
    rows, columns = [r for r, _ in cells], [c for _, c in cells]
    return [[cells.get((r, c)) for c in range(min(columns), max(columns) + 1)] for r in range(min(rows), max(rows) + 1)]
