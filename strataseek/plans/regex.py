"""Regular expressions of the linear-time kind, read and written as the JVM's.

The language is Unicode throughout: classes, word boundaries and folding know all scripts, ``$`` is the very end, and
there are no look-arounds nor back-references. The JVM's differs in most of that, so a pattern is parsed whole and each
part written out as what it means. What isn't a pattern of the language gives None.

Properties that the JVM has no name for (of emoji, say) make a pattern unreadable. It matches by backtracking: a pattern of
nested unbounded repetitions may take long on long texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# What the escapes stand for, in the JVM's spelling. Fixed values.
WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
PERL = {"d": r"\p{Nd}", "s": r"\p{IsWhite_Space}", "w": WORD}
ASCII_PERL = {"d": "0-9", "s": r"\t\n\x0b\f\r ", "w": "0-9A-Za-z_"}
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`\{-~", "space": r"\t\n\x0b\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
CONTROLS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi",
    "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So",
    "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf",
    "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
BINARY = {
    "alphabetic": "Alphabetic", "alpha": "Alphabetic", "ideographic": "Ideographic", "ideo": "Ideographic", "lowercase": "Lowercase", "lower": "Lowercase",
    "uppercase": "Uppercase", "upper": "Uppercase", "whitespace": "White_Space", "wspace": "White_Space", "space": "White_Space", "hexdigit": "Hex_Digit", "hex": "Hex_Digit",
    "joincontrol": "Join_Control", "joinc": "Join_Control", "noncharactercodepoint": "Noncharacter_Code_Point", "nchar": "Noncharacter_Code_Point",
}
#: Counted repetitions beyond this, multiplied along nested ones, are refused, as too large.
MOST = 100_000


class _Unreadable(ValueError):
    pass


@dataclass(frozen=True)
class _Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False
    u: bool = True
    x: bool = False
    R: bool = False


def literal(char: str) -> str:
    """A character as the JVM's pattern of it."""
    if char.isalnum() or (not char.isascii() and char.isprintable()):
        return char
    return f"\\x{{{ord(char):x}}}"


def _loose(name: str) -> str:
    return re.sub(r"[\s_-]+", "", name).lower()


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.names, self.size = text, 0, set(), 1

    def more(self, text: str = "") -> bool:
        return self.text.startswith(text, self.at) if text else self.at < len(self.text)

    def take(self, n: int = 1) -> str:
        if self.at + n > len(self.text):
            raise _Unreadable("the pattern ends too early")
        self.at += n
        return self.text[self.at - n : self.at]

    def skip_blank(self, flags: _Flags) -> None:
        while flags.x and self.more() and (self.text[self.at].isspace() or self.more("#")):
            if self.take() == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1

    # alternations, groups, repetitions

    def alternation(self, flags: _Flags) -> str:
        branches: list[list[str]] = [[]]
        while True:
            self.skip_blank(flags)
            if not self.more() or self.more(")"):
                return "|".join("".join(b) for b in branches)
            c = self.take()
            if c == "|":
                branches.append([])
                continue
            if c == "(":
                atom, flags = self.group(flags)
                if atom is None:
                    continue
            elif c in "*+?{":
                raise _Unreadable("nothing to repeat")
            else:
                atom = self.atom(c, flags)
            branches[-1].append(self.repeated(atom, flags))

    def group(self, flags: _Flags) -> tuple[str | None, _Flags]:
        inner = flags
        if self.more("?"):
            self.take()
            if self.more("P<") or self.more("<"):
                self.take(2 if self.more("P") else 1)
                name = re.compile(r"[\w.\[\]]*").match(self.text, self.at)[0]
                if not re.fullmatch(r"[^\W\d][\w.\[\]]*", name) or name in self.names:
                    raise _Unreadable("a name")
                self.names.add(name)
                self.take(len(name))
                if self.take() != ">":
                    raise _Unreadable("a name")
            else:
                inner = self.flags(flags)
                if self.take() == ")":
                    return None, inner
        body = self.alternation(inner)
        if not self.more(")"):
            raise _Unreadable("a group without end")
        self.take()
        return f"(?:{body})", flags

    def flags(self, flags: _Flags) -> _Flags:
        on, seen = True, set()
        while not (self.more(")") or self.more(":")):
            c = self.take()
            if c == "-" and on:
                on = False
            elif c in "imsUuxR" and c not in seen:
                seen.add(c)
                flags = replace(flags, **{c: on})
            else:
                raise _Unreadable("flags")
        if not seen and self.more(")") or self.text[self.at - 1] == "-":
            raise _Unreadable("flags")
        return flags

    def repeated(self, atom: str, flags: _Flags) -> str:
        whole = self.size
        while True:
            self.skip_blank(flags)
            if not self.more() or self.text[self.at] not in "*+?{":
                self.size = max(self.size, whole)
                return atom
            c = self.take()
            if c == "{":
                m = re.compile(r"\s*([0-9]+)\s*(?:(,)\s*([0-9]+)?\s*)?\}").match(self.text, self.at)
                if not m or (m[3] and int(m[3]) < int(m[1])):
                    raise _Unreadable("a repetition")
                self.at = m.end()
                whole *= max(1, int(m[3] or m[1]))
                if whole > MOST:
                    raise _Unreadable("too large")
                c = f"{{{int(m[1])}{m[2] or ''}{int(m[3]) if m[3] else ''}}}"
            lazy = self.more("?")
            if lazy:
                self.take()
            atom = f"(?:{atom}){c}" + "?" * (lazy != flags.U)

    # atoms

    def atom(self, c: str, flags: _Flags) -> str:
        if c == ".":
            if not flags.u:
                raise _Unreadable("bytes")
            return r"[\x{0}-\x{10ffff}]" if flags.s else r"[^\n\r]" if flags.R else r"[^\n]"
        if c == "^":
            if not flags.m:
                return r"\A"
            return r"(?:\A|(?<=\n)|(?<=\r)(?!\n))" if flags.R else r"(?:\A|(?<=\n))"
        if c == "$":
            if not flags.m:
                return r"\z"
            return r"(?:\z|(?=\r)|(?<!\r)(?=\n))" if flags.R else r"(?:\z|(?=\n))"
        if c == "[":
            return self.folded(self.bracket(flags), flags)
        if c == "\\":
            return self.escape(flags)
        return self.folded(literal(c), flags)

    @staticmethod
    def folded(part: str, flags: _Flags) -> str:
        return f"(?i{'u' if flags.u else ''}:{part})" if flags.i else part

    def escape(self, flags: _Flags) -> str:
        if not self.more():
            raise _Unreadable("an escape")
        c = self.text[self.at]
        word = f"[{WORD if flags.u else ASCII_PERL['w']}]"
        here, there = f"(?<={word})", f"(?={word})"
        no_here, no_there = f"(?<!{word})", f"(?!{word})"
        if c in "AzbB<>":
            self.take()
            if c == "b" and (m := re.compile(r"\{(start|end|start-half|end-half)\}").match(self.text, self.at)):
                self.at = m.end()
                return {"start": no_here + there, "end": here + no_there, "start-half": no_here, "end-half": no_there}[m[1]]
            return {
                "A": r"\A", "z": r"\z", "b": f"(?:{here}{no_there}|{no_here}{there})", "B": f"(?:{here}{there}|{no_here}{no_there})",
                "<": no_here + there, ">": here + no_there,
            }[c]
        kind, value = self.escaped(flags)
        return self.folded(f"[{value}]" if kind == "class" else literal(value), flags)

    def escaped(self, flags: _Flags) -> tuple[str, str]:
        """What follows a backslash, in a class or not: a character, or the inside of a class."""
        c = self.take()
        if c in "dswDSW":
            inside = (PERL if flags.u else ASCII_PERL)[c.lower()]
            if c.isupper() and not flags.u:
                raise _Unreadable("bytes")
            return "class", f"[^{inside}]" if c.isupper() else inside
        if c in "pP":
            return "class", self.property(c == "P", flags)
        if c in "xuU":
            if self.more("{"):
                m = re.compile(r"\{([0-9A-Fa-f]+)\}").match(self.text, self.at)
            else:
                m = re.compile(rf"([0-9A-Fa-f]{{{ {'x': 2, 'u': 4, 'U': 8}[c]} }})".replace(" ", "")).match(self.text, self.at)
            if not m or int(m[1], 16) > 0x10FFFF or 0xD800 <= int(m[1], 16) < 0xE000:
                raise _Unreadable("a code point")
            self.at = m.end()
            return "char", chr(int(m[1], 16))
        if c in CONTROLS:
            return "char", chr(CONTROLS[c])
        if c.isascii() and not c.isalnum() and c not in "<>" and c.isprintable():
            return "char", c
        raise _Unreadable(f"the escape {c}")

    def property(self, negated: bool, flags: _Flags) -> str:
        if not flags.u:
            raise _Unreadable("a property without Unicode")
        if self.more("{"):
            end = self.text.find("}", self.at)
            if end < 0:
                raise _Unreadable("a property")
            name, self.at = self.text[self.at + 1 : end], end + 1
            if name.startswith("^"):
                name, negated = name[1:], not negated
        else:
            name = self.take()
        kind, sign, value = re.fullmatch(r"([^=:!]*)(!=|=|:|)(.*)", name, re.DOTALL).groups()
        if sign == "!=":
            negated = not negated
        named = _loose(value if sign else kind)
        kind = _loose(kind) if sign else ""
        found = None
        if kind in ("", "gc", "generalcategory"):
            category = CATEGORIES.get(named) or next((c for c in {*CATEGORIES.values(), "Nd"} if c.lower() == named), None)
            found = {"any": r"\x{0}-\x{10ffff}", "ascii": r"\x00-\x7f", "assigned": r"\P{Cn}"}.get(named) or (category and rf"\p{{{category}}}")
        if not found and not kind and named in BINARY:
            found = rf"\p{{Is{BINARY[named]}}}"
        if not found and kind in ("", "sc", "script", "scx", "scriptextensions"):
            script = "_".join(w.capitalize() for w in re.split(r"[\s_-]+", value if sign else name) if w)
            found = rf"\p{{IsScript={script}}}".replace("IsScript=", "script=") if script else None
        if not found:
            raise _Unreadable(f"the property {name}")
        return f"[^{found}]" if negated else found

    # classes

    def bracket(self, flags: _Flags) -> str:
        """A class after its opening bracket."""
        negated = self.more("^")
        if negated:
            self.take()
            if not flags.u:
                raise _Unreadable("bytes")
        parts: list[str] = []
        while self.more("-"):
            parts.append(literal(self.take()))
        if not parts and self.more("]"):
            parts.append(literal(self.take()))
        left, operator = None, None

        def joined() -> str:
            own = f"[{''.join(parts)}]" if parts else r"[^\x{0}-\x{10ffff}]"
            if operator is None:
                return own
            return {"&&": f"[{left}&&{own}]", "--": f"[{left}&&[^{own}]]", "~~": f"[[{left}&&[^{own}]][{own}&&[^{left}]]]"}[operator]

        while True:
            while flags.x and self.more() and self.text[self.at].isspace():
                self.take()
            if not self.more():
                raise _Unreadable("a class without end")
            if any(self.more(o) for o in ("&&", "--", "~~")):
                left, operator = joined(), self.take(2)
                parts = []
                continue
            c = self.take()
            if c == "]":
                out = joined()
                return f"[^{out}]" if negated else out
            if c == "[":
                m = re.compile(r":(\^?)([a-z]+):\]").match(self.text, self.at)
                if m and m[2] in POSIX:
                    self.at = m.end()
                    parts.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
                else:
                    parts.append(self.bracket(flags))
                continue
            kind, value = self.escaped(flags) if c == "\\" else ("char", c)
            ranged = self.more("-") and not self.more("-]") and not self.more("--")
            if kind == "class" and not ranged:
                parts.append(value)
            elif kind == "class":
                raise _Unreadable("a range")
            elif ranged:
                self.take()
                c = self.take()
                kind, high = self.escaped(flags) if c == "\\" else ("char", c)
                if kind == "class" or high < value:
                    raise _Unreadable("a range")
                parts.append(f"{literal(value)}-{literal(high)}")
            else:
                parts.append(literal(value))


def to_java(pattern: str) -> str | None:
    """The JVM's spelling of a pattern; None if it isn't one."""
    reader = _Reader(pattern)
    try:
        out = reader.alternation(_Flags())
    except _Unreadable:
        return None
    return out if not reader.more() else None  # a group that ends and never began
