"""The file query language: text to tokens, tokens to one predicate column.

A query is read once on the driver. Its filters (functions, type macros, switches)
hold for the whole query wherever they stand; its text terms form groups, joined by
``|``, of which one must match whole. ``compat=True`` keeps the historical readings
that are otherwise put right: wildcards that don't fold their pattern nor escape
other regular-expression characters, and sizes with suffixes in ranges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strataseek.functions import paths
from strataseek.plans import regex
from strataseek.plans.options import SearchOptions

#: Extensions of the type macros. Fixed values.
TYPES = {
    "audio": "mp3 wav flac aac ogg wma m4a opus".split(),
    "doc": "doc docx pdf txt rtf odt xls xlsx ppt pptx csv".split(),
    "pic": "jpg jpeg png gif bmp tiff webp svg ico".split(),
    "video": "mp4 avi mkv mov wmv flv webm m4v".split(),
    "zip": "zip rar 7z tar gz bz2 xz iso".split(),
    "exe": "exe msi bat cmd ps1 com".split(),
}
MACRO_NAMES = {"picture": "pic", "compressed": "zip", "executable": "exe"} | {n: n for n in TYPES}

#: Switches that change an option, and the value they set. Fixed values.
SWITCHES = {
    "case": ("match_case", True),
    "nocase": ("match_case", False),
    "path": ("match_path", True),
    "nopath": ("match_path", False),
    "wholeword": ("match_whole_word", True),
    "ww": ("match_whole_word", True),
    "nowholeword": ("match_whole_word", False),
    "noww": ("match_whole_word", False),
    "file": ("files_only", True),
    "files": ("files_only", True),
    "folder": ("folders_only", True),
    "folders": ("folders_only", True),
}
#: Switches that are accepted and change nothing. Fixed values.
IDLE_SWITCHES = set("regex noregex wfn wholefilename nowfn nowholefilename wildcards nowildcards ascii noascii utf8 diacritics nodiacritics".split())
#: Functions that are accepted and hold for every row. Fixed values.
IDLE_FUNCTIONS = set(
    """child childcount childfilecount childfoldercount parent infolder filelistfilename dupe namepartdupe sizedupe dmdupe
    dcdupe dadupe attribdupe frn fsi content comment album artist title genre track year width height dimensions
    orientation bitdepth shell knownfolderid count quot apos amp lt gt""".split()
)
DATE_COLUMNS = {
    "dm": "date_modified",
    "datemodified": "date_modified",
    "dc": "date_created",
    "datecreated": "date_created",
    "da": "date_accessed",
    "dateaccessed": "date_accessed",
    "dr": "date_run",
    "daterun": "date_run",
    "rc": "date_recently_changed",
    "recentchange": "date_recently_changed",
}
FUNCTIONS = IDLE_FUNCTIONS | set(DATE_COLUMNS) | set("size ext attrib attributes runcount root empty startwith endwith len type depth parents filelist".split())

#: Sizes by name: above the first bound, up to the second. Fixed values.
SIZE_CLASSES = {
    "empty": (None, 0),
    "tiny": (0, 10 << 10),
    "small": (10 << 10, 100 << 10),
    "medium": (100 << 10, 1 << 20),
    "large": (1 << 20, 16 << 20),
    "huge": (16 << 20, 128 << 20),
    "gigantic": (128 << 20, None),
}
SUFFIXES = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
#: Letters of ``attrib:`` and the flags they ask for. Fixed values.
ATTRIBUTE_LETTERS = {"R": "read_only", "H": "hidden", "S": "system", "A": "archive", "C": "compressed", "E": "encrypted", "N": "normal", "T": "temporary"}

MAX_LONG = (1 << 63) - 1

_TOKEN = re.compile(r'\s+|(?P<either>\|)|\)|(?P<idle>[!<>])(?=\s|$)|"(?P<phrase>[^"]*)"?|(?P<word>[^\s|)]+)')
_COMPARISON = re.compile(r"\s*(>=|<=|>|<|=|)(.*)", re.DOTALL)


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass
class Query:
    """A query read into groups of terms, filters and options."""

    groups: list[list[Term]] = field(default_factory=lambda: [[]])
    filters: list[tuple[str, str]] = field(default_factory=list)
    options: SearchOptions = field(default_factory=SearchOptions)


def parse(text: str, options: SearchOptions | None = None) -> Query:
    """Tokens of a query. A ``|`` at the end leaves an empty group; an unquoted ``)`` ends a word; lone ``!``, ``<`` and ``>`` say nothing."""
    query = Query(options=options or SearchOptions())
    for m in _TOKEN.finditer(text):
        if m["either"]:
            query.groups.append([])
        elif m["phrase"] is not None:
            query.groups[-1].append(Term(m["phrase"], phrase=True))
        elif m["word"]:
            name, colon, value = m["word"].partition(":")
            name = name.lower()
            if colon and name in MACRO_NAMES:
                query.filters.append(("type", MACRO_NAMES[name]))
            elif colon and name in SWITCHES:
                option, on = SWITCHES[name]
                query.options = replace(query.options, **{option: on})
            elif colon and name in IDLE_SWITCHES:
                continue
            elif colon and name in FUNCTIONS:
                query.filters.append((name, value))
            else:
                query.groups[-1].append(Term(m["word"]))
    return query


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _compare(column: Column, op: str, value) -> Column:
    return {">=": column >= value, ">": column > value, "<=": column <= value, "<": column < value, "=": column == value, "": column == value}[op]


def _number(text: str) -> int | None:
    text = text.strip()
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) <= MAX_LONG else None


def number_condition(column: Column, value: str) -> Column:
    """``a..b`` or ``a-b`` inclusive (a missing bound is open), or a comparison; false if it can't be read."""
    value = value.strip()
    low, dots, high = value.partition("..")
    if not dots and (dash := re.fullmatch(r"(.*?[0-9])-([0-9].*)", value, re.DOTALL)):
        low, dots, high = dash[1], "-", dash[2]
    if dots:
        a, b = _number(low), _number(high)
        return column.between(0 if a is None else a, MAX_LONG if b is None else b)
    op, text = _COMPARISON.fullmatch(value).groups()
    n = _number(text)
    return F.lit(False) if n is None else _compare(column, op, F.lit(n))


def _bytes(text: str) -> int | None:
    text = text.strip().lower()
    unit = SUFFIXES.get(text[-2:], 1)
    n = _number(text[:-2] if unit > 1 else text)
    return None if n is None or n * unit > MAX_LONG else n * unit


def size_condition(value: str, compat: bool) -> Column:
    """Condition of ``size:``; folders always pass."""
    size, value = F.col("size"), value.strip()
    if value == "unknown":
        return F.lit(True)
    if value in SIZE_CLASSES:
        above, upto = SIZE_CLASSES[value]
        return _all([size > above] * (above is not None) + [size <= upto] * (upto is not None)) | F.col("is_directory")
    low, dots, high = value.partition("..")
    if dots and not compat:
        a, b = _bytes(low), _bytes(high)
        if (a is None and low.strip()) or (b is None and high.strip()):
            return F.col("is_directory")
        return size.between(0 if a is None else a, MAX_LONG if b is None else b) | F.col("is_directory")
    if dots and value[-2:].lower() in SUFFIXES:  # historical: the last suffix scales a first bound that is a bare number; the second is open
        a = _number(low)
        return (size >= (0 if a is None else a * SUFFIXES[value[-2:].lower()])) | F.col("is_directory")
    if dots or value[-2:].lower() not in SUFFIXES:
        return number_condition(size, value) | F.col("is_directory")
    op, text = _COMPARISON.fullmatch(value).groups()
    n = _bytes(text)
    return (F.lit(False) if n is None else _compare(size, op, F.lit(n))) | F.col("is_directory")


def _day(text: str) -> date | None:
    try:
        return datetime.strptime(text.strip(), "%Y-%m-%d").date()
    except ValueError:
        return None


def date_span(word: str, today: date) -> tuple[date, date] | None:
    """First and last day of a date word."""
    monday, first = today - timedelta(days=today.weekday()), today.replace(day=1)
    before = first - timedelta(days=1)
    after = (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)
    return {
        "today": (today, today),
        "yesterday": (today - timedelta(days=1),) * 2,
        "thisweek": (monday, today),
        "lastweek": (monday - timedelta(days=7), monday - timedelta(days=1)),
        "thismonth": (first, after),
        "lastmonth": (before.replace(day=1), before),
        "thisyear": (date(today.year, 1, 1), date(today.year, 12, 31)),
        "lastyear": (date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)),
    }.get(word)


def date_condition(column: Column, value: str, now: datetime) -> Column:
    """A date word, range or comparison in UTC days; a null date matches ``unknown`` only.

    Bounds are literals on the timestamp itself, so that a scan can use them.
    """
    if value == "unknown":
        return column.isNull()
    span = date_span(value.lower(), now.astimezone(timezone.utc).date() if now.tzinfo else now.date())
    low, dots, high = value.partition("..")

    def start(day: date) -> Column:
        return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp")

    if span is None and dots:
        a, b = _day(low), _day(high)
        if a is None or b is None:
            return F.lit(False)
        span = (a, b)
    if span is None:
        op, text = _COMPARISON.fullmatch(value.strip()).groups()
        day = _day(text)
        if day is None:
            return F.lit(False)
        if op in (">", ">=", "<", "<="):
            edge = start(day + timedelta(days=op in (">", "<=")))
            return F.coalesce(column >= edge if op[0] == ">" else column < edge, F.lit(False))
        span = (day, day)
    return F.coalesce((column >= start(span[0])) & (column < start(span[1] + timedelta(days=1))), F.lit(False))


def attribute_condition(value: str) -> Column:
    """All flags of the letters; D asks for a folder, other letters for nothing."""
    flags = []
    for letter in dict.fromkeys(value.upper()):
        if letter == "D":
            flags.append(F.col("is_directory"))
        elif letter in ATTRIBUTE_LETTERS:
            flags.append(F.coalesce(F.col("attributes")[ATTRIBUTE_LETTERS[letter]], F.lit(False)))
    return _all(flags)


def type_condition(name: str) -> Column:
    return ~F.col("is_directory") & F.lower("extension").isin(TYPES[name]) if name in TYPES else F.lit(False)


def function_condition(name: str, value: str, now: datetime, compat: bool) -> Column:
    """The condition of ``name:value``."""
    if name in IDLE_FUNCTIONS:
        return F.lit(True)
    if name in DATE_COLUMNS:
        return date_condition(F.col(DATE_COLUMNS[name]), value, now)
    lowered = F.lower("file_name")
    return {
        "size": lambda: size_condition(value, compat),
        "ext": lambda: F.lower("extension").isin([x.strip().lower() for x in value.split(";")]),
        "attrib": lambda: attribute_condition(value),
        "attributes": lambda: attribute_condition(value),
        "runcount": lambda: number_condition(F.col("run_count"), value) if value else F.col("run_count") > 0,
        "root": lambda: F.col("parent_path") == "",
        "empty": lambda: F.col("is_directory") & (F.col("size") == 0),
        "startwith": lambda: F.startswith(lowered, F.lit(value.lower())),
        "endwith": lambda: F.endswith(lowered, F.lit(value.lower())),
        "len": lambda: number_condition(F.octet_length("file_name"), value),
        "type": lambda: type_condition(value),
        "depth": lambda: number_condition(paths.depth(F.col("full_path")), value),
        "parents": lambda: number_condition(paths.depth(F.col("full_path")), value),
        "filelist": lambda: F.lit(False),
    }[name]()


def quoted(text: str) -> str:
    """A text as a literal of Java's regular expressions."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII) if text.isascii() else "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in text)


def wildcard_pattern(text: str, fold: bool, compat: bool) -> str:
    """An anchored pattern for ``*`` and ``?``."""
    if compat:
        body = text.replace(".", "\\.").replace("*", ".*").replace("?", ".")
    else:
        body = "".join({"*": ".*", "?": "."}.get(c) or quoted(c) for c in (text.lower() if fold else text))
    return f"(?d)^{body}\\z"


def term_condition(term: Term, options: SearchOptions, compat: bool) -> Column:
    source = F.col("full_path" if options.match_path else "file_name")
    text, negated = term.text, False
    if not term.phrase and text.startswith("!"):
        text, negated = text[1:], True
    elif not term.phrase and ("*" in text or "?" in text):
        pattern = wildcard_pattern(text, not options.match_case, compat)
        return (source if options.match_case else F.lower(source)).rlike(pattern) if not compat or _readable(pattern) else F.lit(False)
    if options.match_whole_word:
        found = source.rlike(rf"(?iuU)\b{quoted(text)}\b")
    elif options.match_case:
        found = F.contains(source, F.lit(text))
    else:
        found = F.contains(F.lower(source), F.lit(text.lower()))
    return ~found if negated else found


def _readable(pattern: str) -> bool:
    """Whether the JVM can read a pattern, so that no job ends with it."""
    session = SparkSession.getActiveSession()
    if session is None:
        return True
    try:
        session._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  the JVM's error for a pattern it can't read
        return False
    return True


def predicate(text: str, options: SearchOptions | None = None, now: datetime | None = None, compat: bool = False) -> Column | None:
    """The condition of a query on a row of files; None if it holds for all (an empty query, whatever the options)."""
    options, now = options or SearchOptions(), now or datetime.now(timezone.utc)
    if not text:
        return None
    if options.regex:
        source = F.col("full_path" if options.match_path else "file_name")
        pattern = regex.to_java(text)
        return source.rlike(pattern) if pattern is not None and _readable(pattern) else F.lit(False)
    return condition_of(parse(text, options), now, compat)


def condition_of(query: Query, now: datetime | None = None, compat: bool = False) -> Column | None:
    """The condition of a query that has been read, of what it says of single rows."""
    now = now or datetime.now(timezone.utc)
    conditions = []
    if query.options.files_only:
        conditions.append(~F.col("is_directory"))
    if query.options.folders_only:
        conditions.append(F.col("is_directory"))
    conditions += [function_condition(name, value, now, compat) for name, value in query.filters]
    groups = [_all([term_condition(t, query.options, compat) for t in g]) for g in query.groups if g]
    if groups:
        conditions.append(reduce(lambda a, b: a | b, groups))
    return _all(conditions) if conditions else None
