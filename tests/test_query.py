"""The query language: worked examples, and random queries against a row-at-a-time reading."""

import random
from datetime import datetime, timedelta

import pytest

from strataseek.operators import search as engine
from strataseek.plans import query as Q
from strataseek.plans.options import SearchOptions, SortField, SortSpec, parse_dir_sort, parse_sort_name
from strataseek.schema import FILE_ENTRY

NOW = datetime(2024, 5, 15, 12)


def entry(name, path="/home", size=1024, ord=0, folder=False, modified=None, runs=0, **flags):
    ext = "" if folder or "." not in name[1:] else name.rsplit(".", 1)[1]
    row = {f.name: None for f in FILE_ENTRY}
    row |= {"file_ord": ord, "full_path": f"{path}/{name}", "file_name": name, "extension": ext, "parent_path": path, "size": size}
    row |= {"date_modified": modified, "is_directory": folder, "run_count": runs}
    row["attributes"] = {f.name: flags.get(f.name, False) for f in FILE_ENTRY["attributes"].dataType}
    return row


def names(spark, rows, text, options=None, compat=False):
    df = spark.createDataFrame([{**r, "file_ord": i} for i, r in enumerate(rows)], FILE_ENTRY)
    return [r["file_name"] for r in engine.search(df, text, options, NOW, compat).collect()]


@pytest.mark.parametrize(
    "rows, text, expected",
    [
        ([entry("test.txt"), entry("document.pdf")], "test", ["test.txt"]),
        ([entry("song.mp3"), entry("document.pdf")], "audio:", ["song.mp3"]),
        ([entry("bigfile.bin", size=2 << 20)], "size:>1mb", ["bigfile.bin"]),
        ([entry("abc.txt"), entry("xyz.pdf"), entry("other.jpg")], "abc | xyz", ["abc.txt", "xyz.pdf"]),
        ([entry("recent.txt", modified=NOW)], "dm:today", ["recent.txt"]),
        ([entry("test.mp3"), entry("test.flac"), entry("test.txt")], "ext:mp3;flac", ["test.flac", "test.mp3"]),
        ([entry("test.mp3"), entry("testing.txt"), entry("other.jpg")], "*.mp3", ["test.mp3"]),
    ],
)
def test_basics(spark, rows, text, expected):
    assert names(spark, rows, text) == expected


ROWS = [
    entry("Foo Bar.txt", modified=datetime(2024, 5, 13)),
    entry("foo.MP3", "/home/Music", size=0),
    entry("tmp", "/home", size=0, folder=True),
    entry("文档 report.docx", "/data", size=5 << 20, modified=datetime(2023, 12, 31, 23, 59), read_only=True, archive=True),
    entry("a+b(1).rs", "/src/code", size=10240, runs=3),
    entry("naïve café.pdf", "/src", size=200 << 20, hidden=True, runs=7),
    entry(".bashrc", "/home/u"),
    entry("x\"y.tmp", "/t", size=102401),
]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a b | c size:>1mb", ["naïve café.pdf", "文档 report.docx"]),
        ("!tmp report", ["文档 report.docx"]),
        ("! tmp", ["tmp", 'x"y.tmp']),
        ('"foo bar" *.txt', ["Foo Bar.txt"]),
        ('x"y', ['x"y.tmp']),
        ("case: Foo", ["Foo Bar.txt"]),
        ("case:Foo folder:", ["tmp"]),
        ("audio:beatles", ["foo.MP3"]),
        ("audio: | pic:", []),
        ("!ext:mp3 foo", ["Foo Bar.txt", "foo.MP3"]),
        ("size:5-9", ["tmp"]),
        ("size:10kb", ["a+b(1).rs", "tmp"]),
        ("size:Tiny", ["tmp"]),
        ("size:1.5mb", ["tmp"]),
        ("size:unknown 文档", ["文档 report.docx"]),
        ("size:4mb..6mb 文档", ["文档 report.docx"]),
        ("dm:thisweek", ["Foo Bar.txt"]),
        ("dm:lastyear", ["文档 report.docx"]),
        ("dm:<2024-01-01", ["文档 report.docx"]),
        ("dm:bad", []),
        ("dm:unknown folder:", ["tmp"]),
        ("runcount:", ["a+b(1).rs", "naïve café.pdf"]),
        ("runcount:4..", ["naïve café.pdf"]),
        ("len:18", ["文档 report.docx"]),
        ("depth:4 foo", ["foo.MP3"]),
        ("attrib:ra", ["文档 report.docx"]),
        ("attrib:H", ["naïve café.pdf"]),
        ("startwith:FOO", ["Foo Bar.txt", "foo.MP3"]),
        ("endwith:.TMP", ['x"y.tmp']),
        ("empty:", ["tmp"]),
        ("ww: caf", []),
        ("ww: café", ["naïve café.pdf"]),
        ("path: /SRC/", ["a+b(1).rs", "naïve café.pdf"]),
        ("type:exe", []),
        ("type:nope", []),
        ("filelist:x", []),
        ("frn:1 content:q café", ["naïve café.pdf"]),
        ("dupe: child:q café", []),
        ("http://x", []),
        ("a+?(1*.rs", ["a+b(1).rs"]),
        ("*.mp3", ["foo.MP3"]),
        ("*.MP3", ["foo.MP3"]),
        ("foo |", ["Foo Bar.txt", "foo.MP3"]),
        ("b(1).rs", ["a+b(1).rs"]),
        ("bashrc ext:", [".bashrc"]),
    ],
)
def test_examples(spark, text, expected):
    assert sorted(names(spark, ROWS, text)) == sorted(expected)


def test_historical_readings(spark):
    assert names(spark, ROWS, "*.MP3", compat=True) == []
    assert names(spark, ROWS, "dupe: child:q café", compat=True) == ["naïve café.pdf"]  # they hold for every row
    assert "naïve café.pdf" in names(spark, ROWS, "size:1kb..2mb", compat=True)  # its second bound is open
    assert "naïve café.pdf" not in names(spark, ROWS, "size:1kb..2mb")
    df = spark.createDataFrame([{**r, "file_ord": i} for i, r in enumerate(ROWS)], FILE_ENTRY)
    late = SearchOptions(offset=100)
    assert engine.search(df, "foo", late).count() == 0
    assert engine.search(df, "foo", late, compat=True).count() == 2


def test_regex_mode(spark):
    options = SearchOptions(regex=True, files_only=True)
    assert names(spark, ROWS, "^[ft]", options) == ["foo.MP3", "tmp"]  # in their case, folders too
    assert names(spark, ROWS, "([", options) == []
    assert names(spark, ROWS, "(?=x)", options) == []


def test_empty_query_keeps_all(spark):
    assert len(names(spark, ROWS, "", SearchOptions(files_only=True))) == len(ROWS)


def test_sorts(spark):
    df = spark.createDataFrame([{**r, "file_ord": i} for i, r in enumerate(ROWS)], FILE_ENTRY)
    by = lambda f, d=False: [r["file_ord"] for r in engine.sort_entries(df, SortSpec(f, d)).collect()]
    assert by(SortField.SIZE)[:2] == [1, 2] and by(SortField.SIZE, True)[-2:] == [1, 2]  # ties keep their order
    assert by(SortField.DATE_MODIFIED)[-1] == 0 and by(SortField.DATE_MODIFIED, True)[:2] == [0, 3]
    paths = [entry("z", "/a.b"), entry("b", "/a")]
    assert names(spark, paths, "", SearchOptions(sort=SortSpec(SortField.PATH))) == ["b", "z"]
    assert by(SortField.ATTRIBUTES, True)[0] == 3


def test_sort_names():
    assert parse_sort_name("size-descending") == SortSpec(SortField.SIZE, True)
    assert parse_sort_name("DM") == SortSpec(SortField.DATE_MODIFIED)
    assert parse_sort_name("nope") is None
    assert parse_dir_sort("-S") == SortSpec(SortField.SIZE, True)
    assert parse_dir_sort("x") is None


def holds(row, text):
    """A second reading of the language, for rows one at a time; terms, groups, sizes and switches only."""
    groups, checks, fold, path = [[]], [], True, False
    for word in text.split():
        if word == "|":
            groups.append([])
        elif word in ("case:", "nocase:"):
            fold = word == "nocase:"
        elif word in ("path:", "nopath:"):
            path = word == "path:"
        elif word == "file:":
            checks.append(not row["is_directory"])
        elif word.startswith("size:>"):
            checks.append(row["is_directory"] or row["size"] > int(word[6:]))
        elif word.startswith("ext:"):
            checks.append(row["extension"].lower() in word[4:].lower().split(";"))
        else:
            groups[-1].append(word)
    source = row["full_path"] if path else row["file_name"]

    def term(w):
        negated, w = w.startswith("!"), w.removeprefix("!")
        found = w.lower() in source.lower() if fold else w in source
        return found != negated

    groups = [g for g in groups if g]
    return all(checks) and (not groups or any(all(map(term, g)) for g in groups))


def test_random_queries(spark):
    rng = random.Random(4)
    rows = [entry("".join(rng.choices("abAB.é", k=rng.randint(1, 6))), rng.choice(["/a", "/b/A"]), rng.randint(0, 50), i, rng.random() < 0.2) for i in range(60)]
    df = spark.createDataFrame(rows, FILE_ENTRY).cache()
    words = ["a", "B", "!b", "ab", "É", "|", "|", "case:", "nocase:", "path:", "nopath:", "file:", "size:>20", "ext:b;ab", "!A"]
    for _ in range(25):
        text = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        got = {r["file_ord"] for r in engine.matching(df, text).collect()}
        assert got == {r["file_ord"] for r in rows if holds(r, text)}, text


def test_date_words():
    today = NOW.date()
    assert Q.date_span("lastweek", today) == (today - timedelta(days=9), today - timedelta(days=3))
    assert Q.date_span("lastmonth", today)[0].isoformat() == "2024-04-01"
    assert Q.date_span("nope", today) is None
