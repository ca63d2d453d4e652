"""Regular expressions of the linear-time, Unicode kind, on the JVM."""

from pyspark.sql import functions as F

from strataseek.operators import search
from strataseek.plans.options import SearchOptions
from strataseek.plans.query import predicate
from strataseek.plans.regex import to_java

#: pattern, texts that it finds, texts that it doesn't.
CASES = [
    (r"^\w+\.txt$", ["文档1.txt", "abc.txt", "Ünï.txt", "a‍b.txt"], ["a b.txt", "a-b.txt", "a.txt\n"]),
    (r"(?i)ünï", ["Ünï.txt", "ÜNÏ"], ["uni"]),
    (r"\p{L}+\d", ["文1", "é٣"], ["1", "-1"]),
    (r"\pL\PL", ["a1", "文 "], ["a", "1", "ab"]),
    (r"\x{6587}|\u6863|\U0001F600", ["文", "档", "😀"], ["a"]),
    (r"^\p{Han}+$", ["文档"], ["文a", ""]),
    (r"\p{Greek}\p{sc=Cyrillic}\p{Script=Latin}", ["αжa"], ["aжα"]),
    (r"^\p{Lowercase_Letter}\p{gc=Lu}\p{uppercase letter}$", ["aBC"], ["ABC"]),
    (r"^[\p{^L}]$|^\P{^Nd}$", ["1", "-"], ["a"]),
    (r"\bcat\b", ["a cat", "cat", "文 cat.txt"], ["cats", "文cat", "_cat"]),
    (r"\Bcat\B", ["scats"], ["cat", "scat"]),
    (r"\b{start}é\b{end}|\<ü\>", ["é", "a é b", "ü"], ["aé", "éa", "üa"]),
    (r"a.c", ["abc", "a\rc", "a c", "a😀c"], ["a\nc", "ac"]),
    (r"(?s)a.c", ["a\nc"], ["ac"]),
    (r"(?m)^b$", ["a\nb\nc", "b"], ["ab", "b\r"]),
    (r"^b$", ["b"], ["b\n", "a\nb"]),
    (r"(?Rm)^b$", ["a\r\nb\r\nc"], ["ab"]),
    (r"\Aa\z", ["a"], ["a\n"]),
    (r"(?x) a b # words" "\n c", ["abc"], ["a b c"]),
    (r"a(?i)b|c", ["aB", "C"], ["AB"]),
    (r"(?i:a)b(?i)c(?-i)d", ["AbCd"], ["ABcd", "AbcD"]),
    (r"(?P<year>\d{4})-(?<月>\d\d)", ["2024-05"], ["24-5"]),
    (r"^(?:a*)*b$", ["aaab", "b"], ["a"]),
    (r"^a*+b{2}{2}$", ["abbbb", "bbbb"], ["abb"]),
    (r"^a{2,3}b{1,}?c{0}$", ["aab", "aaabb"], ["ab", "aaaab"]),
    (r"(?U)^a+?$", ["aa"], ["b"]),
    (r"a||b", ["", "x"], []),
    (r"^()$", [""], ["a"]),
    (r"[]a]", ["]", "a"], ["b"]),
    (r"^[^]a]$", ["b", "\n"], ["]", "a"]),
    (r"^[-a-c-]+$", ["a-c"], ["d"]),
    (r"^[a-z&&[^aeiou]]+$", ["xyz"], ["a", "xa"]),
    (r"^[a-z--aeiou]+$", ["xyz"], ["xa"]),
    (r"^[a-g~~e-k]+$", ["abk"], ["e", "g"]),
    (r"^[^a-c&&b-d]+$", ["adz"], ["b", "c"]),
    (r"^[a[0-9[^\s\S]]]+$", ["a1"], ["b"]),
    (r"^[[:alpha:][:^ascii:]]+$", ["aé"], ["1"]),
    (r"^[[:punct:]]+$", ["!~[\\]{|}"], ["a", "é"]),
    (r"^[\w--\d_]+$", ["ab文"], ["1", "_"]),
    (r"(?i)^[k-m]$", ["K", "\u212a", "l"], ["n"]),
    (r"(?i)^[^k]$", ["a"], ["K", "\u212a"]),
    (r"(?-u:\w)+é$", ["aé"], ["éé"]),
    (r"^\D\S\W$", ["ab-"], ["1b-", "a -", "aba"]),
    (r"\.\-\/\%\"\#\&\~\ ", [".-/%\"#&~ "], ["x"]),
    (r"\t\x41\a", ["\tA\x07"], ["tA"]),
    (r"]}", ["]}"], ["]"]),
    (r"^[\n\]\-\^]+$", ["\n]-^"], ["a"]),
    (r"\p{White_Space}\p{any}\p{ASCII}", ["\u3000文a"], ["a文a"]),
]

BROKEN = [
    "([", "*a", "a|*", "(?=a)", "(?<!a)b", r"(a)\1", r"\Z", r"\Qa\E", r"\h", "a{", "a{,3}", "a{3,2}", "(a", "a)", "[a", "[b-a]", r"[\d-z]", r"\x{110000}", r"\ud800",
    r"\p{Nonsense=X}", "(?i", "(?)", "(?-)", "(?ii)", "(?P<1>a)", "(?<a>x)(?<a>y)", r"(?-u:\W)", "(?-u).", "a\\", r"\y", "(?i)*", "a{1000}{1000}",
]


def test_cases(spark):
    texts = sorted({t for _, a, b in CASES for t in (*a, *b)})
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    row = frame.select("t", *(F.col("t").rlike(to_java(p)).alias(str(k)) for k, (p, _, _) in enumerate(CASES))).collect()
    found = {r["t"]: r for r in row}
    for k, (pattern, yes, no) in enumerate(CASES):
        assert ([t for t in yes if not found[t][str(k)]], [t for t in no if found[t][str(k)]]) == ([], []), pattern


def test_broken_patterns_find_nothing(spark):
    assert [p for p in BROKEN if to_java(p) is not None] == []
    frame = spark.createDataFrame([("a[b", "a")], "file_name string, full_path string")
    assert frame.where(predicate("[", SearchOptions(regex=True))).count() == 0
    # a property that the JVM doesn't know either
    assert frame.where(predicate(r"\p{Unheardof}", SearchOptions(regex=True))).count() == 0


def test_wildcards_that_make_broken_patterns(spark):
    frame = spark.createDataFrame([("[x", "[x"), ("ab", "ab")], "file_name string, full_path string")
    assert search.matching(frame, "[*", compat=True).count() == 0
    assert [r[0] for r in search.matching(frame, "[*").collect()] == ["[x"]
    assert search.matching(frame, "a*", compat=True).count() == 1
