"""What looks at other rows: duplicates and children in queries, the trigram index, subtrees of events, snapshots with gaps."""

from datetime import datetime

from pyspark.sql import functions as F

from strataseek.operators import incremental, inverted, name_index, search
from strataseek.operators.name_index import NameIndex, required
from strataseek.plans.options import SearchOptions
from strataseek.plans.query import Term
from strataseek.schema import FILE_ENTRY, WATCH_EVENT
from strataseek.streaming import watch

NOW = datetime(2024, 5, 15, 12)


def table(spark, rows):
    """Files from (path, size, is_directory, date)."""
    blank = {f.name: None for f in FILE_ENTRY}
    made = []
    for i, (path, size, folder, at) in enumerate(rows):
        parent, _, name = path.rpartition("/")
        made.append(blank | {"file_ord": i, "full_path": path, "file_name": name, "parent_path": parent, "size": size, "is_directory": folder, "date_modified": at})
    return spark.createDataFrame(made, FILE_ENTRY)


FILES = [
    ("/r", 0, True, None),
    ("/r/Alpha.txt", 5, False, NOW),
    ("/r/x", 0, True, NOW),
    ("/r/x/alpha.TXT", 5, False, None),
    ("/r/x/beta.txt", 7, False, NOW),
    ("/r/x/Beta", 0, True, NOW),
    ("/r/x/Beta/gamma.rs", None, False, None),
    ("/r/y", 0, True, None),
    ("/r/y/gamma.md", None, False, None),
]


def test_functions_of_other_rows(spark):
    files = table(spark, FILES)
    found = lambda q, **k: sorted(r["full_path"] for r in search.matching(files, q, now=NOW, **k).collect())
    assert found("dupe:") == ["/r/Alpha.txt", "/r/x/alpha.TXT"]  # folders are no copies of files
    assert found("dupe: beta | x") == ["/r/Alpha.txt", "/r/x/alpha.TXT"]
    assert found("namepartdupe: gamma") == ["/r/x/Beta/gamma.rs", "/r/y/gamma.md"]
    assert found("sizedupe:") == ["/r/Alpha.txt", "/r/x/alpha.TXT"]  # an unknown size is no size
    assert found("dmdupe: size:>5") == ["/r/x/beta.txt"]  # the other one needn't match the rest
    assert found("childcount:") == ["/r", "/r/x", "/r/x/Beta", "/r/y"] and found("childcount:0") == []
    assert found("childcount:3") == ["/r", "/r/x"] and found("childfoldercount:1..2") == ["/r", "/r/x"] and found("childfilecount:2 childfoldercount:1") == ["/r/x"]
    assert found("child:GAMMA !y") == ["/r/x/Beta"] and found("child:zzz") == []
    assert found("infolder:/R/X/") == ["/r/x/Beta", "/r/x/alpha.TXT", "/r/x/beta.txt"] and found("parent:/r/y") == ["/r/y/gamma.md"]
    assert len(found("dupe: childcount:99", compat=True)) == len(FILES)
    plan = search.matching(files, "dupe: alpha", now=NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Window" not in plan


def test_trigram_index(spark, tmp_path, monkeypatch):
    rows = [*FILES, *((f"/r/z/{w}{i}", i, False, NOW) for i in range(300) for w in ("filler-", "Füller_"))]
    files = table(spark, rows).withColumn("file_ord", F.col("file_ord") * 100)
    NameIndex.build(files, str(tmp_path / "ix"))
    index = NameIndex(spark, str(tmp_path / "ix"))
    ids = lambda df: sorted(r["file_ord"] for r in df.select("file_ord").collect())
    for text in ("alpha", "al?ha*", "*er_2?9", "alpha | beta !txt | FÜLLER_12", "filler -29", "zzzz", "dupe: alpha", "case: Füller_1 | alpha", "ww: beta", "be | alpha", '"er_1"', "path:/r/x alpha", "", "size:>298"):
        assert ids(index.matching(text, now=NOW)) == ids(search.matching(files, text, now=NOW)), text
    # what can't match is not among the candidates; what can't be told apart is read whole
    seen = index.candidates("alpha | beta.t").select(F.explode("rows").alias("r")).collect()
    assert sorted(r["r"] for r in seen) == [100, 300, 400]
    assert index.candidates("be | alpha") is None and index.candidates("al", SearchOptions()) is None and index.candidates("alpha", SearchOptions(match_path=True)) is None
    plan = index.matching("alpha", now=NOW)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(block,0)" in plan or "In(block" in plan
    monkeypatch.setattr("strataseek.operators.name_index.LITERALS", 0)
    assert ids(index.matching("alpha", now=NOW)) == [100, 300]


def test_trigrams_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Trigrams are grouped where the names are read, blocks in pieces; files follow the number of rows."""
    monkeypatch.setattr(inverted, "PORTION", 50)
    rows = [(f"/r/{w}{i}", i, False, NOW) for i in range(100) for w in ("report-", "Füller_")]
    files = table(spark, rows).withColumn("file_ord", F.col("file_ord") * 100)
    monkeypatch.setattr(name_index, "SHARE", 20)
    NameIndex.build(files, str(tmp_path / "ix"))
    assert len(list((tmp_path / "ix" / "files").glob("*.parquet"))) > 4  # blocks
    index = NameIndex(spark, str(tmp_path / "ix"))
    pieces = [r for b in index.files.coalesce(1).select("file_ord", "block", F.array(F.lit("rep"), F.substring("file_name", 1, 3)).alias("grams")).toArrow().to_batches() for p in inverted.names([b]) for r in p.to_pylist()]
    assert len({(r["gram"], r["block"]) for r in pieces}) < len(pieces)
    for text in ("report-1", "FÜLLER_ 7 | port-99", "rep 9"):
        want = sorted(r["file_ord"] for r in search.matching(files, text, now=NOW).collect())
        assert want and sorted(r["file_ord"] for r in index.matching(text, now=NOW).collect()) == want, text


def test_required_trigrams():
    exact, case, word = SearchOptions(), SearchOptions(match_case=True), SearchOptions(match_whole_word=True)
    assert required(Term("AbCd"), exact) == {"abc", "bcd"} and required(Term("ab"), exact) is None and required(Term("!abcd"), exact) is None
    assert required(Term("!abc", phrase=True), exact) == {"!ab", "abc"} and required(Term("ab*cde?fgh"), exact) == {"cde", "fgh"}
    assert required(Term("a*c", phrase=True), exact) == {"a*c"} and required(Term("ÀBCdé"), case) == {"bcd"} and required(Term("abcd"), word) is None


def test_subtrees_without_ancestors(spark):
    """Touched paths meet files by their first parts; no row is made of a file's folders, and files are not shuffled."""
    files = table(spark, [("/r/a", 1, False, None), ("/r/ab", 1, False, None), ("/r/a/b", 1, False, None), ("/r/c/d/e", 1, False, None), ("/r/c/dd", 1, False, None)])
    touched = spark.createDataFrame([("/r/a",), ("/r/a",), ("/r/a/b",), ("/r/c/d",), (None,)], "path string")
    assert sorted(r["full_path"] for r in watch.without(files, touched).collect()) == ["/r/ab", "/r/c/dd"]
    plan = watch.without(files, touched)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "full_path" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    events = spark.createDataFrame([(0, NOW, "/r/a", "removed"), (1, NOW, "/r/c", "modified")], WATCH_EVENT)
    scanned = table(spark, [("/r/c/new", 2, False, None), ("/r/c/new", 2, False, None), ("/r/cc", 2, False, None), ("/r/a/x", 2, False, None)])
    assert sorted(r["full_path"] for r in watch.apply_events(files, events, scanned).collect()) == ["/r/ab", "/r/c/new"]


def test_many_touched_paths(spark, monkeypatch):
    monkeypatch.setattr(watch, "SENT", 0)
    files = table(spark, [(f"/r/{i % 7}/{i}", 1, False, None) for i in range(50)])
    assert watch.without(files, spark.createDataFrame([("/r/3",), ("/r/4/4",)], "path string")).count() == 50 - 7 - 1


def test_snapshots_with_gaps(spark):
    """A file without time or fingerprint on both sides is no news."""
    schema = "path string, mtime long, md5 string"
    known = spark.createDataFrame([("a", None, "x"), ("b", 1, None), ("c", 1, "x")], schema)
    disk = spark.createDataFrame([("a", None, "x"), ("b", 1, None), ("c", None, "x"), ("d", None, None)], schema)
    assert sorted(r["path"] for r in incremental.to_index(disk, known).collect()) == ["c", "d"]


def test_names_in_small_portions(monkeypatch):
    """Trigrams of names are inverted a smaller portion at a time than the words of pages, with the same rows in the index."""
    monkeypatch.setattr(inverted, "NAMED", 10)
    rows = [{"file_ord": i, "block": i - i % 4, "grams": [f"g{(i + k) % 9}" for k in range(4)]} for i in range(20)]
    schema = inverted.pa.schema([("file_ord", "int64"), ("block", "int64"), ("grams", inverted.pa.list_(inverted.pa.string()))])
    sizes = []
    monkeypatch.setattr(inverted, "_by_term", lambda lists, f=inverted._by_term: (sizes.append(len(lists.flatten())), f(lists))[1])
    made = [r for b in inverted.names([inverted.pa.RecordBatch.from_pylist(rows, schema)]) for r in b.to_pylist()]
    assert sizes == [8] * 10
    assert sorted((r["gram"], r["block"], i) for r in made for i in r["rows"]) == sorted((g, r["block"], r["file_ord"]) for r in rows for g in r["grams"])
