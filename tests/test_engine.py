"""The engine object, the command line and the catalogue."""

import pytest

from strataseek.engine import Catalog, Engine, Source, file_parts, parse_command, run_command
from strataseek.plans.options import SortField, SortSpec
from strataseek.sources.versions import Raced


def test_engine(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    (tmp_path / "d" / "b.mp3").write_text("yy")
    (tmp_path / "l.efu").write_text("filename,size,date_created,date_modified,date_accessed,attributes\n/z/c.txt,9,,,,\n")
    engine = Engine(spark, [Source("folder", str(tmp_path / "d")), Source("file_list", str(tmp_path / "l.efu")), Source("folder", "/nowhere", enabled=False), Source("ntfs", "C:")])
    engine.build()
    assert engine.totals() == (4, 3, 1)
    assert [r["file_name"] for r in engine.search("ext:txt").collect()] == ["a.txt", "c.txt"]
    assert engine.quick_search("a.txt", 1 << 40).count() == 1
    path = str(tmp_path / "d" / "a.txt")
    engine.increment_run_count(path)
    engine.increment_run_count(path)
    engine.set_run_count("/z/c.txt", 7)
    assert engine.run_count(path) == 2 and engine.run_count("/none") == 0
    assert [r["file_name"] for r in engine.search("runcount:>1").collect()] == ["a.txt", "c.txt"]
    assert file_parts(engine.search("a.txt")).first()["is_file_result"]
    assert run_command(engine, ["-get-result-count", "ext:txt"]) == 2
    assert [r["file_name"] for r in run_command(engine, ["-sort", "size", "-sort-descending", "-n", "1", "ext:txt"]).collect()] == ["c.txt"]
    assert run_command(engine, ["-get-run-count", path]) == 2
    run_command(engine, ["-txt", str(tmp_path / "out"), "ext:txt"])
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    shown = run_command(engine, ["-size", "-name", "-highlight", "-pause", "-timeout", "9", "c.txt"])
    assert [tuple(r) for r in shown.collect()] == [(9, "c.txt", "/z/【c.txt】")]
    assert run_command(engine, ["-hide-empty-search-results"]).isEmpty() and "-sort" in run_command(engine, ["-help"])
    before = engine.files
    assert engine.use(engine.sources) is before
    assert [r["file_name"] for r in engine.use([Source("file_list", str(tmp_path / "l.efu"))]).collect()] == ["c.txt"]


def test_command_line():
    c = parse_command(["-r", "-p", "-o", "5", "-sort", "dm", "-sort-descending", "^a", "b"])
    assert c.query == "^a b" and c.options.regex and c.options.match_path and c.options.offset == 5
    assert c.options.sort == SortSpec(SortField.DATE_MODIFIED, True) and c.options.max_results == 0
    assert parse_command(["a", "-unknown", "b", "-n", "x"]).query == "a -unknown b"


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "base"))
    assert catalog.databases() == []
    a, b = catalog.create("one", "/r1"), catalog.create("two", "/r2")
    catalog.activate(b)
    assert catalog.active()["name"] == "two" and {r["id"] for r in catalog.databases()} == {a, b}
    catalog.delete(b)
    assert [r["id"] for r in catalog.databases()] == [a] and catalog.active() is None
    # documents of a database, and a second writer
    assert catalog.documents(a) == 0
    catalog.index(a).upsert(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "file_id long, location long, body string"))
    assert catalog.documents(a) == 2
    other, last = Catalog(spark, str(tmp_path / "base")), catalog.versions.last
    other.versions.last = lambda: (last()[0] - 1, last()[1])  # has read the state before another wrote
    with pytest.raises(Raced):
        other.create("late", "/r3")
    catalog.delete(a)
    assert catalog.databases() == []
