"""Sources, sinks, inventories, extraction, incremental upkeep, histories and streams on small trees."""

import csv
import glob
import io
import json
import os
import struct
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataseek.functions import formatting, paths, tokens
from strataseek.operators import fulltext, history, incremental, listing, search
from strataseek.operators.text_index import TextIndex
from strataseek.schema import FILE_ENTRY, WATCH_EVENT
from strataseek.sources import file_list, fsindex, pages, sinks
from strataseek.streaming import watch


@pytest.fixture()
def tree(tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("tree")
    for name, text in {"a.rs": "fn a() {}", "sub/b.TXT": "hello world", "sub/deep/c.py": "x = 1", "noext": "", ".hidden/d.txt": "secret", "_x.md": "under"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_index_folder(spark, tree):
    found = {r["full_path"][len(str(tree)) :]: r for r in fsindex.index_folder(spark, str(tree)).collect()}
    assert set(found) == {"", "/a.rs", "/noext", "/_x.md", "/sub", "/sub/b.TXT", "/sub/deep", "/sub/deep/c.py"}
    assert found["/sub"]["is_directory"] and found["/sub"]["attributes"]["directory"]
    assert found["/sub/b.TXT"]["extension"] == "TXT" and found["/sub/b.TXT"]["size"] == 11
    assert len({r["file_ord"] for r in found.values()}) == len(found)
    everything = fsindex.index_folder(spark, str(tree), include_hidden=True)
    assert everything.count() == len(found) + 2
    assert fsindex.index_folder(spark, str(tree), depth=1).count() == 5
    assert fsindex.index_folder(spark, str(tree), fast=True).where("date_created IS NOT NULL").isEmpty()


def test_search_over_a_tree(spark, tree):
    df = fsindex.index_folder(spark, str(tree))
    assert [r["file_name"] for r in search.search(df, "ext:txt;rs").collect()] == ["a.rs", "b.TXT"]
    folders = {r["file_name"]: (r["child_files"], r["child_folders"]) for r in search.child_counts(df).collect()}
    assert folders["sub"] == (1, 1) and folders["deep"] == (1, 0)


def test_file_list_round_trip(spark, tree, tmp_path):
    df = fsindex.index_folder(spark, str(tree))
    out = str(tmp_path / "list")
    sinks.write_file_list(df, out)
    (name,) = glob.glob(f"{out}/*.csv")
    with open(name) as f:
        assert next(csv.reader(f)) == ["filename", "size", "date_created", "date_modified", "date_accessed", "attributes"]
    back = file_list.to_entries(file_list.load(spark, out), "list")
    key = lambda d: sorted((r["full_path"], r["file_name"], r["size"], r["is_directory"], r["extension"]) for r in d.collect())
    assert key(back) == key(df)
    assert back.where("file_list_filename <> 'list'").isEmpty() and not back.where("date_modified IS NOT NULL").isEmpty()
    assert file_list.to_entries(file_list.load(spark, out), "list", compat=True).where("date_modified IS NOT NULL").isEmpty()


def test_broken_file_list(spark, tmp_path):
    path = tmp_path / "bad.efu"
    path.write_text("filename,size,date_created,date_modified,date_accessed,attributes\n/a/b.txt,x,,,,\n/a,1\n")
    assert file_list.load(spark, str(path), broken_is_empty=True).isEmpty()
    path.write_text("filename,size,date_created,date_modified,date_accessed,attributes\n/a/b.txt,x,,,,\n")
    assert [tuple(r)[:2] for r in file_list.load(spark, str(path)).collect()] == [("/a/b.txt", 0)]


def test_database(spark, tmp_path):
    import bz2

    data = {"magic": "EZDB", "entries": [{"full_path": "/a/b.txt", "file_name": "b.txt", "size": 7, "is_directory": False}]}
    (tmp_path / "db.json.bz2").write_bytes(bz2.compress(json.dumps(data).encode()))
    df = file_list.load_database(spark, str(tmp_path / "db.json.bz2"))
    assert [(r["full_path"], r["size"]) for r in df.collect()] == [("/a/b.txt", 7)]
    assert file_list.load_database(spark, str(tmp_path / "missing")).isEmpty()
    file_list.save_database(df, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db")).count() == 1


@pytest.mark.parametrize("rows", [0, 7])
def test_database_as_json(spark, tree, tmp_path, rows):
    df = fsindex.index_folder(spark, str(tree)).limit(rows)
    file_list.save_database(df.repartition(3), str(tmp_path / "db"), "json")
    assert all(f.endswith(".bz2") for f in glob.glob(str(tmp_path / "db" / "part-*")))
    back = file_list.load_database(spark, str(tmp_path / "db"))
    key = lambda d: sorted(map(repr, d.drop("date_created", "date_modified", "date_accessed", "date_recently_changed", "date_run").collect()))
    assert back.count() == rows and key(back) == key(df)
    assert back.select("date_modified").subtract(df.select(F.date_trunc("millisecond", "date_modified"))).isEmpty()


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_extraction(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p("one")}{p(" ")}<w:tbl>{p("cell")}</w:tbl>{p("two")}</w:body></w:document>'})
    slide = '<p xmlns:a="x"><a:t>{}</a:t></p>'
    pptx = _zip({"ppt/slides/slide1.xml": slide.format("first"), "ppt/slides/slide2.xml": slide.format(" "), "ppt/slides/slide3.xml": slide.format("third"), "ppt/slides/slide5.xml": slide.format("lost")})
    rows = [("/x/a.docx", docx), ("/x/b.PPTX", pptx), ("/x/c.txt", "été".encode()), ("/x/bad.txt", b"\xff"), ("/x/bad.docx", b"no zip"), ("/x/d.pdf", b"%PDF"), ("/x/g.xls", b"?"), ("/x/e.bin", b"?"), ("/x/f.txt", None)]
    got = pages.extract(spark.createDataFrame(rows, "path string, content binary")).collect()
    good = sorted((r["path"], r["location"], r["text"]) for r in got if r["error"] is None)
    assert good == [("/x/a.docx", 1, "one"), ("/x/a.docx", 2, "two"), ("/x/b.PPTX", 1, "first"), ("/x/b.PPTX", 3, "third"), ("/x/c.txt", 1, "été"), ("/x/f.txt", 1, "")]
    assert sorted(r["path"] for r in got if r["error"]) == ["/x/bad.docx", "/x/bad.txt", "/x/d.pdf", "/x/g.xls"]
    assert pages.split_pages("a\f \fb\n") == [(1, "a"), (3, "b")]
    assert pages.split_pages(" ") == []
    assert pages.eligible(spark.createDataFrame([("/a/b.PDF",), ("/a/pdf",), ("/c.exe",), (None,)], "path string")).first()["files"] == 1


def _pdf(objects, ahead=b""):
    return b"%PDF-1.7\n" + ahead + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer <</Root 1 0 R>>\n%%EOF"


def _stream(data, entries=b""):
    return b"<</Length %d %s>>\nstream\n%s\nendstream" % (len(data), entries, data)


def test_text_layer():
    packed = _stream(zlib.compress(b"BT /F1 12 Tf 72 700 Td (Gr\\374n \\(a\\)) Tj 0 -14 Td [(wo) -20 (rd) -300 (next)] TJ ET"), b"/Filter /FlateDecode")
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0001> <0002> <6587> <0005> <0006> [<0041> <00420043>] endbfrange 1 beginbfchar <0009> <D83DDE00> endbfchar"
    unpacked = {
        1: b"<</Type /Catalog /Pages 2 0 R>>",
        2: b"<</Type /Pages /Kids [6 0 R 3 0 R 9 0 R] /Count 3 /Resources <</Font <</F1 5 0 R>>>>>>",
        3: b"<</Type /Page /Parent 2 0 R /Contents [4 0 R]>>",
        4: packed,
        5: b"<</Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding>>",
        6: b"<</Type /Page /Contents 7 0 R /Resources <</Font <</F2 8 0 R>> /XObject <</X 11 0 R>>>>>>",
        7: _stream(b"q /X Do Q BT /F2 9 Tf <000100020005> Tj T* <00060009> Tj ET BI /W 1 ID (BT) EI BT (x) Tj ET"),
        8: b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 10 0 R>>",
        9: b"<</Type /Page>>",
        10: _stream(cmap),
        11: _stream(b"BT /F2 9 Tf <0005> Tj ET", b"/Subtype /Form"),
    }
    expected = [(1, "A\n文斈A\nBC\U0001f600"), (2, "Grün (a)\nword next")]
    assert pages.pdf(_pdf(unpacked)) == expected
    inner = {n: unpacked[n] for n in (1, 2, 3, 5)}
    places, body = [], b""
    for n, o in inner.items():
        places.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    head = b" ".join(places) + b" "
    rows = head + body
    wide = 16
    rows += b" " * (-len(rows) % wide)
    up, before = b"", bytes(wide)
    for at in range(0, len(rows), wide):
        row = rows[at : at + wide]
        up, before = up + b"\2" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True)), row
    objects = {n: o for n, o in unpacked.items() if n not in inner}
    objects[12] = _stream(zlib.compress(up), b"/Type /ObjStm /N 4 /First %d /Filter [/FlateDecode] /DecodeParms [<</Predictor 12 /Columns %d>>]" % (len(head), wide))
    assert pages.pdf(_pdf(objects)) == expected
    assert pages.pdf(_pdf({1: b"<</Type /Catalog>>"})) == [(1, "")]
    with pytest.raises(ValueError, match="encrypted"):
        pages.pdf(_pdf(unpacked) + b"trailer <</Encrypt 9 0 R>>")


def _compound(stream, small):
    """A compound file that holds the stream, among its small ones or not."""
    sector = lambda b: b + bytes(-len(b) % 512)
    chain = lambda at, n: [*range(at + 1, at + n), 0xFFFFFFFE]
    n = -(-len(stream) // 512)
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(48) + struct.pack("<IQ", start, size)
    table = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *chain(3, n)]
    minis = chain(0, -(-len(stream) // 64))
    top = entry("Root Entry", 5, 3 if small else 0xFFFFFFFE, len(stream) if small else 0) + entry("Workbook", 2, 0 if small else 3, len(stream))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096 if small else 0, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    pad = lambda x: sector(b"".join(struct.pack("<I", i) for i in x))
    return head + pad(table) + sector(top) + pad(minis) + sector(stream)


@pytest.mark.parametrize("small", [False, True])
def test_binary_workbook(small):
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    at = lambda r, c, form, *v: struct.pack(f"<HHH{form}", r, c, 0, *v)
    bof, eof = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)), record(0x0A, b"")
    text = lambda s, wide: struct.pack("<HB", len(s), wide) + s.encode("utf-16-le" if wide else "latin-1")
    # the second string goes on in the next record, wide there
    shared = record(0xFC, struct.pack("<II", 2, 2) + text("文档", 1) + struct.pack("<HB", 4, 0) + b"ab") + record(0x3C, b"\1" + "cd".encode("utf-16-le"))
    cells = [(0xFD, at(0, 1, "I", 0)), (0xFD, at(1, 1, "I", 1)), (0x203, at(1, 2, "d", 0.1)), (0x27E, at(2, 1, "I", (7 << 2) | 2)), (0x205, at(2, 2, "BB", 1, 0)), (0xBD, at(3, 1, "IHIH", (150 << 2) | 3, 0, 0xFFFFFFF2, 0))]
    cells += [(0x06, at(4, 1, "d", 3.0) + bytes(8)), (0x06, at(4, 2, "B5xH", 0, 0xFFFF) + bytes(8)), (0x207, text("sum", 0)), (0x205, at(5, 2, "BB", 7, 1))]
    sheet = bof + b"".join(record(k, b) for k, b in cells) + eof
    names = [b"One", b"Two"]
    size = len(bof) + sum(4 + 8 + len(n) for n in names) + len(shared) + len(eof)
    places = [size, size + len(sheet)]
    bound = b"".join(record(0x85, struct.pack("<IBBBB", p, 0, 0, len(n), 0) + n) for p, n in zip(places, names, strict=True))
    stream = bof + bound + shared + eof + sheet + bof + eof
    assert pages.xls(_compound(stream, small)) == [(1, "文档  \nabcd 0.1 \n7 true \n1.5 -4 \n3 sum \n  \n")]
    with pytest.raises(ValueError):
        pages.xls(b"PK")


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    sinks.write_xlsx(spark.createDataFrame([(1, "a<b", None), (2, "x", "y")], "n int, s string, t string").orderBy("n"), path)
    with open(path, "rb") as f:
        assert pages.xlsx(f.read()) == [(1, "n s t \n1 a<b  \n2 x y \n")]


def test_document_upkeep(spark, tree):
    docs = pages.documents(spark, str(tree)).drop("content")
    assert [r["filename"] for r in docs.collect()] == ["b.TXT"]
    known = docs.withColumn("file_id", F.lit(5).cast("long"))
    changed = docs.withColumn("mtime", F.col("mtime") + 1).unionByName(docs.withColumn("path", F.lit("/new")))
    assert [tuple(r) for r in incremental.compare_index(known, changed).collect()] == [(1, 1, 0)]
    assert incremental.to_index(docs, known).isEmpty()
    assert sorted(r["file_id"] for r in incremental.assign_ids(known, changed).collect()) == [5, 6]
    table = spark.createDataFrame([(1, 1, "old"), (2, 1, "keep"), (3, 1, "gone")], "file_id long, location long, body string")
    new = spark.createDataFrame([(1, 1, "new")], "file_id long, location long, body string")
    out = incremental.upsert_pages(table, new, spark.createDataFrame([(3,)], "file_id long"))
    assert sorted(r["body"] for r in out.collect()) == ["keep", "new"]


def test_inventory_and_sinks(spark, tree, tmp_path):
    df = fsindex.index_folder(spark, str(tree))
    assert [r["extension"] for r in listing.extensions(df).collect()] == sorted(["rs", "txt", "py", "md", listing.NO_EXTENSION])
    inventory = listing.inventory(df)
    assert sorted(r["index"] for r in inventory.collect()) == [1, 2, 3, 4, 5]
    sinks.write_inventory(inventory, str(tmp_path / "inv"))
    assert [r["relative_path"] for r in listing.sources(df, str(tree)).collect()] == ["_x.md", "a.rs", "sub/b.TXT", "sub/deep/c.py"]
    code = listing.sources(df, str(tree), "A.R").withColumn("content", F.lit("fn a() {}"))
    sinks.write_merged(listing.merged_text(code), str(tmp_path / "merged"))
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(str(tmp_path / "merged" / "part-*"))))
    assert text == f"===== 文件: a.rs =====\n路径: {tree}/a.rs\n文件名: a.rs\n--- 代码 ---\nfn a() {{}}\n--- 结束 ---\n\n"
    broken = listing.merged_text(code.withColumn("content", F.lit(None).cast("string")), error=F.lit("denied"))
    assert "[读取失败: denied]" in broken.first()["block"]
    sinks.write_paths(df, str(tmp_path / "list"), "m3u")
    (name,) = glob.glob(str(tmp_path / "list" / "part-*"))
    with open(name) as f:
        assert f.readline() == "#EXTM3U\n" and len(f.readlines()) == df.count()
    assert json.loads(sinks.json_rows(df.where("file_name = 'a.rs'")).first()["json"])["name"] == "a.rs"


def test_renaming(spark):
    R = listing.RenameRule
    df = spark.createDataFrame([(i, f"/d/f{i}.txt", f"f{i}.txt", "/d") for i in range(12)], "file_ord long, full_path string, file_name string, parent_path string")
    new = [r["new_path"] for r in listing.rename_preview(df, [R(find="f", replace="g", prefix="p-", counter_format="_{n}"), R(suffix="!", new_extension="md")]).orderBy("number").collect()]
    assert new[0] == "/d/p-g0_1!.md" and new[11] == "/d/p-g11_12!.md"
    assert listing.rename_preview(df, [R()], "/e/").orderBy("number").first()["new_path"] == "/e/f0.txt"
    name = lambda n, k, *rules: one(spark, listing.renamed(F.lit(n), F.lit(k), list(rules)))
    assert name("a.txt", 1500, R(counter_format="{N}")) == "a1500.txt"
    assert name(".bashrc", 1, R(prefix="x")) == "x.bashrc"
    assert name("a", 1, R(counter_format="{N}{x}")) == "a"


def test_renaming_files(spark, tree):
    preview = lambda *rows: spark.createDataFrame([(i, f"{tree}/{a}", f"{tree}/{b}") for i, (a, b) in enumerate(rows)], "number long, old_path string, new_path string")
    listing.rename(preview(("a.rs", "b.rs"), ("sub", "other")))
    assert (tree / "b.rs").exists() and not (tree / "a.rs").exists() and (tree / "other/deep/c.py").exists()
    assert len(listing.rename(preview(("other", "sub"), ("b.rs", "c.rs")), copy=True)) == 2
    assert (tree / "sub/deep/c.py").read_text() == "x = 1" and (tree / "b.rs").exists() and (tree / "c.rs").exists()
    with pytest.raises(OSError, match="1 files done"):
        listing.rename(preview(("b.rs", "d.rs"), ("none", "x"), ("c.rs", "e.rs")))
    assert (tree / "d.rs").exists() and (tree / "c.rs").exists()


def test_rebuilding(spark, tree, tmp_path):
    turns = []
    query = watch.rebuild(spark, lambda: fsindex.index_folder(spark, str(tree)), lambda df, n: turns.append((n, df.count())), str(tmp_path / "c"), "1 second")
    for _ in range(120):
        if len(turns) > 1:
            break
        query.awaitTermination(0.5)
    query.stop()
    assert len(turns) > 1 and turns[0][1] == 8


@pytest.mark.parametrize("n, shown, document", [(0, "0 B", "0 B"), (999, "999 B", "999 B"), (1000, "0.98 KB", "1000 B"), (1023, "1.00 KB", "1023 B"), (1536, "1.50 KB", "1.5 KB"), (10**6, "0.95 MB", "976.6 KB"), (5 << 30, "5.00 GB", "5120.0 MB"), (10**18, f"{10**18} B", "953674316406.2 MB")])
def test_sizes(spark, n, shown, document):
    assert one(spark, formatting.format_size(F.lit(n))) == shown
    assert one(spark, formatting.format_file_size(F.lit(n))) == document


def test_text_helpers(spark):
    assert one(spark, formatting.byte_slice(F.lit("aé日x"), F.lit(2), F.lit(2))) == "é"  # the length counts from the character that the start lies in
    assert one(spark, formatting.byte_slice(F.lit("aé日x"), F.lit(2), F.lit(3))) == "é日"
    hits = fulltext.with_hits(spark.createDataFrame([(1, 1, "日" * 300 + "词"), (2, 1, "none"), (3, 1, "aaa词a")], "file_id long, location long, body string"), ["词", "a"])
    found = {r["file_id"]: [tuple(h) for h in r["hits"]] for r in hits.collect()}
    assert found == {1: [(1, "日" * 84 + "词", "词")], 2: [], 3: [(1, "aaa词a", "词")] + [(1, "aaa词a", "a")] * 4}
    assert one(spark, formatting.byte_slice(F.lit("abc"), F.lit(1), F.lit(99))) == "bc"
    assert one(spark, formatting.ellipsis(F.lit("日本語"), 2)) == "日本..."
    assert one(spark, formatting.html_escape(F.lit('<a&"b">'))) == "&lt;a&amp;&quot;b&quot;&gt;"
    assert one(spark, formatting.highlight(F.lit("ab b"), ["a", "b"])) == "【a】【b】 【b】"
    assert one(spark, formatting.format_timestamp(F.lit(10**15))) == "时间错误"
    assert one(spark, paths.parent(F.lit("/a"))) == "/" and one(spark, paths.parent(F.lit("a"))) == "" and one(spark, paths.parent(F.lit("/a/b/"))) == "/a"
    assert one(spark, paths.extension(F.lit(".bashrc"))) == "" and one(spark, paths.extension(F.lit("a.b.c"))) == "c"
    assert tokens.segment("Ab, 中国人 x_1") == ["ab", "中国", "国人", "x", "1"]


def test_fulltext(spark, tmp_path):
    rows = [(1, 1, "The quick brown fox"), (2, 1, "quick quick fox"), (3, 1, "brown the quick"), (4, 1, " "), (5, 2, None)]
    df = spark.createDataFrame(rows, "file_id long, location long, body string")
    index = TextIndex.create(df, str(tmp_path / "ix"))
    for rank in (lambda q: fulltext.rank(df, q), index.rank):
        ids = lambda q, r=rank: {x["file_id"] for x in r(q).collect()}
        assert ids("fox") == {1, 2} and ids("quick AND brown") == {1, 3} and ids("quick NOT brown") == {2}
        assert ids('"quick brown"') == {1} and ids("+quick -the") == {2} and ids("br*") == {1, 3} and ids("NOT fox") == set()
        assert ids("(fox OR brown) AND the") == {1, 3} and ids("f?x AND the") == {1}
        assert ids("zzz") == set()
    best = [r["file_id"] for r in fulltext.top(fulltext.rank(df, "quick fox")).collect()]
    assert best[0] == 2
    scores = lambda ranked: sorted((r["file_id"], round(r["score"], 9)) for r in ranked.collect())
    assert scores(fulltext.rank(df, "quick fox the")) == scores(index.rank("quick fox the"))


def test_fulltext_results(spark, tmp_path):
    body = "é" * 300 + " fox and fox"
    df = spark.createDataFrame([(1, 1, body), (2, 1, "fox"), (3, 1, "fox gone")], "file_id long, location long, body string")
    meta = spark.createDataFrame([(1, "/d/B.txt", "B.txt", 10, "x", 700), (2, "/d/a.txt", "a.txt", 20, "x", 3)], "file_id long, path string, filename string, mtime long, md5 string, file_size long")
    index = TextIndex.create(df, str(tmp_path / "ix"))
    got = fulltext.search(index, meta, "fox", order="name_asc").collect()
    assert [r["filename"] for r in got] == ["a.txt", "B.txt"]  # a page without data of its file is left out
    assert got[1]["keyword_count"] == 2 and len(got[1]["hits"]) == 2 and got[1]["snippet"].endswith("...")
    assert got[0]["snippet"] == "【fox】" and got[1]["hits"][0]["snippet"].startswith("é")
    assert [r["filename"] for r in fulltext.sort_results(spark.createDataFrame(got), "name_desc").collect()] == ["B.txt", "a.txt"]
    assert [r["filename"] for r in fulltext.sort_results(spark.createDataFrame(got), "name_desc", compat=True).collect()] == ["a.txt", "B.txt"]
    rows = sinks.result_rows(spark.createDataFrame(got), meta).orderBy("路径").collect()
    assert rows[0]["文件大小"] == "700 B" and rows[0]["修改时间(UTC)"] == "1970-01-01 00:00:10"
    assert fulltext.search(df, meta, "  ").isEmpty() and fulltext.search(index, meta, "  ").isEmpty()


def test_case_of_counts_and_hits(spark):
    """Words are found in any case; they are counted and shown in any case too, unless that is switched off."""
    df = spark.createDataFrame([(1, 1, "Only Trash capital"), (2, 1, "Trash trash TRASH")], "file_id long, location long, body string")
    meta = spark.createDataFrame([(i, f"/d/{i}.txt", f"{i}.txt", 10, 1) for i in (1, 2)], "file_id long, path string, filename string, mtime long, file_size long")
    found = lambda **k: {r["file_id"]: (r["keyword_count"], len(r["hits"]), r["snippet"]) for r in fulltext.search(df, meta, "Trash", **k).collect()}
    assert found() == {1: (1, 1, "only 【trash】 capital"), 2: (3, 3, "【trash】 【trash】 【trash】")}
    assert found(ignore_case=False) == {1: (1, 1, "Only 【Trash】 capital"), 2: (1, 1, "【Trash】 trash TRASH")}


def events(spark, *rows):
    return spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i), p, k) for i, (p, k) in enumerate(rows)], WATCH_EVENT)


def test_histories(spark):
    e = events(spark, ("/a", "opened"), ("/b", "opened"), ("/a", "opened"), ("/c", "added"))
    runs = history.run_history(e)
    assert [(r["path"], r["run_count"]) for r in history.most_run(runs, 5).collect()] == [("/a", 2), ("/b", 1)]
    assert history.last_run(runs, 1).first()["path"] == "/a"
    assert [r["path"] for r in history.run_history(e, 1).collect()] == ["/b"]
    assert {r["path"]: r["run_count"] for r in history.increment(runs, e).collect()} == {"/a": 4, "/b": 2}
    log = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, ""), (5, None)], "seq long, query string")
    assert [r["query"] for r in history.recent_searches(log).collect()] == ["x", "y"]
    assert [r["query"] for r in history.first_searches(log).collect()] == ["y", "x"]


def file_rows(spark, *names):
    return spark.createDataFrame([{f.name: None for f in FILE_ENTRY} | {"full_path": p, "file_ord": i, "size": s} for i, (p, s) in enumerate(names)], FILE_ENTRY)


def test_events(spark):
    files = file_rows(spark, ("/r/a", 1), ("/r/d", 0), ("/r/d/x", 2), ("/r/dx", 3))
    e = events(spark, ("/r/a", "removed"), ("/r/a", "added"), ("/r/d", "removed"), ("/r/n", "added"), ("/r/dx", "opened"))
    now = file_rows(spark, ("/r/a", 9), ("/r/n", 5), ("/r/n/y", 6), ("/r/other", 7))
    got = {r["full_path"]: r["size"] for r in watch.apply_events(files, e, now).collect()}
    assert got == {"/r/a": 9, "/r/dx": 3, "/r/n": 5, "/r/n/y": 6}
    again = watch.apply_events(watch.apply_events(files, e, now), e, now)
    assert sorted(r["full_path"] for r in again.collect()) == sorted(got)


def test_walk_by_levels(spark, tree, tmp_path):
    """The same rows in the same order as the walk by subtrees; a single deep folder is listed by several tasks."""
    for how in ({}, {"include_hidden": True}, {"depth": 1}, {"depth": 0}):
        want = fsindex.index_folder(spark, str(tree), **how).orderBy("file_ord").drop("file_ord", "date_accessed").collect()
        got = fsindex.index_by_levels(spark, str(tree), **how).orderBy("file_ord")
        assert got.drop("file_ord", "date_accessed").collect() == want
        assert [r["file_ord"] for r in got.collect()] == list(range(len(want)))
    deep = tmp_path / "root" / "only"
    for i in range(12):
        (deep / f"d{i}").mkdir(parents=True)
        (deep / f"d{i}" / "f.txt").write_text("x")
    paths = lambda df: [r["full_path"] for r in df.orderBy("file_ord").collect()]
    assert paths(fsindex.index_by_levels(spark, str(tmp_path / "root"))) == paths(fsindex.index_folder(spark, str(tmp_path / "root")))
    assert fsindex.index_by_levels(spark, str(tmp_path / "none")).count() == 0


def test_following_a_tree(spark, tree, tmp_path):
    fsindex.register(spark)
    state, version = tmp_path / "state", [spark.createDataFrame([], FILE_ENTRY)]

    def save(df, number):
        path = str(tmp_path / f"v{number}")
        df.write.mode("overwrite").parquet(path)
        version[0] = spark.read.parquet(path)

    stream = spark.readStream.format("fswatch").options(path=str(tree), state=str(state)).load()
    q = watch.follow(stream, lambda: version[0], lambda last: fsindex.index_folder(spark, str(tree)), save, str(tmp_path / "cp"), processingTime="0 seconds")
    try:
        q.processAllAvailable()
        assert version[0].count() == 8
        os.remove(tree / "a.rs")
        (tree / "sub" / "new.txt").write_text("n")
        for _ in range(50):
            q.processAllAvailable()
            names = {r["file_name"] for r in version[0].collect()}
            if "new.txt" in names:
                break
        assert "new.txt" in names and "a.rs" not in names
    finally:
        q.stop()


def test_activity_stream(spark, tmp_path):
    events(spark, ("/a", "added"), ("/b", "added"), ("/a", "removed")).write.parquet(str(tmp_path / "in"))
    q = watch.activity(watch.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.sql("SELECT * FROM activity").collect()} == {("added", 2), ("removed", 1)}
