"""Pages of documents: (location, text) of pdf (its text layer), txt, docx, xlsx, xls and pptx files.

Contents come through Spark's binary reader, so any store that it reads will do. A
file that can't be read gives one row with its error and no page. Readers are this package's own;
``EXTRACTORS`` takes others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.functions import formatting, paths
from strataseek.sources.pdf import page_texts
from strataseek.sources.xls import sheets

#: Extensions that are indexed. Fixed values.
INDEXABLE = "pdf docx txt xlsx xls pptx".split()

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def split_pages(text: str) -> list[tuple[int, str]]:
    """Pages of a text layer, parted by form feeds: numbered before blank ones go."""
    return [(i, p.strip()) for i, p in enumerate(text.split("\f"), 1) if p.strip()]


def txt(data: bytes) -> list[tuple[int, str]]:
    return [(1, data.decode("utf-8"))]


def docx(data: bytes) -> list[tuple[int, str]]:
    """Top-level paragraphs that aren't blank, counted."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    texts = ["".join(t.text or "" for r in p.findall(f"{_W}r") for t in r.findall(f"{_W}t")) for p in (body if body is not None else []) if p.tag == f"{_W}p"]
    return list(enumerate((t for t in texts if t.strip()), 1))


def pdf(data: bytes) -> list[tuple[int, str]]:
    """Pages with text; a file without pages gives an empty first one."""
    found = page_texts(data)
    return split_pages("\f".join(t.replace("\f", " ") for t in found)) if found else [(1, "")]


def xlsx(data: bytes) -> list[tuple[int, str]]:
    """A page for each sheet with a value: its used range, cells followed by a space, rows by a line feed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            rows = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row")
            out.append(_ranged(rows, shared))
    return _sheet_pages(out)


def xls(data: bytes) -> list[tuple[int, str]]:
    """As ``xlsx``."""
    return _sheet_pages([[[_plain(v) for v in row] for row in sheet] for sheet in sheets(data)])


def _sheet_pages(found: list[list[list[str]]]) -> list[tuple[int, str]]:
    texts = ["".join("".join(f"{v} " for v in row) + "\n" for row in rows) for rows in found]
    return [(i, t) for i, t in enumerate(texts, 1) if t.strip()] or [(1, "")]


def _plain(value: str | float | bool | None) -> str:
    """A cell's value as text: numbers without exponent, whole ones without fraction."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else format(Decimal(repr(value)), "f")
    return value or ""


def _ranged(rows: Iterable[ElementTree.Element], shared: list[str]) -> list[list[str]]:
    """The cells of the used range, missing ones blank; a cell or row that doesn't name its place follows the one before."""
    cells, line = {}, 0
    for row in rows:
        line, column = int(row.get("r") or line + 1), 0
        for c in row.findall(f"{_S}c"):
            named = re.match("[A-Z]+", c.get("r") or "")
            column = reduce(lambda n, x: 26 * n + ord(x) - 64, named[0], 0) if named else column + 1
            cells[line, column] = _cell(c, shared)
    if not cells:
        return []
    lines, columns = [x for x, _ in cells], [x for _, x in cells]
    return [[cells.get((i, j), "") for j in range(min(columns), max(columns) + 1)] for i in range(min(lines), max(lines) + 1)]


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, value = c.get("t"), c.findtext(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if value is None or kind == "e":
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    return _plain(float(value)) if kind in (None, "n") else value


def pptx(data: bytes) -> list[tuple[int, str]]:
    """Slides 1, 2, ... up to the first that is missing; their text nodes joined, blank slides left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, n = set(z.namelist()), 1
        while f"ppt/slides/slide{n}.xml" in names:
            text = "".join(ElementTree.fromstring(z.read(f"ppt/slides/slide{n}.xml")).itertext())
            if text.strip():
                out.append((n, text))
            n += 1
    return out or [(1, "")]


EXTRACTORS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {"pdf": pdf, "docx": docx, "txt": txt, "xlsx": xlsx, "xls": xls, "pptx": pptx}

PAGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("location", T.LongType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def extract(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """Pages of files (path, content): path, location, text, error. An unknown extension has no pages."""
    readers = extractors or EXTRACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(b.schema.get_field_index("path")).to_pylist(), b.column(b.schema.get_field_index("content")).to_pylist(), strict=True):
                found = re.search(r"[^/]\.([^./]*)$", path or "")
                reader = readers.get(found[1].lower()) if found else None
                if not reader:
                    continue
                try:
                    rows += [(path, n, t, None) for n, t in reader(content or b"")]
                except Exception as e:  # noqa: BLE001  a broken file must not end the job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PAGES.names)

    return files.select("path", "content").mapInArrow(run, PAGES)


def eligible(files: DataFrame) -> DataFrame:
    """How many of the files (path) an index would take in."""
    wanted = F.lower(paths.extension(paths.file_name(F.col("path")))).isin(INDEXABLE)
    return files.agg(F.count_if(wanted).alias("files"))


def _described(found: DataFrame) -> DataFrame:
    name = paths.file_name(F.col("path"))
    own = found.where(F.lower(paths.extension(name)).isin(INDEXABLE))
    return own.select("path", name.alias("filename"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("file_size"), formatting.fingerprint(F.col("content")).alias("md5"), "content")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Indexable files below a folder: path, filename, mtime (epoch seconds), file_size, md5 (the fingerprint), content."""
    return _described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))


def documents_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """As ``documents``, of some files by their paths; all of them exist."""
    if not files:
        return _described(spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary"))
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]  # paths are read as patterns
    return _described(spark.read.format("binaryFile").load(escaped))
