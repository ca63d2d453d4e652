"""Writers: file lists, result and inventory tables, playlists, merged sources, JSON and HTML rows."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.functions import formatting
from strataseek.sources import file_list

#: Headings of the result export and of the inventory. Fixed values.
RESULT_HEADINGS = ("文件名", "路径", "位置", "分数", "命中次数", "修改时间(UTC)", "文件大小", "摘要")
INVENTORY_HEADINGS = ("序号", "文件名", "扩展名", "文件地址", "创建时间", "修改时间", "文件大小")


def write_file_list(files: DataFrame, path: str) -> None:
    """A file list in order of the scan, over as many part files as its size asks for."""
    file_list.from_entries(files.orderBy("file_ord")).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def result_rows(results: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """The columns of the result export; sizes of files without data are ``?``."""
    if meta is not None:
        results = results.drop("file_size").join(meta.select("file_id", "file_size"), "file_id", "left")
    values = (
        F.col("filename"),
        F.col("path"),
        F.col("location").cast("string"),
        F.format_string("%.2f", "score"),
        F.col("keyword_count").cast("string"),
        formatting.format_timestamp(F.col("mtime")),
        F.coalesce(formatting.format_file_size(F.col("file_size")), F.lit("?")),
        F.col("snippet"),
    )
    return results.select(*(v.alias(h) for v, h in zip(values, RESULT_HEADINGS, strict=True)))


def write_results(results: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    result_rows(results, meta).write.mode("overwrite").csv(path, header=True, escape='"')


def inventory_rows(inventory: DataFrame) -> DataFrame:
    columns = ("index", "name", "extension", "path", "created", "modified", "size")
    return inventory.orderBy("index").select(*(F.col(c).alias(h) for c, h in zip(columns, INVENTORY_HEADINGS, strict=True)))


def write_inventory(inventory: DataFrame, path: str) -> None:
    inventory_rows(inventory).write.mode("overwrite").csv(path, header=True, escape='"')


def write_xlsx(rows: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A one-sheet workbook on the driver's disk, streamed row by row; numbers as numbers, all else as text."""
    kinds = dict(rows.dtypes)
    numeric = [kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") for c in rows.columns]

    def cell(value, number: bool) -> str:
        if value is None:
            return "<c/>"
        return f"<c><v>{value}</v></c>" if number else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, office, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            out.write(f"<row>{''.join(cell(c, False) for c in rows.columns)}</row>".encode())
            for row in rows.toLocalIterator():
                out.write(f"<row>{''.join(cell(v, n) for v, n in zip(row, numeric, strict=True))}</row>".encode())
            out.write(b"</sheetData></worksheet>")


def write_merged(blocks: DataFrame, path: str) -> None:
    """Blocks (relative_path, block) as text, part files in order of path."""
    lines = blocks.orderBy("relative_path").select(F.regexp_replace("block", "\n\\z", ""))  # the writer ends each row with a line feed
    lines.write.mode("overwrite").text(path)


def write_paths(files: DataFrame, path: str, kind: str = "txt") -> None:
    """Extension: one full path a line, in order over the part files; playlists begin with their mark."""
    lines = files.orderBy("file_ord").select(F.col("full_path").alias("value"))
    if kind in ("m3u", "m3u8"):
        first = files.sparkSession.createDataFrame([("#EXTM3U", 0)], "value string, o int")
        numbered = files.select(F.col("full_path").alias("value"), F.lit(1).alias("o"), "file_ord")
        lines = first.withColumn("file_ord", F.lit(0).cast("long")).unionByName(numbered).orderBy("o", "file_ord").select("value")
    lines.write.mode("overwrite").text(path)


def json_rows(files: DataFrame, most: int = 100) -> DataFrame:
    """Name, path, size and kind of the first results, a JSON object each."""
    shown = F.struct(F.col("file_name").alias("name"), F.col("full_path").alias("path"), "size", "is_directory")
    return files.limit(most).select(F.to_json(shown).alias("json"))


def html_rows(files: DataFrame, most: int = 100) -> DataFrame:
    """Escaped name and folder, formatted size and date of the first results."""
    return files.limit(most).select(
        formatting.html_escape(F.col("file_name")).alias("name"),
        formatting.html_escape(F.col("parent_path")).alias("folder"),
        formatting.format_size(F.col("size")).alias("size"),
        formatting.format_date(F.col("date_modified")).alias("modified"),
    )
