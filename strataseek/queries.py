"""The registered queries over the file and document operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek import fixtures
from strataseek.functions import formatting, paths, tokens
from strataseek.functions.segment import Segmenter
from strataseek.operators import fulltext, history, incremental, listing, search
from strataseek.operators.name_index import NameIndex
from strataseek.operators.text_index import TextIndex
from strataseek.plans.options import SearchOptions, SortField, SortSpec
from strataseek.sources import scratch, sinks
from strataseek.streaming import counters, watch

Query = Callable[[SparkSession, str], DataFrame]

#: The day that date words are read against.
NOW = datetime(2001, 8, 1)
#: Columns of the rows that a search returns.
SHOWN = ("file_ord", "full_path", "size", "is_directory")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = fixtures.with_views(sql)
        return f

    return add


def _matching(name: str, query: str, where: str, compat: bool = False, **options) -> None:
    """A query that returns all rows a search matches."""
    shown = ", ".join(SHOWN)

    @registered(f"SELECT {shown} FROM file_entries WHERE {where}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matching(fixtures.files(spark, sf_dir), query, SearchOptions(**options), NOW, compat).select(*SHOWN)


def _types(names: str) -> str:
    return "NOT is_directory AND lower(extension) IN (" + ", ".join(f"'{x}'" for x in names.split()) + ")"


_AUDIO, _DOC = _types("mp3 wav flac aac ogg wma m4a opus"), _types("doc docx pdf txt rtf odt xls xlsx ppt pptx csv")

_matching("name_substring", "report", "contains(lower(file_name), 'report')")
_matching("name_two_terms", "order 12", "contains(lower(file_name), 'order') AND contains(lower(file_name), '12')")
_matching("name_case", "case: Report", "contains(file_name, 'Report')")
_matching("path_substring", "path: cust1/f", "contains(lower(full_path), 'cust1/f')")
_matching("whole_word", "ww: order", r"regexp_matches(file_name, '(?i)\border\b')")
_matching("wildcard_star", "*.mp3", r"regexp_matches(lower(file_name), '^.*\.mp3$')")
_matching("wildcard_upper", "*.FLAC", r"regexp_matches(lower(file_name), '^.*\.flac$')")
_matching("wildcard_upper_compat", "*.FLAC", "false", compat=True)
_matching("wildcard_question", "order-???.txt", r"regexp_matches(lower(file_name), '^order-...\.txt$')")
_matching("negation", "!report 1", "NOT contains(lower(file_name), 'report') AND contains(lower(file_name), '1')")
_matching("or_groups", "report mp3 | 文档 | order 99", "(contains(lower(file_name), 'report') AND contains(lower(file_name), 'mp3')) OR contains(file_name, '文档') OR (contains(lower(file_name), 'order') AND contains(lower(file_name), '99'))")
_matching("or_with_filter", "test | 文档 size:>1mb", "(contains(lower(file_name), 'test') OR contains(file_name, '文档')) AND (is_directory OR size > 1048576)")
_matching("phrase", '"test 1"', "contains(lower(file_name), 'test 1')")
_matching("unknown_function_is_text", "foo:1 | order", "contains(lower(file_name), 'foo:1') OR contains(lower(file_name), 'order')")
_matching("idle_function", "content:y frn:x report", "contains(lower(file_name), 'report')")
_matching("idle_function_compat", "child:x content:y dupe: report", "contains(lower(file_name), 'report')", compat=True)
_SHARED = "NOT is_directory AND {0} IN (SELECT {0} FROM file_entries WHERE NOT is_directory GROUP BY {0} HAVING count(*) > 1)"
_matching("dupe_sizes", "sizedupe: report | 文档 | tar", _SHARED.format("size") + " AND (contains(lower(file_name), 'report') OR contains(file_name, '文档') OR contains(lower(file_name), 'tar'))")
_matching("dupe_dates", "size:>1mb dmdupe: audio:", f"{_SHARED.format('date_modified')} AND size > 1048576 AND {_AUDIO}")
_matching("dupe_twice", "dmdupe: sizedupe: !test", f"{_SHARED.format('size')} AND {_SHARED.format('date_modified')} AND NOT contains(lower(file_name), 'test')")
_matching("in_folder", "infolder:/DATA/cust7/f report | order", "lower(parent_path) = '/data/cust7/f' AND (contains(lower(file_name), 'report') OR contains(lower(file_name), 'order'))")
_matching("macro_audio", "audio:", _AUDIO)
_matching("macro_doc", "doc:", _DOC)
_matching("macro_pic", "pic:", _types("jpg jpeg png gif bmp tiff webp svg ico"))
_matching("macro_video", "video:", _types("mp4 avi mkv mov wmv flv webm m4v"))
_matching("macro_zip", "zip:", _types("zip rar 7z tar gz bz2 xz iso"))
_matching("macro_exe", "exe:", _types("exe msi bat cmd ps1 com"))
_matching("macros_or_is_empty", "audio: | pic:", f"{_AUDIO} AND {_types('jpg png')}")
_matching("type_function", "type:doc", _DOC)
_matching("ext_list", "ext:mp3;FLAC", "lower(extension) IN ('mp3', 'flac')")
_matching("ext_none", "ext:", "extension = ''")
for _name, _where in {
    "empty": "size <= 0",
    "tiny": "size > 0 AND size <= 10240",
    "small": "size > 10240 AND size <= 102400",
    "medium": "size > 102400 AND size <= 1048576",
    "large": "size > 1048576 AND size <= 16777216",
    "huge": "size > 16777216 AND size <= 134217728",
    "gigantic": "size > 134217728",
}.items():
    _matching(f"size_{_name}", f"size:{_name}", f"is_directory OR ({_where})")
_matching("size_at_least", "size:>=1mb", "is_directory OR size >= 1048576")
_matching("size_below", "size:<10KB", "is_directory OR size < 10240")
_matching("size_range", "size:1000..200000", "is_directory OR size BETWEEN 1000 AND 200000")
_matching("size_range_dash", "size:1000-200000", "is_directory OR size BETWEEN 1000 AND 200000")
_matching("size_range_suffix", "size:1kb..2mb", "is_directory OR size BETWEEN 1024 AND 2097152")
_matching("size_range_suffix_compat", "size:100..200kb", "is_directory OR size >= 102400", compat=True)
_matching("date_range", "dm:1996-01-01..1996-12-31", "CAST(date_modified AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
_matching("date_from", "dm:>=1998-06-01", "CAST(date_modified AS DATE) >= DATE '1998-06-01'")
_matching("date_after", "datemodified:>1998-06-01", "CAST(date_modified AS DATE) > DATE '1998-06-01'")
_matching("date_day", "dm:1997-03-05", "CAST(date_modified AS DATE) = DATE '1997-03-05'")
_matching("date_unknown", "dm:unknown", "date_modified IS NULL")
_matching("date_created_unknown", "dc:unknown file:", "NOT is_directory")
for _name, _low, _high in (
    ("today", "2001-08-01", "2001-08-01"),
    ("yesterday", "2001-07-31", "2001-07-31"),
    ("thisweek", "2001-07-30", "2001-08-01"),
    ("lastweek", "2001-07-23", "2001-07-29"),
    ("thismonth", "2001-08-01", "2001-08-31"),
    ("lastmonth", "2001-07-01", "2001-07-31"),
    ("thisyear", "2001-01-01", "2001-12-31"),
    ("lastyear", "2000-01-01", "2000-12-31"),
):
    _matching(f"date_{_name}", f"dm:{_name}", f"CAST(date_modified AS DATE) BETWEEN DATE '{_low}' AND DATE '{_high}'")
_matching("attributes_read_archive", "attrib:RA", "read_only AND archive")
_matching("attributes_folder", "attributes:dx", "is_directory")
_matching("run_count_any", "runcount:", "run_count > 0")
_matching("run_count_range", "runcount:2..4", "run_count BETWEEN 2 AND 4")
_matching("run_count_above", "runcount:>5", "run_count > 5")
_matching("name_bytes", "len:>14", "strlen(file_name) > 14")
_matching("depth", "depth:5", "len(list_filter(string_split(full_path, '/'), lambda x: x <> '')) + 1 = 5")
_matching("starts_with", "startwith:REPORT_1", "starts_with(lower(file_name), 'report_1')")
_matching("ends_with", "endwith:6.MP4", "suffix(lower(file_name), '6.mp4')")
_matching("empty_folders", "empty:", "is_directory AND size = 0")
_matching("root_only", "root:", "parent_path = ''")
_matching("file_list_function", "filelist:x", "false")
_matching("files_switch", "file: 77", "NOT is_directory AND contains(file_name, '77')")
_matching("folders_switch", "folder: 77", "is_directory AND contains(file_name, '77')")
_matching("files_option", "9", "NOT is_directory AND contains(file_name, '9')", files_only=True)
_matching("empty_query", "", "true", files_only=True)
_matching("regex_mode", r"^order-1[0-9]+\.(rs|tar)$", r"regexp_matches(file_name, '^order-1[0-9]+\.(rs|tar)$')", regex=True)
_matching("regex_path", r"cust[0-4]/[OP]/test", r"regexp_matches(full_path, 'cust[0-4]/[OP]/test')", regex=True, match_path=True)
_matching("regex_invalid", "([", "false", regex=True)
_matching("regex_unicode_class", r"^\w+\.txt$", r"regexp_matches(file_name, '^[\p{L}\p{N}\p{M}_]+\.txt$')", regex=True)
_matching("regex_property", r"^\p{Han}{2}\d+\.(?P<ext>[a-z--m-p]+\d?)\z", r"regexp_matches(file_name, '^\p{Han}{2}[0-9]+\.[a-lq-z]+[0-9]?$')", regex=True)
_matching("regex_code_point", r"^\x{6587}\u6863\d*[02468]\b", r"regexp_matches(file_name, '^文档[0-9]*[02468]([^0-9]|$)')", regex=True)
_matching("regex_boundary", r"\btest\b|\b文档\d+\b", r"regexp_matches(file_name, '^(test |文档)')", regex=True)


@registered("SELECT file_ord, full_path, size, is_directory FROM file_entries WHERE contains(file_name, 'Report_') AND regexp_matches(lower(file_name), '7(\\.[a-z0-9]*)?$')")
def regex_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding beyond ASCII: names with a word in three alphabets, asked for in the other case."""
    files = fixtures.files(spark, sf_dir).withColumn("file_name", F.replace("file_name", F.lit("Report_"), F.lit("ÜnïЖЯΣ_")))
    return search.matching(files, r"(?i)ÜNÏжяσ_\d*7(?:\.\w*)?$", SearchOptions(regex=True)).select(*SHOWN)




def _by_index(name: str, query: str, where: str, **options) -> None:
    """A search through a saved index of the trigrams of names."""
    shown = ", ".join(SHOWN)

    @registered(f"SELECT {shown} FROM file_entries WHERE {where}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        NameIndex.build(fixtures.files(spark, sf_dir), path := scratch.new_path(spark, "names"))
        return NameIndex(spark, path).matching(query, SearchOptions(**options), NOW).select(*SHOWN)


_by_index("name_substring_indexed", "report", "contains(lower(file_name), 'report')")
_by_index("wildcard_star_indexed", "*rt_*7*.mp?", r"regexp_matches(lower(file_name), '^.*rt_.*7.*\.mp.$')")
_by_index("or_groups_indexed", "report mp3 | 文档1 | order 99 !7", "(contains(lower(file_name), 'report') AND contains(lower(file_name), 'mp3')) OR contains(file_name, '文档1') OR (contains(lower(file_name), 'order') AND contains(lower(file_name), '99') AND NOT contains(lower(file_name), '7'))")
_by_index("rare_name_indexed", "test 12 | _777 size:>1kb", "(contains(lower(file_name), 'test') AND contains(lower(file_name), '12') OR contains(file_name, '_777')) AND (is_directory OR size > 1024)")
_by_index("case_indexed", "case: Report_1 | ORDER", "contains(file_name, 'Report_1') OR contains(file_name, 'ORDER')")
_by_index("short_term_indexed", "7 | report", "contains(file_name, '7') OR contains(lower(file_name), 'report')")


def _page(name: str, query: str, where: str, order: str, spec: SortSpec, limit: int = 1000, offset: int = 0) -> None:
    """A query that returns one page of sorted results, with its place in it."""
    shown = ", ".join(SHOWN)

    @registered(f"SELECT {shown} FROM file_entries WHERE {where} ORDER BY {order}, file_ord LIMIT {limit} OFFSET {offset}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(fixtures.files(spark, sf_dir), query, SearchOptions(sort=spec, max_results=limit, offset=offset), NOW).select(*SHOWN)


_page("flagship", "size:>1mb audio:", f"{_AUDIO} AND size > 1048576", "lower(file_name)", SortSpec())
_page("sort_name_descending", "order", "contains(lower(file_name), 'order')", "lower(file_name) DESC", SortSpec(SortField.NAME, True), 200)
_page("sort_size_page", "doc:", _DOC, "size DESC", SortSpec(SortField.SIZE, True), 100, 50)
_page("sort_date_nulls", "report", "contains(lower(file_name), 'report')", "date_modified ASC NULLS FIRST", SortSpec(SortField.DATE_MODIFIED), 300)
_page("sort_path", "test", "contains(lower(file_name), 'test')", "string_split(full_path, '/')", SortSpec(SortField.PATH), 300)
_page("sort_extension", "文档", "contains(file_name, '文档')", "lower(extension)", SortSpec(SortField.EXTENSION), 300, 10)
_page("sort_run_count", "runcount:", "run_count > 0", "run_count DESC", SortSpec(SortField.RUN_COUNT, True), 300)
_page("sort_attributes", "attrib:H", "hidden", "CAST(read_only AS INT) + 2 * CAST(hidden AS INT) + 16 * CAST(is_directory AS INT) + 32 * CAST(archive AS INT) DESC", SortSpec(SortField.ATTRIBUTES, True), 200)


@registered(f"SELECT {', '.join(SHOWN)} FROM file_entries WHERE file_ord < 5000 AND contains(lower(file_name), 'report') ORDER BY lower(file_name), file_ord LIMIT 1000")
def quick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.quick_search(fixtures.files(spark, sf_dir), "report", 5000).select(*SHOWN)


@registered("SELECT count(*) AS total, CAST(count_if(NOT is_directory) AS BIGINT) AS files, CAST(count_if(is_directory) AS BIGINT) AS folders FROM file_entries WHERE contains(lower(file_name), '1')")
def count_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counts(search.matching(fixtures.files(spark, sf_dir), "1"))


@registered("SELECT DISTINCT CASE WHEN extension = '' THEN '(无扩展名)' ELSE lower(extension) END AS extension FROM file_entries WHERE NOT is_directory")
def extensions_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.extensions(fixtures.files(spark, sf_dir))


def _exact(n: str, d: int, digits: int) -> str:
    ten = 10**digits
    scaled = f"(CAST({n} AS HUGEINT) * {ten})"
    q, r = f"({scaled} // {d})", f"({scaled} % {d})"
    v = f"({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"concat(CAST({v} // {ten} AS VARCHAR), '.', lpad(CAST({v} % {ten} AS VARCHAR), {digits}, '0'))"


@registered(f"SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, {_exact('CAST(sum(size) AS BIGINT)', 1 << 20, 2)} AS total_mb FROM file_entries WHERE NOT is_directory")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.totals(fixtures.files(spark, sf_dir))


_UNIT = "CASE WHEN size < 1000 THEN concat(CAST(size AS VARCHAR), ' B') " + " ".join(f"WHEN size < {1000 ** (k + 1)} THEN concat({_exact('size', 1 << (10 * k), 2)}, ' {u}')" for k, u in enumerate(("KB", "MB", "GB"), 1)) + " END"


@registered(f"SELECT file_ord, {_UNIT} AS shown, CASE WHEN size < 1024 THEN concat(CAST(size AS VARCHAR), ' B') WHEN size < 1048576 THEN concat({_exact('size', 1024, 1)}, ' KB') ELSE concat({_exact('size', 1 << 20, 1)}, ' MB') END AS document_size FROM file_entries")
def size_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir).select("file_ord", formatting.format_size(F.col("size")).alias("shown"), formatting.format_file_size(F.col("size")).alias("document_size"))


@registered("SELECT file_ord, CASE WHEN file_ord * 86400 > 253402300799 THEN '时间错误' ELSE strftime(to_timestamp(file_ord * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS shown, coalesce(strftime(date_modified, '%Y-%m-%d %H:%M'), '') AS modified FROM file_entries")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir).select("file_ord", formatting.format_timestamp(F.col("file_ord") * 86400).alias("shown"), formatting.format_date(F.col("date_modified")).alias("modified"))


@registered(
    """SELECT file_ord, regexp_extract(full_path, '([^/]*)$', 1) AS name, regexp_extract(file_name, '^.+\\.([^.]*)$', 1) AS extension,
  CASE WHEN regexp_matches(file_name, '^.+\\.[^.]*$') THEN regexp_extract(file_name, '^(.+)\\.[^.]*$', 1) ELSE file_name END AS stem,
  regexp_extract(full_path, '^(.*)/[^/]*$', 1) AS parent, substr(full_path, 7) AS relative FROM file_entries"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, name = F.col("full_path"), F.col("file_name")
    return fixtures.files(spark, sf_dir).select(
        "file_ord",
        paths.file_name(path).alias("name"),
        paths.extension(name).alias("extension"),
        paths.stem(name).alias("stem"),
        paths.parent(path).alias("parent"),
        paths.relative(path, "/data").alias("relative"),
    )


@registered("SELECT file_ord, CAST(CAST(read_only AS INT) + 2 * CAST(hidden AS INT) + 16 * CAST(is_directory AS INT) + 32 * CAST(archive AS INT) AS BIGINT) AS bits FROM file_entries")
def attribute_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir).select("file_ord", formatting.attribute_bits(F.col("attributes")).alias("bits"))


@registered(
    """SELECT row_number() OVER (ORDER BY file_ord) AS "index", file_name AS name, CASE WHEN extension = '' THEN '(无扩展名)' ELSE lower(extension) END AS extension,
  full_path AS path, '' AS created, coalesce(strftime(date_modified, '%Y-%m-%d %H:%M:%S'), '') AS modified, size
FROM file_entries WHERE NOT is_directory AND lower(extension) IN ('mp3', 'flac', 'rs')"""
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.inventory(fixtures.files(spark, sf_dir), ["mp3", "flac", "rs"])


@registered(
    """SELECT number, full_path AS old_path, concat(parent_path, '/', 'new_', replace(CASE WHEN regexp_matches(file_name, '^.+\\.[^.]*$') THEN regexp_extract(file_name, '^(.+)\\.[^.]*$', 1) ELSE file_name END, 'order', 'o'), '_',
  CASE WHEN number + 4 < 1000 THEN lpad(CAST(number + 4 AS VARCHAR), 3, '0') ELSE CAST(number + 4 AS VARCHAR) END, '.bak') AS new_path
FROM (SELECT *, row_number() OVER (ORDER BY file_ord) AS number FROM file_entries WHERE NOT is_directory) f"""
)
def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [listing.RenameRule(find="order", replace="o", prefix="new_", suffix="_", counter_format="{N}", counter_start=5, new_extension="bak")]
    return listing.rename_preview(fixtures.files(spark, sf_dir).where(~F.col("is_directory")), rules)


@registered(
    """SELECT substr(full_path, 7) AS relative_path, concat('===== 文件: ', substr(full_path, 7), ' =====\n路径: ', full_path, '\n文件名: ', file_name, '\n--- 代码 ---\n', 'size ', CAST(size AS VARCHAR), '\n--- 结束 ---\n\n') AS block
FROM file_entries WHERE NOT is_directory AND lower(extension) IN ('rs', 'txt')"""
)
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.merged_text(listing.sources(fixtures.files(spark, sf_dir), "/data"), F.concat(F.lit("size "), F.col("size").cast("string")))


@registered(
    """SELECT path AS relative_path, concat('===== 文件: ', path, ' =====\n路径: /data/', path, '\n文件名: ', filename, '\n--- 代码 ---\n', coalesce(body, '[读取失败: empty]'), '\n--- 结束 ---\n\n') AS block
FROM doc_pages WHERE contains(lower(path), 'doc_1')"""
)
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged contents: whole texts of documents, those whose path has a word in it."""
    pages = fixtures.view(spark, sf_dir, "doc_pages")
    files = pages.select(F.concat(F.lit("/data/"), "path").alias("full_path"), F.col("filename").alias("file_name"), F.lit("TXT").alias("extension"), F.lit(False).alias("is_directory"), F.col("body").alias("content"))
    return listing.merged_text(listing.sources(files, "/data", "DOC_1"), error=F.lit("empty"))


@registered("SELECT file_ord, full_path, size, is_directory FROM file_entries WHERE file_ord % 10 = 0 AND (is_directory OR size > 1024)")
def root_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a folder above them, made of every tenth row."""
    files = fixtures.files(spark, sf_dir).withColumn("parent_path", F.when(F.col("file_ord") % 10 == 0, "").otherwise(F.col("parent_path")))
    return search.matching(files, "root: size:>1kb", now=NOW).select(*SHOWN)


@registered("SELECT string_agg(full_path, chr(10) ORDER BY file_ord) AS text FROM (SELECT * FROM file_entries ORDER BY file_ord LIMIT 50) f")
def clipboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.clipboard(fixtures.files(spark, sf_dir))


@registered("""SELECT replace(replace(replace(file_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name, parent_path AS folder, size, modified FROM (
  SELECT file_name, parent_path, file_ord, """ + _UNIT + """ AS size, coalesce(strftime(date_modified, '%Y-%m-%d %H:%M'), '') AS modified FROM file_entries WHERE contains(lower(file_name), 'report') ORDER BY lower(file_name), file_ord LIMIT 100) f""")
def html_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.html_rows(search.search(fixtures.files(spark, sf_dir), "report", SearchOptions(max_results=100)))


@registered("""SELECT CAST(json_object('name', file_name, 'path', full_path, 'size', size, 'is_directory', is_directory) AS VARCHAR) AS json
FROM (SELECT * FROM file_entries WHERE contains(lower(file_name), 'report') ORDER BY lower(file_name), file_ord LIMIT 100) f""")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(search.search(fixtures.files(spark, sf_dir), "report", SearchOptions(max_results=100)))


@registered(
    """SELECT f.file_ord, f.full_path, f.size, f.is_directory FROM file_entries f WHERE NOT is_directory AND size IN (SELECT size FROM file_entries WHERE NOT is_directory GROUP BY size HAVING count(*) > 1)"""
)
def duplicate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.duplicates(fixtures.files(spark, sf_dir), "size").select(*SHOWN)


@registered("SELECT parent_path AS full_path, CAST(count_if(NOT is_directory) AS BIGINT) AS child_files, CAST(count_if(is_directory) AS BIGINT) AS child_folders FROM file_entries GROUP BY parent_path")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fixtures.files(spark, sf_dir)
    # the view has no rows for the folders that files lie in; make them
    folders = entries.select("parent_path").distinct().select(F.col("parent_path").alias("full_path"), F.lit(True).alias("is_directory"), F.lit("").alias("parent_path"))
    tree = entries.select("full_path", "is_directory", "parent_path").unionByName(folders)
    return search.child_counts(tree).where("child_files + child_folders > 0").select("full_path", "child_files", "child_folders")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with rows for the folders that they lie in, and their names cut short, so that some are equal."""
    entries = fixtures.files(spark, sf_dir).withColumn("file_name", F.regexp_replace("file_name", "[0-9]{2}(?=\\.|$)", ""))
    folders = entries.select("parent_path").distinct().select(F.col("parent_path").alias("full_path"), F.substring_index("parent_path", "/", -1).alias("file_name"), F.substring_index("parent_path", "/", 3).alias("parent_path"), F.lit(True).alias("is_directory"))
    return entries.unionByName(folders, allowMissingColumns=True)


_TREE = r"""entries AS (SELECT * REPLACE (regexp_replace(file_name, '[0-9]{2}(\.|$)', '\1') AS file_name) FROM file_entries),
tree AS (SELECT full_path, file_name, parent_path, is_directory FROM entries UNION ALL
  SELECT DISTINCT parent_path, regexp_extract(parent_path, '([^/]*)$', 1), regexp_extract(parent_path, '^(/[^/]*/[^/]*)', 1), true FROM entries),
inside AS (SELECT parent_path AS folder, count(*) AS n, count_if(is_directory) AS d FROM tree GROUP BY parent_path)"""


def _related(name: str, query: str, where: str) -> None:
    """A query over the tree, of functions that look at other rows."""

    @registered(f"SELECT * FROM (WITH {_TREE}\nSELECT full_path, file_name FROM tree LEFT JOIN inside ON folder = full_path WHERE {where}) x", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matching(_tree(spark, sf_dir), query, now=NOW).select("full_path", "file_name")


_NAMES = "NOT is_directory AND lower(file_name) IN (SELECT lower(file_name) FROM tree WHERE NOT is_directory GROUP BY lower(file_name) HAVING count(*) > 1)"
_related("dupe_names", "dupe: report | 文档", f"{_NAMES} AND (contains(lower(file_name), 'report') OR contains(file_name, '文档'))")
_related("child_count", "childcount:>10", "is_directory AND coalesce(n, 0) > 10")
_related("child_folders", "childfoldercount:1..8 childfilecount:>=20", "is_directory AND coalesce(d, 0) BETWEEN 1 AND 8 AND coalesce(n - d, 0) >= 20")
_related("child_name", "child:MP3 folder: p | o", "is_directory AND (contains(lower(file_name), 'p') OR contains(lower(file_name), 'o')) AND full_path IN (SELECT parent_path FROM tree WHERE contains(lower(file_name), 'mp3'))")


_CHANGES = """SELECT coalesce(d.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN d.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM snapshot_known k FULL OUTER JOIN snapshot_disk d ON k.path = d.path
WHERE k.path IS NULL OR d.path IS NULL OR k.mtime <> d.mtime OR k.md5 IS DISTINCT FROM d.md5"""


@registered(f"SELECT CAST(count_if(change = 'new') AS BIGINT) AS new_count, CAST(count_if(change = 'modified') AS BIGINT) AS modified_count, CAST(count_if(change = 'deleted') AS BIGINT) AS deleted_count FROM ({_CHANGES}) c")
def compare_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.compare_index(fixtures.view(spark, sf_dir, "snapshot_known"), fixtures.view(spark, sf_dir, "snapshot_disk"))


@registered(_CHANGES)
def index_changes_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of snapshots saved in buckets, the known one opened again."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    incremental.save_snapshot(fixtures.view(spark, sf_dir, "snapshot_known"), known := scratch.new_path(spark, "known"), buckets)
    disk = incremental.save_snapshot(fixtures.view(spark, sf_dir, "snapshot_disk"), scratch.new_path(spark, "disk"), buckets)
    return incremental.changes(incremental.open_snapshot(spark, known, buckets), disk)


@registered(_CHANGES)
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(fixtures.view(spark, sf_dir, "snapshot_known"), fixtures.view(spark, sf_dir, "snapshot_disk"))


@registered("SELECT path FROM snapshot_disk d WHERE NOT EXISTS (SELECT 1 FROM snapshot_known k WHERE k.path = d.path AND k.mtime = d.mtime AND k.md5 = d.md5)")
def files_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.to_index(fixtures.view(spark, sf_dir, "snapshot_disk"), fixtures.view(spark, sf_dir, "snapshot_known")).select("path")


@registered("SELECT path, file_id FROM snapshot_known k WHERE EXISTS (SELECT 1 FROM snapshot_disk d WHERE d.path = k.path)")
def index_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sweep(fixtures.view(spark, sf_dir, "snapshot_known"), fixtures.view(spark, sf_dir, "snapshot_disk")).select("path", "file_id")


@registered("""SELECT d.path, coalesce(k.file_id, m.last + row_number() OVER (PARTITION BY k.path IS NULL ORDER BY d.path)) AS file_id
FROM snapshot_disk d LEFT JOIN snapshot_known k ON d.path = k.path, (SELECT max(file_id) AS last FROM snapshot_known) m""")
def index_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.assign_ids(fixtures.view(spark, sf_dir, "snapshot_known"), fixtures.view(spark, sf_dir, "snapshot_disk")).select("path", "file_id")


_RUNS = "SELECT path, count(*) AS run_count, max(ts) AS last_run FROM watch_events WHERE kind = 'opened' GROUP BY path"


@registered(f"{_RUNS} ORDER BY run_count DESC, path LIMIT 100")
def history_most_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.most_run(history.run_history(fixtures.view(spark, sf_dir, "watch_events")), 100)


@registered(f"{_RUNS} ORDER BY last_run DESC, path LIMIT 100")
def history_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_run(history.run_history(fixtures.view(spark, sf_dir, "watch_events")), 100)


@registered(f"SELECT path, CAST(2 * run_count AS BIGINT) AS run_count, last_run FROM ({_RUNS}) r")
def history_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.view(spark, sf_dir, "watch_events")
    return history.increment(history.run_history(events), events)


@registered(f"SELECT f.file_ord, coalesce(r.run_count, 0) AS run_count FROM file_entries f LEFT JOIN ({_RUNS}) r ON r.path = f.full_path")
def files_with_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = history.run_history(fixtures.view(spark, sf_dir, "watch_events"))
    return search.with_run_history(fixtures.files(spark, sf_dir), runs).select("file_ord", "run_count")


@registered("SELECT query, max(seq) AS seq FROM search_log WHERE coalesce(query, '') <> '' GROUP BY query ORDER BY seq DESC LIMIT 100")
def search_history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_searches(fixtures.view(spark, sf_dir, "search_log"), 100)


@registered("SELECT query, min(seq) AS seq FROM search_log WHERE coalesce(query, '') <> '' GROUP BY query ORDER BY seq DESC LIMIT 20")
def search_history_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_searches(fixtures.view(spark, sf_dir, "search_log"), 20)


def _streamed(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The events replayed as a stream in four parts, stopped and started again after each; an owner is a customer's folder."""
    events = fixtures.view(spark, sf_dir, "watch_events").withColumn("owner", F.substring_index("path", "/", 3))
    folder, schema = scratch.new_path(spark, "counters"), "seq long, ts timestamp, path string, kind string, owner string"
    events = events.select("seq", F.col("ts").cast("timestamp").alias("ts"), "path", "kind", "owner")
    for part in range(4):
        events.where(F.col("seq") % 4 == part).write.mode("append").parquet(f"{folder}/events")
        counters.count(spark.readStream.schema(schema).parquet(f"{folder}/events"), folder, most)
    return counters.current(spark, folder)


@registered(f"{_RUNS} ORDER BY run_count DESC, path LIMIT 100")
def history_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.most_run(_streamed(spark, sf_dir, 0).drop("owner"), 100)


@registered(f"{_RUNS} ORDER BY run_count DESC, path LIMIT 100")
def history_streamed_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With state of its own and a bound that no owner reaches."""
    return history.most_run(_streamed(spark, sf_dir, 1000).drop("owner"), 100)


_LATEST = "SELECT path, seq, ts, kind FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS place FROM watch_events WHERE kind <> 'opened') e WHERE place = 1"


@registered(_LATEST)
def watch_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.latest(fixtures.view(spark, sf_dir, "watch_events"))


@registered(f"""SELECT file_ord, full_path, size, is_directory FROM file_entries WHERE full_path NOT IN (SELECT path FROM ({_LATEST}) l)
UNION ALL SELECT file_ord, full_path, size + 1, is_directory FROM file_entries WHERE full_path IN (SELECT path FROM ({_LATEST}) l WHERE kind <> 'removed')""")
def watch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.files(spark, sf_dir)
    scanned = files.withColumn("size", F.col("size") + 1)  # what a scan now finds at every path
    return watch.apply_events(files, fixtures.view(spark, sf_dir, "watch_events"), scanned).select(*SHOWN)


@registered("SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n FROM watch_events GROUP BY ALL")
def watch_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.activity(fixtures.view(spark, sf_dir, "watch_events"))


# Full-text search. Scores are compared at four places.

_TOKENS = r"list_filter(string_split(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _scored(terms: list[str], matches: str, scores: str | None = None) -> str:
    """SQL of BM25 over terms; ``matches`` and ``scores`` may use f0, f1, ... (counts) and s0, s1, ... (scores)."""
    f = [f"len(list_filter(toks, lambda t: t = '{t}')) AS f{i}" for i, t in enumerate(terms)]
    df = [f"count_if(f{i} > 0) AS df{i}" for i in range(len(terms))]
    s = [f"CASE WHEN f{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0.0 END AS s{i}" for i in range(len(terms))]
    total = scores or " + ".join(f"s{i}" for i in range(len(terms)))
    return f"""SELECT file_id, location, {total} AS raw FROM (
  SELECT *, {', '.join(s)} FROM (
    SELECT file_id, location, toks, len(toks) AS dl, {', '.join(f)} FROM (SELECT file_id, location, {_TOKENS} AS toks FROM doc_pages WHERE trim(body) <> '') p) c,
  (SELECT count(*) AS n, avg(len(toks)) AS avgdl, {', '.join(df)} FROM (SELECT toks, {', '.join(f)} FROM (SELECT {_TOKENS} AS toks FROM doc_pages WHERE trim(body) <> '') q) d) stats) x
WHERE {matches}"""


def _index(pages: DataFrame, tokenizer: Callable = tokens.words) -> TextIndex:
    """An index of the pages, saved and opened again."""
    path = TextIndex.create(pages.select("file_id", "location", "body"), scratch.new_path(pages.sparkSession, "index"), tokenizer).path
    return TextIndex(pages.sparkSession, path, tokenizer)


def _text(name: str, query: str, terms: list[str], matches: str, scores: str | None = None, indexed: bool = False, plain: bool = False) -> None:
    """A query that ranks all matching pages."""

    @registered(f"SELECT file_id, location, round(raw, 4) AS score FROM ({_scored(terms, matches, scores)}) r", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = fixtures.view(spark, sf_dir, "doc_pages").select("file_id", "location", "body")
        ranked = _index(pages).rank(query, plain) if indexed else fulltext.rank(pages, query, plain=plain)
        return ranked.select("file_id", "location", F.round("score", 4).alias("score"))


_AFTER = "len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))"
_text("text_or", "trash loser moron", ["trash", "loser", "moron"], "f0 + f1 + f2 > 0")
_text("text_or_indexed", "trash loser moron", ["trash", "loser", "moron"], "f0 + f1 + f2 > 0", indexed=True)
_text("text_and", "trash AND the", ["trash", "the"], "f0 > 0 AND f1 > 0")
_text("text_not", "the NOT of", ["the", "of"], "f0 > 0 AND f1 = 0", "s0")
_text("text_plus_minus", "+thing -of the", ["thing", "of", "the"], "f0 > 0 AND f1 = 0", "s0 + s2")
_text("text_nested", "(trash OR moron) AND NOT loser", ["trash", "moron", "loser"], "f0 + f1 > 0 AND f2 = 0", "s0 + s1")
_text("text_plain_operators", "trash and moron", ["trash", "and", "moron"], "f0 + f1 + f2 > 0", plain=True)
_text(
    "text_phrase",
    '"of the"',
    ["of", "the"],
    f"{_AFTER} > 0",
    f"(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5))) * {_AFTER} * 2.2 / ({_AFTER} + 1.2 * (0.25 + 0.75 * dl / avgdl))",
)


_LETTER = r"[\p{L}\p{N}]"
for _name, _query, _like in (
    ("text_wildcard", "disgust*", f"disgust{_LETTER}*"),
    ("text_wildcard_prefix_indexed", "disgust*", f"disgust{_LETTER}*"),
    ("text_wildcard_suffix_indexed", "*ting", f"{_LETTER}*ting"),
    ("text_wildcard_inner_indexed", "d?sg*t?ng", f"d{_LETTER}sg{_LETTER}*t{_LETTER}ng"),
    ("text_wildcard_both_indexed", "*isgus*", f"{_LETTER}*isgus{_LETTER}*"),
):

    @registered(f"SELECT file_id, location, 1.0::DOUBLE AS score FROM (SELECT file_id, location, {_TOKENS} AS toks FROM doc_pages) p WHERE len(list_filter(toks, lambda t: regexp_matches(t, '^{_like}$'))) > 0", _name)
    def _(spark: SparkSession, sf_dir: str, query: str = _query, indexed: bool = _name.endswith("indexed")) -> DataFrame:
        pages = fixtures.view(spark, sf_dir, "doc_pages").select("file_id", "location", "body")
        return _index(pages).rank(query) if indexed else fulltext.rank(pages, query)


@registered(f"SELECT file_id, location, round(raw, 4) AS score FROM ({_scored(['trash', 'the'], 'f0 + f1 > 0')}) r ORDER BY raw DESC, file_id LIMIT 500")
def text_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.view(spark, sf_dir, "doc_pages").select("file_id", "location", "body")
    return fulltext.top(fulltext.rank(pages, "trash the")).select("file_id", "location", F.round("score", 4).alias("score"))


_BEST = {  # the best pages of a saved index: SQL of all pages, and the query
    "text_top_indexed": ("trash the", _scored(["trash", "the"], "f0 + f1 > 0")),
    "text_top_and_indexed": ("trash AND the", _scored(["trash", "the"], "f0 > 0 AND f1 > 0")),
    "text_top_phrase_indexed": (
        '"of the" moron',
        _scored(
            ["of", "the", "moron"],
            f"{_AFTER} > 0 OR f2 > 0",
            f"s2 + CASE WHEN {_AFTER} > 0 THEN (ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5))) * {_AFTER} * 2.2 / ({_AFTER} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END",
        ),
    ),
}
for _name, (_query, _all) in _BEST.items():

    @registered(f"SELECT file_id, location, round(raw, 4) AS score FROM ({_all}) r ORDER BY raw DESC, file_id LIMIT 100", _name)
    def _(spark: SparkSession, sf_dir: str, query: str = _query) -> DataFrame:
        return _index(fixtures.view(spark, sf_dir, "doc_pages")).top(query, 100).select("file_id", "location", F.round("score", 4).alias("score"))


@registered("SELECT file_id, CAST(len(list_filter(string_split(body, ' '), lambda t: t = 'the')) + len(list_filter(string_split(body, ' '), lambda t: t = 'trash')) AS BIGINT) AS keyword_count FROM doc_pages")
def text_keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.view(spark, sf_dir, "doc_pages")
    return pages.select("file_id", F.coalesce(fulltext.keyword_count(F.col("body"), ["the", "trash"]), F.lit(0)).alias("keyword_count"))


_FOUND = f"""SELECT r.file_id, d.path, d.filename, round(r.raw, 4) AS score, CAST(len(list_filter(string_split(lower(d.body), ' '), lambda t: t = 'moron')) AS BIGINT) AS keyword_count
FROM ({_scored(['moron'], 'f0 > 0')}) r JOIN doc_pages d ON d.file_id = r.file_id ORDER BY r.raw DESC, r.file_id LIMIT 500"""


def _search(spark: SparkSession, sf_dir: str, indexed: bool, **how) -> DataFrame:
    view = fixtures.view(spark, sf_dir, "doc_pages")
    found = fulltext.search(_index(view) if indexed else view.select("file_id", "location", "body"), view, "Moron", order="frequency", hits=False, **how)
    return found.select("file_id", "path", "filename", F.round("score", 4).alias("score"), "keyword_count")


@registered(_FOUND)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, indexed=False)


@registered(_FOUND)
def text_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, indexed=True)


@registered(_FOUND.replace("lower(d.body)", "d.body").replace("t = 'moron')) AS BIGINT)", "t = 'Moron')) AS BIGINT)"))
def text_search_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in another case are found, and not counted."""
    return _search(spark, sf_dir, indexed=False, ignore_case=False)


@registered(f"""SELECT r.file_id, w.keyword, CAST((length(body) - length(replace(lower(body), w.keyword, ''))) / length(w.keyword) AS BIGINT) AS hits
FROM ({_scored(['trash', 'loser'], 'f0 + f1 > 0')} ORDER BY raw DESC, file_id LIMIT 500) r JOIN doc_pages d ON d.file_id = r.file_id, (VALUES ('trash'), ('loser')) w(keyword) WHERE contains(lower(body), w.keyword)""")
def text_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = fixtures.view(spark, sf_dir, "doc_pages")
    found = fulltext.search(view.select("file_id", "location", "body"), view, "trash loser").select("file_id", F.explode("hits").alias("hit"))
    return found.groupBy("file_id", "hit.keyword").agg(F.count("*").alias("hits"))


def _chinese(spark: SparkSession, sf_dir: str, query: str, indexed: bool) -> DataFrame:
    files = fixtures.files(spark, sf_dir)
    pages = files.select(F.col("file_ord").alias("file_id"), F.lit(1).alias("location"), F.regexp_replace("file_name", "文档", "我们学习文档检索系统").alias("body"))
    return (_index(pages).rank(query) if indexed else fulltext.rank(pages, query)).select("file_id")


for _name, _query in (("text_han_word", "文档"), ("text_han_phrase", "文档检索"), ("text_han_run", "学习文档"), ("text_han_sign", "检")):
    for _indexed in (False, True):

        @registered("SELECT file_ord AS file_id FROM file_entries WHERE contains(file_name, '文档')", _name + "_indexed" * _indexed)
        def _(spark: SparkSession, sf_dir: str, query: str = _query, indexed: bool = _indexed) -> DataFrame:
            return _chinese(spark, sf_dir, query, indexed)


#: Phrases, and the words of a dictionary of one to four signs, some of which overlap.
_PHRASES = ("我们学习文档检索系统", "检索系统的文档", "学习检索方法", "系统研究生命起源")
_COUNTS = {"我们": 90, "学习": 60, "文档": 40, "检索": 20, "系统": 50, "检索系统": 30, "方法": 40, "研究": 30, "研究生": 20, "生命": 20, "起源": 10, "命": 3, "的": 200}


def _segmented(spark: SparkSession, sf_dir: str, query: str, indexed: bool) -> DataFrame:
    words = Segmenter.of(spark.createDataFrame(list(_COUNTS.items()), "word string, count long"))
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.pmod("file_ord", F.lit(4)) + 1).cast("int"))
    pages = fixtures.files(spark, sf_dir).select(F.col("file_ord").alias("file_id"), F.lit(1).alias("location"), F.concat("file_name", F.lit(" "), phrase).alias("body"))
    return (_index(pages, words).rank(query) if indexed else fulltext.rank(pages, query, words)).select("file_id")


# a word is found where the best path has it, not inside a longer one or across two
for _name, _query, _where in (
    ("text_segmented_word", "检索", "file_ord % 4 = 2"),
    ("text_segmented_long", "检索系统 AND NOT 的", "file_ord % 4 = 0"),
    ("text_segmented_across", "研究生 方法", "file_ord % 4 = 2"),
    ("text_segmented_phrase", "系统研究生命", "file_ord % 4 = 3"),
):
    for _indexed in (False, True):

        @registered(f"SELECT file_ord AS file_id FROM file_entries WHERE {_where}", _name + "_indexed" * _indexed)
        def _(spark: SparkSession, sf_dir: str, query: str = _query, indexed: bool = _indexed) -> DataFrame:
            return _segmented(spark, sf_dir, query, indexed)


def _rank_of(where: str) -> str:
    left = _scored(["trash", "loser"], "f0 + f1 > 0").replace("doc_pages", f"(SELECT * FROM doc_pages WHERE {where}) u")
    return f"SELECT file_id, location, round(raw, 4) AS score FROM ({left}) r"


def _old_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TextIndex]:
    """The pages, and an index in which a third of the files have old texts."""
    pages = fixtures.view(spark, sf_dir, "doc_pages").select("file_id", "location", "body")
    old = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("trash of old "), F.coalesce("body", F.lit("")))).otherwise(F.col("body"))
    return pages, _index(pages.withColumn("body", old))


@registered(_rank_of("file_id % 11 <> 3"))
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of old texts, brought up to date: a third of the files changed, an eleventh gone."""
    pages, index = _old_index(spark, sf_dir)
    index.upsert(pages.where("file_id % 3 = 0 AND file_id % 11 <> 3"), pages.where("file_id % 11 = 3").select("file_id"))
    return TextIndex(spark, index.path).rank("trash loser").select("file_id", "location", F.round("score", 4).alias("score"))


@registered(_rank_of("file_id % 11 <> 3 AND file_id % 13 <> 5"))
def index_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of upserts, one of them from another opening of the index, and a compaction."""
    pages, index = _old_index(spark, sf_dir)
    index.upsert(pages.where("file_id % 6 = 0"))
    index.upsert(pages.where("file_id % 6 = 3"), pages.where("file_id % 11 = 3").select("file_id"))
    index.upsert(pages.where("file_id % 11 = 3 AND file_id % 2 = 0"))  # some come back
    index = TextIndex(spark, index.path)
    index.upsert(None, pages.where("file_id % 13 = 5 OR file_id % 11 = 3").select("file_id"))
    index.compact(whole=True)
    return TextIndex(spark, index.path).rank("trash loser").select("file_id", "location", F.round("score", 4).alias("score"))


@registered("SELECT count(DISTINCT file_id) AS files FROM doc_pages")
def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.file_count(fixtures.view(spark, sf_dir, "doc_pages"))


_PLAIN = "regexp_replace(body, '[^\\x00-\\x7F]', '?', 'g')"


@registered(f"""SELECT file_id, keyword, substr(b, greatest(begins - 250, 0) + 1, length(keyword) + 500) AS snippet FROM (
  SELECT file_id, b, keyword, CAST(list_sum(list_transform(parts[:k], lambda x: length(x))) + (k - 1) * length(keyword) AS BIGINT) AS begins FROM (
    SELECT file_id, b, keyword, string_split(b, keyword) AS parts, unnest(range(1, len(string_split(b, keyword)))) AS k
    FROM (SELECT d.file_id, lower({_PLAIN}) AS b FROM ({_scored(['trash', 'loser'], 'f0 + f1 > 0')} ORDER BY raw DESC, file_id LIMIT 500) r JOIN doc_pages d ON d.file_id = r.file_id) t, (VALUES ('trash'), ('loser')) w(keyword)) u) h""".replace("FROM doc_pages WHERE", f"FROM (SELECT * REPLACE ({_PLAIN} AS body) FROM doc_pages) pl WHERE"))
def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit in the best pages with the text around it; letters beyond ASCII replaced, as SQL can't cut bytes."""
    view = fixtures.view(spark, sf_dir, "doc_pages").withColumn("body", F.regexp_replace("body", "[^\\x00-\\x7F]", "?"))
    found = fulltext.search(view.select("file_id", "location", "body"), view, "trash loser")
    return found.select("file_id", F.explode("hits").alias("hit")).select("file_id", "hit.keyword", "hit.snippet")


_SNIPPET = """left(body, CAST(coalesce(list_min(list_filter(range(125, 501), lambda k: strlen(left(body, CAST(k AS BIGINT))) >= 500)), length(body)) AS BIGINT))"""
_DOC_SIZE = f"CASE WHEN file_size < 1024 THEN concat(CAST(file_size AS VARCHAR), ' B') WHEN file_size < 1048576 THEN concat({_exact('file_size', 1024, 1)}, ' KB') ELSE concat({_exact('file_size', 1 << 20, 1)}, ' MB') END"


@registered(
    f"""SELECT d.filename AS "文件名", d.path AS "路径", CAST(r.location AS VARCHAR) AS "位置", printf('%.2f', r.raw) AS "分数",
  CAST(len(list_filter(string_split(lower(d.body), ' '), lambda t: t = 'moron')) AS VARCHAR) AS "命中次数", strftime(to_timestamp(d.mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS "修改时间(UTC)",
  {_DOC_SIZE} AS "文件大小", replace(concat({_SNIPPET.replace('body', 'lower(body)')}, CASE WHEN strlen(lower(body)) > 500 THEN '...' ELSE '' END), 'moron', '【moron】') AS "摘要"
FROM ({_scored(['moron'], 'f0 > 0')} ORDER BY raw DESC, file_id LIMIT 500) r JOIN doc_pages d ON d.file_id = r.file_id"""
)
def result_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = fixtures.view(spark, sf_dir, "doc_pages")
    return sinks.result_rows(fulltext.search(view.select("file_id", "location", "body"), view, "moron"), view)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
