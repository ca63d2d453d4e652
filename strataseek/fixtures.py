"""Deterministic tables of files, pages, snapshots and events, derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a base table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.schema import ATTRIBUTES, FILE_ENTRY

FILE_ENTRIES = """
SELECT file_ord, CONCAT(parent_path, '/', file_name) AS full_path, file_name, extension, parent_path, size,
       date_modified, is_directory, read_only, hidden, archive, run_count
FROM (
SELECT file_ord, parent_path,
  CASE WHEN is_directory THEN CONCAT('batch_', CAST(file_ord AS VARCHAR(20)))
       WHEN ext = '' THEN stem ELSE CONCAT(stem, '.', ext) END AS file_name,
  CASE WHEN is_directory THEN '' ELSE ext END AS extension,
  CASE WHEN is_directory AND file_ord % 2 = 0 THEN 0 ELSE size END AS size,
  date_modified, is_directory, read_only, hidden, archive, run_count
FROM (
SELECT o_orderkey AS file_ord,
  CONCAT('/data/cust', CAST(o_custkey % 50 AS VARCHAR(20)), '/', o_orderstatus) AS parent_path,
  CONCAT(CASE WHEN o_orderkey % 7 = 0 THEN 'Report_' WHEN o_orderkey % 7 = 1 THEN 'test ' WHEN o_orderkey % 7 = 2 THEN '文档' ELSE 'order-' END,
         CAST(o_orderkey AS VARCHAR(20))) AS stem,
  CASE o_orderkey % 12 WHEN 0 THEN 'mp3' WHEN 1 THEN 'FLAC' WHEN 2 THEN 'docx' WHEN 3 THEN 'pdf' WHEN 4 THEN 'txt' WHEN 5 THEN 'jpg'
    WHEN 6 THEN 'mp4' WHEN 7 THEN 'zip' WHEN 8 THEN 'exe' WHEN 9 THEN 'rs' WHEN 10 THEN 'tar' ELSE '' END AS ext,
  CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE CAST(FLOOR(o_totalprice) AS BIGINT) *
    (CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 256 ELSE 4096 END) END AS size,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS date_modified,
  o_orderkey % 19 = 0 AS is_directory, o_orderpriority = '1-URGENT' AS read_only,
  o_orderkey % 23 = 0 AS hidden, o_orderkey % 3 = 0 AS archive,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 10 ELSE 0 END AS run_count
FROM {orders}) a) b"""

DOC_PAGES = """
SELECT doc_id AS file_id, CAST(1 AS BIGINT) AS location, CONCAT(source, '/doc_', CAST(doc_id AS VARCHAR(20)), '.txt') AS path,
       CONCAT('doc_', CAST(doc_id AS VARCHAR(20)), '.txt') AS filename, text AS body, n_chars AS file_size,
       1700000000 + doc_id AS mtime FROM {documents}"""

SNAPSHOT_KNOWN = f"SELECT path, mtime, md5(body) AS md5, file_id FROM ({DOC_PAGES}) p WHERE file_id % 10 <> 0"

SNAPSHOT_DISK = f"SELECT path, mtime + CASE WHEN file_id % 5 = 1 THEN 60 ELSE 0 END AS mtime, md5(body) AS md5 FROM ({DOC_PAGES}) p WHERE file_id % 7 <> 0"

WATCH_EVENTS = """
SELECT event_id AS seq, ts, CONCAT('/data/cust', CAST(user_id % 50 AS VARCHAR(20)), '/F/order-', CAST(event_id % 200 AS VARCHAR(20)), '.rs') AS path,
       CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'modified' ELSE 'opened' END AS kind FROM {events}"""

SEARCH_LOG = "SELECT event_id AS seq, ts, props AS query FROM {events} WHERE event_type = 'view'"

VIEWS = {
    "file_entries": FILE_ENTRIES,
    "doc_pages": DOC_PAGES,
    "snapshot_known": SNAPSHOT_KNOWN,
    "snapshot_disk": SNAPSHOT_DISK,
    "watch_events": WATCH_EVENTS,
    "search_log": SEARCH_LOG,
}

TABLES = ("orders", "documents", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of files in the full schema of a file row."""
    raw = view(spark, sf_dir, "file_entries")
    own = {"read_only", "hidden", "archive"}
    flags = F.struct(*((F.col(f.name) if f.name in own else F.col("is_directory") if f.name == "directory" else F.lit(False)).alias(f.name) for f in ATTRIBUTES))
    return raw.withColumn("attributes", flags).select(*((F.col(f.name) if f.name in (*raw.columns, "attributes") else F.lit(None)).cast(f.dataType).alias(f.name) for f in FILE_ENTRY))


def with_views(sql: str) -> str:
    """A statement for DuckDB, with the views it names before it."""
    named = [n for n in VIEWS if n in sql]
    plain = lambda s: reduce(lambda x, t: x.replace("{" + t + "}", t), TABLES, s)
    return f"WITH {', '.join(f'{n} AS ({plain(VIEWS[n])})' for n in named)}\n{sql}" if named else sql
