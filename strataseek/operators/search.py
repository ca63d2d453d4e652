"""Search over the table of files: predicate, stable sort, page."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions import formatting, paths
from strataseek.plans.options import SearchOptions, SortField, SortSpec
from strataseek.plans.relational import DUPLICATES, matching, shared


def sort_keys(spec: SortSpec) -> list[Column]:
    """Keys of a sort. Nulls come first ascending and last descending; ties keep the order of the scan either way."""
    column = {
        SortField.NAME: F.lower("file_name"),
        SortField.PATH: paths.components(F.col("full_path")),
        SortField.SIZE: F.col("size"),
        SortField.EXTENSION: F.lower("extension"),
        SortField.DATE_CREATED: F.col("date_created"),
        SortField.DATE_MODIFIED: F.col("date_modified"),
        SortField.DATE_ACCESSED: F.col("date_accessed"),
        SortField.ATTRIBUTES: formatting.attribute_bits(F.col("attributes")),
        SortField.FILE_LIST_FILE_NAME: F.col("file_list_filename"),
        SortField.RUN_COUNT: F.col("run_count"),
        SortField.DATE_RECENTLY_CHANGED: F.col("date_recently_changed"),
        SortField.DATE_RUN: F.col("date_run"),
    }[spec.field]
    return [column.desc() if spec.descending else column.asc(), F.col("file_ord").asc()]


def sort_entries(files: DataFrame, spec: SortSpec) -> DataFrame:
    return files.orderBy(*sort_keys(spec))


def search(files: DataFrame, query: str, options: SearchOptions | None = None, now: datetime | None = None, compat: bool = False) -> DataFrame:
    """Matches, sorted, from ``offset``, ``max_results`` of them (0: all).

    Sort and limit become one top-k, so no more than a page leaves each task. With
    ``compat``, an offset beyond the last match is ignored, which takes a count.
    """
    options = options or SearchOptions()
    found = matching(files, query, options, now, compat)
    offset = options.offset
    if compat and offset and offset >= found.count():
        offset = 0
    out = sort_entries(found, options.sort)
    if offset:
        out = out.offset(offset)
    return out.limit(options.max_results) if options.max_results else out


def quick_search(files: DataFrame, query: str, max_scan: int, options: SearchOptions | None = None, now: datetime | None = None) -> DataFrame:
    """A search over the first ``max_scan`` rows of the scan only; offsets don't count."""
    options = options or SearchOptions()
    out = sort_entries(matching(files.where(F.col("file_ord") < max_scan), query, options, now), options.sort)
    return out.limit(options.max_results) if options.max_results else out


def counts(files: DataFrame) -> DataFrame:
    """Number of rows, files and folders, as one row."""
    return files.agg(F.count("*").alias("total"), F.count_if(~F.col("is_directory")).alias("files"), F.count_if("is_directory").alias("folders"))


def with_run_history(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files with ``run_count`` and ``date_run`` from a history (path, run_count, last_run)."""
    named = history.select(F.col("path").alias("full_path"), F.col("run_count").alias("_n"), F.col("last_run").alias("_at"))
    out = files.join(named, "full_path", "left").withColumns({"run_count": F.coalesce("_n", F.lit(0).cast("long")), "date_run": F.col("_at")})
    return out.select(*files.columns)


def duplicates(files: DataFrame, by: str = "name") -> DataFrame:
    """Files that share their folded name, size or modification date with another; as the ``dupe:`` functions of queries."""
    key = DUPLICATES[{"name": "dupe", "size": "sizedupe", "date": "dmdupe"}[by]]()
    keyed = files.where(~F.col("is_directory")).withColumn("_key", key)
    return keyed.join(shared(files, key), "_key", "left_semi").select(*files.columns)


def child_counts(files: DataFrame) -> DataFrame:
    """Folders with their number of files and folders."""
    inside = files.groupBy(F.col("parent_path").alias("full_path")).agg(F.count_if(~F.col("is_directory")).alias("child_files"), F.count_if("is_directory").alias("child_folders"))
    folders = files.where("is_directory").join(inside, "full_path", "left")
    return folders.select(*files.columns, F.coalesce("child_files", F.lit(0)).alias("child_files"), F.coalesce("child_folders", F.lit(0)).alias("child_folders"))
