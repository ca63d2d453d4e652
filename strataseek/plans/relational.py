"""Functions of the query language that look at other rows: a query becomes a plan of joins, not one condition.

``dupe:`` and its kin ask whether other files share a key, ``childcount:`` and its kin what lies in a folder. Each is a
semi-join of the candidate rows with an aggregation of the whole table, combined before its shuffle: a name that a third
of all files share is a row a task. Conditions on the row itself are applied first, so they reach the scan.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions import formatting, paths
from strataseek.plans.options import SearchOptions
from strataseek.plans.query import Query, condition_of, number_condition, parse, predicate

#: What rows of one group of duplicates share.
DUPLICATES = {
    "dupe": lambda: F.lower("file_name"),
    "namepartdupe": lambda: F.lower(paths.stem(F.col("file_name"))),
    "sizedupe": lambda: F.col("size"),
    "dmdupe": lambda: F.col("date_modified"),
    "dcdupe": lambda: F.col("date_created"),
    "dadupe": lambda: F.col("date_accessed"),
    "attribdupe": lambda: formatting.attribute_bits(F.col("attributes")),
}
CHILD_COUNTS = {"childcount": "_all", "childfilecount": "_files", "childfoldercount": "_folders"}
FOLDERS = {"parent", "infolder"}
RELATIONAL = {*DUPLICATES, *CHILD_COUNTS, *FOLDERS, "child"}


def shared(files: DataFrame, key: Column) -> DataFrame:
    """``_key`` of the keys that more than one file has; null is no key."""
    keyed = files.where(~F.col("is_directory")).select(key.alias("_key")).where(F.col("_key").isNotNull())
    return keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")


def _inside(files: DataFrame) -> DataFrame:
    """What lies in each folder that has anything in it."""
    folder = F.col("is_directory")
    return files.groupBy(F.col("parent_path").alias("_folder")).agg(F.count("*").alias("_all"), F.count_if(~folder).alias("_files"), F.count_if(folder).alias("_folders"))


def applied(files: DataFrame, found: DataFrame, name: str, value: str) -> DataFrame:
    """The rows of ``found`` for which ``name:value`` holds among all ``files``."""
    if name in DUPLICATES:
        key = DUPLICATES[name]()
        candidates = found.where(~F.col("is_directory")).withColumn("_key", key)
        return candidates.join(shared(files, key), "_key", "left_semi").select(*found.columns)
    if name in CHILD_COUNTS:
        held = number_condition(F.coalesce(F.col(CHILD_COUNTS[name]), F.lit(0)), value) if value else F.coalesce(F.col(CHILD_COUNTS[name]), F.lit(0)) > 0
        folders = found.where("is_directory")
        return folders.join(_inside(files), folders["full_path"] == F.col("_folder"), "left").where(held).select(*(folders[c] for c in found.columns))
    if name in FOLDERS:
        return found.where(F.lower("parent_path") == (value.lower().rstrip("/") or value.lower()))
    holders = files.where(F.contains(F.lower("file_name"), F.lit(value.lower()))).select(F.col("parent_path").alias("_folder"))
    folders = found.where("is_directory")
    return folders.join(holders, folders["full_path"] == F.col("_folder"), "left_semi")


def matching(files: DataFrame, text: str, options: SearchOptions | None = None, now: datetime | None = None, compat: bool = False, among: DataFrame | None = None) -> DataFrame:
    """The rows that a query matches. With ``compat`` the functions that look at other rows hold for every row.

    ``among``: the only rows that can match, if that is known.
    """
    among = files if among is None else among
    options = options or SearchOptions()
    query: Query | None = None if compat or options.regex or not text else parse(text, options)
    related = [f for f in query.filters if f[0] in RELATIONAL] if query else []
    if not related:
        condition = predicate(text, options, now, compat)
        return among if condition is None else among.where(condition)
    own = replace(query, filters=[f for f in query.filters if f[0] not in RELATIONAL])
    condition = condition_of(own, now, compat)
    found = among if condition is None else among.where(condition)
    for name, value in related:
        found = applied(files, found, name, value)
    return found
