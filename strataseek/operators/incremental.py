"""Incremental maintenance: comparing an index with the disk, upserts, sweeps, ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.operators.listing import numbered


def save_snapshot(files: DataFrame, path: str, buckets: int = 200) -> DataFrame:
    """Write a snapshot (path, mtime, md5, ...) in buckets of its paths, so that it is compared with others of as many buckets where it lies."""
    name = f"snapshot_{uuid.uuid4().hex}"
    files.write.bucketBy(buckets, "path").sortBy("path").option("path", path).format("parquet").saveAsTable(name)
    return files.sparkSession.table(name)


def open_snapshot(spark: SparkSession, path: str, buckets: int = 200) -> DataFrame:
    """A snapshot that has been saved in so many buckets."""
    name = f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def compare_index(known: DataFrame, disk: DataFrame) -> DataFrame:
    """Numbers of new, modified and deleted paths; both sides have path, mtime, md5."""
    return changes(known, disk).agg(*(F.count_if(F.col("change") == c).alias(f"{c}_count") for c in ("new", "modified", "deleted")))


def changes(known: DataFrame, disk: DataFrame) -> DataFrame:
    """``path, change`` of every path that differs: new, modified (time or fingerprint) or deleted."""
    a = known.select("path", F.col("mtime").alias("a_mtime"), F.col("md5").alias("a_md5"), F.lit(True).alias("a"))
    b = disk.select("path", F.col("mtime").alias("b_mtime"), F.col("md5").alias("b_md5"), F.lit(True).alias("b"))
    both = a.join(b, "path", "full_outer")
    differs = ~(F.col("a_mtime").eqNullSafe(F.col("b_mtime")) & F.col("a_md5").eqNullSafe(F.col("b_md5")))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(differs, "modified")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())


def to_index(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Files on disk whose time or fingerprint the index doesn't have; what both sides lack is equal."""
    k = known.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("md5").alias("_md5"))

    def equal(a: Column, b: Column) -> Column:  # said so that it is no key of the join: snapshots lie by path
        return F.coalesce(a == b, a.isNull() & b.isNull())

    return disk.join(k, (disk["path"] == k["_path"]) & equal(disk["mtime"], k["_mtime"]) & equal(disk["md5"], k["_md5"]), "left_anti")


def sweep(known: DataFrame, disk: DataFrame) -> DataFrame:
    """The index without paths that are gone."""
    return known.join(disk.select("path"), "path", "left_semi")


def gone(known: DataFrame, disk: DataFrame) -> DataFrame:
    return known.join(disk.select("path"), "path", "left_anti")


def assign_ids(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``file_id``: a known path keeps its id, new ones count on from the largest."""
    last = known.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    ids = known.select("path", "file_id")
    old = incoming.join(ids, "path")
    new = numbered(incoming.join(ids, "path", "left_anti"), [F.col("path")], "file_id", first=last + 1)
    return old.unionByName(new)


def upsert_pages(pages: DataFrame, changed: DataFrame, gone_ids: DataFrame | None = None) -> DataFrame:
    """All pages with those of changed files replaced and those of gone files removed."""
    stale = changed.select("file_id").distinct()
    if gone_ids is not None:
        stale = stale.unionByName(gone_ids.select("file_id")).distinct()
    return pages.join(stale, "file_id", "left_anti").unionByName(changed.select(*pages.columns))
