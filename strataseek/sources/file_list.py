"""File lists (CSV with filename, size, dates and attributes) and the JSON database, both ways."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.functions import paths
from strataseek.schema import ATTRIBUTES, FILE_ENTRY, FILE_LIST


def load(spark: SparkSession, path: str, broken_is_empty: bool = False) -> DataFrame:
    """Rows of a file list; sizes that can't be read are 0. A row of another width is an error, or with ``broken_is_empty`` the list counts as empty."""
    mode = "PERMISSIVE" if broken_is_empty else "FAILFAST"
    schema = T.StructType([*FILE_LIST.fields, T.StructField("_broken", T.StringType())])
    # whether a row is broken shows only where all its columns are read
    raw = spark.read.option("columnPruning", "false").csv(path, schema=schema if broken_is_empty else FILE_LIST, header=True, mode=mode, escape='"', enforceSchema=True, columnNameOfCorruptRecord="_broken")
    out = raw.select("filename", F.coalesce(F.col("size").try_cast("long"), F.lit(0)).alias("size"), "date_created", "date_modified", F.coalesce("attributes", F.lit("")).alias("attributes"))
    if broken_is_empty and raw.select("filename", "_broken").where(F.col("_broken").isNotNull()).limit(1).collect():
        return out.where(F.lit(False))
    return out


def to_entries(listed: DataFrame, list_name: str, compat: bool = False) -> DataFrame:
    """File rows of a list. Dates that are epoch seconds or timestamps are kept; ``compat`` leaves them null."""

    def stamp(name: str):
        seconds = F.col(name).try_cast("long")
        return F.lit(None).cast("timestamp") if compat else F.coalesce(F.timestamp_seconds(seconds), F.col(name).try_cast("timestamp"))

    name = paths.file_name(F.col("filename"))
    folder = F.contains("attributes", F.lit("D"))
    letters = {"read_only": "R", "hidden": "H", "system": "S", "directory": "D", "archive": "A", "normal": "N", "temporary": "T", "compressed": "C", "encrypted": "E"}
    flags = [(F.contains("attributes", F.lit(letters[f.name])) if f.name in letters and not compat else F.lit(False)).alias(f.name) for f in ATTRIBUTES]
    values = {
        "file_ord": F.monotonically_increasing_id(),
        "full_path": F.col("filename"),
        "file_name": name,
        "extension": F.when(folder, "").otherwise(paths.extension(name)),
        "parent_path": paths.parent(F.col("filename")),
        "size": F.col("size"),
        "date_created": stamp("date_created"),
        "date_modified": stamp("date_modified"),
        "attributes": F.struct(*flags),
        "is_directory": folder,
        "file_list_filename": F.lit(list_name),
        "run_count": F.lit(0).cast("long"),
    }
    return listed.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FILE_ENTRY))


def from_entries(files: DataFrame) -> DataFrame:
    """A file list of file rows: dates as epoch seconds, D for folders."""
    seconds = lambda c: F.coalesce(F.unix_seconds(c).cast("string"), F.lit(""))
    return files.select(
        F.col("full_path").alias("filename"),
        F.col("size").cast("string").alias("size"),
        seconds("date_created").alias("date_created"),
        seconds("date_modified").alias("date_modified"),
        F.lit("").alias("date_accessed"),
        F.when(F.col("is_directory"), "D").otherwise("").alias("attributes"),
    )


def load_database(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON database (bzip2 or plain); a missing one has none."""
    schema = T.StructType([T.StructField("entries", T.ArrayType(FILE_ENTRY))])
    try:
        raw = spark.read.json(path, schema=schema, multiLine=True)
    except PySparkException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FILE_ENTRY)
    return raw.select(F.explode("entries").alias("e")).select("e.*")


def save_database(files: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a database: Parquet, split by rows, or with ``form="json"`` what ``load_database`` reads.

    JSON goes out as bzip2, one document of entries for each partition, streamed.
    """
    if form == "parquet":
        files.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    if form != "json":
        raise ValueError(f"no such form of a database: {form}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"magic":"EZDB","entries":['
        for b in batches:
            lines = b.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *("," + x for x in lines[1:])])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]}" if before == "," else before + "]}"])], names=["value"])

    entries = files.select(F.to_json(F.struct(*FILE_ENTRY.names)).alias("value"))
    entries.mapInArrow(run, "value string").write.mode("overwrite").option("compression", "bzip2").text(path)
