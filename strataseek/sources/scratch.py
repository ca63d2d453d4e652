"""Folders for tables that a job writes and reads back, below the folder that the session names as shared."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder and a cluster an error: no shared folder can be guessed."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="strataseek-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/strataseek/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: a short lineage, and what an executor loses is read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path in its own form."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop() -> None:
    """Delete what this process has written so; what can't be deleted stays listed."""
    left = []
    while _made:
        spark, path = _made.pop()
        try:
            system, target = files_of(spark, path)
            system.delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone when the process ends; the others are still tried
            left.append((spark, path))
    _made.extend(left)


atexit.register(drop)
