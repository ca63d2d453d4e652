"""Change events applied to the table of files.

Events are rows (seq, ts, path, kind). The last event of a path in a batch decides:
added and modified paths are replaced by the rows that a scan now gives for them and
what is below them, removed ones go with all that is below them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.operators.incremental import assign_ids
from strataseek.operators.text_index import TextIndex
from strataseek.schema import WATCH_EVENT
from strataseek.sources.pages import documents_of, extract
from strataseek.sources.scratch import files_of, written

#: Touched paths that may be sent to every task, and documents that are read at once.
SENT, AT_ONCE = 1_000_000, 1000


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path (by time, then number); combined before the shuffle, so a busy path is a row a task."""
    last = events.where(F.col("kind") != "opened").groupBy("path").agg(F.max(F.struct("ts", "seq", "kind")).alias("e"))
    return last.select("path", "e.seq", "e.ts", "e.kind")


def touched_by(files: DataFrame, touched: DataFrame, name: str = "_touched") -> DataFrame:
    """``files`` with a flag: whether a row is one of the touched paths or lies below one.

    A touched path of k parts can only be the first k parts of a file's path, so each number of parts that occurs
    among the touched paths is one equi-join with them. As a rule they are few and sent to every task, and
    the files stay where they are; nothing is made of the folders above every file.
    """
    roots = touched.select(F.col("path").alias("_root")).where(F.col("_root").isNotNull()).groupBy("_root").agg(F.size(F.split("_root", "/")).alias("_parts"))
    counts = {r["_parts"]: r["n"] for r in roots.groupBy("_parts").agg(F.count("*").alias("n")).collect()}  # a row for each depth
    few = sum(counts.values()) <= SENT
    out = files.withColumn(name, F.lit(False))
    for parts in sorted(counts):
        own = roots.where(F.col("_parts") == parts).select("_root", F.lit(True).alias("_hit"))
        joined = out.join(F.broadcast(own) if few else own, F.substring_index("full_path", "/", parts) == F.col("_root"), "left")
        out = joined.withColumn(name, F.col(name) | F.col("_hit").isNotNull()).drop("_root", "_hit")
    return out


def without(files: DataFrame, touched: DataFrame) -> DataFrame:
    """Files that are neither a touched path nor below one."""
    return touched_by(files, touched).where("NOT _touched").drop("_touched")


def apply_events(files: DataFrame, events: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """The table after a batch of events; ``scanned`` holds the rows that now stand at the added and modified paths."""
    last = latest(events)
    out = without(files, last)
    if scanned is None:
        return out
    wanted = touched_by(scanned, last.where(F.col("kind") != "removed")).where("_touched")
    return out.unionByName(wanted.dropDuplicates(["full_path"]).select(*files.columns))


def follow(events: DataFrame, load: Callable[[], DataFrame], scan: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Apply a stream of events batch by batch; ``save`` gets the new table and the batch's number, and writes a new version.

    A batch that is repeated after a failure gives the same table: paths are replaced, not added to.
    """

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(apply_events(load(), batch, scan(latest(batch).where(F.col("kind") != "removed"))), number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow_documents(events: DataFrame, index: TextIndex, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Keep a full-text index and its table of files (file_id, path, filename, mtime, md5, file_size) up to date with a stream of events.

    Of each batch only the touched documents are read, ``AT_ONCE`` at a time; those that are removed, or gone by then, go with
    all that is below them. A batch that is repeated after a failure puts the same pages in the place of its own.
    """
    spark, names = index.spark, ["file_id", "path", "filename", "mtime", "md5", "file_size"]

    def step(batch: DataFrame, number: int) -> None:
        last = written(latest(batch).select("path", "kind"), "touched")
        n = last.count()
        for share in range(shares := -(-n // AT_ONCE)):
            own = last.where(F.pmod(F.xxhash64("path"), F.lit(shares)) == share).collect()
            there, gone = [], []
            for path, kind in own:
                system, target = files_of(spark, path)
                whole = system.makeQualified(target).toString()
                is_file = kind != "removed" and system.exists(target) and system.getFileStatus(target).isFile()
                (there if is_file else gone).append(whole)
            files = load()
            found = documents_of(spark, there)
            ids = written(assign_ids(files.select("path", "file_id"), found.select(*(c for c in names if c != "file_id"))), "documents").select(*names)
            pages = extract(found.select("path", "content")).where("error IS NULL").join(F.broadcast(ids.select("path", "file_id")), "path")
            left = touched_by(files.withColumn("full_path", F.col("path")), spark.createDataFrame([(p,) for p in gone], "path string"))
            stale = left.where("_touched").select("file_id").unionByName(ids.select("file_id"))
            index.upsert(pages.select("file_id", "location", F.col("text").alias("body")), stale)
            save(files.join(stale, "file_id", "left_anti").select(*names).unionByName(ids), number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rebuild(spark: SparkSession, make: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1800 seconds"):
    """Make the table anew again and again; ``save`` gets it with the turn's number, and writes a new version."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda _, number: save(make(), number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind, on event time with a watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "kind", "n")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files that appear in a folder."""
    return spark.readStream.schema(WATCH_EVENT).parquet(path)
