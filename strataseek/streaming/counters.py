"""Run histories kept by a stream: counts of openings with the latest, first-in eviction and expiry.

Each owner (a user, a machine; one for all, if there is one) has a history of its own, a state of bounded size: a path is
counted where it is known, else inserted with one; beyond ``most`` paths the one inserted first goes, and counts from one
again if it comes back. An owner without openings for ``idle`` is forgotten. Events of a batch are taken in the order of
time and number. What a batch changes is written under its number, so that a batch that is repeated after a failure
writes the same again; ``current`` is the last word on each path.

Histories without eviction don't depend on order: their openings are combined where they are read, so an owner or path that
a third of all events has is a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from strataseek.streaming.state import stateful

CHANGES = "owner string, path string, run_count long, last_run timestamp, kept boolean"


class History(StatefulProcessor):
    """One owner's history: path -> (count, last opening, number of the insertion)."""

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle) -> None:
        ttl = {} if self.idle_ms is None else {"ttlDurationMs": self.idle_ms}
        self.paths = handle.getMapState("paths", "path string", "n long, at timestamp, place long", **ttl)
        self.places = handle.getValueState("places", "last long", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        known = {k[0]: v for k, v in self.paths.iterator()}
        before = dict(known)
        last = self.places.get()[0] if self.places.exists() else 0
        order = sorted(known, key=lambda p: known[p][2])  # by insertion
        gone = 0  # of ``order``, how many have been evicted from its beginning
        for path, at in zip(events["path"], events["ts"], strict=True):
            if path in known:
                count, latest, place = known[path]
                known[path] = (count + 1, at if latest is None or at > latest else latest, place)
                continue
            last += 1
            known[path] = (1, at, last)
            order.append(path)
            if self.most and len(known) > self.most:
                del known[order[gone]]
                gone += 1
        changed = [(p, *known[p][:2], True) for p in known if before.get(p) != known[p]] + [(p, 0, None, False) for p in before if p not in known]
        for p, *_, kept in changed:
            self.paths.updateValue((p,), known[p]) if kept else self.paths.removeKey((p,))
        self.places.update((last,))
        yield pd.DataFrame([(key[0], *c) for c in changed], columns=["owner", "path", "run_count", "last_run", "kept"])

    def close(self) -> None:
        pass


def openings(events: DataFrame) -> DataFrame:
    """``owner, path, seq, ts`` of opened paths."""
    return events.where("kind = 'opened' AND path IS NOT NULL").select("owner", "path", "seq", "ts")


def count(events: DataFrame, path: str, most: int = 0, idle: int | None = None, **trigger) -> None:
    """Take a stream of events (owner, path, seq, ts, kind) into the history below ``path``, all that there is or by another trigger; again after any stop.

    ``idle``: seconds without openings after which an owner's paths are forgotten, by the clock. Without ``most`` and ``idle`` the
    counts are a plain streaming aggregation, combined before its shuffle.
    """
    spark = events.sparkSession
    if most or idle:
        keyed = openings(events).groupBy("owner")
        changes = keyed.transformWithStateInPandas(History(most, idle and idle * 1000), CHANGES, "Update", "ProcessingTime" if idle else "None")
    else:
        counted = openings(events).groupBy("owner", "path").agg(F.count("*").alias("run_count"), F.max("ts").alias("last_run"))
        changes = counted.withColumn("kept", F.lit(True))

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    with stateful(spark):
        query = changes.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
        if not trigger:
            query.awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """``owner, path, run_count, last_run`` of the history below ``path``."""
    changes = spark.read.schema(f"{CHANGES}, batch int").parquet(f"{path}/changes")
    last = changes.groupBy("owner", "path").agg(F.max_by(F.struct("run_count", "last_run", "kept"), "batch").alias("x"))
    return last.where("x.kept").select("owner", "path", "x.run_count", "x.last_run")
