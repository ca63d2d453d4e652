"""Run and search histories, from event rows or as running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_history(events: DataFrame, most: int = 0) -> DataFrame:
    """``path, run_count, last_run`` of opened paths; with ``most``, the oldest by first opening go beyond that many."""
    out = events.where("kind = 'opened'").groupBy("path").agg(F.count("*").alias("run_count"), F.max("ts").alias("last_run"), F.min("seq").alias("first_seq"))
    if most:
        out = out.orderBy(F.col("first_seq").desc()).limit(most)
    return out.select("path", "run_count", "last_run")


def increment(history: DataFrame, events: DataFrame) -> DataFrame:
    """A history with the openings of ``events`` added."""
    both = history.select("path", "run_count", "last_run").unionByName(run_history(events))
    return both.groupBy("path").agg(F.sum("run_count").alias("run_count"), F.max("last_run").alias("last_run"))


def most_run(history: DataFrame, limit: int) -> DataFrame:
    return history.orderBy(F.col("run_count").desc(), "path").limit(limit)


def last_run(history: DataFrame, limit: int) -> DataFrame:
    return history.orderBy(F.col("last_run").desc_nulls_last(), "path").limit(limit)


def recent_searches(log: DataFrame, limit: int = 100) -> DataFrame:
    """``query, seq`` of distinct searches, the latest first; a repeated search moves to the front, empty ones don't count."""
    latest = log.where(F.coalesce(F.col("query"), F.lit("")) != "").groupBy("query").agg(F.max("seq").alias("seq"))
    return latest.orderBy(F.col("seq").desc()).limit(limit)


def first_searches(log: DataFrame, limit: int = 20) -> DataFrame:
    """As ``recent_searches``, but a repeated search keeps the place of its first."""
    first = log.where(F.coalesce(F.col("query"), F.lit("")) != "").groupBy("query").agg(F.min("seq").alias("seq"))
    return first.orderBy(F.col("seq").desc()).limit(limit)
