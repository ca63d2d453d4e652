"""Settings of streaming queries with state of their own kind."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: The store that such state needs; changes are uploaded rather than whole stores, and no disk is set aside for each of many small ones.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries that start within have the settings; the session's own come back."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    try:
        for name, value in STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
