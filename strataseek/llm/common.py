"""Plumbing shared by the training-data operators.

Per-row work runs in ``mapInArrow``: one Arrow batch in, one out, so a task's
memory is one batch and a lost executor only costs a re-read of its split.
Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the
folder that every executor sees.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_made: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is named, a local master (tests) gets a temporary one, and a cluster an error: no folder can be guessed there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strataseek-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with ``drop_written``."""
    path = f"{scratch_dir(spark).rstrip('/')}/strataseek/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, columnar, replicated by the store."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting for shuffle files to go when the execution that made them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_clean(df: DataFrame, name: str) -> DataFrame:
    """As ``written``; what was shuffled to make the table is deleted at once, so that steps one after the other need the disk of the largest, not of all."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def drop_written() -> None:
    """Delete the scratch tables of this process; results that still read them become unreadable. What can't be deleted stays listed."""
    left = []
    while _made:
        session, path = _made.pop()
        try:
            jvm = session.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone when the process ends; the other tables are still tried
            left.append((session, path))
    _made.extend(left)


atexit.register(drop_written)


def portions(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of up to ``rows`` rows and ``most`` bytes of texts; a longer text comes by itself."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right"))
        upto = min(max(upto, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list | None]],
    fields: list[tuple[str, T.DataType]],
    keep: Iterable[str],
    rows: int = 1 << 30,
    most: int = 1 << 60,
    remembers: bool = False,
) -> DataFrame:
    """Append columns computed from whole Arrow batches.

    ``make()`` runs once a task and returns ``fn(batch) -> columns`` (one list or
    Arrow array per entry of ``fields``). ``keep`` names the input columns that
    stay; an input column whose name is also in ``fields`` gives way to the new one.
    Batches of more than ``rows`` rows or ``most`` bytes of texts are handed over in slices.
    What the worker remembers of another operator (``remembered``) goes first, unless this one ``remembers`` too.
    """
    names = {n for n, _ in fields}
    kept = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    arrow = [(n, to_arrow_type(t)) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        fn = make()
        for batch in (p for b in batches for p in (portions(b, rows, most) if most < 1 << 60 else (b.slice(at, rows) for at in range(0, b.num_rows, rows)))):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, (_, t) in zip(fn(batch), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + made, names=kept + [n for n, _ in arrow])

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` begins with it."""
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    return name


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """One row for each of the ``rows`` smallest different values of the 64-bit hash ``key``; rows of equal key count as one.

    Of a larger table only hashes below a bound are ranked, some twice as many values as wanted, so that
    not every task sends as many as are wanted in all. The bound counts different values, as copies say nothing of how hashes spread.
    """
    name = unused(df, "_key")
    keyed = df.withColumn(name, key)
    n = keyed.select(name).distinct().count()
    if n > 4 * rows:
        keyed = keyed.where(F.col(name) < F.lit(-(1 << 63) + (1 << 64) * 2 * rows // n))
    return keyed.dropDuplicates([name]).orderBy(name).limit(rows).drop(name)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A batch's texts, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


_remembered: dict = {}


def remembered(key: Hashable, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks: one thing at a time, as the worker serves other operators too."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Let go of what is remembered, and give memory that lies idle back to the system."""
    _remembered.clear()
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """A function's results, forgotten all at once when there are ``limit`` of them."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
