"""Click throttling by token buckets, as a stateful stream.

Clicks come in numbered batches, late and out of order. Each waits in a calendar
queue - event hour to list of clicks, a MapState - until the stream's horizon has
passed it: a tick drains the hours that lie wholly before the horizon, splits the
hour that it falls into, and sorts only what it drains. Drained clicks meet the
token bucket of their client in order of time.

Keys of the state are buckets of clients, because a call to the state costs as much
as hundreds of clicks; a bucket's clients share a queue and one row of credits. A
client with more than ``HOT`` clicks has several keys, its event hours dealt out
over lanes, so that none of them sees more than a share of its clicks. Its
credit can't be carried along a lane; instead each drained hour leaves the map
credit before -> credit after, which has few pieces (a start can change the number
of admitted clicks by no more than a full bucket holds, so equal numbers give one
straight piece), the maps are applied along each hot client's hours, rows of a few
numbers, and every hour is then settled by itself from the credit found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from strataseek.llm.common import scratch_path, written

BATCHES = 10
COST, FULL = 300 * 1_000_000, 12 * 300 * 1_000_000
LATENESS = 6 * 3600 * 1_000_000
HOUR = 3600 * 1_000_000
#: Clicks of a bucket of ordinary clients, about; a client with more than HOT clicks gets a lane for each LANE of them.
BUCKET, HOT, LANE = 400_000, 20_000, 5_000
NEVER, ALWAYS = -(1 << 63), (1 << 63) - 1
LATE, ADMITTED, THROTTLED = "late", "admitted", "throttled"
#: Settings of the stream: the store that the operator needs, changes uploaded rather than whole stores, no disk set aside for each of its many small stores.
#: An executor's stores share one bounded memory, and those of earlier starts, which a look after them closes, don't pile up beside it.
#: A start opens a store for each shuffle partition: each has small write buffers, and none four threads of its own to sum up checkpoint files.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}

_LISTS = "clients array<bigint>, us array<bigint>, ids array<bigint>"
#: Lists of clicks on their way to the queue; no hour: a tick.
_FED = f"client bigint, bucket bigint, hour bigint, {_LISTS}, batch int, late_before bigint, drain_before bigint"
_SETTLED = f"client bigint, hour bigint, batch int, {_LISTS}, outcome array<string>, credit array<bigint>, penalty array<bigint>, penalty_end array<bigint>, low array<bigint>, slope array<bigint>, base array<bigint>"


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 in UTC; a timestamp without a zone is read as UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = (column - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
        return (seconds.cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(column)


def _div(a: Column, by: int) -> Column:
    """The whole part, rounded down."""
    return ((a - F.pmod(a, F.lit(by))) / by).cast("long")


class Bucket:
    """Token buckets of clients: client -> (credit, last settled time, start of the penalty or None)."""

    def __init__(self, state: dict | None = None, cost: int = COST, full: int = FULL):
        self.state, self.cost, self.full = state if state is not None else {}, cost, full

    def settle(self, client: int, us: int) -> tuple[str, int, int | None, int | None]:
        """Outcome, credit after, start and end of the penalty."""
        known = self.state.get(client)
        have, penalty = (self.full, None) if known is None else (min(self.full, known[0] + us - known[1]), known[2])
        if have >= self.cost:
            have -= self.cost
            self.state[client] = (have, us, None)
            return ADMITTED, have, None, None
        penalty = us if penalty is None else penalty
        self.state[client] = (have, us, penalty)
        return THROTTLED, have, penalty, us + self.cost - have


def credit_map(us: list[int], cost: int = COST, full: int = FULL) -> tuple[list[int], list[int], list[int]]:
    """The map from the credit at the first of the (sorted) clicks, its gain included, to the credit after the last.

    From ``low`` on up to the next one, the credit after is ``base`` + ``slope`` * the credit before.
    """
    pieces, at = [(0, 1, 0)], us[0]
    for t in us:
        gain, at = t - at, t
        made = []
        for k, (low, slope, base) in enumerate(pieces):
            end = pieces[k + 1][0] if k + 1 < len(pieces) else full + 1
            if not slope:
                value = min(full, base + gain)
                made.append((low, 0, value - cost if value >= cost else value))
                continue
            base += gain
            # from these starts on a click is admitted, and the bucket is full
            admitted, brim = cost - base, full - base
            if low < admitted:
                made.append((low, 1, base))
            if admitted < end and max(low, admitted) < min(end, brim):
                made.append((max(low, admitted), 1, base - cost))
            if brim < end:
                made.append((max(low, brim), 0, full - cost))
        pieces = [p for k, p in enumerate(made) if not k or p[1:] != made[k - 1][1:]]
    return tuple(map(list, zip(*pieces, strict=True)))


class CalendarQueue(StatefulProcessor):
    """The stateful operator: a row in is a list of clicks of one hour, or a tick; a row out an hour's drained clicks."""

    def init(self, handle) -> None:
        self.queue = handle.getMapState("queue", "hour bigint", _LISTS)
        self.credits = handle.getValueState("credits", "clients array<bigint>, credit array<bigint>, last array<bigint>, penalty array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        client, fresh, late = key[0], {}, ([], [], [])
        for row in rows:
            batch, late_before, drain_before = row.batch, row.late_before, row.drain_before
            if row.hour is None:
                continue
            own = zip(row.clients, row.us, row.ids, strict=True)
            if row.hour * HOUR < late_before:
                own = list(own)
                for click in own:
                    if click[1] < late_before:
                        for x, v in zip(late, click, strict=True):
                            x.append(v)
                own = [click for click in own if click[1] >= late_before]
            fresh.setdefault(row.hour, []).extend(own)
        if late[0]:
            n = len(late[0])
            yield _row(client, None, batch, late, [LATE] * n, [None] * n, [None] * n, [None] * n)
        bucket, loaded = Bucket(), False
        waiting = {k[0] for k in self.queue.keys()}
        for hour in sorted(waiting.union(h for h, x in fresh.items() if x)):
            clicks = fresh.get(hour, [])
            if hour * HOUR >= drain_before and not clicks:
                continue
            if hour in waiting:
                clicks = [*clicks, *zip(*self.queue.getValue((hour,)), strict=True)]
            due = clicks if (hour + 1) * HOUR <= drain_before else [c for c in clicks if c[1] < drain_before]
            if len(due) < len(clicks):
                if due:  # the horizon's hour
                    clicks = [c for c in clicks if c[1] >= drain_before]
                if due or hour in fresh:
                    self.queue.updateValue((hour,), tuple(map(list, zip(*clicks, strict=True))))
            elif hour in waiting:
                self.queue.removeKey((hour,))
            if not due:
                continue
            due.sort(key=lambda c: (c[1], c[2] is not None, c[2] or 0))
            lists = tuple(map(list, zip(*due, strict=True)))
            if client is not None:
                yield _row(client, hour, batch, lists, None, None, None, None, *credit_map(lists[1]))
                continue
            if not loaded:
                loaded, saved = True, self.credits.get() if self.credits.exists() else ([], [], [], [])
                bucket.state.update((c, rest) for c, *rest in zip(*saved, strict=True))
            done = [bucket.settle(c, t) for c, t, _ in due]
            yield _row(client, hour, batch, lists, *map(list, zip(*done, strict=True)))
        if loaded:
            self.credits.update((list(bucket.state), *map(list, zip(*bucket.state.values(), strict=True))))

    def close(self) -> None:
        pass


def _row(client, hour, batch, lists, outcome, credit, penalty, penalty_end, low=None, slope=None, base=None) -> Row:
    return Row(client=client, hour=hour, batch=batch, clients=lists[0], us=lists[1], ids=lists[2], outcome=outcome, credit=credit, penalty=penalty, penalty_end=penalty_end, low=low, slope=slope, base=base)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of single clicks as lists of those that share key and hour: fewer rows to shuffle and to hand to the queue."""
    schema = pa.schema([(n, pa.int64()) for n in ("client", "bucket", "hour")] + [(n, pa.list_(pa.int64())) for n in ("clients", "us", "ids")] + [("batch", pa.int32()), ("late_before", pa.int64()), ("drain_before", pa.int64())])
    heads = ("client", "bucket", "hour", "batch", "late_before", "drain_before")
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(b.schema.get_field_index(c)).fill_null(NEVER).to_numpy() for c in heads[:3]]
        order = np.lexsort(keys[::-1])
        keys, table = [k[order] for k in keys], b.take(pa.array(order))
        starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        offsets, column = pa.array(np.append(starts, len(order)).astype(np.int32)), lambda c: table.column(table.schema.get_field_index(c))  # noqa: B023
        made = {c: column(c).take(pa.array(starts)) for c in heads}
        made |= {n: pa.ListArray.from_arrays(offsets, column(c)) for n, c in (("clients", "client_id"), ("us", "us"), ("ids", "click_id"))}
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)


def batched(clicks: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The clicks (equal rows once; no time or client: left out) with their key and batch, and the keys of hot clients.

    A click without arrival comes in the first batch, one without an id is never held back.
    """
    kinds = {f.name: f.dataType for f in clicks.schema.fields}
    rest = [c for c in clicks.columns if c not in ("click_id", "ts", "arrived_at", "client_id")]
    some = clicks.where("ts IS NOT NULL AND client_id IS NOT NULL").select(
        "click_id",
        F.col("client_id").cast("long").alias("client_id"),
        micros(F.col("ts"), kinds["ts"]).alias("us"),
        micros(F.col("arrived_at"), kinds["arrived_at"]).alias("arrived"),
        F.xxhash64(F.lit(1), *rest).alias("_a"),
        F.xxhash64(*rest, F.lit(2)).alias("_b"),
    )
    counted = some.groupBy("client_id").agg(F.count("*").alias("n"), F.min("arrived").alias("low"), F.max("arrived").alias("high"))
    counted = written(counted, "throttle-clients")
    low, high, n = counted.agg(F.min("low"), F.max("high"), F.sum("n")).first()
    first, last = ((low or 0) // HOUR, (high or 0) // HOUR)
    hot = written(counted.where(F.col("n") > HOT).select("client_id", F.ceil(F.col("n") / LANE).alias("lanes")), "throttle-hot-clients")
    number = _div((_div(F.col("arrived"), HOUR) - first) * batches, last - first + 1)
    number = F.when(F.crc32(F.col("click_id").cast("string")) % 7 == 0, F.least(number + 1, F.lit(batches - 1))).otherwise(number)
    keyed = some.join(hot, "client_id", "left").withColumn("hour", _div(F.col("us"), HOUR))
    keyed = keyed.select(
        F.when(F.col("lanes").isNotNull(), F.col("client_id")).alias("client"),
        F.coalesce(F.pmod("hour", "lanes"), F.pmod(F.xxhash64("client_id"), F.lit(-(-(n or 0) // BUCKET) or 1))).alias("bucket"),
        "hour", "client_id", "us", F.col("click_id").cast("long").alias("click_id"), "arrived", "_a", "_b",
        F.coalesce(number, F.lit(0)).cast("int").alias("batch"),
    )
    # dealt out by key once: equal rows lie together, and so do a bucket's clicks of a batch
    once = keyed.repartition("client", "bucket").dropDuplicates().drop("arrived", "_a", "_b").sortWithinPartitions("batch", "client", "bucket", "hour")
    lanes = hot.select(F.col("client_id").alias("client"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("bucket"))
    ordinary = clicks.sparkSession.range(-(-(n or 0) // BUCKET) or 1).select(F.lit(None).cast("long").alias("client"), F.col("id").alias("bucket"))
    return once, ordinary.unionByName(lanes)


def settled(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Feed the batches in order to the stream, restarted for each on one checkpoint, and return what it settled: lists of clicks by key and hour."""
    spark = clicks.sparkSession
    folder = scratch_path(spark, "throttle")
    once, keys = batched(clicks, batches)
    once.write.partitionBy("batch").option("compression", "zstd").parquet(f"{folder}/batches")
    fed = spark.read.schema(once.schema).parquet(f"{folder}/batches")
    keys = written(keys, "throttle-keys")
    latest = {r["batch"]: r["us"] for r in fed.groupBy("batch").agg(F.max("us").alias("us")).collect()}  # a row a batch
    source = f"{folder}/source"
    columns = ["client", "bucket", "hour", "client_id", "us", "click_id"]
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        for k in range(batches):
            seen = [latest[j] for j in range(k) if j in latest]
            horizon = max(seen) - LATENESS if seen else NEVER
            ticks = keys.select("client", "bucket", *(F.lit(None).cast("long").alias(c) for c in columns[2:]))
            rows = fed.where(F.col("batch") == k).select(*columns).unionByName(ticks)
            rows = rows.withColumns({"batch": F.lit(k), "late_before": F.lit(horizon), "drain_before": F.lit(ALWAYS if k == batches - 1 else horizon)})
            rows.write.mode("append").parquet(source)
            queue = spark.readStream.schema(rows.schema).parquet(source).mapInArrow(_listed, _FED).groupBy("client", "bucket")
            out = queue.transformWithState(CalendarQueue(), _SETTLED, "Append", "None")
            query = out.writeStream.format("parquet").option("path", f"{folder}/settled").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(_SETTLED).parquet(f"{folder}/settled")


_RUN = ["client", "hour", "batch"]


def _starts(runs: pd.DataFrame) -> pd.DataFrame:
    """The credit at the first click of each of a hot client's drained hours."""
    runs = runs.sort_values("first")
    credit, last, found = FULL, None, []
    for x in runs.itertuples():
        credit = FULL if last is None else min(FULL, credit + x.first - last)
        found.append(credit)
        piece = int(np.searchsorted(x.low, credit, side="right")) - 1
        credit, last = int(x.base[piece] + x.slope[piece] * credit), x.last
    return runs[_RUN].assign(start=found)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hours of hot clients settled from their start; a penalty that began in an earlier hour is left open."""
    for b in batches:
        out = {"outcome": [], "credit": [], "penalty": [], "penalty_end": [], "tail": [], "admits": []}
        for client, us, start in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("client", "us", "start")), strict=True):
            bucket = Bucket({client: (start, us[0], None)})
            done = [bucket.settle(client, t) for t in us]
            admits = next((k for k, d in enumerate(done) if d[0] == ADMITTED), None)
            out["outcome"].append([d[0] for d in done])
            out["credit"].append([d[1] for d in done])
            head = len(done) if admits is None else admits
            out["penalty"].append([None if k < head else d[2] for k, d in enumerate(done)])
            out["penalty_end"].append([d[3] for d in done])
            # the state after the hour: of an hour without admission only what it adds to an open penalty
            out["tail"].append(bucket.state[client][2])
            out["admits"].append(admits is not None)
        lists = pa.list_(pa.int64())
        kinds = {"outcome": pa.list_(pa.string()), "credit": lists, "penalty": lists, "penalty_end": lists, "tail": pa.int64(), "admits": pa.bool_()}
        keep = [c for c in b.schema.names if c not in out]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(v, kinds[n]) for n, v in out.items())], names=[*keep, *out])


def _hot(drained: DataFrame) -> DataFrame:
    """Outcomes of the drained hours of hot clients. No task sees more of a client than an hour's clicks, or a few numbers for each of its hours."""
    ends = drained.select(*_RUN, F.get("us", F.lit(0)).alias("first"), F.element_at("us", -1).alias("last"), "low", "slope", "base")
    starts = ends.groupBy("client").applyInPandas(_starts, "client long, hour long, batch int, start long")
    hours = drained.select(*_RUN, "clients", "us", "ids").join(starts, _RUN)
    schema = T.StructType([*hours.schema.fields, *T._parse_datatype_string("outcome array<string>, credit array<bigint>, penalty array<bigint>, penalty_end array<bigint>, tail bigint, admits boolean").fields])
    done = written(hours.mapInArrow(_replayed, schema), "throttle-hot")
    # what an hour finds open: the first penalty since the last hour that admitted
    runs = done.select(*_RUN, "admits", "tail", F.get("us", F.lit(0)).alias("first")).withColumn("part", F.sum(F.col("admits").cast("int")).over(Window.partitionBy("client").orderBy("first")))
    after = F.first("tail", ignorenulls=True).over(Window.partitionBy("client", "part").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("after", after).withColumn("open", F.lag("after").over(Window.partitionBy("client").orderBy("first")))
    open_at = done.join(runs.select(*_RUN, "open"), _RUN)
    first = F.get("us", F.lit(0))
    penalty = F.transform(F.arrays_zip("outcome", "penalty"), lambda x: F.when(x["outcome"] == THROTTLED, F.coalesce(x["penalty"], F.col("open"), first)))
    return open_at.withColumn("penalty", penalty)


def throttle(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``click_id, outcome, batch, credit_after, penalty_start_us, penalty_end_us, client_id`` of every click.

    Defined results: equal rows count once; rows without time or client give none; without arrival a click comes in
    the first batch; clicks of one client with equal time go by id, those without an id first (of clicks equal in
    both it doesn't matter which goes first). No clicks give no rows, and still run all batches. Other columns only
    tell equal rows apart; none is passed on. The texts of ``props`` are read as one number, however long.
    """
    lists = settled(clicks, batches)
    columns = ["batch", "clients", "us", "ids", "outcome", "credit", "penalty", "penalty_end"]
    done = lists.where("outcome IS NOT NULL").select(*columns)
    drained = lists.where("outcome IS NULL")
    if not drained.isEmpty():
        done = done.unionByName(_hot(drained).select(*columns))
    each = done.select("batch", F.inline(F.arrays_zip("clients", "ids", "outcome", "credit", "penalty", "penalty_end")))
    return each.select(
        F.col("ids").alias("click_id"),
        "outcome",
        "batch",
        F.col("credit").alias("credit_after"),
        F.col("penalty").alias("penalty_start_us"),
        F.col("penalty_end").alias("penalty_end_us"),
        F.col("clients").alias("client_id"),
    )
