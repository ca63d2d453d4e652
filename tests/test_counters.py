"""Run histories kept by a stream, against one event after the other."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strataseek.operators import incremental
from strataseek.streaming import counters

SCHEMA = "seq long, ts timestamp, path string, kind string, owner string"


def test_first_in_eviction(spark, tmp_path):
    """Three parts, stopped and started again after each; a path that comes back after it went counts from one."""
    rng, day = random.Random(4), datetime(2024, 1, 1)
    parts = [[(100 * p + i, day + timedelta(days=p, minutes=rng.randrange(50)), rng.choice("abcdefg"), rng.choice(["opened"] * 4 + ["added"]), rng.choice("xy")) for i in range(60)] for p in range(3)]
    parts[1] += [(190, day + timedelta(days=1), None, "opened", "x"), (191, day + timedelta(days=1), "a", "opened", "new")]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counters.count(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), str(tmp_path / "h"), most=3)
    want = {}
    for rows in parts:
        for _, ts, path, kind, owner in sorted(rows, key=lambda r: (r[1], r[0])):
            own = want.setdefault(owner, {}) if kind == "opened" and path else None
            if own is None:
                continue
            own[path] = (own[path][0] + 1, max(ts, own[path][1])) if path in own else (1, ts)
            if len(own) > 3:
                del own[next(iter(own))]  # by insertion
    got = {}
    for r in counters.current(spark, str(tmp_path / "h")).collect():
        got.setdefault(r["owner"], {})[r["path"]] = (r["run_count"], r["last_run"])
    assert got == want and set(got) == {"x", "y", "new"}


def test_saved_snapshots_are_not_shuffled(spark, tmp_path):
    """Two snapshots saved in buckets of their paths are compared where they lie."""
    schema = "path string, mtime long, md5 string"
    known = spark.createDataFrame([(f"/p{i}", i, "x") for i in range(50)], schema)
    disk = known.where("mtime > 5").withColumn("md5", F.when(F.col("mtime") % 10 == 0, "y").otherwise(F.col("md5"))).unionByName(spark.createDataFrame([("/new", 1, "x")], schema))
    a = incremental.save_snapshot(known, str(tmp_path / "a"), 4)
    b = incremental.save_snapshot(disk, str(tmp_path / "b"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (incremental.changes(a, b), incremental.to_index(b, a)):
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert tuple(incremental.compare_index(a, b).first()) == (1, 4, 6)
        again = incremental.open_snapshot(spark, str(tmp_path / "a"), 4)
        one_side = incremental.changes(again, disk)._jdf.queryExecution().executedPlan().toString()
        assert one_side.count("Exchange hashpartitioning") == 1 and tuple(incremental.compare_index(again, disk).first()) == (1, 4, 6)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
