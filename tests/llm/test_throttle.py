"""Click throttling against a plain run over sorted clicks."""

import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataseek.llm import throttle

COLUMNS = ("click_id", "outcome", "batch", "credit_after", "penalty_start_us", "penalty_end_us")
EPOCH = datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def plain(rows, batches=10):
    """The contract, word by word, over rows (click_id, ts, arrived_at, client_id, ...)."""
    clicks = [(r[0], micros(r[1]), r[2] and micros(r[2]) // throttle.HOUR, r[3]) for r in set(rows) if r[1] is not None and r[3] is not None]
    hours = [c[2] for c in clicks if c[2] is not None]
    low, high = (min(hours), max(hours)) if hours else (0, 0)
    dealt = [[] for _ in range(batches)]
    for c in clicks:
        k = 0 if c[2] is None else (c[2] - low) * batches // (high - low + 1)
        dealt[min(k + 1, batches - 1) if c[0] is not None and zlib.crc32(str(c[0]).encode()) % 7 == 0 else k].append(c)
    waiting, seen, state, out = [], None, {}, []
    for k, own in enumerate(dealt):
        horizon = float("-inf") if seen is None else seen - throttle.LATENESS
        out += [(c[0], "late", k, None, None, None) for c in own if c[1] < horizon]
        last = k == batches - 1
        waiting += [c for c in own if c[1] >= horizon] if last else []
        due = sorted((c for c in waiting if last or c[1] < horizon), key=lambda c: (c[1], c[0] is not None, c[0] or 0))
        waiting = [c for c in waiting if not last and c[1] >= horizon] + ([] if last else [c for c in own if c[1] >= horizon])
        for i, t, _, client in due:
            credit, at, penalty = state.get(client, (throttle.FULL, t, None))
            credit = min(throttle.FULL, credit + t - at)
            if credit >= throttle.COST:
                credit, penalty = credit - throttle.COST, None
                out.append((i, "admitted", k, credit, None, None))
            else:
                penalty = t if penalty is None else penalty
                out.append((i, "throttled", k, credit, penalty, t + throttle.COST - credit))
            state[client] = (credit, t, penalty)
        seen = max([c[1] for c in own] + ([] if seen is None else [seen]), default=None)
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def run(frame, **how):
    return ordered(tuple(r) for r in throttle.throttle(frame, **how).select(*COLUMNS).collect())


@pytest.mark.parametrize(("hot", "batches"), [(False, 10), (True, 4)])
def test_given_clicks(spark, sf, monkeypatch, hot, batches):
    """All given clicks; with low bounds the frequent clients are split into lanes."""
    if hot:
        monkeypatch.setattr(throttle, "HOT", 150)
        monkeypatch.setattr(throttle, "LANE", 40)
        monkeypatch.setattr(throttle, "BUCKET", 1000)
    frame = spark.read.parquet(f"{sf}/clicks.parquet")
    want = plain([tuple(r) for r in frame.collect()], batches)
    assert {r[1] for r in want} == {"late", "admitted", "throttled"}
    assert run(frame, batches=batches) == ordered(want)


def test_awkward(spark, monkeypatch):
    """Nulls in any column, repeated rows, ties, a microsecond at the horizon, long texts, a hot client, clashing names."""
    monkeypatch.setattr(throttle, "HOT", 30)
    monkeypatch.setattr(throttle, "LANE", 10)
    day, rows, random_ = datetime(2024, 3, 31), [], random.Random(5)
    for i in range(400):
        ts = day + timedelta(seconds=random_.randrange(86_400 * 2), microseconds=random_.choice((0, 1, 999_999)))
        rows.append((i % 390, ts, ts + timedelta(hours=random_.choice((0, 0, 1, 30))), random_.choice((1, 1, 1, 2, 3)), None, 1.0, "x" * 10))
    rows += rows[:20]
    rows += [(500, None, day, 1, "k", 1.0, ""), (501, day, None, 1, None, None, None), (None, day, day, 2, "k", 1.0, None), (None, day, day, 2, "j", 1.0, None), (503, day, day, None, "k", 1.0, "x")]
    rows += [(600 + i, day + timedelta(hours=7), day + timedelta(hours=7), 1, "k", None, "y" * 100_000) for i in range(3)]
    rows.append((700, datetime(1969, 12, 31, 23, 30), day, 2, None, None, None))
    frame = spark.createDataFrame(rows, SCHEMA)
    frame = frame.withColumns({"bucket": F.lit(1), "hour": F.lit("x"), "batch": F.lit(3), "client": F.lit(0), "us": F.lit(None).cast("int")})
    assert run(frame, batches=5) == ordered(plain(rows, 5))


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA), batches=2) == []


def test_credit_map():
    """The map says what a run over the clicks gives, from every start, in few pieces."""
    random_ = random.Random(1)
    for gap in (2, 30, 200, 400, 1500):
        us = sorted(random_.randrange(gap * 300) * 1_000_000 for _ in range(300))
        low, slope, base = throttle.credit_map(us)
        assert low[0] == 0 and low == sorted(set(low)) and len(low) <= 40
        for start in [0, throttle.FULL, *(random_.randrange(throttle.FULL + 1) for _ in range(60)), *low, *(x - 1 for x in low[1:])]:
            bucket = throttle.Bucket({1: (start, us[0], None)})
            for t in us:
                end = bucket.settle(1, t)[1]
            k = max(i for i, x in enumerate(low) if x <= start)
            assert base[k] + slope[k] * start == end


def test_small_stores(spark):
    """No state store brings threads of its own: an executor opens one for each shuffle partition, at each start."""
    threads = lambda: {t.getId() for t in spark._jvm.java.lang.Thread.getAllStackTraces().keySet() if t.getName().startswith("ChecksumCheckpointFileManager")}
    day, before = datetime(2024, 3, 31), threads()
    rows = [(i, day + timedelta(hours=i), day + timedelta(hours=i), i % 3, None, 1.0, None) for i in range(60)]
    assert run(spark.createDataFrame(rows, SCHEMA), batches=2) == ordered(plain(rows, 2))
    assert threads() <= before
