"""Every registered query against its SQL on DuckDB."""

import pytest
from pyspark.sql import functions as F

from strataseek import queries
from tests.conftest import rows_of

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, sf, name):
    got = rows_of(queries.queries()[name](spark, sf).toPandas())
    if name in SQL:
        assert got == rows_of(duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 180
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_times_of_large_keys(spark, sf, tmp_path):
    """Rows beyond the largest key of the given tables are shown too, and those beyond the year 9999 with the error text."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").limit(1)
    keys = [1_999_999, 2_000_000, 2_932_896, 2_932_897]
    for k in keys:
        orders.withColumn("o_orderkey", F.lit(k).cast("long")).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    got = {r["file_ord"]: r["shown"] for r in queries.queries()["time_formats"](spark, str(tmp_path)).collect()}
    assert got == dict(zip(keys, ["7445-10-24 00:00:00", "7445-10-25 00:00:00", "9999-12-31 00:00:00", "时间错误"], strict=True))
