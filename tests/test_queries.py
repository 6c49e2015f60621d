"""Every registered query of the domain views against its SQL twin in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest
from conftest import SF

from karst import fixtures, plans
from karst.fixtures import TABLES

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE:
        got = duck.sql(ORACLE[name])
        assert sorted(got.columns) == columns
        at = [got.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["agg_monthly_flow", "gr_distinct_targets"])
def test_parts_grow_with_the_input(spark, monkeypatch, name):
    confs = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before, query = {c: spark.conf.get(c, None) for c in confs}, QUERIES[name]
    rows = sorted(map(str, query(spark, SF).collect()))
    assert {c: spark.conf.get(c, None) for c in confs} == before  # small inputs leave the session as it is
    try:
        for c, v in (("PART_BYTES", 1024), ("SCAN_BYTES", 4096), ("TOGETHER_BYTES", 2048)):
            monkeypatch.setattr(fixtures, c, v)
        df = query(spark, SF)
        size = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in (["lineitem", "orders"] if name == "agg_monthly_flow" else ["supplier", "nation", "lineitem", "customer"]))
        parts = -(-size // 1024)
        assert [spark.conf.get(c) for c in confs] == [str(parts), "2048", "4096"]
        assert f", {parts})" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, df.collect())) == rows
        spark.conf.set(confs[0], str(parts + 1))  # what does more already stays
        query(spark, SF)
        assert spark.conf.get(confs[0]) == str(parts + 1)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_parts_of_a_large_input_are_small(spark):
    confs = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        fixtures.grow_parts(spark, 32 << 20)
        assert {c: spark.conf.get(c, None) for c in confs} == before
        for gb in (1, 6):
            fixtures.grow_parts(spark, gb << 30)
            parts, together, scan = (int(spark.conf.get(c)) for c in confs)
            assert (gb << 30) / parts <= 4 << 20 and together <= 4 << 20 and scan <= 8 << 20
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
