"""Every catalogued query against DuckDB, on the driver's smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from blockprism.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, names, order):
    at = [names.index(c) for c in order]
    tidy = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(tidy(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_agrees_with_duckdb(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    theirs = duck.sql(catalogue.ORACLES[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    assert plain(map(tuple, ours.collect()), ours.columns, order) == plain(theirs.fetchall(), theirs.columns, order)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_cartesian_products(spark):
    for name in ("slot_overlaps", "free_overlaps", "read_range", "gc_revalidate"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_range_filters_reach_the_scan(spark, tmp_path):
    from blockprism.plans.derive import Derived
    from blockprism.sources import tables

    tables.write(Derived(spark, SF).blockmap, str(tmp_path), "blockmap")
    plan = tables.read(spark, str(tmp_path), "blockmap").filter("vol_id = 'vol-1' and lba >= 8 and lba < 16").select("pba")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lba), GreaterThanOrEqual(lba,8), LessThan(lba,16)]" in plan and "PartitionFilters" in plan and "crc32" not in plan.split("ReadSchema")[-1]
