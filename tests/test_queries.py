"""Every query outside the text subpackage against its oracle SQL, whole rows compared."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tierlens import workloads
from tierlens.operators.membership import not_in
from tierlens.plans.sqlquery import TABLES

SF = "/root/testdata/sf0.01"
@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.10g}")
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(workloads.ORACLES))
def test_oracle(spark, duck, name):
    got, want = workloads.QUERIES[name](spark, SF), duck.sql(workloads.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs
    assert mine


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(workloads.ORACLES) <= set(workloads.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Values of a subquery: none, nulls only, copies, both, what the query makes null, what it asks for besides.
TAKEN = [[], [None, None], [1, 1, 2], [2, None, 2], [3], [3, 7, 7], [5], [1, 2, 5, 7, 8]]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_not_in_is_that_of_sql(spark, tmp_path, threshold):
    """Tables that hold no values, nulls and copies on both sides, with the values broadcast and shuffled."""
    c = duckdb.connect()
    c.sql(f"copy (select k::bigint as s_suppkey from (values (1), (2), (3), (5), (5), (null), (null), (7), (7)) t(k)) to '{tmp_path}/supplier.parquet'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for taken in TAKEN:
            rows = ", ".join(f"({'null' if v is None else v}, 50)" for v in taken) or "(0, 49)"
            c.sql(f"copy (select k::bigint as l_suppkey, q::double as l_quantity from (values {rows}, (7, 49), (null, 49)) t(k, q)) to '{tmp_path}/lineitem.parquet'")
            tables = {t: f"'{tmp_path}/{t}.parquet'" for t in ("supplier", "lineitem")}
            for t, path in tables.items():
                c.sql(f"create or replace view {t} as select * from {path}")
            order = lambda rows: sorted(map(tuple, rows), key=repr)
            got = workloads.QUERIES["join_not_in_null"](spark, str(tmp_path))
            assert order(got.collect()) == order(c.sql(workloads.ORACLES["join_not_in_null"]).fetchall()), taken
            left, right = (spark.read.parquet(p.strip("'")) for p in tables.values())
            got = not_in(left, "s_suppkey", right.where("l_quantity = 50").select("l_suppkey"), "free")
            want = c.sql("select s_suppkey, s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50) from supplier")
            assert order(got.collect()) == order(want.fetchall()), taken
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_not_in_compares_no_pairs(spark):
    """The null-aware test under ``or`` is an equi-join that needs no broadcast; its values are read once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = workloads.QUERIES["join_not_in_null"](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    assert not [k for k in ("NestedLoopJoin", "CartesianProduct", "BroadcastExchange") if k in plan]
    assert "ReusedExchange" in plan
