"""Queries against their SQL in DuckDB, on small tables made here."""

import datetime
import random

import duckdb
import pytest

from stepwell import catalog

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def rows():
    rng = random.Random(1)
    day = datetime.datetime(2024, 1, 1)
    some = lambda *x: rng.choice(x)
    money = lambda: round(rng.uniform(-900, 9000), 2)
    return {
        "region": [(k, n) for k, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])],
        "nation": [(k, f"N{k:02}", k % 5) for k in range(25)],
        "customer": [(k, f"C{k}", rng.randrange(25), money(), some(*catalog.SEGMENTS)) for k in range(300)],
        "supplier": [(k, f"S{k}", rng.randrange(25), money()) for k in range(60)],
        "orders": [(k, rng.randrange(300), some("F", "O", "P"), money() + 1000, day + datetime.timedelta(rng.randrange(500)), some("1-URGENT", "5-LOW")) for k in range(900)],
        "lineitem": [(k // 4, k % 50, k % 60, k % 4 + 1, float(rng.randrange(1, 50)), money() + 1000, 0.05, 0.02, some("A", "N", "R"), some("O", "F"), day) for k in range(2000)],
        "events": [(k, day + datetime.timedelta(seconds=61 * k), rng.randrange(40), some("click", "error", "purchase", "signup", "view"), round(rng.uniform(0, 100), 3), "{}") for k in range(1500)],
    }


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    con = duckdb.connect()
    for name, got in rows().items():
        spark.createDataFrame(got, SCHEMAS[name]).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    return path, con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    path, con = data
    df = catalog.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    got = sorted(str(tuple(map(plain, r))) for r in df.select(*columns).collect())
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(str(tuple(plain(r[k]) for k in order)) for r in want.fetchall())


def test_noise_is_repeatable_and_bounded(spark, data):
    path, _ = data
    a, b = (sorted(map(tuple, catalog.noise(spark, path).collect())) for _ in range(2))
    assert a == b
    before = {k: v for k, _, _, v, _ in rows()["customer"]}
    assert all(0.25 <= v / before[k] <= 3 for k, v in a if before[k])


def test_scans_are_pruned(spark, data):
    path, _ = data
    plan = catalog.topk_desc(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = catalog.filter_group_mean(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in plan and "ReadSchema: struct<event_type:string,value:double>" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(catalog.QUERIES) <= set(names)
    assert set(entry.entry(spark).columns) == {"segment", "c_nationkey", "balance", "n"}
