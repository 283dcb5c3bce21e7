from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

import sylvan.extra_queries  # noqa: F401
from sylvan import model as m
from sylvan.model import element
from sylvan.operators import aggregates
from sylvan.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    assert all(isinstance(v, (int, str, bool, float, datetime, Decimal, type(None))) for r in rows for v in r)
    if name in SQL:
        want = duck.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
        assert sorted(rows, key=str) == sorted(want, key=str)
    else:
        assert rows


def test_verify_aggregates_with_customers_without_orders(spark, tmp_path):
    """A customer of the segment without orders is no row of the SQL; the check still finds the tree's wrong sum."""
    spark.createDataFrame([(1, "BUILDING"), (2, "BUILDING"), (3, "OTHER")], "c_custkey bigint, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(7, 1, 1.25), (8, 1, 2.5), (9, 3, 4.0)], "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(f"select k, now from ({SQL['verify_aggregates']})").fetchall()
    assert [tuple(r) for r in QUERIES["verify_aggregates"](spark, str(tmp_path)).select("k", "now").collect()] == want == [(1, 375)]
    tree = m.frame(spark, [element([], b"t", m.SUM_TREE, sum=-1)])
    assert [(r.now_sum_value, r.n_elements) for r in aggregates.verify_aggregates(tree).collect()] == [(0, 0)]
