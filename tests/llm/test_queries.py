import duckdb
import pytest

from sylvan.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r[x] for x in cols) for r in got.collect()) == sorted(want, key=lambda r: r) if name != "op9_warc" else sorted(map(str, want)) == sorted(str(tuple(r[x] for x in cols)) for r in got.collect())
