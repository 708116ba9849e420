import pytest

import __spark_entry__ as entry
from tagloom.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_engine_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", ["search_full", "tag_map", "compare_queries", "explosion_score", "bubble_edges"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
