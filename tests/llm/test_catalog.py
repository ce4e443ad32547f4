import duckdb
import pytest

import __spark_entry__
from voltsheaf.llm import catalog


def test_all_operators_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names and set(catalog.queries()) <= names


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_small)
    want = con.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    a = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    b = sorted((tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()), key=str)
    assert a == b
