import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from voltsheaf import catalogue, catalogue_cleaning, catalogue_plans  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def plain(row, order):
    return tuple(v.item() if hasattr(v := row[i], "item") else v for i in order)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_small, name):
    df = catalogue.queries()[name](spark, sf_small)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((plain(r, [df.columns.index(c) for c in names]) for r in df.collect()), key=key)
    b = sorted((plain(r, [want.columns.index(c) for c in names]) for r in want.fetchall()), key=key)
    assert a == b


def test_amplitude_windows_at_the_last_half_millisecond(spark, tmp_path):
    times = ["05:59:59.999999", "05:59:59.9995", "05:59:59.999499", "06:00:00", "06:00:00.000499", "06:00:00.0005", "06:30:00", "07:59:59.9996"]
    rows = " UNION ALL ".join(f"SELECT {i}L AS event_id, TIMESTAMP_NTZ '2024-01-01 {t}' AS ts, 1L AS user_id, 'view' AS event_type, {i * 7.0}D AS value" for i, t in enumerate(times))
    spark.sql(rows).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.queries()["amplitude_windows"](spark, str(tmp_path)).orderBy("start").collect()]
    want = con.sql(f"SELECT start, user_id, event_type, ptp, n, flag FROM ({catalogue.oracle_sql()['amplitude_windows']}) ORDER BY start").fetchall()
    assert got == [tuple(r) for r in want] and [r[4] for r in got] == [1, 7, 6, 1, 1]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_kernel_queries_have_rows(spark, sf_small, name):
    assert catalogue.queries()[name](spark, sf_small).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf_small):
    plan = catalogue.queries()["qc_semi"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "c_name" not in plan


def test_the_rest_works_without_the_llm_folders(tmp_path):
    ignore = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(REPO, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_upsert_merges_two_tables(spark, sf_small, monkeypatch):
    seen = []
    inner = catalogue.cohort.upsert
    monkeypatch.setattr(catalogue.cohort, "upsert", lambda old, new, *a: seen.append((old, new)) or inner(old, new, *a))
    catalogue.queries()["upsert_latest"](spark, sf_small)
    old, new = (t.select("o_custkey").distinct() for t in seen[0])
    assert old.join(new, "o_custkey").count() > 0 and old.subtract(new).count() > 0
    assert seen[0][0].intersect(seen[0][1]).count() > 0
