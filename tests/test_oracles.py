"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from trawl.plans import stored  # noqa: F401  registers its queries
from trawl.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(tuple(r[i] for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from trawl.functions.paths import matches_glob
    from trawl.plans.workspace import table

    plan = table(spark, SF, "documents").where(matches_glob(F.col("source"), "src1/**"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(source,src1/)" in plan


def test_top_k_is_no_global_sort(spark):
    plan = QUERIES["k2_knn_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
