"""Every registered query of the retrieval engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cursor.fetchall())
    assert got == want
    assert got, "a query without rows proves nothing"


def test_every_query_has_sql_but_the_fuzzy_one():
    assert set(QUERIES) - set(SQL) == {"vendor_fuzzy"}


def test_queries_tell_classes_apart(spark):
    for name, column in (("categorize_docs", "category"), ("query_type", "kind"), ("task_router", "agent"), ("signal_bucket", "signal"), ("badge_counts", "badge")):
        assert QUERIES[name](spark, SF).select(column).distinct().count() > 1
