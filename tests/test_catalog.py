"""Every registered query against its SQL in DuckDB on the smallest tables: columns, types and values."""

import math
import os

import pytest

from aerolith import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalog.load()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
#: Queries that train models: slow, and without SQL.
MODELS = {"gbt_forecast", "forest_forecast", "weather_normalised", "seasonal_forecast", "bootstrap_means", "permutation_test"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-4 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == types
    key = lambda row: [(v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row]
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=key)
    want = sorted(([r[rel.columns.index(c)] for c in columns] for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - MODELS))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()
