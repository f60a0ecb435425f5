"""Every plan with SQL gives DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from textquarry import registry

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, D).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    key = lambda f: sorted((tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in f[cols].astype(object).itertuples(index=False)), key=repr)
    assert repr(key(got)) == repr(key(want))


def test_rows_only_plans_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, D).count() > 0
