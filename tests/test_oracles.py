"""Every query that has an oracle gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(value(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


RULES = {n for n in registry.oracle_sql() if n.startswith("reqs_") and n not in ("reqs_verdicts", "reqs_lint", "reqs_scoring", "reqs_schema_001", "reqs_meta_002", "reqs_clarify_005")}  # test_reqs.py has them


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - RULES))
def test_query_matches_oracle(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
