import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from causeway.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    one = lambda v: None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (int, np.integer)) else str(v)
    return sorted(repr([one(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(sql.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES) - {"graph_classifier", "monte_carlo_table", "subject_pair"}))
def test_query_runs(spark, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got) and len(got.columns) > 1 and not got.columns.duplicated().any()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 5
    assert set(e.oracle_sql()) <= set(e.queries())
