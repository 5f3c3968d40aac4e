"""Every registered query of the record engine against its DuckDB oracle."""

import math

import duckdb
import pandas as pd
import pytest

from quern import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_oracle(spark, data, duck, name):
    got = plans.QUERIES[name](spark, data)
    want = duck.sql(plans.ORACLE[name])
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(got.toPandas()) == rows(want.df())
