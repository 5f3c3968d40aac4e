"""Queries of the operators that SQL can express against their DuckDB oracles."""

import duckdb
import pytest

from quern.llm import queries

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_oracle(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE[name])
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
