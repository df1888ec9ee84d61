"""The operators that SQL can express against DuckDB on the smallest data."""

import duckdb
import pytest

from quirelens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
