"""Every registered query with SQL against DuckDB on the smallest data."""

import math

import duckdb
import pytest

from quirelens.plans import catalog
from quirelens.plans import fitted as _fitted  # noqa: F401  these modules register their queries
from quirelens.plans import layouts as _layouts  # noqa: F401
from quirelens.plans import tables as _tables  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or str(x) in ("<NA>", "nan"):
        return None
    kind = type(x).__name__
    if "float" in kind or kind == "Decimal":
        return None if math.isnan(x) else round(float(x), 5)
    return int(x) if "int" in kind or "bool" in kind else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(([plain(x) for x in r] for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, sf_dir, name):
    assert rows(catalog.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and "report_exposure" in e.queries()
