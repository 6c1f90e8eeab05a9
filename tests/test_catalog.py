"""Every query against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from emberlog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE:
        assert rows
        return
    found = duck.sql(catalog.ORACLE[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert rows == sorted((tuple(shown(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["syslog_severity", "message"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
