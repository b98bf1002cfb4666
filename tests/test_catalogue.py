import datetime

import duckdb
import pytest

from tessera.operators import logreplay
from tessera.plans import catalogue

ORACLE, QUERIES = catalogue.oracle_sql(), catalogue.queries()


def normal(v):
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted((tuple(normal(v) for v in r) for r in found.fetchall()), key=str)
    assert sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=str) == expected


def test_outcomes(spark):
    log = spark.createDataFrame([(1, 1, "BEGIN", None, None), (2, 1, "INSERT", 5, 1), (3, 2, "UPDATE", 5, 2), (4, 1, "COMMIT", None, None), (5, 3, "INSERT", 6, 9), (6, 3, "ABORT", None, None), (7, None, "CHECKPOINT", None, None)], "lsn long, txn long, kind string, rid long, val long")
    assert {tuple(r) for r in logreplay.analysis(log).collect()} == {(1, "COMMITTED"), (2, "ACTIVE"), (3, "ABORTED")}
    assert [tuple(r) for r in logreplay.redo(log).collect()] == [(5, 1)]
    assert [tuple(r) for r in logreplay.undo(log).collect()] == [(2, 1)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
