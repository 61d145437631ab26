"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from wakeline.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def value(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{DIR}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(value, r)) for r in df.select(*columns).collect())
    if name in registry.ORACLES:
        rel = db.sql(registry.ORACLES[name])
        at = [rel.columns.index(c) for c in columns]
        assert len(rel.columns) == len(columns)
        assert rows == sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_half_turns_leave_the_scaler_as_in_sql(spark, tmp_path):
    """Three vessels of sf0.1 with turns of 180 degrees, whose sign the mean course change hangs on."""
    c = duckdb.connect()
    c.sql(f"copy (select * from '/root/testdata/sf0.1/events.parquet' where user_id in (931, 690, 913)) to '{tmp_path}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = registry.QUERIES["prep_impute_zscore"](spark, str(tmp_path))
    rel = c.sql(registry.ORACLES["prep_impute_zscore"])
    rows = sorted(tuple(map(value, r)) for r in df.select(*rel.columns).collect())
    assert rows and rows == sorted(tuple(map(value, r)) for r in rel.fetchall())
