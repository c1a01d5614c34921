"""Every registered query against its DuckDB counterpart at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_sf}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_time", "entity_id", "feature_name", "known_at", "value"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small_sf, name):
    df = QUERIES[name](spark, small_sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if name not in ORACLES:
        assert len(df.columns) > 0
        return
    cur = con.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))
