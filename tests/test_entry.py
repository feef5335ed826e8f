"""Driver contract: entry, registry, and a few queries against their oracle at sf0.001."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _canon(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["collection_id", "hour", "segment", "event_count", "first_event", "content", "tags"]


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 40
    assert set(o) <= set(q)


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    """Every registered query equals its DuckDB oracle on the smallest driver tables."""
    con = duck
    sdf = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    drows = sorted(tuple(_canon(r[dcols.index(c)]) for c in order) for r in cur.fetchall())
    srows = sorted(tuple(_canon(r[c]) for c in order) for r in sdf.collect())
    assert srows == drows
