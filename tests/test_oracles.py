"""Every query with an oracle gives DuckDB's rows; the others give rows of a stable schema."""

import math

import duckdb
import pytest

from playmill.plans import registry
from playmill.plans.bindings import TABLES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "__float__"):
        return round(float(v), 5) + 0.0
    return str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in registry.ORACLES:
        assert ours
        return
    got = duck.execute(registry.ORACLES[name])
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in got.fetchall()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
