"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quillon import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


#: Rounds of many jobs without a twin in SQL: tests/test_density.py and tests/test_networks.py have their operators against brute force.
ROUNDS = {"M14_density_consensus", "M14_density_sweep", "M19_topology", "M20_manifold_deviation", "M35_communities"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - ROUNDS))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert cols
        return
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
