"""Queries that must see every row of their table."""

from __future__ import annotations

import os

import pytest

from quillon import registry
from quillon.sources.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_whole_lineitem(spark):
    run = lambda name: registry.QUERIES[name](spark, SF)
    l = table(spark, SF, "lineitem")
    ends = {r[0] for r in l.select("l_suppkey").unionAll(l.select("l_partkey")).collect()}
    assert {r["node"] for r in run("M35_page_rank").collect()} == ends
    assert {r["node"] for r in run("M68_multilayer_degree").collect()} == ends
    assert {r["a"] for r in run("U1_union_both_directions").collect()} == ends
    assert run("M37_identifier_normalisation").count() == l.count()
    assert sum((r["n"] or 0) + (r["n_1"] or 0) + (r["n_2"] or 0) for r in run("J3_outer_many").collect()) == l.filter("l_returnflag in ('A', 'R', 'N')").count()
    assert run("M35_hubs").count() > 0
