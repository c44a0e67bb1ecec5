"""The queries that have SQL give its rows."""

from __future__ import annotations

import pytest

from sluice.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, sql, name):
    ours = QUERIES[name](spark, small)
    theirs = sql(ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    order = sorted(names)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in ours.collect())
    other = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in theirs.fetchall())
    assert mine == other
