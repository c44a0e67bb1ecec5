"""Each query gives the rows of its SQL."""

from __future__ import annotations

import pytest

from sluice import control_queries, queries

QUERIES, ORACLES = queries.QUERIES | control_queries.QUERIES, queries.ORACLES | control_queries.ORACLES


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


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "filled_md5", "n_chars", "n_lines"]
