"""Every query outside the optional subpackage against its SQL."""

from __future__ import annotations

import pytest

from postsieve.plans.queries import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["run_id", "file_seq", "change", "field", "new_field"]
    assert set(e.oracle_sql()) <= set(e.queries())
