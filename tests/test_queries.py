"""Every registered query against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF_DIR

from tallyguard.plans.catalog import ORACLES, QUERIES


# Queries that find nothing at the smallest scale have to find something here.
LARGER_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        problems = differences(df, duck, ORACLES[name])
        if problems == ["no rows"]:
            problems = differences(QUERIES[name](spark, LARGER_DIR), connect(LARGER_DIR), ORACLES[name])
        assert problems == []
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1000
