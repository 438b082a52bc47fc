"""Every registered query against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
import oracles
from noteflow.plans import driver_queries
from tools.check_oracles import compare, connect

# approximate: its recall and distances are tested in test_approximate
WITHOUT_SQL = {"knn_approximate"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_which_queries_have_sql():
    assert set(driver_queries.ALL) - set(oracles.all_sql()) == WITHOUT_SQL
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", driver_queries.ALL)
def test_query(spark, con, sf_dir, name):
    result = compare(spark, con, name, sf_dir)
    assert result.startswith(("equal", "rows only")), result
    assert not result.endswith(" 0 rows")


def test_entry(spark):
    assert {r.risk_tier for r in driver.entry(spark).collect()} == {"HIGH", "MEDIUM", "LOW", "TOTAL"}
