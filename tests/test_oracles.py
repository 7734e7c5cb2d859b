"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["sentiment_label", "count", "share"]
    rows = result.collect()
    assert sum(r["share"] for r in rows) == pytest.approx(1, abs=1e-5)
