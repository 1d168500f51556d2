"""Every named query against its DuckDB text on the smallest tables."""

import pytest

from oracle_check import compare, oracle_connection
from soundfield.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, small, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], small)
    assert ok, message


SLOW = {"trees_by_block", "hybrid_by_site", "kernel_scores"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_other_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
