"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract_entry
import contract
from oracle_check import compare, connect

# the queries of the optional package have tests of their own
OWN = contract.QUERIES
QUERIES = contract_entry.queries()
SQL = {n: s for n, s in contract_entry.oracle_sql().items() if n in OWN}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    problem = compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
    assert problem is None


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if n in OWN))
def test_query_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract_entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["dashboard_long", "search_logs", "p95_index", "hist_1h", "more_like_this"])
def test_plans_have_no_products(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
