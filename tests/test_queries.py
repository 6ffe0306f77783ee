from __future__ import annotations

import re

import pytest

import __spark_entry__ as spark_entry
from tools.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
# the training-data queries have tests of their own in tests/llm
QUERIES = {n: q for n, q in spark_entry.queries().items() if n != "pipeline" and not re.match(r"op\d", n)}
SQL = {n: q for n, q in spark_entry.oracle_sql().items() if n in QUERIES}
# work that is done in Arrow batches, see README
PYTHON = {"rate_limit", "rate_limit_hot_key", "budget_admission"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert compare(df, con, SQL[name]) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
