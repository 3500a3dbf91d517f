"""Every registered query against its SQL on the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.harness import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, name):
    plans = []

    def run(spark, sf):
        out = queries()[name](spark, sf)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString())
        return out
    err, _, _ = compare(spark, name, run, oracle_sql().get(name), SF)
    assert err is None, err
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plans[0]


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    from scenelake.plans import queries as plans
    assert set(plans.QUERIES) == set(plans.ORACLE) and set(oracle_sql()) <= set(queries())
