"""Every query with SQL, row for row."""

import pytest

import __spark_entry__ as entry
from spinewright.plans import resolve_queries
from tests.compare import SF, same_rows

QUERIES = {k: v for p in entry._PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in entry._PLANS for k, v in p.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 15


def test_plans_push_down_and_prune(spark):
    text = resolve_queries.survivorship_pick(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in text and "Cartesian" not in text
    text = QUERIES["closure_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in text
    for name in ("block_phone", "block_trigram_top5", "proximity_join", "candidate_union"):
        assert "NestedLoop" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name
