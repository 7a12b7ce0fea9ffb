"""Every registered SQL twin against its Spark query on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLE[name]) is None


SPLIT = [
    "agg_best_threshold", "agg_threshold_sweep", "eval_full_metrics", "win_point_adjust", "win_segments", "win_sliding_windows",
    "win_ewma", "win_align_scores", "win_stable_row_id", "cost_threshold", "pot_threshold_by_moments", "stream_deadband_fill",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_plan_equals_sql(spark, sf, con, split_plans, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 4
    assert set(ORACLE) <= set(QUERIES)
