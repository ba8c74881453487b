"""Every registered query of the engine against its SQL, and those without SQL against their contracts."""

import pytest

from kelpline.plans.catalogue import ORACLES, QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    oracle.check(spark, con, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_run_iou_aggregates_once(spark, sf_dir):
    """Pixels are bits of one number a frame: no second aggregation in a task."""
    plan = QUERIES["run_iou"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2
