"""Every registered retention query against its SQL, and those without one for rows and schema."""

import pytest

from keepwell.plans import queries as plans
from tests.oracle import assert_same, duck


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, data, name):
    assert_same(plans.QUERIES[name](spark, data), duck(data), plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["l4_feature_ablation", "l5_importances", "k2_model_candidates", "a9_model_by_archetype"])
def test_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
