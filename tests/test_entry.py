"""The driver's contract, and plans that must stay as they are."""

import __spark_entry__ as entry
import pytest

from millrace.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(QUERIES) <= set(queries)
    assert entry.entry(spark).count() == 1


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["coverage_report", "search_tiered", "entity_coverage_status", "merge_minmax_any", "calibrated_ranking", "normalize_urls", "merge_jobs", "trigram_neighbors", "absence_lifecycle"])
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_scans_are_pruned(spark):
    text = plan(spark, "search_filters")
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in text and "c_acctbal" not in text.split("ReadSchema")[1]
    assert "text" not in plan(spark, "census").split("ReadSchema: struct<")[1].split(">")[0]
