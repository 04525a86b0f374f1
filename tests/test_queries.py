import pytest

from millrace.plans.registry import ORACLE, QUERIES

from .oracle import same

DATA = "/root/testdata/sf0.01"
#: Queries that may have no rows on these tables.
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert same(QUERIES[name](spark, DATA), ORACLE[name], DATA) or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
