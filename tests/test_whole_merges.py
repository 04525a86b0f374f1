import duckdb
import pytest

from millrace.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, keys", [
    ("merge_all_documents", "SELECT doc_id // 2 FROM documents"),
    ("merge_all_jobs", "SELECT CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 ELSE o_orderkey END FROM orders UNION SELECT o_orderkey - 1 FROM orders WHERE o_orderkey % 3 <> 0"),
])
def test_every_row_is_merged(spark, name, keys):
    table = keys.split(" FROM ")[1].split()[0]
    want = duckdb.sql(keys.replace(f"FROM {table}", f"FROM '{DATA}/{table}.parquet'")).fetchall()
    got = [r["k"] for r in QUERIES[name](spark, DATA).select("k").collect()]
    assert len(got) == len(set(got)) and set(got) == {k for (k,) in want}
