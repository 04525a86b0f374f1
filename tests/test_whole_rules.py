import duckdb

from millrace.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"


def rows(sql):
    for table in ("part", "orders", "events", "customer"):
        sql = sql.replace(f"FROM {table}", f"FROM '{DATA}/{table}.parquet'")
    return duckdb.sql(sql).fetchall()


def test_conflicts_of_all_parts(spark):
    brands = {}
    for name, brand in rows("SELECT p_name, p_brand FROM part"):
        brands.setdefault(name, set()).add(brand)
    want = {(n, a, b) for n, x in brands.items() for a in x for b in x if a != b}
    assert {tuple(r) for r in QUERIES["all_name_conflicts"](spark, DATA).collect()} == want


def test_decisions_on_all_names(spark):
    want = {n for (n,) in rows("SELECT p_name FROM part")}
    assert {r["p_name"] for r in QUERIES["all_resolver_decisions"](spark, DATA).collect()} == want


def test_all_stored_customers_count_as_stored(spark):
    stored, users = {k for (k,) in rows("SELECT o_custkey FROM orders")}, {k for (k,) in rows("SELECT user_id FROM events")}
    got = {tuple(r) for r in QUERIES["all_suppressed_union"](spark, DATA).collect()}
    assert got == {(k, "orders") for k in stored} | {(k, "events") for k in users - stored}


def test_drift_of_all_customers(spark):
    want = {str(k) for k, n in rows("SELECT c_custkey, c_name FROM customer") if n.lower() != n}
    got = QUERIES["all_audit_findings"](spark, DATA).where("code = 'name_drift'").collect()
    assert {str(r["subject"]) for r in got} == want and len(got) == len(want) > 10
