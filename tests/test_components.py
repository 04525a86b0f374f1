import duckdb

from millrace.operators import graph
from millrace.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_whole_graph_against_union_find(spark):
    edges = duckdb.sql(f"SELECT DISTINCT 2 * l_partkey, 2 * l_suppkey + 1 FROM '{DATA}/lineitem.parquet'").fetchall()
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = QUERIES["part_supplier_components"](spark, DATA).collect()
    assert len(got) == len(root) and {r["id"]: r["component"] for r in got} == {v: find(v) for v in root}


def test_edges_are_told_apart_in_bounded_tasks(spark, monkeypatch):
    """Ten times the edges, ten times the tasks: no task holds more edges than it may."""
    monkeypatch.setattr(graph, "EDGES", 1000)
    seen, inner = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: seen.append(df.rdd.glom().map(len).max() if not seen else 0) or inner(df))
    edges = spark.range(30_000).selectExpr("id AS a", "id - id % 10 AS b")
    assert graph.connected_components(edges).where("component = id - id % 10").count() == 30_000
    assert 0 < seen[0] <= 2000
