import corpus_pipeline as P

from . import test_decontaminate, test_lines, test_neardup, test_tokens
from .test_tokens import library  # noqa: F401


def test_stages(spark, library):  # noqa: F811
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame([(1001, None, "en", "s", 0), (1002, "123 - 456", "en", "s", 9), (1003, "", None, None, None)], docs.schema)
    docs = docs.unionByName(extra).repartition(3)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(P.STAGES)

    def step(name, df):
        out = P.written(stages[name](spark, df, d), name)
        assert out.columns == docs.columns
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    df, got = step("language", docs)
    want = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    assert got == want and not {1001, 1002, 1003} & set(got)
    df, got = step("line_dedup", df)
    lines = test_lines.brute(list(want.items()), 3)
    want = {i: x for (i, t), x in lines.items() if x == t or any(y.strip(" ") for y in x.split("\n"))}
    assert got == want
    df, got = step("near_duplicates", df)
    kept = test_neardup.brute(list(want.items()))
    want = {i: t for i, t in want.items() if kept[i][2]}
    assert got == want
    df, got = step("benchmark_passages", df)
    bad = test_decontaminate.brute(list(want.items()), items)
    want = {i: t for i, t in want.items() if not bad[i][-1]}
    assert got == want and any(v[-1] for v in bad.values())
    pieces = [tuple(r) for r in stages["packed"](spark, df, d).collect()]
    test_tokens.check_pieces(pieces, {i: test_tokens.ids_of(library, t, 1) for i, t in want.items()}, 2048)


def test_run(spark):
    d = "/root/testdata/sf0.001"
    out = P.run(spark, d)
    assert 0 < out.select("doc_id").distinct().count() < 200 and P.ORACLE_SQL is None
