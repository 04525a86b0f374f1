from millrace.llm import lines as L


def test_fingerprints_are_fewer_than_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = L.fingerprints(docs, 3, "text", "doc_id").cache()
    windows = prints.selectExpr("sum(size(windows))").first()[0]
    lines = docs.selectExpr("size(filter(split(text, '\n'), x -> trim(x) <> '')) AS n").where("n >= 3")
    assert windows == lines.selectExpr("sum(n - 2)").first()[0]
    assert 0 < L.matches(prints).select("key", "line").distinct().count() < prints.count() < 0.7 * windows


def test_any_column_names(spark):
    text = "one line\nanother line\na third line\nmore"
    names = ["doc_id", "text", "_lines", "_gone", "_content", "_line_key", "_starts", "a.b", "key", "_n_lines", "n_lines", "c0"]
    df = spark.createDataFrame([(i, text, *(f"{c}{i}" for c in names[2:])) for i in range(2)], names)
    out = L.deduplicated(df)
    assert out.columns == [*names, "__n_lines", "_n_removed", "_n_runs"]
    rows = sorted(map(tuple, out.collect()))
    assert rows[0] == (0, text, *(f"{c}0" for c in names[2:]), 4, 0, 0) and rows[1] == (1, "", *(f"{c}1" for c in names[2:]), 4, 4, 1)
    kept = L.without_repeats(df)
    assert kept.columns == names and [r["doc_id"] for r in kept.collect()] == [0]
    assert L.deduplicated(df.where("false")).count() == 0


def test_a_heavy_run_is_spread(spark):
    """One passage in every document, and rows repeated whole."""
    df = spark.createDataFrame([(i // 2, f"top {i // 2}\ncommon a\ncommon b\ncommon c\nend {i // 2}") for i in range(2000)], "doc_id long, text string").repartition(7)
    got = {tuple(r) for r in L.deduplicated(df).collect()}
    assert len(got) == 1000 and (0, "top 0\ncommon a\ncommon b\ncommon c\nend 0", 5, 0, 0) in got and (999, "top 999\nend 999", 5, 3, 1) in got
