import random

from millrace.llm import lines as L

from .oracle import same


def brute(docs, window):
    rows = sorted({(d, t) for d, t in docs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, gone = set(), {}
    for d, t in rows:
        content = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        for k in range(len(content) - window + 1):
            name = tuple(x for _, x in content[k : k + window])
            if name in seen:
                gone.setdefault((d, t), set()).update(content[k + j][0] for j in range(window))
            seen.add(name)
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())) for d, t in docs}


def test_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "\n\n"), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (5, "x\nx\nx\nx\nx"), (6, "\n".join("abc"[i % 3] for i in range(3000)))]
    docs += [(10 + i, "\n".join(rng.choice(["a", "b", "c", "", "  ", "é"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, starts string").repartition(5)
    for window in (1, 2, 3):
        want = brute(docs, window)
        got = L.deduplicated(df, window=window)
        assert got.columns[:3] == df.columns
        rows = [tuple(r)[:2] for r in got.collect()]
        assert sorted(map(str, rows)) == sorted(str((d, want[d, t])) for d, t in docs)
    assert L.without_repeats(df.where("false")).count() == 0
    left = {r["doc_id"] for r in L.without_repeats(df).collect()}
    assert {1, 2, 3, 5} <= left and 6 not in left


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    assert same(L.op10_lines(spark, d), L.SQL, d) == 200


def test_native(spark):
    plan = L.op10_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
