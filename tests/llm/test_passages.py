import random

import duckdb

from millrace.llm import lines as L


def brute(docs, window, chars):
    """{(doc_id, text): text without later repeated runs}, by the words of the rule."""
    rows = sorted({(d, t) for d, t in docs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, gone = set(), {}
    for d, t in rows:
        content = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        for size in range(1, window + 1):
            for k in range(len(content) - size + 1):
                name = tuple(x for _, x in content[k : k + size])
                if size < window and sum(len(x.strip(" ")) for x in name) < chars:
                    continue
                if name in seen:
                    gone.setdefault((d, t), set()).update(content[k + j][0] for j in range(size))
                seen.add(name)
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())) for d, t in docs}


LONG = " ".join(f"word{i}" for i in range(57))


def test_single_lines_of_more_than_50_words(spark):
    assert len(" ".join("x" * 51)) >= L.CHARS
    docs = [(1, f"{LONG}\nan own line"), (2, LONG), (3, f"first\n\n{LONG}\nlast"), (4, "short"), (5, "short"), (6, f"{LONG} and more"), (7, "a" * 60 + "\n" + "b" * 60), (8, "q\n" + "a" * 60 + "\n" + "b" * 60), (9, "a" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in L.deduplicated(df, chars=L.CHARS).collect()}
    assert got == {1: docs[0][1], 2: "", 3: "first\n\nlast", 4: "short", 5: "short", 6: docs[5][1], 7: docs[6][1], 8: "q", 9: "a" * 60}


def test_against_brute_force(spark):
    rng = random.Random(5)
    pick = ["a", "bb", "cccc", "", "  ", "é" * 9, " " + "d" * 6 + " ", "ffffffffffff"]
    docs = [(None, "cccc\nbb"), (1, None), (2, ""), (3, "ffffffffffff"), (3, "ffffffffffff"), (4, "ffffffffffff")]
    docs += [(10 + i, "\n".join(rng.choice(pick) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for window, chars in ((3, 8), (3, 10), (4, 14)):
        want = brute(docs, window, chars)
        got = L.deduplicated(df, window=window, chars=chars).select("doc_id", "text").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((d, want[d, t])) for d, t in docs)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()
    want = brute(docs, L.WINDOW, L.CHARS)
    done = L.deduplicated(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), chars=L.CHARS)
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {k: want[k, t] for k, t in docs}
    seen = set()
    for _, t in sorted((k, t) for (k, _), t in want.items() if t is not None):
        for line in t.split("\n"):
            assert len(line.split()) <= 50 or line not in seen
            seen.add(line)
