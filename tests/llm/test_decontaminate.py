import hashlib
import re

from millrace.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    lengths = sorted({len(g) for g in grams})
    out = {}
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


PASSAGE = " ".join(f"word{i}" for i in range(20))
DOCS = [
    (1, None), (2, ""), (3, "..."), (4, PASSAGE), (5, PASSAGE.upper().replace(" ", ", ") + " tail"), (6, "x " * 3000 + PASSAGE), (7, " ".join(PASSAGE.split()[:12])),
    (8, "Été 9 çà"), (9, "a b"), (10, "a a a a b"), (11, PASSAGE + " " + PASSAGE), (12, "short"), (12, "short"), (None, "alpha beta"),
]
ITEMS = [(1, PASSAGE), (2, "a b"), (3, "Short"), (4, None), (5, "?!"), (10, PASSAGE), (11, "été 9"), (12, "a a a")]


def rows(df):
    return [tuple(r)[:6] for r in df.collect()]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, item_id string, n_hit long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(3)
    want = brute(DOCS, ITEMS)
    got = rows(D.scan(docs, items))
    assert len(got) == len(DOCS)
    for doc, *rest in got:
        assert tuple(rest) == want[doc], doc
    for block in (1, 40):
        assert sorted(rows(D.scan(docs, items, block_bytes=block)), key=str) == sorted(got, key=str)
    assert {r[0] for r in D.clean(docs, items).collect()} == {d for d, v in want.items() if not v[-1]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.scan(docs, items)) == []
    full = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert rows(D.scan(full, items))[0][1:3] == (3, 0)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    got = {r[0]: r[1:] for r in rows(D.op3_decontaminate(spark, d))}
    assert got == want
    assert any(v[-1] for v in want.values())
