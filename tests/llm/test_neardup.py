import random
import re

from millrace.llm import neardup as N
from millrace.llm.components import components


def sets_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    own = {d: sets_of(t) for d, t in docs}
    ids = sorted(own)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for d in ids:
        for s in own[d]:
            by_shingle.setdefault(s, []).append(d)
    tried = set()
    for group in by_shingle.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    common = len(own[a] & own[b])
                    if 100 * common >= 75 * (len(own[a]) + len(own[b]) - common):
                        ra, rb = find(a), find(b)
                        root[max(ra, rb)] = min(ra, rb)
    return {d: (len(own[d]), find(d), find(d) == d) for d in ids}


def cases():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs = [None, "", "  \n", "one two", "One  TWO", "one two three", "É é", "a b c d e", "A B\tC d e"]
    common = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(1, 8)):
            edited = list(base)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = word()
            docs.append(" ".join(edited))
    docs += [" ".join([word() for _ in range(rng.randint(0, 40))] + common) for _ in range(40)]
    chain = [word() for _ in range(120)]
    docs += [" ".join(chain[i : i + 100]) for i in range(0, 21, 3)]
    docs += ["same text over and over again here"] * 30 + ["x " * 20000]
    return list(enumerate(docs))


def as_map(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs = cases()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_shingles int, key string").repartition(4)
    want = brute(docs)
    assert as_map(N.near_duplicates(df)) == want
    kept = N.representatives(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [d for d, v in want.items() if v[2]]


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (9, "A b c d e f g")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in N.near_duplicates(twice).collect()))) == sorted(map(str, [(5, 3, 5, True), (5, 3, 5, True), (None, 3, None, True), (9, 3, 5, False)]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (202, 201), (300, 300)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200, 202: 200}


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert as_map(N.op4_neardup(spark, d)) == brute(docs)


def test_heavy_and_light_buckets(spark):
    """Buckets of several components are kept whole, by either way; a heavy one of a single component goes."""
    rows = [(0, 1, r, 0) for r in range(300)] + [(0, -2, r, r % 2) for r in range(300)] + [(1, 2, 1, 1), (1, 2, 2, 2), (1, 3, 1, 1), (1, 3, 2, 1), (2, None, 1, 1)]
    named = spark.createDataFrame(rows, "i int, half long, rep long, part long").repartition(4)
    with N.Scratch(spark, "buckets") as tmp:
        got = sorted(tuple(r) for r in N._mixed(tmp, named).collect())
        assert N._mixed(tmp, named.where("false")).count() == 0
    assert got == sorted([r for r in rows if r[1] == -2] + [(1, 2, 1, 1), (1, 2, 2, 2)])


def test_texts_of_one_id_go_or_stay_together(spark):
    """Two texts of one id are one document: linked by either, and all rows of a document that is marked kept stay."""
    words = lambda seed, n=40: " ".join(f"w{seed}x{k}" for k in range(n))
    rows = [(0, words(1)), (1, words(1)), (1, words(2)), (3, words(3)), (3, words(4)), (5, words(4)), (9, words(2) + " tail"), (None, words(3)), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()}
    by = {i: (c, k) for i, _, c, k in got}
    assert by == {0: (0, True), 1: (0, False), 3: (3, True), 5: (3, False), 9: (0, False), None: (None, True), 7: (7, True)}
    assert len({(i, c, k) for i, _, c, k in got}) == len(by)  # one verdict for each id
    left = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in N.representatives(df).collect())
    assert left == sorted([(0, words(1)), (3, words(3)), (3, words(4)), (-1, words(3)), (7, "")])
