import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import substrings as S


def brute(docs, length):
    texts = {d: (t or "").encode() for d, t in docs}
    seen = Counter(t[i : i + length] for _, t in ((d, (t or "").encode()) for d, t in docs) for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:5] for r in df.collect()}  # n_kept and text follow


def test_against_brute_force(spark):
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, other = noise(150), noise(110)
    docs = [None, "", "a", "a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, noise(100), passage, passage, passage[:99], passage[20:120]]
    docs += [noise(rng.randint(0, 300)) + passage[rng.randint(0, 40) :] + noise(rng.randint(0, 300)) for _ in range(12)]
    docs += [noise(50) + other + noise(5) + other, other[:105] + noise(60), noise(3) + other[4:] + passage[:101]]
    base = noise(2500)
    for _ in range(6):
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        docs.append("".join(t))
    docs += [base[400:1200], base * 2, base[1000:] + base[:1000]]
    rows = list(enumerate(docs)) + [(None, base[:300])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, doc int, at int").repartition(4)
    assert got(S.remove_repeats(df, length=100, block=10)) == brute(rows, 100)
    assert got(S.remove_repeats(df, length=400)) == brute(rows, 400)


def test_runs_that_differ_in_a_period_only(spark):
    """X Y is repeated at the start of X Y Y; what follows there is not."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("bcdefghij") for _ in range(n))
    docs = []
    for k in range(30):
        head, period = noise(50), noise(1 + k % 3)
        docs += [head + (period * 50)[:50], head + (period * 50)[:62]]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 100)
    assert {w[1] for w in want.values()} == {100}
    assert got(S.remove_repeats(df, length=100, block=10)) == want


def test_anchors_do_not_depend_on_the_size_of_the_text():
    rng = np.random.default_rng(3)
    names = rng.integers(1 << 63, 1 << 64, 6000, dtype=np.uint64)
    names[40], names[60] = (5 << 20) + (9 << 9), (5 << 20) + (3 << 9)  # equal but for bits that a long text gave up and a short one did not
    short, long = (S.anchors(names[:n], np.array([0, n + 49]), 100) for n in (101, 6000))
    at = [np.repeat(anchor, n)[:51].tolist() for _, n, anchor in (short, long)]
    assert at[0] == at[1]


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(S.op5_substrings(spark, d)) == brute(docs, 400)


def test_repeated_ids_and_kept_text(spark):
    """Rows of one id and different texts are documents of their own; what stays is given as bytes, spans and text."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, heads = noise(120), [noise(130) for _ in range(4)]
    rows = [(1, heads[0] + passage), (1, passage + heads[1]), (1, heads[2]), (2, "é" * 30 + heads[3]), (2, "x" + "é" * 30 + heads[3]), (3, heads[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted((r["doc_id"], r["text"], r["n_kept"], r["n_removed"]) for r in S.remove_repeats(df, length=100, block=10).collect())
    want = sorted([(1, heads[0], 130, 120), (1, heads[1], 130, 120), (1, "", 0, 130), (2, "", 0, 190), (2, "x", 1, 190), (3, "", 0, 130)])
    assert [(a, c, d) for a, _, c, d in out] == [(a, c, d) for a, _, c, d in want] and [b for _, b, _, _ in out] == [b for _, b, _, _ in want]
    whole = {(r["doc_id"], bytes(r["kept"])): [tuple(x) for x in r["spans"]] for r in S.cut_repeats(df, length=100, block=10).collect()}
    assert whole[1, heads[0].encode()] == [(130, 250)] and whole[1, heads[1].encode()] == [(0, 120)]


def java_hash_twins(spark, n=120_000, size=519):
    """Two random texts of one length whose 32-bit Spark hashes are equal."""
    made = spark.range(n).select(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.substr(F.lit("abcdefghijklmnop"), (F.pmod(F.xxhash64("id", k), F.lit(16)) + 1).cast("int"), F.lit(1)))).alias("text"))
    twins = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()
    return twins["t"][:2]


def test_texts_of_one_id_whose_hashes_collide(spark):
    """Only one of two texts without an id is repeated elsewhere; they share a 32-bit hash."""
    one, two = java_hash_twins(spark)
    df = spark.createDataFrame([(None, one), (None, two), (7, two)], "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() == 1
    want = brute([(0, one), (1, two), (2, two)], 400)
    assert want[0][1] == 0 and sorted(r["n_removed"] for r in S.remove_repeats(df, length=400).collect()) == sorted(w[1] for w in want.values()) == [0, 519, 519]


def test_characters_that_stay_are_whole(spark):
    both = "".join(chr(65 + k % 26) * (k % 5 + 1) for k in range(40))[:100]
    rows = [(1, "keep � this"), (2, "é" + both + "€"), (3, "x" + both + "y�")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in S.remove_repeats(df, length=100, block=10).collect()}
    assert got == {1: "keep � this", 2: "é€", 3: "xy�"}
    half = "é" * 60  # a run that begins within a character
    df = spark.createDataFrame([(1, "a" + half), (2, "b" + half[:-1] + "è")], "doc_id long, text string")
    for r in S.remove_repeats(df, length=100, block=10).collect():
        assert set(r["text"]) <= set("abéè")
