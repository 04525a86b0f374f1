"""Operators on vectors against brute force in plain integers: nulls, ties, repeated rows and ids, odd lengths, clashing names, empty tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import hamerly, negatives, queries, topk

from .oracle import same

NAMES = "uid id score components cluster rank n cell r part i kind shard".split()
SCHEMA = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{n}` string" for n in NAMES)
LAST = 1 << 64


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], SCHEMA).repartition(parts)


def vectors(n, dims, seed, groups=7):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [[c + rng.gauss(0, 0.15) for c in rng.choice(centres)] for _ in range(n)]


def odd_rows(dims=8):
    rng, made = random.Random(5), vectors(700, dims, 4)
    rows = [(k, v, rng.randrange(4)) for k, v in enumerate(made)]
    rows += [(1000 + k, made[3], 1) for k in range(150)]  # one common vector
    rows += [(2000 + k, [0.5] * dims, k % 3) for k in range(60)]  # ties
    rows += [(k, made[9], 2) for k in (50, 50, 100, 100, 707)]  # repeated ids and rows
    rows += [(None, made[5], 1), (None, made[5], 1), (None, None, None), (5000, None, 1), (5100, made[1], None)]
    rows += [(5200, [None, *made[1][1:]], 1), (5300, [float("nan"), *made[1][1:]], 1), (5400, [float("inf"), *made[1][1:]], 1)]
    rows += [(5500, made[2][: dims - 3], 0), (5600, [], 0), (5700, [*made[2], 0.25], 0), (-100, made[8], 3), (5800, [1e4] * dims, 2)]
    return rows


def ints(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    import numpy as np

    return [math.floor(scale * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, every, k, scale=256):
    kept = [(i, r[0], c) for i, r in enumerate(rows) if (c := ints(r[1], scale)) is not None]
    out = []
    for i, q, c in kept:
        if q is not None and q % every == 0:
            best = sorted((-dot(c, d), LAST if v is None else v, j) for j, v, d in kept if j != i)[:k]
            out += [(q, n + 1, None if v == LAST else v, -s) for n, (s, v, _) in enumerate(best)]
    return out


def brute_negatives(rows, every, few=5, many=10):
    kept = [(i, r[0], r[2], c) for i, r in enumerate(rows) if r[2] is not None and (c := ints(r[1], 256)) is not None]
    kept = [(i, v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, c) for i, v, label, c in kept]
    out = []
    for i, a, label, c in kept:
        if a is None or a % every:
            continue
        scores = [(-dot(c, d), LAST if v is None else v, j, other) for j, v, other, d in kept if j != i]
        for p, positive, _, _ in sorted(x for x in scores if x[3] == label)[:few]:
            fits = sorted(x for x in scores if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:many]
            out += [(a, None if positive == LAST else positive, n + 1, None if v == LAST else v, -p, -s) for n, (s, v, _, _) in enumerate(fits)]
    return out


def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(r[0], c) for r in rows if r[1] is not None and len(r[1]) == dims and (c := ints(r[1], 1024)) is not None]
    seeds = sorted(((hashlib.sha256(f"3:{v}".encode()).hexdigest() if v is not None else "z"), c) for v, c in kept)[:k]
    centroids = [c for _, c in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min((far(c, m), j) for j, m in enumerate(centroids)) for _, c in kept]
        if n < rounds:
            for j in range(len(centroids)):
                members = [c for (_, c), (_, o) in zip(kept, own, strict=True) if o == j]
                if members:
                    centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    per = [sum(d for d, o in own if o == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(v, o, d, per[o], sum(per), digest[o]) for (v, _), (d, o) in zip(kept, own, strict=True)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op11_negatives", "op12_hamerly", "op13_topk"])
def test_queries_equal_sql(spark, name):
    d = "/root/testdata/sf0.01"
    assert same(queries.QUERIES[name](spark, d), queries.ORACLE[name], d)


@pytest.mark.parametrize("k, shard_rows", [(1, 1 << 15), (5, 300), (40, 64)])
def test_top_k(spark, k, shard_rows):
    rows = odd_rows()
    got = topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0, k=k, shard_rows=shard_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert ordered(got.collect()) == ordered(brute_top(rows, 50, k))


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [0.0, 0.0], 1), (7, [-1.0, 3.0], 1)]
    assert ordered(topk.search(frame(spark, rows, 1), F.col("vec_id") % 50 == 0).collect()) == ordered(brute_top(rows, 50, 5))
    assert topk.search(frame(spark, rows[2:], 1), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_beyond_double_precision(spark):
    rows = [(k, [3e5 + k * 0.37, -2e5 + k, 1.0 * k], 1) for k in range(120)]
    assert ordered(topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()) == ordered(brute_top(rows, 50, 5))
    with pytest.raises(Exception, match="62 bits"):
        topk.search(frame(spark, [(0, [1e30], 1)]), F.col("vec_id") % 50 == 0).collect()


def test_index_stops_early_and_only_on_proof():
    import numpy as np

    X = np.floor(256 * np.array(vectors(4000, 16, 1, groups=400)))
    index = topk.ImpactIndex(X, np.arange(4000), np.arange(4000))
    assert sum(len(rows) for level in index.levels for _, _, rows in level) == np.count_nonzero(X)  # every row and component
    tried = []
    inner = index._possible
    index._possible = lambda *a: tried.append(len(a[1])) or inner(*a)
    q, r, score = index.search(X[:40], np.arange(40), 5, np.full(40, -np.inf))
    assert len(tried) < len(index.levels) - topk.FIRST_TRY or tried[-1] < 10  # few queries, if any, walked to the end
    want = X[:40] @ X.T
    want[np.arange(40), np.arange(40)] = -np.inf
    assert np.array_equal(score[np.lexsort((-score, q))].reshape(40, 5), -np.sort(-want)[:, :5])


def test_negatives(spark):
    rows = odd_rows()
    for every, dims in ((20, 8), (100, 8)):
        label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        got = negatives.mine(frame(spark, rows), F.col("vec_id") % every == 0, label)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert ordered(got.collect()) == ordered(brute_negatives(rows, every))
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    lonely = [(0, [1.0], 1), (100, [2.0], 2), (3, [1.0], 3)]
    assert negatives.mine(frame(spark, lonely), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_negatives_in_small_groups_and_slices(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 7)
    monkeypatch.setattr(negatives, "SLICE", 90)
    monkeypatch.setattr(negatives, "ANCHORS_A_PIVOT", 5)
    rows = odd_rows()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, label)
    assert ordered(got.collect()) == ordered(brute_negatives(rows, 10))


def test_bounds_keep_rows_from_groups_they_can_not_serve(spark, monkeypatch):
    unit = [[x / math.sqrt(dot(v, v)) for x in v] for v in vectors(600, 8, 11, groups=6)]
    rows = [(k, v, k % 2) for k, v in enumerate(unit)]
    monkeypatch.setattr(negatives, "ANCHORS_A_PIVOT", 5)
    shares, inner = [], negatives.salted_join

    def watched(big, small, *rest):
        serves = F.filter("targets", lambda t: (t["low"] <= F.col("r")) & (F.col("r") <= t["high"]))
        shares.append(big.join(small, ["part", "cell"]).agg(F.sum(F.size(serves)) / F.sum(F.size("targets"))).first()[0])
        return inner(big, small, *rest)

    monkeypatch.setattr(negatives, "salted_join", watched)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"))
    assert len(shares) == 2 and shares[0] < 0.5 and shares[1] < 1
    assert got.count() > 0


@pytest.mark.parametrize("dims, n", [(8, 700), (8, 5)])
def test_clusters(spark, dims, n):
    rows, trace = odd_rows(dims)[: None if n > 5 else n], []
    got = hamerly.cluster(frame(spark, rows), dims=dims, trace=trace)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(brute_clusters(rows, dims=dims))
    assert len(trace) == 11 and trace[0][0] == trace[0][1] and (n == 5 or trace[-1][1] < trace[-1][0] / 2)  # bounds save scans


def test_clusters_of_nothing(spark):
    assert hamerly.cluster(frame(spark, [])).count() == 0
    assert hamerly.cluster(frame(spark, [(1, [1.0], 1), (2, None, 1)])).count() == 0
