"""Hard negatives by a Voronoi-partitioned kNN join.

The highest inner products are the smallest distances once vectors are augmented: a row x gets the component
sqrt(M^2 - |x|^2), M being the largest norm, and an anchor q gets 0, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Pivots are
augmented rows of a bounded sample, far apart from one another; every row and every anchor goes to its nearest pivot's
cell with its distance to that pivot.

For a group of anchors in cell i (all within U of pivot i) that need rows no farther than D and, where scores are capped, no
nearer than N, a row of cell j at distance r from its pivot can serve only if

    max(|ij| - U - D, N - U - |ij|, 0) <= r <= |ij| + U + D,     |ij| the distance of the two pivots,

by the triangle inequality. Only such rows are replicated to the group. Its anchors are split into groups of bounded size and
what is routed to it into slices of bounded size, so a hot cell, label or vector is many tasks; each is an exact local join that
holds its anchors and streams the rows. The best of all slices are merged by rank.

The join runs twice. Positives: rows of the anchor's own label; D comes from the k + 1 rows of each cell and label that
are nearest to their pivot. Negatives: rows of other labels between the two shares of a positive's score, which give D and N.

Defined cases: see `vectors`; rows, not ids, are joined, so repeated ids and rows each count; a null id is no anchor, comes last among
ties and is returned as null; an anchor without another row of its label, or whose positives all score below 0, has no row;
with fewer rows than asked for all are returned; an empty table gives no row; other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, salted_join, written
from .vectors import EXACT, NO_ID, constant_runs, first_of_each, matrix, products, quantised

#: Pivots: one for so many anchors, at most MOST, picked from a sample of SAMPLE rows by hash.
ANCHORS_A_PIVOT, MOST, SAMPLE = 64, 64, 1024
#: Anchors of a group and rows of a slice: what a task holds and what it streams past.
GROUP, SLICE = 1024, 1 << 16
_MARGIN = 1e-7
_FOUND = "asked long, uid long, id long, score long"


def _augmented(X: np.ndarray, largest2: float) -> np.ndarray:
    return np.hstack([X, np.sqrt(np.maximum(0.0, largest2 - (X * X).sum(axis=1)))[:, None]])


def pivots(rows: DataFrame, wanted: int, dims: int, largest2: float) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it; equal vectors give one."""
    sample = rows.select("components").distinct().orderBy(F.xxhash64("components"), "components").limit(SAMPLE).collect()
    X = _augmented(matrix(pa.array([r["components"] for r in sample], pa.list_(pa.int32())), dims), largest2)
    chosen, far = [0], ((X - X[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(X)):
        nxt = int(far.argmax())
        chosen.append(nxt)
        far = np.minimum(far, ((X - X[nxt]) ** 2).sum(axis=1))
    return X[chosen]


def _cells(P: np.ndarray, dims: int, largest2: float):
    """Adds to each row its cell and its distance to the pivot, as a row and as an anchor."""
    p2 = (P * P).sum(axis=1)

    def nearest(X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = np.maximum(0.0, (X * X).sum(axis=1)[:, None] + p2[None, :] - 2 * X @ P.T)
        cell = d2.argmin(axis=1)
        return cell.astype(np.int32), np.sqrt(((X - P[cell]) ** 2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                X = matrix(batch.column("components"), dims)
                cell, r = nearest(_augmented(X, largest2))
                own, u = nearest(np.hstack([X, np.zeros((len(X), 1))]))
                columns = [*(batch.column(c) for c in ("uid", "id", "label", "components", "norm2", "anchor")), cell, r, own, u]
                yield pa.record_batch(columns, names=["uid", "id", "label", "components", "norm2", "anchor", "cell", "r", "own_cell", "u"])

    return run


def _distances(spark: SparkSession, P: np.ndarray) -> DataFrame:
    """(i, j, apart) for all pairs of pivots: MOST * MOST rows at most."""
    apart = np.sqrt(((P[:, None, :] - P[None, :, :]) ** 2).sum(axis=2))
    return spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(P)) for j in range(len(P))], "i int, j int, apart double")


def _routes(groups: DataFrame, apart: DataFrame, margin: float) -> DataFrame:
    """(part, cell, targets): which groups of a part the rows of a cell may serve, and at which distances from their pivot.
    groups: (part, i, U, D, N, splits, slices), one row per part and cell with anchors."""
    reach = F.col("U") + F.col("D")
    low = F.greatest(F.col("apart") - reach, F.col("N") - F.col("U") - F.col("apart"), F.lit(0.0)) - margin
    target = F.struct("i", low.alias("low"), (F.col("apart") + reach + margin).alias("high"), "splits", "slices")
    return groups.join(F.broadcast(apart), "i").groupBy("part", F.col("j").alias("cell")).agg(F.collect_list(target).alias("targets"))


def _join(rows: DataFrame, asked: DataFrame, groups: DataFrame, apart: DataFrame, kernel, k: int, tasks: int, margin: float) -> DataFrame:
    """The first k rows of every asked one, by slices. rows: (part, cell, r, uid, id, label, components); asked: (asked, part,
    i, uid, label, components, low, high), low and high the scores between which its rows must lie."""
    counts = rows.groupBy("part", "cell").agg(F.count("*").alias("n"))
    routes = _routes(groups, apart, margin).join(counts, ["part", "cell"])
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = salted_join(rows, routes, ["part", "cell"], ["uid"], total)
    serves = F.filter("targets", lambda t: (t["low"] <= F.col("r")) & (F.col("r") <= t["high"]))
    met = met.withColumn("t", F.explode(serves)).select("*", F.col("t.i").alias("i"), F.pmod(F.xxhash64("uid"), "t.slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("t.splits") - 1)).alias("split"))
    names = ["part", "i", "split", "slice", "kind", "asked", "uid", "id", "label", "components", "low", "high"]
    empty = {"asked": F.lit(None).cast("long"), "low": F.lit(None).cast("long"), "high": F.lit(None).cast("long")}
    streamed = met.withColumns({"kind": F.lit(1), **empty}).select(names)
    sized = groups.select("part", "i", "splits", "slices")
    held = asked.join(sized, ["part", "i"]).withColumn("split", F.pmod(F.xxhash64("uid"), F.col("splits")).cast("int"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).withColumns({"kind": F.lit(0), "id": F.lit(None).cast("long")}).select(names)
    units = held.unionByName(streamed).repartition(tasks, "part", "i", "split", "slice")
    found = units.sortWithinPartitions("part", "i", "split", "slice", "kind").mapInArrow(kernel, _FOUND)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _local(dims: int, k: int, other_label: bool, exact: bool):
    """The exact join of one task: the asked rows are held, the others come by in batches."""

    class Unit:
        def __init__(self):
            self.parts: list[pa.RecordBatch] = []
            self.ready = False

        def settle(self) -> None:
            take = lambda c: np.concatenate([b.column(c).to_numpy() for b in self.parts])
            self.asked, uid, self.label, low, high = (take(c) for c in ("asked", "uid", "label", "low", "high"))
            Q = np.concatenate([matrix(b.column("components"), dims) for b in self.parts])
            self.uid, first, self.own = np.unique(uid, return_index=True, return_inverse=True)  # an anchor may ask several times
            self.Q, self.low, self.high = Q[first], low, high
            self.best = [np.zeros(0, np.int64) for _ in range(4)]  # place of the asked, score, id, uid
            self.worst = np.full(len(self.asked), np.iinfo(np.int64).min)  # k-th score so far
            self.ready = True

        def meet(self, whole: pa.RecordBatch) -> None:
            for a in range(0, whole.num_rows, 2048):
                self._meet(whole.slice(a, 2048))

        def _meet(self, batch: pa.RecordBatch) -> None:
            X = matrix(batch.column("components"), dims)
            uid, ids, label = (batch.column(c).to_numpy() for c in ("uid", "id", "label"))
            by_anchor = products(self.Q, X, exact)
            for a in range(0, len(self.asked), 256):
                own = self.own[a : a + 256]
                score = by_anchor[own]
                fits = (score >= np.maximum(self.low[a : a + 256], self.worst[a : a + 256])[:, None]) & (score <= self.high[a : a + 256, None])
                fits &= (label[None, :] != self.label[a : a + 256, None]) if other_label else (uid[None, :] != self.uid[own][:, None])
                q, r = np.nonzero(fits)
                if len(q):
                    self._merge(q + a, score[q, r], ids[r], uid[r])

        def _merge(self, q, score, ids, uid) -> None:
            touched = np.isin(self.best[0], q)
            old, rest = [x[touched] for x in self.best], [x[~touched] for x in self.best]
            new = [np.concatenate(x) for x in zip(old, (q, score, ids, uid), strict=True)]
            keep = first_of_each(new[0], new[1], new[2], new[3], k)
            new = [x[keep] for x in new]
            place, n = np.unique(new[0], return_counts=True)
            ends = np.cumsum(n) - 1  # first_of_each gives each group in order, so its last is the k-th
            self.worst[place[n == k]] = new[1][ends[n == k]]
            self.best = [np.concatenate(x) for x in zip(rest, new, strict=True)]

        def rows(self) -> pa.RecordBatch:
            q, score, ids, uid = self.best
            return pa.record_batch([self.asked[q], uid, ids, score], names=["asked", "uid", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, key = Unit(), None
        for (*here, kind), batch in constant_runs(batches, ["part", "i", "split", "slice", "kind"]):
            if key != here:
                if unit.ready:
                    yield unit.rows()
                unit, key = Unit(), here
            if kind == 0:
                unit.parts.append(batch)
            elif unit.parts:
                if not unit.ready:
                    unit.settle()
                unit.meet(batch)
        if unit.ready:
            yield unit.rows()

    return run


def mine(
    df: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `anchors` holds and each of its
    first `positives` other rows of equal label, the first `negatives` rows of another label that score from low to high per cent of it."""
    spark = df.sparkSession
    with Scratch(spark, "negatives") as scratch:
        wanted = quantised(df.where(label.isNotNull()), vector, scale, id=F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)), label=label.cast("long"), anchor=F.coalesce(anchors, F.lit(False)) & F.col(id).isNotNull())
        base = scratch.written(wanted, "vectors")
        n, asking, dims, largest2 = base.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("components")), F.max("norm2")).first()
        if not asking:
            return written(spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "negatives")
        exact = largest2 < EXACT
        P = pivots(base, max(2, min(MOST, asking // ANCHORS_A_PIVOT)), dims, float(largest2))
        margin = _MARGIN * (math.sqrt(largest2) + 1)
        apart = _distances(spark, P)
        rows = scratch.written(base.mapInArrow(_cells(P, dims, float(largest2)), "uid long, id long, label long, components array<int>, norm2 long, anchor boolean, cell int, r double, own_cell int, u double"), "cells")
        asked = scratch.written(rows.where("anchor").withColumn("i", F.col("own_cell")), "anchors")
        tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / SLICE) * math.ceil(asking / GROUP))
        splits = F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("splits")

        # positives: a label is a part; D is the distance within which k other rows of the label must lie
        near = Window.partitionBy("label", "cell").orderBy("r", "uid")
        nearest = rows.select("label", "cell", "r", "uid").withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= positives + 1)
        reach = nearest.join(F.broadcast(apart), F.col("cell") == F.col("j")).select("label", "i", (F.col("apart") + F.col("r")).alias("reach"))
        ranked = reach.withColumn("nth", F.row_number().over(Window.partitionBy("label", "i").orderBy("reach"))).where(F.col("nth") == positives + 1)
        sizes = rows.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(SLICE))).cast("int").alias("slices"))
        groups = asked.groupBy("label", "i").agg(F.max("u").alias("U"), splits).join(ranked.select("label", "i", "reach"), ["label", "i"], "left").join(sizes, "label")
        groups = groups.select(F.col("label").alias("part"), "i", "U", (F.col("U") + F.coalesce("reach", F.lit(float("inf")))).alias("D"), F.lit(0.0).alias("N"), "splits", "slices")
        least, most = -(1 << 62), 1 << 62
        ask = asked.select(F.col("uid").alias("asked"), F.col("label").alias("part"), "i", "uid", "label", "components", F.lit(least).alias("low"), F.lit(most).alias("high"))
        found = _join(rows.withColumn("part", F.col("label")), ask, scratch.written(groups, "groups"), apart, _local(dims, positives, False, exact), positives, tasks, margin)
        pairs = found.select(F.col("asked").alias("anchor_uid"), F.col("rank").alias("nth"), F.col("id").alias("positive"), F.col("score").alias("positive_score")).where("positive_score >= 0")
        share = lambda c, percent, up: F.expr(f"({c} * {percent} + {99 if up else 0}) div 100")
        pairs = scratch.written(pairs.withColumns({"low": share("positive_score", low, True), "high": share("positive_score", high, False)}), "positives")

        # negatives: one part; scores from low to high bound the distances from both sides
        ask = asked.select("uid", "label", "components", "norm2", "i", "u", F.col("id").alias("anchor_id")).join(pairs, F.col("uid") == F.col("anchor_uid"))
        ask = ask.withColumns({"asked": F.col("uid") * positives + F.col("nth") - 1, "part": F.lit(0).cast("long")})
        at = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2").cast("double") + F.lit(float(largest2)) - 2.0 * score))
        bounds = ask.groupBy("part", "i").agg(F.max("u").alias("U"), F.max(at(F.col("low"))).alias("D"), F.min(at(F.col("high"))).alias("N"), splits)
        groups = scratch.written(bounds.withColumn("slices", F.lit(max(1, math.ceil(n / SLICE)))), "groups")
        found = _join(rows.withColumn("part", F.lit(0).cast("long")), ask, groups, apart, _local(dims, negatives, True, exact), negatives, tasks, margin)
        shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        named = ask.select("asked", "anchor_id", shown("positive").alias("positive_id"), "positive_score")
        out = found.join(named, "asked").select("anchor_id", "positive_id", "rank", shown("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return written(out, "negatives")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.c, v.c)::BIGINT AS score
  FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
