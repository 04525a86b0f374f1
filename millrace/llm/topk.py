"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Rows are dealt into shards by hash. A shard's index has a posting for every component of every vector: postings of one
dimension, sign and impact level form a segment, and levels are quantiles of the shard's magnitudes, so that outliers
don't spoil them. A block of queries walks the segments by descending level and adds query component times the level's
representative to its accumulators. What a vector's processed segments leave out has a known norm, so by Cauchy-Schwarz a
score lies within |query| * |left out| of its accumulator. The leaders, scored exactly, give a threshold; a query stops only
when the vectors that can still reach it are few, and all of those are scored exactly. A query that never gets there has
walked the whole index and scores whatever is left, so results are exact for any data.

One shard comes first: each query's k-th best there is a threshold for all other shards. Queries come in groups and shards
have a bounded number of rows, so a task holds one shard's index and one block of queries.

Defined cases: see `vectors`; rows, not ids, are candidates, so a row with the query's id but not itself is one; a row
without an id is no query, comes last among ties and is returned as null; repeated rows each count; fewer than k candidates
are all returned; an empty table gives no row; other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, written
from .vectors import EXACT, NO_ID, constant_runs, first_of_each, matrix, paired_products, quantised

#: Rows of a shard, queries of a group (a task's share) and of a block (one walk over the segments).
SHARD_ROWS, GROUP_QUERIES, BLOCK_QUERIES = 1 << 15, 1 << 14, 128
#: Shares of the postings that lie below each level's lower edge; the last level takes the rest.
EDGES = (0.99, 0.96, 0.9, 0.82, 0.74, 0.66, 0.58, 0.5, 0.42, 0.34, 0.26, 0.0)
#: Levels from which on a stop is tried, and the share of a shard's rows that may be left to be scored exactly.
FIRST_TRY, FEW = 4, 1 / 16
_FOUND = "query long, query_id long, uid long, id long, score long"


class ImpactIndex:
    """Postings of the vectors X (rows of integers) in segments by descending impact level."""

    def __init__(self, X: np.ndarray, uids: np.ndarray, ids: np.ndarray):
        self.X, self.uids, self.ids = X, uids, ids
        n, dims = X.shape
        magnitude = np.abs(X)
        edges = np.unique(np.quantile(magnitude, EDGES, method="lower"))[::-1] if X.size else np.zeros(0)
        self.levels: list[list[tuple[int, float, np.ndarray]]] = []
        self.left_out: list[np.ndarray] = []
        residue = X.copy()
        above = np.inf
        for low in edges:
            inside = (magnitude >= low) & (magnitude < above) & (magnitude > 0)
            above = low
            if not inside.any():
                continue
            level = float(np.rint(magnitude[inside].mean()))
            segments = []
            for sign in (1.0, -1.0):
                dim, row = np.nonzero((inside & (X * sign > 0)).T)
                cuts = np.searchsorted(dim, np.arange(dims + 1))
                for d in range(dims):
                    if cuts[d] < cuts[d + 1]:
                        segments.append((d, sign * level, row[cuts[d] : cuts[d + 1]]))
            residue[inside] -= np.sign(X[inside]) * level
            self.levels.append(segments)
            self.left_out.append(np.sqrt((residue * residue).sum(axis=1)))
        norms2 = (X * X).sum(axis=1)
        self.largest = math.sqrt(norms2.max()) if n else 0.0

    def search(self, Q: np.ndarray, quids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query's place, row's place, score) of each query's first k rows among those that reach its floor."""
        n, m = len(self.X), len(Q)
        norms = np.sqrt((Q * Q).sum(axis=1))
        exact = (float(norms.max()) if m else 0.0) * self.largest < EXACT
        acc = np.zeros((n, m), np.float32)
        active = np.arange(m)
        weights = Q.astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, segments in enumerate(self.levels):
            for d, value, rows in segments:
                acc[rows] += weights[:, d] * np.float32(value)
            last = at == len(self.levels) - 1
            if at < FIRST_TRY and not last:
                continue
            possible = self._possible(acc, Q[active], quids[active], norms[active], floor[active], self.left_out[at], k, exact)
            done = np.full(len(active), True) if last else possible.sum(axis=0) <= max(4 * k, FEW * n)
            if done.any():
                found.append(self._scored(possible[:, done], active[done], Q, quids, k, floor, exact))
                active, acc = active[~done], np.ascontiguousarray(acc[:, ~done])
                weights = weights[~done]
            if not len(active):
                break
        if len(active):  # no posting at all: every score is 0
            found.append(self._scored(np.ones((n, len(active)), bool), active, Q, quids, k, floor, exact))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _possible(self, acc, Q, quids, norms, floor, left_out, k, exact) -> np.ndarray:
        """Which rows can still be among each query's first k: those whose upper bound reaches the k-th best of the leaders."""
        n, m = acc.shape
        lead = min(n, 2 * k + 1)
        rows = np.argpartition(acc, n - lead, axis=0)[n - lead :]
        score = paired_products(self.X[rows.T.ravel()], np.repeat(Q, lead, axis=0), exact).astype(np.float64).reshape(m, lead)
        score[self.uids[rows.T] == quids[:, None]] = -np.inf
        kth = np.sort(score, axis=1)[:, lead - k] if lead >= k else np.full(m, -np.inf)
        threshold = np.maximum(kth, floor)
        rounding = 1e-5 * norms * self.largest * math.sqrt(self.X.shape[1]) + 1.0  # of single-precision sums
        return acc + left_out[:, None] * norms[None, :] * (1 + 1e-9) + rounding[None, :] >= threshold[None, :]

    def _scored(self, possible, queries, Q, quids, k, floor, exact) -> tuple[np.ndarray, ...]:
        row, column = np.nonzero(possible)
        parts = []
        for a in range(0, len(row), 1 << 16):
            r, q = row[a : a + (1 << 16)], queries[column[a : a + (1 << 16)]]
            score = paired_products(self.X[r], Q[q], exact)
            keep = (self.uids[r] != quids[q]) & (score >= floor[q])
            parts.append((q[keep], r[keep], score[keep]))
        q, r, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        first = first_of_each(q, score, self.ids[r], self.uids[r], k)
        return q[first], r[first], score[first]


def _walk(dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, index = None, [], None
        for (shard, group, kind), batch in constant_runs(batches, ["shard", "query_group", "kind"]):
            if unit != (shard, group):
                unit, rows, index = (shard, group), [], None
            if kind == 0:
                rows.append(batch)
                continue
            if not rows:
                continue
            if index is None:
                X = np.concatenate([matrix(b.column("components"), dims) for b in rows])
                uids, ids = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("uid", "id"))
                index = ImpactIndex(X, uids, ids)
            for a in range(0, batch.num_rows, BLOCK_QUERIES):
                part = batch.slice(a, BLOCK_QUERIES)
                quids, qids = part.column("uid").to_numpy(), part.column("id").to_numpy()
                floor = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                q, r, score = index.search(matrix(part.column("components"), dims), quids, k, floor)
                yield pa.record_batch([quids[q], qids[q], index.uids[r], index.ids[r], score], names=["query", "query_id", "uid", "id", "score"])

    return run


def _searched(base: DataFrame, queries: DataFrame, shards: Column, groups: int, dims: int, k: int, tasks: int) -> DataFrame:
    """The first k rows of every shard for every query; `shards` lists, for a query, the shards that it goes to."""
    names = ["shard", "query_group", "kind", "uid", "id", "components", "least"]
    rows = base.withColumn("query_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(0)).withColumn("least", F.lit(None).cast("double"))
    asked = queries.withColumn("query_group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn("kind", F.lit(1)).withColumn("shard", F.explode(shards))
    units = rows.select(names).unionByName(asked.select(names)).repartition(tasks, "shard", "query_group")
    return units.sortWithinPartitions("shard", "query_group", "kind").mapInArrow(_walk(dims, k), _FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query's rows, with their ranks."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, asks: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, <id>, score): the k rows with the highest inner products for every row for which `asks` holds."""
    spark = df.sparkSession
    with Scratch(spark, "search") as scratch:
        base = scratch.written(quantised(df, vector, scale, id=F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)), asks=F.coalesce(asks, F.lit(False)) & F.col(id).isNotNull()), "vectors")
        n, queries, dims = base.agg(F.count("*"), F.count_if("asks"), F.max(F.size("components"))).first()
        cores = spark.sparkContext.defaultParallelism
        shards = max(1, math.ceil(n / shard_rows), min(2 * cores, n // 1024))
        groups = max(1, math.ceil(queries / GROUP_QUERIES))
        base = base.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
        asked = base.where("asks").drop("shard").withColumn("least", F.lit(float("-inf")))
        first = scratch.written(_searched(base.where("shard = 0"), asked, F.array(F.lit(0)), groups, dims or 0, k, groups), "first")
        kth = best(first, k).where(F.col("rank") == k).select(F.col("query").alias("uid"), F.col("score").cast("double").alias("least"))
        asked = asked.drop("least").join(kth, "uid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found = first
        if shards > 1:
            others = F.sequence(F.lit(1), F.lit(shards - 1))
            found = found.unionByName(_searched(base.where("shard > 0"), asked, others, groups, dims or 0, k, shards * groups))
        id_out = F.when(F.col("id") != NO_ID, F.col("id")).alias(id)
        return written(best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), id_out, "score"), "top")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
