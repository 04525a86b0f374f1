"""Exact k-means in integers with Hamerly's bounds.

Every vector carries its cluster, an upper bound on the distance to that cluster's centroid and one lower bound on the
distance to the second nearest. After a round the centroids move; the upper bound grows by the drift of its own centroid,
the lower one shrinks by the largest drift of the others. A vector whose upper bound stays below its lower bound, or below
half the way from its centroid to the nearest other, keeps its cluster unseen. Else the upper bound is made exact, and if
that doesn't settle it the vector is ambiguous: its exact integer distances to all centroids are scanned, ties going to the
smaller number. Bounds are doubles with a margin above their rounding, and must be strictly apart to count, so a tie is always
scanned and clusters equal those of a full scan.

A round is one pass that reads vectors with their bounds and writes them to the shared folder; nothing is shuffled but a
count and a sum of each cluster and task. A lost executor costs its tasks of one round. At most two rounds' tables exist.

Defined cases: only vectors with `dims` components, none null or non-finite, are kept; rows are vectors, so repeated ids and rows
each count; a null id is kept, but hashes after all others as a seed; fewer vectors than clusters give as many centroids;
without any vector there is no row; other columns are not read."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, written
from .vectors import EXACT, matrix, paired_products, products, quantised

#: Share of the distances by which bounds are widened: far above the rounding of a square root and a few sums.
MARGIN = 1e-9
_STATE = "vec_id long, components array<int>, norm2 long, cluster int, upper double, lower double, scanned boolean"


def _squares(X: np.ndarray, norm2: np.ndarray, C: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, or of each row to its own."""
    c2 = (C.astype(object) ** 2).sum(axis=1).astype(np.int64)
    exact = math.sqrt(float(norm2.max(initial=0)) * float(c2.max(initial=0))) < EXACT
    if own is None:
        return norm2[:, None] + c2[None, :] - 2 * products(X, C.astype(np.float64), exact)
    return norm2 + c2[own] - 2 * paired_products(X, C[own].astype(np.float64), exact)


def _assign(centroids: list[list[int]], drift: list[float]):
    C = np.array(centroids, np.int64)
    k, dims = C.shape
    between = np.sqrt(_squares(C.astype(np.float64), (C.astype(object) ** 2).sum(axis=1).astype(np.int64), C).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * (1 - MARGIN)
    moved = np.array(drift)
    others = np.array([max((moved[j] for j in range(k) if j != c), default=0.0) for c in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            X = matrix(batch.column("components"), dims)
            norm2 = batch.column("norm2").to_numpy()
            cluster = batch.column("cluster").to_numpy().copy()
            upper, lower = batch.column("upper").to_numpy().copy(), batch.column("lower").to_numpy().copy()
            known = cluster >= 0
            own = np.maximum(cluster, 0)
            upper = np.where(known, (upper + moved[own]) * (1 + MARGIN), np.inf)
            lower = np.where(known, np.maximum(0.0, (lower - others[own]) * (1 - MARGIN)), 0.0)
            bound = np.where(known, np.maximum(lower, half[own]), 0.0)
            near = np.flatnonzero(known & (upper >= bound))
            if len(near):
                exact = np.sqrt(_squares(X[near], norm2[near], C, own[near]).astype(np.float64))
                upper[near] = exact * (1 + MARGIN)
            scan = np.flatnonzero(upper >= bound)
            if len(scan):
                d = _squares(X[scan], norm2[scan], C)
                nearest = d.argmin(axis=1)  # the first of equal ones
                cluster[scan] = nearest
                upper[scan] = np.sqrt(d[np.arange(len(scan)), nearest].astype(np.float64)) * (1 + MARGIN)
                second = np.partition(d, 1, axis=1)[:, 1].astype(np.float64) if k > 1 else np.full(len(scan), np.inf)
                lower[scan] = np.sqrt(second) * (1 - MARGIN)
            scanned = np.zeros(batch.num_rows, bool)
            scanned[scan] = True
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("components"), batch.column("norm2"), cluster.astype(np.int32), upper, lower, scanned],
                names=["vec_id", "components", "norm2", "cluster", "upper", "lower", "scanned"],
            )

    return run


def _moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid becomes floor(sum / count) of its vectors, component by component; k rows reach the driver."""
    dims = len(centroids[0])
    sums = [F.sum(F.col("components")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    after = [*centroids]
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return after


def _distances(centroids: list[list[int]]):
    C = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy()
                d = _squares(matrix(batch.column("components"), C.shape[1]), batch.column("norm2").to_numpy(), C, cluster)
                yield pa.record_batch([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(
    df: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
    id: str = "vec_id", vector: str = "embedding", trace: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """(<id>, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector. The first centroids are the vectors
    with the smallest sha256 of `<seed>:<id>`. trace gets (rows, rows scanned in full) of every assignment."""
    spark = df.sparkSession
    with Scratch(spark, "clusters") as scratch:
        kept = quantised(df.where(F.size(vector) == dims), vector, scale, vec_id=F.col(id).cast("long")).drop("uid")
        state = scratch.written(kept.withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0), "scanned": F.lit(False)}), "start")
        by_hash = state.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "components")
        centroids = [list(r["components"]) for r in by_hash.limit(clusters).collect()]
        if not centroids:
            return written(state.select("vec_id", "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).withColumnRenamed("vec_id", id), "clusters")
        drift = [0.0] * len(centroids)
        for n in range(rounds + 1):
            before = state
            state = scratch.written(before.mapInArrow(_assign(centroids, drift), _STATE), f"round{n}")
            scratch.drop(before)
            if trace is not None:
                trace.append(tuple(state.agg(F.count("*"), F.count_if("scanned")).first()))
            if n < rounds:
                after = _moved(state, centroids)
                drift = [math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) * (1 + MARGIN) for a, b in zip(centroids, after, strict=True)]
                centroids = after
        result = scratch.written(state.mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), "distances")
        inertia = {r["cluster"]: r["s"] for r in result.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
        per = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        out = result.join(F.broadcast(per), "cluster")  # one row per centroid
        return written(out.select(F.col("vec_id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(clusters: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same by full scans, a pair of common table expressions a round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS k, c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {clusters})""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""d{n} AS MATERIALIZED (SELECT vec_id, c, k, d FROM (
  SELECT v.vec_id, v.c, k, list_sum(list_transform(list_zip(v.c, c{n}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
  SELECT k, list(f ORDER BY i) AS c FROM (
    SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f
    FROM (SELECT k, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM d{n}) GROUP BY k, i) GROUP BY k) AS m ON m.k = c{n}.k)"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, d{rounds}.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY d{rounds}.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM d{rounds} JOIN c{rounds} ON d{rounds}.k = c{rounds}.k"""
    )


SQL = _sql()
