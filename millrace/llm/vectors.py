"""Embedding vectors as integers, and what the operators on them share.

A vector is a row with an id, a component array and whatever else is asked for. Components x become floor(scale * x), x as
double, so inner products and distances are exact integers. Rows whose array is null, or holds a null or non-finite
component, take no part. Rows are told apart by `uid`, not by their id: ids may be null or repeat. A vector with fewer
components than another counts as padded with zeros. One whose squared norm would leave 62 bits raises an error, since its
scores need not fit a long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this, sums of products of integers are exact in double precision.
EXACT = float(1 << 53)
#: Stands for a null id where rows are ordered: null comes after all others.
NO_ID = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    c = F.col(vector)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(df: DataFrame, vector: str, scale: int, **columns: Column) -> DataFrame:
    """uid, the columns asked for, components (array<int>) and norm2 (long) of the usable rows. uid is only settled once the
    result is written."""
    scaled = F.transform(F.col("_vector"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    rows = df.where(usable(vector)).select(*[c.alias(n) for n, c in columns.items()], F.col(vector).alias("_vector"))
    rows = rows.withColumn("_scaled", scaled).withColumn("_norm2", F.aggregate("_scaled", F.lit(0.0), lambda acc, x: acc + x * x))
    too_large = F.raise_error(F.lit("a vector's squared norm exceeds 62 bits after scaling"))
    fitting = F.when(F.col("_norm2") < float(1 << 62), F.col("_scaled")).otherwise(too_large)
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), *columns,
        F.transform(fitting, lambda x: x.cast("int")).alias("components"), F.col("_norm2").cast("long").alias("norm2"),
    )


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The arrays as rows of a matrix of doubles (integers below 2^31 each), short ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, as long."""
    if exact_in_double:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def paired_products(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of row i of a with row i of b, as long."""
    if exact_in_double:
        return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def constant_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of the batches in which the key columns (integers) don't change, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        moved = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [0, *(np.flatnonzero(moved) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each group: higher scores first, then smaller ids, then smaller uids."""
    order = np.lexsort((uids, ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]
