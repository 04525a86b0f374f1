"""What the operators of this subpackage share: the shared folder, written stages, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch: with texts of some kilobytes, a few megabytes.
BATCH_ROWS, BATCH_BYTES = "256", "16m"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    temporary folder of its own; on a cluster executors could not see one, so there it is an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _fallback[app].removeprefix("file://"), True)
    return _fallback[app]


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the table goes as soon as the table is there
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators leave for later, because their results are computed from them, go when this block ends: what is wanted
    of the results must be read or written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and lineage ends there. The table stays, since what is made
    from it is computed later, until the caller's `temporary` block ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return _write(df, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that go when the block ends: what is made from them must be written by then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self.tables)}-{name}"
        table = _write(df, path)
        self.tables.append((table, path))
        return table

    def drop(self, df: DataFrame) -> None:
        """Deletes the table that `written` gave, before the block ends."""
        _delete(self.spark, next(path for table, path in self.tables if table is df))

    def __exit__(self, *error) -> None:
        _delete(self.spark, self.path)


#: A key with more than this share of the rows is heavy: there are at most HEAVY of them, whatever the table.
HEAVY, SALTS = 256, 64


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], total: int, how: str = "inner") -> DataFrame:
    """big joined with small on the keys `on`, all rows kept whole. small has one row per key and, as n, how many rows of big have
    that key; total is the number of big's rows. A key with more than total / HEAVY rows is spread over SALTS tasks by the columns
    spread_by. Only those keys are broadcast, HEAVY rows at most."""
    heavy = F.broadcast(small.where(F.col("n") * HEAVY > total).select(*on, F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    right = small.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", "n")
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts may be long. DataFrames are lazy, so this stays set; what a user has set stays too."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * size).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name for the pair of names (a, b)."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03)))


_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1024)
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)]))
                for b in (_BASE, pow(_BASE, -1, 1 << 64))
            ]
    return _powers


_SYMBOL = mix(np.arange(1, 1 + (1 << 16), dtype=np.uint64))


class Rolling:
    """Hashes of any slices of a byte (or code point below 65536, others folded) array, after one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _power_tables(n + 1)
        if symbols.dtype.itemsize > 2:
            wide = symbols >> np.uint32(16)
            value = _SYMBOL[symbols & np.uint32(0xFFFF)] + wide * np.uint64(0x9E3779B97F4A7C15)
        else:
            value = _SYMBOL[symbols]
        value *= up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(x + (end - start).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run ends where a row ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cuts = offsets[:-1]
    edge[cuts[cuts < n]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], n)
    keep = inside[at]
    return at[keep], ends[keep]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return _LOWER[data]


def fresh_names(names: list[str], taken: list[str]) -> list[str]:
    """The names, each with underscores in front until no column has it."""
    there = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
    return out


def kept_rows(docs: DataFrame, text: str, keep) -> DataFrame:
    """The rows, with all their columns, for which keep(bytes, offsets) of the text column is true."""
    names = docs.columns
    place = names.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(place))
            mask = [keep(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
            yield batch.filter(pa.array(np.concatenate(mask) if mask else np.zeros(0, bool), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
