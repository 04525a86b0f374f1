"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session (tests) gets a temporary folder of its own; on a cluster it is an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="millrace-core-")
        atexit.register(shutil.rmtree, _fallback[app].removeprefix("file://"), True)
    return _fallback[app]


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators stage go when this block ends: what is made from them must be read or written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: computed once, the same to all who read it, and lineage ends there. The table stays until the
    caller's `temporary` block ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that may be sent to every task.
FEW = 100_000


def broadcast_if_few(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to join with parts of a staged table: broadcast if it is counted and found to have FEW rows at most, else as the planner will."""
    return F.broadcast if table.count() <= FEW else lambda part: part


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows of few bytes and much work, dealt over four tasks a core."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)
