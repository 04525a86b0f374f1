"""Writers: append, replace by partition, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Rows whose key is not there yet; a second call with the same rows writes none."""
    there = rows.sparkSession.read.schema(rows.schema).parquet(path)
    append(rows.dropDuplicates(keys).join(there.select(*keys), keys, "left_anti"), path)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def canonical_json(*names: str) -> Column:
    """An object with sorted keys, nulls included."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def identity(*names: str) -> Column:
    return F.sha2(canonical_json(*names), 256)


def report(rows: DataFrame, path: str) -> None:
    """One JSON line a row, keys sorted."""
    rows.select(canonical_json(*rows.columns).alias("value")).write.mode("overwrite").text(path)
