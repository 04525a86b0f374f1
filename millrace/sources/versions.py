"""A keyed table in versions, upserted batch by batch.

Rows lie in buckets by a hash of their key. A batch rewrites only the buckets that it touches, into a folder of its own; then a
new manifest (which folder each bucket is in, and the last batch) replaces the old one by one rename. Readers follow the manifest,
so they see the table before the batch or after it, never between. A batch whose id is not above the manifest's has been applied and
changes nothing; one that fails leaves the manifest, and so the table, as it was."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table: each upsert rewrites whole ones, and the manifest lists all.
BUCKETS = 64
_MANIFEST, _BUCKET = "_manifest.json", "_bucket"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        """schema: of the rows, as DDL. A table that is there keeps the number of buckets that it was made with."""
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets = self.manifest().get("buckets", buckets)

    def _fs(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """{batch, buckets, folders: bucket -> folder}; empty for a table that isn't there."""
        jvm, fs = self._fs()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_MANIFEST}")
        if not fs.exists(where):
            return {}
        stream = fs.open(where)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        jvm, fs = self._fs()
        new, at = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in (f"_new-{uuid.uuid4().hex}", _MANIFEST))
        out = fs.create(new)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        overwrite = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, overwrite)

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        """The rows of some buckets; each folder is asked for its own buckets only."""
        by: dict[str, list[int]] = {}
        for bucket, folder in folders.items():
            by.setdefault(folder, []).append(int(bucket))
        out = self.spark.createDataFrame([], f"{self.schema}, {_BUCKET} int")
        for folder, numbers in sorted(by.items()):
            read = self.spark.read.schema(f"{self.schema}, {_BUCKET} int").option("basePath", f"{self.path}/{folder}")
            out = out.unionByName(read.parquet(*[f"{self.path}/{folder}/{_BUCKET}={n}" for n in sorted(numbers)]))
        return out

    def read(self) -> DataFrame:
        """The table as its last whole batch left it."""
        return self._rows(self.manifest().get("folders", {})).drop(_BUCKET)

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """merge(stored rows, batch rows) of the touched buckets replaces them; False if the batch had been applied before. merge
        must give a key's rows from that key's rows alone."""
        now = self.manifest()
        if now and batch_id <= now["batch"]:
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_BUCKET)
        folders = now.get("folders", {})
        touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]  # as many as there are buckets, at most
        stored = self._rows({b: folders[b] for b in touched if b in folders}).select(names)
        folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
        merge(stored, batch.select(names)).select(*names, bucket).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        left = self._left(folder)
        after = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in touched if b in left}
        self._swap({"batch": batch_id, "buckets": self.buckets, "folders": after})
        return True

    def _left(self, folder: str) -> set[str]:
        """The buckets of which the merge left rows."""
        jvm, fs = self._fs()
        return {s.getPath().getName().partition("=")[2] for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")) if s.isDirectory()}

    def vacuum(self) -> int:
        """Deletes folders that the manifest doesn't name: of failed batches, and of older versions. Not while a batch runs or an older
        version is read."""
        jvm, fs = self._fs()
        keep, gone = set(self.manifest().get("folders", {}).values()), 0
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("batch-", "_new-")) and name not in keep:
                gone += fs.delete(status.getPath(), True)
        return gone


def upserting(table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is one upsert under its id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id, merge)

    return run


def newest(keys: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps each key's last row by `order`."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        rows = stored.unionByName(batch)
        whole = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
        return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(whole).select("_row.*")

    return merge
