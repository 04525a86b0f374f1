"""Token-id output, compressed by Re-Pair grammars.

Documents are range-partitioned by id; each partition is a shard, cut into blocks of `BLOCK_IDS` ids (or one document), so that
a grammar's memory is bounded. In a block, adjacent id pairs that occur `LEAST` times or more are replaced by new symbols, all
such pairs in a round, non-overlapping from the left and never across a document's end (measured on 262,144 ids, that leaves 167,238
symbols; replacing only the most frequent tenth of the pairs in a round leaves 180,682 and takes eight times as long). Rounds go on until no pair is left that frequent. The rules are kept beside the symbols with the number of ids
that each rule stands for. With the documents' symbol offsets any stretch of any document can be decoded without the rest.

File format: Parquet, one row per block: `shard`, `block`, `before` (ids of the shard before the block), `doc_ids`, `sizes`
(ids of each document), `symbols_at` (offset of each document among the symbols), `base` (first rule's symbol), `rules`
(little-endian unsigned 32-bit pairs), `expansions` (unsigned 32-bit ids per rule), `symbols` (unsigned 16-bit where all
symbols are below 65536, else 32-bit).

Defined cases: null and empty texts have only the end id; a null doc_id sorts first; rows of equal doc_id are written in order of
text; repeated rows are all written; an empty table gives no block and no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, small_batches, steps, utf8
from .tokens import encoder, tokenizer_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
BLOCK_IDS, LEAST = 1 << 18, 16
FORMAT = "shard long, block long, before long, doc_ids array<long>, sizes array<long>, symbols_at array<long>, base long, rules binary, expansions binary, symbols binary"
READ = "doc_id long, shard long, start long, n_tokens long, ids_crc32 long"
NAMES = [f.split()[0] for f in FORMAT.split(", ")]
_BUCKETS = 1 << 20


def _chosen(place: np.ndarray) -> np.ndarray:
    """Of places (ascending) of pairs, some that don't overlap: of every run of adjacent places the first, third, ..."""
    head = np.ones(len(place), bool)
    head[1:] = place[1:] != place[:-1] + 1
    run = np.flatnonzero(head)
    return place[(np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) % 2 == 0]


def compress(ids: np.ndarray, at: np.ndarray, least: int = LEAST):
    """(base, rules, expansions, symbols, offsets of the rows among the symbols). at: n + 1 offsets of the rows among ids."""
    base = int(ids.max()) + 1 if len(ids) else 1
    base = max(base, 50257)
    symbols, rules, top = ids.astype(np.int64), [], base
    last = np.zeros(len(ids), bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    size = np.ones(base, np.int64)
    while len(symbols) > 1:
        bucket = (symbols[:-1] * 40503 + symbols[1:] * 10007) & (_BUCKETS - 1)
        bucket[last[:-1]] = _BUCKETS
        often = np.bincount(bucket, minlength=_BUCKETS + 1) >= least
        often[_BUCKETS] = False
        place = np.flatnonzero(often[bucket])
        pair = (symbols[place] << 32) | symbols[place + 1]
        found, which, counts = np.unique(pair, return_inverse=True, return_counts=True)
        hit = counts[which] >= least
        place, which = place[hit], which[hit]
        if not len(place):
            break
        own = _chosen(place)
        rule = which[np.searchsorted(place, own)]
        used, rule = np.unique(rule, return_inverse=True)
        symbols[own] = top + rule
        left, right = found[used] >> 32, found[used] & 0xFFFFFFFF
        size = np.concatenate([size, size[left] + size[right]])
        rules.append(np.stack([left, right], 1))
        top += len(used)
        last[own] = last[own + 1]
        keep = np.ones(len(symbols), bool)
        keep[own + 1] = False
        symbols, last = symbols[keep], last[keep]
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    expansions = size[base:]
    ids_before = np.concatenate([[0], np.cumsum(size[symbols])])
    return base, rules, expansions, symbols, np.searchsorted(ids_before, at)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    symbols = symbols.astype(np.int64)
    while len(big := np.flatnonzero(symbols >= base)):
        times = np.ones(len(symbols), np.int64)
        times[big] = 2
        at = np.cumsum(times) - times
        out = np.repeat(symbols, times)
        pair = rules[symbols[big] - base]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols.astype(np.uint32)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, rules, expansions of a block's row."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    wide = row["base"] + len(rules) > 1 << 16
    return np.frombuffer(row["symbols"], "<u4" if wide else "<u2"), rules, np.frombuffer(row["expansions"], "<u4")


def stretch(row: dict, document: int, start: int, stop: int) -> np.ndarray:
    """ids start to stop of the document-th document of a block, decoding only the symbols that hold them."""
    symbols, rules, expansions = unpacked(row)
    at = [*row["symbols_at"], len(symbols)]
    own = symbols[at[document] : at[document + 1]].astype(np.int64)
    big = own >= row["base"]
    size = np.ones(len(own), np.int64)
    size[big] = expansions[own[big] - row["base"]]
    ends = np.cumsum(size)
    low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[low - 1]) if low else 0
    return expand(own[low:high], row["base"], rules)[start - skipped : stop - skipped]


def _write(path: str, end_id: int):
    def block(shard: int, number: int, before: int, ids: list[np.ndarray], docs: list[int | None]) -> pa.RecordBatch:
        sizes = [len(x) for x in ids]
        base, rules, expansions, symbols, at = compress(np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)]))
        kind = "<u4" if base + len(rules) > 1 << 16 else "<u2"
        values = [shard, number, before, docs, sizes, at[:-1].tolist(), base, rules.astype("<u4").tobytes(), expansions.astype("<u4").tobytes(), symbols.astype(kind).tobytes()]
        i64 = pa.int64()
        kinds = [i64, i64, i64, pa.list_(i64), pa.list_(i64), pa.list_(i64), i64, pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path).encode, TaskContext.get().partitionId()
        number, before, held, ids, docs = 0, 0, 0, [], []
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in steps(offsets):
                found, at = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(j - i):
                    ids.append(np.append(found[at[k] : at[k + 1]], np.uint32(end_id)))
                    docs.append(doc_ids[i + k])
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield block(shard, number, before, ids, docs)
                        number, before, held, ids, docs = number + 1, before + held, 0, [], []
        if ids:
            yield block(shard, number, before, ids, docs)

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all documents, in ascending order of doc_id, to `path`."""
    small_batches(docs.sparkSession)
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = table.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer or tokenizer_path(TOKENIZER), end_id), FORMAT).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            symbols, rules, _ = unpacked(row)
            ids = expand(symbols, row["base"], rules).astype("<u4").tobytes()
            sizes = np.array(row["sizes"], np.int64)
            start = np.cumsum(sizes) - sizes
            crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(sizes), row["shard"])), pa.array(start + row["before"]), pa.array(sizes), pa.array(crc, pa.int64())], [f.split()[0] for f in READ.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the files: where it starts among all ids, how many it has and their checksum."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    totals = blocks.select("shard", "before", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    rows = blocks.mapInArrow(_read, READ)
    return rows.join(starts, "shard").select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path)
    return read(spark, path)
