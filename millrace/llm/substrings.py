"""Removal of repeated byte strings by bucket-pointer refinement, spread over a cluster.

A suffix's bucket is named by its first q bytes; names of longer prefixes come from the names of shorter ones at later
offsets: name(2q, i) = name of (name(q, i), name(q, i + q)). A bucket with one member is finished. What a single machine
does by sorting all suffixes is done here for a sample that loses nothing, in ever narrower levels:

0. Among the suffixes that start within a string of `length` bytes and are `length / 2` bytes long or more, the one with the
   least name is the string's anchor: equal strings have equal anchors at equal offsets. The strings of one anchor stand in
   a row and form one stretch. Anchors are bucketed by name; buckets of one member are dropped. Stretches that are equal as
   a whole (same bucket pointers at the later offsets) are repeated whole.
1. In the other buckets, stretches are refined into blocks of `BLOCK` starts by offset from the anchor, named by the bytes
   that all strings of a block share. Buckets of one member are dropped; equal blocks are repeated whole.
2. In what is left, each start is bucketed by the full name of its string. As all starts of a block are near one another,
   its first and last repeated start tell what it covers.

Each level counts by hash aggregation with partial sums and joins the counts back, so a bucket is never gathered in a task.
The final names have 128 bits.

Defined cases: null is an empty text; texts shorter than `length` lose nothing; equal rows are copies of one another and count
as repeated; rows of equal doc_id and other text are documents of their own; a null doc_id is treated like any other id; an
empty table gives one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, documents, paired, small_batches, spread, steps, utf8, written

LENGTH, BLOCK = 400, 25
#: Names give up so many bits to their place when the least is sought: as many in any text, else equal strings of texts of different
#: sizes could have different anchors. Arrow's texts have fewer than 2^31 bytes.
_PLACE = np.uint64(32)
#: A row of documents is known by two 64-bit hashes of its id and text.
_ROW = ["doc", "h"]
_ANCHORS = "doc long, h long, at int, n int, bucket long, whole long"
_BLOCKS = "doc long, h long, at int, n int, core long, whole long"
_STARTS = "doc long, h long, block int, at int, w1 long, w2 long"
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, text string"


def bucket_names(data: np.ndarray, size: int) -> np.ndarray:
    """Name of the `size` bytes from each position on (fewer than `size` positions before the end have none)."""
    q = size
    while q % 2 == 0 and q > 25:
        q //= 2
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    at = np.arange(n - q + 1)
    names = Rolling(data).of(at, at + q)
    while q < size:
        names = paired(names[:-q], names[q:])
        q *= 2
    return names


def _placed(names: np.ndarray) -> np.ndarray:
    """Names with their place in the low bits, so that the first of equal ones is the least."""
    return (names >> _PLACE << _PLACE) | np.arange(len(names), dtype=np.uint64)


def anchors(names: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch of strings with one anchor: its first start, its number of starts, and the anchor's place."""
    reach = length - length // 2 + 1  # places an anchor can take in a string
    least = _placed(names)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    if reach > width:
        least = np.minimum(least[: -(reach - width)], least[reach - width :]) if len(least) > reach - width else least[:0]
    anchor = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    starts = spread(offsets[:-1], sizes)
    own = anchor[starts]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(first)
    return starts[head], np.diff(np.append(head, len(own))), own[head]


def _name(names: np.ndarray, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """Name of bytes start to end, of 1 to 3 times `half` bytes, from bucket names at later offsets."""
    out = paired(names[start], names[end - half])
    return paired(out, names[np.minimum(start + half, end - half)])


def _whole(names: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Name of all bytes of n strings from `start` on. Their number is a part of it: with a period at the end (X Y and X Y Y), runs of
    different sizes have equal names at the same offsets."""
    at = paired(_name(names, start, start + n - 1 + length, length // 2), (anchor - start).astype(np.uint64))
    return paired(at, n.astype(np.uint64))


def _stretches(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc, text_hash = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, j in steps(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(part) < length:
                    continue
                names = bucket_names(part, half)
                start, n, anchor = anchors(names, at, length)
                row = np.searchsorted(at, start, "right") - 1
                whole = _whole(names, start, n, anchor, length)
                yield pa.RecordBatch.from_arrays([pa.array(doc[i + row]), pa.array(text_hash[i + row]), pa.array((start - at[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(names[anchor].view(np.int64)), pa.array(whole.view(np.int64))], [f.split()[0] for f in _ANCHORS.split(", ")])

    return run


def _per_row(batches: Iterator[pa.RecordBatch], length: int, rows: Callable[..., list[np.ndarray]], schema: str) -> Iterator[pa.RecordBatch]:
    """rows(names, bytes, first starts, counts) of each document, all but the document's id and hash."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        out: list[list[np.ndarray]] = [[] for _ in fields]
        for k, (doc, text_hash, at, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
            part = data[offsets[k] : offsets[k + 1]]
            order = np.lexsort((n, at))
            found = rows(bucket_names(part, length // 2), part, np.array(at, np.int64)[order], np.array(n, np.int64)[order])
            for column, values in zip(out, [np.full(len(found[0]), doc), np.full(len(found[0]), text_hash), *found], strict=True):
                column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(kinds[f[1]]) for c, f in zip(out, fields, strict=True)], [f[0] for f in fields])


def _blocks(length: int, block: int):
    half = length // 2

    def of(names, part, at, n):
        own = spread(at, n)
        # the anchors again: those of the stretches' own strings
        reach = length - half + 1
        tagged = _placed(names)
        anchor = np.array([int(tagged[a : a + reach].argmin()) + a for a in at.tolist()], np.int64)
        back = np.repeat(anchor, n) - own
        number = back // block
        head = np.ones(len(own), bool)
        head[1:] = (number[1:] != number[:-1]) | (own[1:] != own[:-1] + 1) | np.diff(np.repeat(np.arange(len(at)), n)).astype(bool)
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(own)))
        start, k, a = own[first], number[first], (own + back)[first]
        core = a - block * k
        core = paired(_name(names, core, core - block + 1 + length, half), k.astype(np.uint64))
        whole = _whole(names, start, size, a, length)
        return [start, size, core.view(np.int64), whole.view(np.int64)]

    return lambda batches: _per_row(batches, length, of, _BLOCKS)


def _starts(length: int):
    half = length // 2

    def of(names, part, at, n):
        own = spread(at, n)
        one = paired(names[own], names[own + half])
        return [np.repeat(at, n), own, one.view(np.int64), Rolling(part).of(own, own + length).view(np.int64)]

    return lambda batches: _per_row(batches, length, of, _STARTS)


def _level(tmp: Scratch, table: DataFrame, bucket: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Of a level's rows: (doc, h, at, n) that are repeated whole; and one row of each kind, from buckets that hold several kinds.

    A kind that is repeated goes on too, by one row: others of its bucket may share strings with it."""
    kinds = tmp.written(table.groupBy(bucket, "whole").agg(F.count("*").alias("members"), F.min(F.struct("doc", "h", "at", "n")).alias("first")), f"{name}-kinds")
    several = kinds.groupBy(bucket).agg(F.count("*").alias("kinds")).where("kinds > 1").select(bucket)
    open_ = kinds.join(several, bucket, "left_semi").select("first.*")
    whole = table.join(kinds.where("members > 1").select(bucket, "whole"), [bucket, "whole"], "left_semi").select("doc", "h", "at", "n")
    return tmp.written(whole, f"{name}-whole"), open_


def _with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, h, text, at, n): a document's rows beside its text. Rows of one document are no more than its bytes."""
    own = rows.distinct().groupBy(*_ROW).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    return texts.join(own.hint("merge"), _ROW).select("doc", "h", "text", "at", "n")


def repeated(tmp: Scratch, texts: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc, h, at, n): runs of n starts from `at` whose first and last string of `length` bytes occur elsewhere. texts: (doc, h, text)."""
    long = texts.where(F.octet_length("text") >= length).select(*_ROW, "text")
    stretches = tmp.written(long.mapInArrow(_stretches(length), _ANCHORS), "stretches")
    whole, open_ = _level(tmp, stretches, "bucket", "stretches")
    blocks = tmp.written(_with_text(long, open_).mapInArrow(_blocks(length, block), _BLOCKS), "blocks")
    equal, mixed = _level(tmp, blocks, "core", "blocks")
    starts = tmp.written(_with_text(long, mixed).mapInArrow(_starts(length), _STARTS), "starts")
    twice = starts.groupBy("w1", "w2").agg(F.count("*").alias("members")).where("members > 1").select("w1", "w2")
    found = starts.join(twice, ["w1", "w2"], "left_semi").groupBy(*_ROW, "block").agg(F.min("at").alias("at"), F.max("at").alias("to"))
    return whole.unionByName(equal).unionByName(found.select("doc", "h", "at", (F.col("to") - F.col("at") + 1).alias("n")))


def removed_spans(at: list[int], n: list[int], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes to remove, in order."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(at, n, strict=True)):
        end = a + b - 1 + length
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], end)
        else:
            spans.append((a, end))
    return spans


def _whole_characters(part: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """The bytes of characters that stay whole."""
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    if not len(lead) or lead[0]:
        lead = np.concatenate([[0], lead])
    return np.repeat(np.minimum.reduceat(stays, lead), np.diff(np.append(lead, len(part))))


def _cut(length: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sizes, removed, spans, kept, texts = [], [], [], [], []
            for k, (at, n) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                part = data[offsets[k] : offsets[k + 1]]
                own = removed_spans(at or [], n or [], length)
                stays = np.ones(len(part), bool)
                for a, b in own:
                    stays[a:b] = False
                sizes.append(len(part))
                removed.append(sum(b - a for a, b in own))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(part[stays].tobytes())
                texts.append(part[_whole_characters(part, stays)].tobytes().decode("utf-8", "replace") if own else batch.column(1)[k].as_py())
            values = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "text"])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per document: bytes, bytes removed, the maximal removed runs (from start up to end), the bytes that stay, and as text the
    characters that stay whole."""
    spark = docs.sparkSession
    small_batches(spark)
    if length % 2 or block >= length // 4:
        raise ValueError("length must be even and more than four blocks")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = own.select("doc_id", *[F.xxhash64(F.lit(k), "doc_id", "text").alias(name) for k, name in enumerate(_ROW)], "text")
    with Scratch(spark, "substrings") as tmp:
        ranges = written(repeated(tmp, texts, length, block), "ranges")
    own = ranges.groupBy(*_ROW).agg(F.collect_set(F.struct("at", "n")).alias("own")).select(*_ROW, F.col("own.at").alias("at"), F.col("own.n").alias("n"))
    return texts.join(own.hint("merge"), _ROW, "left").select("doc_id", "text", "at", "n").mapInArrow(_cut(length), SCHEMA)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """Digests of cut_repeats. `text` and `n_kept` are what stays; a character of which bytes were removed is left out of `text`."""
    done = cut_repeats(docs, **options)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "text")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
