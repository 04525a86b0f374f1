"""Packing of token sequences by non-negative least squares over length combinations.

Whole windows are cut off every document first. What is left, shorter than a window, is counted into a histogram of
lengths. Combinations of at most three lengths that fill a window exactly are enumerated, their repeat counts solved
against the histogram by non-negative least squares (multiplicative updates), rounded, and taken while the histogram has
the lengths. The residue is packed greedily: laid end to end, longest first, and cut where a window is full; the last
stretch is cut at powers of two. The plan is a function of the histogram alone: its size is bounded by the window (of 2048
tokens: 350,000 combinations), not by the corpus. Documents find their place in it by their rank among those of equal length, which
is counted within each partition while the ids are written, and offset by the counts of earlier partitions.

Defined cases: null and empty texts have only their end id; repeated rows are packed once each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_batches, steps, utf8, written
from .tokens import encoder, tokenizer_path

WINDOW, END_ID = 2048, 1
TOKENIZER = "byte_bpe_50k.json"
TOKENS = "row long, doc_id long, n long, part int, rank long, whole long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenize(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        seen, row, whole = np.zeros(window, np.int64), part << 33, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            lengths, ranks, before, blobs = [], [], [], []
            for i, j in steps(offsets):
                ids, at = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = b - a + 1
                    lengths.append(n)
                    ranks.append(int(seen[n % window]))
                    before.append(whole)
                    seen[n % window] += 1
                    whole += n // window
                    blobs.append(np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(ranks, pa.int64()), pa.array(before, pa.int64()), pa.array(blobs, pa.binary())],
                ["row", "doc_id", "n", "part", "rank", "whole", "ids"],
            )
            row += n

    return run


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of present lengths with a + b + c = window; c = 0 for pairs."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [np.zeros((0, 3), np.int64)]
    for a in np.sort(lengths)[::-1].tolist():
        rest = window - a
        low = -(-rest // 2)
        b = np.arange(low, min(a, rest) + 1)
        c = rest - b
        keep = there[b] & ((c == 0) | there[c]) & (b > 0)
        if keep.any():
            out.append(np.stack([np.full(int(keep.sum()), a), b[keep], c[keep]], 1))
    return np.concatenate(out)


def non_negative_least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x >= 0 that brings the lengths used by x repeats of each combination near the histogram."""
    if not len(combos):
        return np.zeros(0)
    target = histogram.astype(float)
    target[0] = 0
    x = np.full(len(combos), max(1e-9, target.sum() / (3 * len(combos))))
    up = target[combos].sum(1)
    for _ in range(rounds):
        used = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=len(target))
        used[0] = 0
        x *= up / np.maximum(used[combos].sum(1), 1e-12)
    return x


@dataclass
class Plan:
    """Where the rank-th document of each residual length goes. Segments are sorted by (length, first rank)."""

    window: int
    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray  # of the segment's first document, or -1 for the stretch of residues
    offset: np.ndarray  # in its sequence, or of the first document in the stretch
    cuts: np.ndarray  # ends of the sequences of the stretch after the last whole window
    stretch: int
    stretch_id: int
    sequences: int

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of each piece of a residue."""
        key = int(np.searchsorted(self.length * (1 << 40) + self.first, length * (1 << 40) + rank, "right")) - 1
        return self.pieces(key, length, rank)

    def pieces(self, key: int, length: int, rank: int) -> list[tuple[int, int, int]]:
        more = rank - int(self.first[key])
        if self.sequence[key] >= 0:
            return [(int(self.sequence[key]) + more, int(self.offset[key]), length)]
        at, end = int(self.offset[key]) + more * length, int(self.offset[key]) + (more + 1) * length
        out, whole = [], self.stretch // self.window * self.window
        while at < end:
            if at < whole:
                number, start, stop = at // self.window, at // self.window * self.window, (at // self.window + 1) * self.window
            else:
                k = int(np.searchsorted(self.cuts, at, "right"))
                number, start, stop = whole // self.window + k, whole if k == 0 else int(self.cuts[k - 1]), int(self.cuts[k])
            size = min(end, stop) - at
            out.append((self.stretch_id + number, at - start, size))
            at += size
        return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    x = non_negative_least_squares(combos, left)
    taken = np.zeros(window + 1, np.int64)
    segments, sequence = [], 0
    order = np.argsort(-x, kind="stable").tolist()
    for rounded in (True, False):  # the solved counts first, then whatever the histogram still gives
        for c in order:
            parts = [int(v) for v in combos[c] if v]
            most = min(int(left[v]) // parts.count(v) for v in parts)
            n = min(most, int(x[c] + 0.5)) if rounded else most
            if n > 0:
                offset = 0
                for v in parts:
                    segments.append((v, int(taken[v]), sequence, offset))
                    taken[v] += n
                    left[v] -= n
                    offset += v
                sequence += n
    stretch = 0
    for v in range(window - 1, 0, -1):
        if left[v]:
            segments.append((v, int(taken[v]), -1, stretch))
            stretch += int(left[v]) * v
    cuts, rest = [], stretch % window
    base = stretch - rest
    while rest:
        size = 1 << (rest.bit_length() - 1)
        base += size
        cuts.append(base)
        rest -= size
    segments.sort()
    columns = np.array(segments, np.int64).reshape(-1, 4)
    return Plan(window, *columns.T, np.array(cuts, np.int64), stretch, sequence, sequence + stretch // window + len(cuts))


def _pieces(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, keys = plan.window, plan.length * (1 << 40) + plan.first
        for batch in batches:
            out: list[list[int | None]] = [[] for _ in range(7)]
            blobs, at = utf8(batch.column(2))
            raw = memoryview(blobs)
            doc, n, place, whole = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            where = np.searchsorted(keys, np.array([x % window for x in n], np.int64) * (1 << 40) + np.array(place, np.int64), "right") - 1
            for k in range(batch.num_rows):
                full, rest, start = n[k] // window, n[k] % window, 0
                parts = [(plan.sequences + whole[k] + i, 0, window) for i in range(full)]
                if rest:
                    parts += plan.pieces(int(where[k]), rest, place[k])
                for sequence, offset, size in parts:
                    low = int(at[k]) + 4 * start
                    for column, value in zip(out, (doc[k], start, size, zlib.crc32(raw[low : low + 4 * size]), n[k], sequence, offset), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], [f.split()[0] for f in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per piece: which ids of which document, in which sequence and where there. Ids are written once to the shared
    folder; a later step reads only lengths and ranks to lay out the plan, and the ids once more for the pieces."""
    spark = docs.sparkSession
    small_batches(spark)
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokens = written(table.mapInArrow(_tokenize(tokenizer or tokenizer_path(TOKENIZER), end_id, window), TOKENS), "tokens")
    lengths = tokens.select("row", "part", "rank", "whole", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("full"))
    counts = lengths.groupBy("part", "rest").agg(F.count("*").alias("docs"), F.sum("full").alias("full"))
    histogram = {r["rest"]: r["docs"] for r in counts.groupBy("rest").agg(F.sum("docs").alias("docs")).collect()}
    layout = plan(histogram, window)
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("rank_from", F.coalesce(F.sum("docs").over(earlier.partitionBy("rest").orderBy("part")), F.lit(0)))
    wholes = counts.groupBy("part").agg(F.sum("full").alias("full")).withColumn("bin", F.lit(0))
    wholes = wholes.withColumn("whole_from", F.coalesce(F.sum("full").over(earlier.partitionBy("bin").orderBy("part")), F.lit(0)))
    placed = lengths.join(ranks.select("part", "rest", "rank_from"), ["part", "rest"]).join(wholes.select("part", "whole_from"), "part")
    placed = placed.select("row", (F.col("rank") + F.col("rank_from")).alias("place"), (F.col("whole") + F.col("whole_from")).alias("whole"))
    return tokens.drop("whole").join(placed, "row").select("doc_id", "n", "ids", "place", "whole").mapInArrow(_pieces(layout), PIECES)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
