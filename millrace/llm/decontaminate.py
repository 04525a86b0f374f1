"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A window is
a set of word shingles that must be contained whole in a document, so the necessary prefix of its shingles, ordered from
the rarest in the corpus, is one shingle: the rarest. Documents are joined with those prefix shingles only; the offset of
the shingle in its window and the ends of the document bound where the window could lie (positional and length bounds);
the words there are then compared one by one.

The benchmark is broadcast in blocks of at most `BLOCK_BYTES` of text, one at a time, and the documents are read once for each:
the larger side is never shuffled for it. Documents with hits are few rows; where there are several blocks, those of one text are
united by a 128-bit hash of it, and a text that very many rows hold is spread over tasks.

Defined cases: null and empty texts have no words and are not contaminated; an item without words has no window; equal
items are all reported; a null or repeated doc_id changes nothing, as verdicts belong to texts; an empty table gives one. `scan`
reads no other columns, `clean` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, documents, lowered, paired, runs, salted_join, small_batches, spread, steps, utf8, written

WINDOW, SHINGLE = 13, 4
#: A benchmark is broadcast in blocks of at most so many bytes of text.
BLOCK_BYTES = 8 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    return _PATTERN.findall((text or "").encode("utf-8", "surrogatepass").translate(bytes(lowered(np.arange(256, dtype=np.uint8)))))


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Of lower-cased bytes: hash, start, end of each word, and the first word of each row."""
    starts, ends = runs(_WORD[data], offsets)
    return Rolling(data).of(starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = paired(out, words[i : i + n])
    return out


@dataclass
class Windows:
    """The distinct windows of a block of items; of `k` words are the shingles of windows with at least k words."""

    words: list[tuple[bytes, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)

    @classmethod
    def of(cls, rows, window: int) -> Windows:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in rows:
            words = item_words(text)
            for i in range(max(1, len(words) - window + 1)) if words else ():
                found.setdefault(tuple(words[i : i + window]), set()).add(str(item))
        ordered = sorted(found)
        return cls(ordered, [sorted(found[w]) for w in ordered])

    def shingles(self, k_max: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each window: k, its word hashes and its shingle hashes."""
        out = []
        for w in self.words:
            data = np.frombuffer(b" ".join(w), np.uint8)
            hashes = word_hashes(data, np.array([0, len(data)]))[0]
            k = min(k_max, len(w))
            out.append((k, hashes, shingled(hashes, k)))
        return out


class Index:
    """Prefix shingle -> (window, offset of the shingle in it), by k, and the windows' words."""

    def __init__(self, windows: Windows, shingles, rarity: dict[int, int]):
        self.windows = windows
        self.length = np.array([len(w) for w in windows.words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.hashes = np.concatenate([h for _, h, _ in shingles]) if shingles else np.zeros(0, np.uint64)
        by_k: dict[int, list[tuple[int, int, int]]] = {}
        for w, (k, _, names) in enumerate(shingles):
            offset = min(range(len(names)), key=lambda i: (rarity.get(int(names[i]), 0), int(names[i]), i))
            by_k.setdefault(k, []).append((int(names[offset]), w, offset))
        self.by_k = {}
        for k, rows in by_k.items():
            rows.sort()
            names, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            self.by_k[k] = (names, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def occurrences(self, hashes: np.ndarray, first: np.ndarray):
        """(window, position of its first word) for all that occur within a row."""
        row_end = np.repeat(first[1:], np.diff(first))
        row_start = np.repeat(first[:-1], np.diff(first))
        for k, (names, at, windows, offsets) in self.by_k.items():
            found = shingled(hashes, k)
            where = np.searchsorted(names, found)
            where[where == len(names)] = 0
            pos = np.flatnonzero(names[where] == found)
            n = at[where[pos] + 1] - at[where[pos]]
            entry, pos = spread(at[where[pos]], n), np.repeat(pos, n)
            window, start = windows[entry], pos - offsets[entry]
            fits = (start >= row_start[pos]) & (start + self.length[window] <= row_end[pos])
            window, start = window[fits], start[fits]
            for i in range(0, len(window), 50_000):
                w, s = window[i : i + 50_000], start[i : i + 50_000]
                n = self.length[w]
                same = hashes[spread(s, n)] == self.hashes[spread(self.at[w], n)]
                whole = np.logical_and.reduceat(same, np.cumsum(n) - n) if len(n) else np.zeros(0, bool)
                yield w[whole], s[whole]


def _shingle_counts(names: np.ndarray, ks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in steps(offsets):
                part, at = lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                hashes = word_hashes(part, at)[0]
                for k in ks:
                    found = shingled(hashes, k)
                    where = np.searchsorted(names, found)
                    where[where == len(names)] = 0
                    counts += np.bincount(where[names[where] == found], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["name", "n"])

    return run


def rarity(docs: DataFrame, shingles, text: str = "text") -> dict[int, int]:
    """How often each shingle of the windows occurs in all documents (across a document's end too: it only orders them)."""
    if not shingles:
        return {}
    names = np.unique(np.concatenate([s for _, _, s in shingles]))
    counted = docs.select(F.col(text).cast("string")).mapInArrow(_shingle_counts(names, sorted({k for k, _, _ in shingles})), "name long, n long")
    rows = counted.groupBy("name").agg(F.sum("n").alias("n")).collect()
    return {r["name"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}


def _hits(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """For each row: words, numbers of the hit words, and the items found."""
    hashes, starts, ends, first = word_hashes(data, offsets)
    rows = len(offsets) - 1
    edges = np.zeros(len(hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(rows)]
    raw, checked = data.tobytes(), {}
    for windows, at in index.occurrences(hashes, first):
        for w, s in zip(windows.tolist(), at.tolist(), strict=True):
            words = index.windows.words[w]
            key = (s, w)
            if key not in checked:
                checked[key] = all(raw[starts[s + i] : ends[s + i]] == x for i, x in enumerate(words))
            if checked[key]:
                edges[s] += 1
                edges[s + len(words)] -= 1
                items[int(np.searchsorted(first, s, "right")) - 1].update(index.windows.items[w])
    hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    at = np.searchsorted(hit, first)
    return np.diff(first).tolist(), [(hit[at[r] : at[r + 1]] - first[r]).tolist() for r in range(rows)], [sorted(x) for x in items]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Items in blocks of bounded size, in order of id; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if block and size + len(r["t"] or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"] or "")
    yield block


def _found(index: Index):
    """(n_words, hit words, items) of every row of (k0, k1, text)."""
    hits, names = pa.list_(pa.int32()), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            n_words, hit, items = [], [], []
            for i, j in steps(offsets):
                found = _hits(index, lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
                for out, part in zip((n_words, hit, items), found, strict=True):
                    out += part
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n_words, pa.int64()), pa.array(hit, hits), pa.array(items, names)], _FOUND)

    return run


_FOUND = ["k0", "k1", "doc_id", "n_words", "hit", "items"]
_KEY = ["k0", "k1"]


def _verdicts(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, text: str, doc_id: str, item: str, block_bytes: int) -> DataFrame:
    """(k0, k1, doc_id, n_words, n_hit, items, contaminated) of every row, written; k0 and k1 name the text."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.col(text).cast("string")
    table = docs.select(F.xxhash64(F.lit(1), whole).alias("k0"), F.xxhash64(F.lit(2), whole).alias("k1"), whole.alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    schema = "k0 long, k1 long, doc_id long, n_words long, hit array<int>, items array<string>"
    with Scratch(spark, "decontaminate") as tmp:
        first, more = None, []
        for rows in _blocks(benchmark, item, text, block_bytes):
            windows = Windows.of(rows, window)
            shingles = windows.shingles(shingle)
            part = table.mapInArrow(_found(Index(windows, shingles, rarity(table.withColumnRenamed("text", text), shingles, text))), schema)
            if first is None:
                first = tmp.written(part, "first")
            else:
                more.append(tmp.written(part.where(F.size("hit") > 0), "more"))
        hit, items = F.col("hit"), F.col("items")
        if more:
            others = more[0]
            for part in more[1:]:
                others = others.unionByName(part)
            # rows of one text have equal hits in each block, so sets of sets hold no more than one row's
            rest = others.groupBy(*_KEY).agg(F.flatten(F.collect_set("hit")).alias("hit2"), F.flatten(F.collect_set("items")).alias("items2"))
            counts = first.groupBy(*_KEY).agg(F.count("*").alias("n"))
            first = salted_join(first, counts.join(rest, _KEY), _KEY, ["doc_id"], first.count(), "left")
            none = F.array()
            hit = F.array_union(hit, F.coalesce("hit2", none.cast("array<int>")))
            items = F.array_union(items, F.coalesce("items2", none.cast("array<string>")))
        n_hit = F.size(hit).cast("long")
        done = first.select(*_KEY, "doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(items).alias("items"))
        return written(done.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))), "verdicts")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: words, words inside an occurrence of a window, the items with one, and whether it is contaminated."""
    done = _verdicts(docs, benchmark, window, shingle, text, doc_id, item, block_bytes)
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Each row is judged by its own text; only texts that are
    contaminated are looked up, so where they are few (a size that the planner checks) no document is shuffled."""
    names, plain = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = f"c{names.index(text)}"
    if own != text:
        benchmark = benchmark.select(F.col(item).alias("item"), F.col(text).alias(own))
    done = _verdicts(plain.withColumn("no_id", F.lit(None).cast("long")), benchmark, window, shingle, own, "no_id", "item", block_bytes)
    bad = written(done.where("contaminated").select(*_KEY).distinct(), "contaminated")
    keyed = plain.withColumn("k0", F.xxhash64(F.lit(1), F.col(own).cast("string"))).withColumn("k1", F.xxhash64(F.lit(2), F.col(own).cast("string")))
    return keyed.join(bad, _KEY, "left_anti").drop(*_KEY).toDF(*names)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")
