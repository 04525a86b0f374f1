"""I-Match fingerprints over several randomised lexicons.

The lexicon is the band of terms whose document frequency lies between `LOW` and `HIGH` of all documents: rarer terms
and commoner ones say little about copies. A document's terms in the band, distinct and sorted, are what I-Match hashes; an
edit of any one changes that hash, so it is taken over `SUBSETS` random subsets of the lexicon instead. At level v a
subset holds a term with chance 2^-v; v follows the number n of the document's terms in the band, 2^(v-1) < n <= 2^v, so
that about one of them falls into each subset. Hashes are given for levels v and v + 1, so that fingerprints of documents of
somewhat different size have a level in common.

The lexicon has at most (terms of an average document) / LOW entries, whatever the corpus: all document frequencies sum to
the number of documents times that average.

A fingerprint is the level (two digits) and two lists of hashes (8 hexadecimal digits each; zeros where a subset holds no
term), or, for a document without terms in the band, `d` and a digest of its text. The likeness of two fingerprints is, at
the finest level that both have, the share of equal hashes among subsets that hold a term of one of the documents; without a
common level, or with digests, it is 1 if the fingerprints are equal and else 0.

Defined cases: null is an empty text; equal texts have equal fingerprints; rows of equal doc_id follow one another in order
of text; with one document, the next one is itself; a null doc_id sorts last; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lowered, mix, small_batches, steps, utf8
from .decontaminate import word_hashes
from .tokens import Known

LOW, HIGH, SUBSETS = 0.0005, 0.2, 48
FLUSH = 1 << 21
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NULL_ID = -(1 << 63)


def term_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct terms (hashes of lower-cased words) of each row."""
    words, _, _, first = word_hashes(lowered(data), offsets)
    return [np.unique(words[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, rows = [], 0, 0

    def flush():
        terms, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], ["term", "df"])

    for batch in batches:
        data, offsets = utf8(batch.column(0))
        rows += batch.num_rows
        for i, j in steps(offsets):
            for terms in term_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                held.append(terms)
                size += len(terms)
        if size > FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


class Lexicon:
    """The terms of the band."""

    def __init__(self, terms: np.ndarray, subsets: int = SUBSETS):
        self.terms, self.subsets = terms, subsets
        self.salts = mix(np.arange(1, subsets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.known = None

    def __getstate__(self):
        return self.terms, self.subsets

    def __setstate__(self, state):
        self.__init__(*state)

    def fingerprints(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Levels (-1: none), hashes (rows, 2, subsets) and the fingerprints as text."""
        if self.known is None:
            self.known = Known()
            self.known.add(self.terms)
        words, _, _, first = word_hashes(lowered(data), offsets)
        inside = self.known.find(words) >= 0
        sets = [np.unique(words[a:b][inside[a:b]]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        n = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(n)
        levels = np.where(n > 0, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), -1)
        hashes = np.zeros((len(n), 2, self.subsets), np.uint32)
        if len(some):
            flat, begin = np.concatenate(sets), (np.cumsum(n) - n)[some]
            limit = np.repeat(np.uint64(0xFFFFFFFFFFFFFFFF) >> levels[some].astype(np.uint64), n[some])
            for k, salt in enumerate(self.salts):
                draw = mix(flat ^ salt)
                for finer in range(2):
                    chosen = draw <= (limit >> np.uint64(finer))
                    total = np.add.reduceat(np.where(chosen, mix(draw + salt), np.uint64(0)), begin)
                    count = np.add.reduceat(chosen.astype(np.int64), begin)
                    short = (total >> np.uint64(32)).astype(np.uint32)
                    hashes[some, finer, k] = np.where(count > 0, np.maximum(short, 1), 0)
        names = []
        for i in range(len(n)):
            if levels[i] >= 0:
                names.append(f"{levels[i]:02d}{hashes[i].astype('>u4').tobytes().hex()}")
            else:
                names.append("d" + hashlib.sha256(data[offsets[i] : offsets[i + 1]]).hexdigest())
        return levels, hashes, names


def likenesses(levels_a, hashes_a, names_a, levels_b, hashes_b, names_b) -> np.ndarray:
    out = np.array([float(a == b) for a, b in zip(names_a, names_b, strict=True)])
    top = np.maximum(levels_a, levels_b)
    near = np.flatnonzero((levels_a >= 0) & (levels_b >= 0) & (np.abs(levels_a - levels_b) <= 1))
    # both have level top; of equal levels the finer list is common too
    same = (levels_a == levels_b)[near]
    a = hashes_a[near, np.where(same, 1, top[near] - levels_a[near])]
    b = hashes_b[near, np.where(same, 1, top[near] - levels_b[near])]
    coarse_a, coarse_b = hashes_a[near, 0], hashes_b[near, 0]
    used = ((a > 0) | (b > 0)).sum(1)
    fine = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    coarse = ((coarse_a == coarse_b) & (coarse_a > 0)).sum(1) / np.maximum(((coarse_a > 0) | (coarse_b > 0)).sum(1), 1)
    out[near] = np.where(same & (used == 0), coarse, fine)
    return out


def likeness(a: str, b: str) -> float:
    """Of two fingerprints as text."""

    def read(name):
        if name[0] == "d":
            return np.array([-1]), np.zeros((1, 2, 1), np.uint32), [name]
        raw = np.frombuffer(bytes.fromhex(name[2:]), ">u4").astype(np.uint32)
        return np.array([int(name[:2])]), raw.reshape(1, 2, -1), [name]

    x, y = read(a), read(b)
    if x[1].shape != y[1].shape:
        return float(a == b)
    return float(likenesses(*x, *y)[0])


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH, subsets: int = SUBSETS) -> Lexicon:
    """The band of document frequency, counted over all documents. Its size is bounded by low."""
    plain = docs.select(F.col(text).cast("string").alias("text"))
    n = docs.count()
    counts = plain.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = counts.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))).select("term").toArrow()
    return Lexicon(np.sort(band.column(0).to_numpy().view(np.uint64)), subsets)


def _edited(text: str, follower: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + follower[:m]


def _compare(book: Lexicon):
    """Rows of a range stand together, in descending doc_id; a row of role 1 is only the follower of the last of role 0."""

    def done(rows: list[tuple], prints) -> pa.RecordBatch:
        """All rows but the last, each with the one behind it. rows: (doc_id, role, range, text)."""
        pairs = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k][2] == rows[k + 1][2]]
        edited = [_edited(rows[k][3], rows[k + 1][3]).encode() for k in pairs]
        other = book.fingerprints(np.frombuffer(b"".join(edited), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64))
        levels, hashes, names = prints
        here, after = np.array(pairs, np.int64), np.array(pairs, np.int64) + 1
        own = [names[k] for k in pairs]
        near = likenesses(levels[here], hashes[here], own, *other)
        following = likenesses(levels[here], hashes[here], own, levels[after], hashes[after], [names[k + 1] for k in pairs])
        values = [pa.array([rows[k][0] for k in pairs], pa.int64()), pa.array([len(rows[k][3]) for k in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(own, pa.string()), pa.array(other[2], pa.string()), pa.array(near, pa.float64()), pa.array(following, pa.float64())]
        return pa.RecordBatch.from_arrays(values, [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_print = None, None
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            ids, roles, ranges = (batch.column(k).to_pylist() for k in range(3))
            for i, j in steps(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                levels, hashes, names = book.fingerprints(part, at)
                raw = part.tobytes()
                rows = [(ids[k], roles[k], ranges[k], raw[at[k - i] : at[k - i + 1]].decode()) for k in range(i, j)]
                if last is not None:
                    rows = [last, *rows]
                    levels, hashes, names = np.append(last_print[0], levels), np.concatenate([last_print[1], hashes]), last_print[2] + names
                yield done(rows, (levels, hashes, names))
                last, last_print = rows[-1], (levels[-1:], hashes[-1:], names[-1:])

    return run


def in_sequence(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, role, range, text): documents dealt into ranges of doc_id. The follower of a range's last document, which is the
    next range's first, comes with it as role 1; the first document of all follows the last. Only range borders reach the driver."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = np.unique(np.array(plain.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) or [0.0]).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, ids.to_numpy(np.int64), "left").astype(np.int32))

    tops = plain.select("doc_id", range_of("doc_id").alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    # the top document of a range is the follower of the range above it; that of the highest follows the lowest's last
    above = {r["top"]: (tops[k + 1]["range"] if k + 1 < len(tops) else tops[0]["range"]) for k, r in enumerate(tops)}
    keys = np.array(sorted(above), np.int64)
    to = np.array([above[k] for k in sorted(above)], np.int32)

    @F.pandas_udf("array<struct<range:int,role:int>>")
    def places(ids: pd.Series) -> pd.Series:
        own = ids.to_numpy(np.int64)
        ranges, where = np.searchsorted(borders, own, "left").tolist(), np.searchsorted(keys, own)
        where[where == len(keys)] = 0
        top = (keys[where] == own).tolist()
        return pd.Series([[{"range": r, "role": 0}, {"range": int(to[w]), "role": 1}] if t else [{"range": r, "role": 0}] for r, t, w in zip(ranges, top, where.tolist(), strict=True)])

    dealt = plain.select("doc_id", "text", F.explode(places("doc_id")).alias("p")).select("doc_id", "p.role", "p.range", "text")
    return dealt.repartition("range").sortWithinPartitions("range", "role", F.desc("doc_id"), "text")


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", low: float = LOW, high: float = HIGH, subsets: int = SUBSETS) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and how like they and the next document's are."""
    small_batches(docs.sparkSession)
    book = lexicon(docs, text, low, high, subsets)
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    done = in_sequence(docs, text, doc_id).mapInArrow(_compare(book), SCHEMA)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
