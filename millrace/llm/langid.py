"""Language identification by cross-parsing.

For each language a bounded sample of labelled text becomes a suffix automaton. A text is parsed greedily into the longest
phrases that occur in the sample: its number of phrases times log2 of the sample's length, per letter, estimates the
cross entropy, and the language with the least wins. Symbols are the lower-case letters of all samples, whatever their number. An
automaton is a sparse transition table (each state's row shifted so that rows interleave); where it has no transition the next
phrase begins, so that segments of many texts are parsed side by side.

The sample is the one bounded thing: for each language the `SAMPLE_DOCS` labelled texts that may be learned from with the smallest
hash of their id, those of at most `SAMPLE_SYMBOLS` characters first. They are taken whole, in that order, as long as they fit into
`SAMPLE_SYMBOLS` letters together, others are passed over; only where none fits is the first one cut to that size. All of every
text to be identified is parsed, in segments of `SEGMENT` symbols.

Defined cases: null text, or text without a letter, gives `und` and score 0, as does everything where nothing could be
learned; ties go to the first language in order of name; labels that are null are not learned; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, kept_rows, small_batches, steps, utf8
from .tokens import LETTER, classes, code_points

SAMPLE_DOCS, SAMPLE_SYMBOLS, SEGMENT = 64, 49152, 256
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(1)
def folded() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for what isn't a letter."""
    table = np.arange(0x110000, dtype=np.uint32)
    letters = classes() == LETTER
    for c in np.flatnonzero(letters).tolist():
        if unicodedata.category(chr(c)) in ("Lu", "Lt") and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    table[~letters] = 0
    return table


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 for each run of anything else, and the rows' offsets among them."""
    codes, at, _ = code_points(data, offsets)
    out = folded()[codes]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    before = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], before[at]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, state 0 being the empty one (Blumer et al.)."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


def sampled(texts: list[str], budget: int) -> list[int]:
    """Letters of the texts that fit, a 0 behind each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    letters, at = letters_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    out: list[int] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if len(out) + b - a < budget:
            out += [*letters[a:b].tolist(), 0]
    return out or [*letters[at[0] : at[0] + budget - 1].tolist(), 0]


class Automaton:
    """A suffix automaton as interleaved rows: state q has a transition by c to target[base[q] + c] where owner[base[q] + c] is q.
    root: where a phrase that begins with c leads; the last state has no transitions."""

    def __init__(self, symbols: list[int], wide: int):
        nexts = suffix_automaton(symbols)
        sizes = np.array([len(x) for x in nexts])
        dead, room = len(nexts), 4 * int(sizes.sum()) + 2 * wide
        self.root = np.full(wide, dead, np.int32)
        self.root[list(nexts[0])] = list(nexts[0].values())
        self.base, self.owner, self.target = np.zeros(dead + 1, np.int32), np.full(room, -1, np.int32), np.zeros(room, np.int32)
        rng = np.random.default_rng(0)
        for q in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():  # the longest rows while there is most room
            own = np.fromiter(nexts[q], np.int64, sizes[q])
            while True:
                tries = rng.integers(0, room - wide, 64)
                free = np.flatnonzero((self.owner[tries[:, None] + own] < 0).all(1))
                if len(free):
                    break
            self._put(q, int(tries[free[0]]), own, list(nexts[q].values()))
        single = np.flatnonzero(sizes == 1)
        own = np.array([next(iter(nexts[q])) for q in single.tolist()], np.int64)
        slots = np.flatnonzero(self.owner[wide:] < 0)[: len(single)] + wide
        self.base[single], self.owner[slots], self.target[slots] = slots - own, single, [next(iter(nexts[q].values())) for q in single.tolist()]

    def _put(self, state: int, base: int, symbols: np.ndarray, targets: list[int]) -> None:
        self.base[state], self.owner[base + symbols], self.target[base + symbols] = base, state, targets


class Model:
    """Samples by language; automata are built where they are used."""

    def __init__(self, samples: dict[str, list[str]], sample_symbols: int = SAMPLE_SYMBOLS):
        self.languages = sorted(samples)
        self.texts = {name: sampled(texts, sample_symbols) for name, texts in samples.items()}
        self.alphabet = sorted({c for own in self.texts.values() for c in own} - {0})
        self.key = hash(tuple((k, tuple(v)) for k, v in sorted(self.texts.items())))

    def tables(self) -> tuple[np.ndarray, list[tuple[Automaton, float]]]:
        """Letter -> symbol (0: separator, last: in no sample), and for each language its automaton and the weight of a phrase."""
        wide = len(self.alphabet) + 2
        symbol = np.full(0x110000, wide - 1, np.int32)
        symbol[0] = 0
        symbol[self.alphabet] = np.arange(1, wide - 1)
        own = [symbol[np.array(self.texts[name], np.int64)].tolist() for name in self.languages]
        return symbol, [(Automaton(x, wide), math.log2(max(2, len(x)))) for x in own]

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, rows) bits a symbol, and the number of letters of each row."""
        symbol, tables = built(self)
        letters, at = letters_of(data, offsets)
        symbols = symbol[letters]
        rows = len(at) - 1
        sizes = np.diff(at)
        n_segments = -(-sizes // SEGMENT)
        row = np.repeat(np.arange(rows), n_segments)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        start = at[row] + number * SEGMENT
        size = np.minimum(SEGMENT, at[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        active = np.searchsorted(-size, -np.arange(SEGMENT), "left")
        bits = np.zeros((len(tables), rows))
        for k, (automaton, weight) in enumerate(tables):
            state, phrases = automaton.root[symbols[start]], np.ones(len(row), np.int32)
            for t in range(1, SEGMENT):
                n = active[t]
                if not n:
                    break
                here, c = state[:n], symbols[start[:n] + t]
                at_row = automaton.base[here] + c
                fails = automaton.owner[at_row] != here
                state[:n] = np.where(fails, automaton.root[c], automaton.target[at_row])
                phrases[:n] += fails
            bits[k] = np.bincount(row, phrases, rows) * weight / np.maximum(1, sizes)
        known = np.concatenate([[0], np.cumsum(letters != 0)])
        return bits, known[at[1:]] - known[at[:-1]]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        bits, letters = self.entropies(data, offsets)
        best = bits.argmin(0)
        # the chance of the winner if every language's code lengths, of a quarter of 256 letters at most, were weighed
        gap = (bits - bits.min(0)) * np.minimum(letters, 256) / 4
        score = np.where(letters > 0, 1 / np.exp2(-gap).sum(0), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score


_built: dict[int, tuple] = {}


def built(model: Model) -> tuple:
    if model.key not in _built:
        _built.clear()
        _built[model.key] = model.tables()
    return _built[model.key]


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled documents that are not held out. Only ids, labels and hashes are read to choose the sample; each task
    passes on at most sample_docs rows of a language, and no more than those texts reach the driver, none longer than the budget."""
    name = F.concat_ws(":", F.xxhash64(text), F.xxhash64(doc_id), F.xxhash64(lang))
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        name.alias("name"), F.col(lang).alias("label"), F.col(text).cast("string").alias("t"), (F.length(text) > SAMPLE_SYMBOLS).alias("long"), F.xxhash64(doc_id).alias("h")
    )
    first = Window.partitionBy("label").orderBy("long", "h", "name")
    picks = usable.drop("t").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs).collect()
    if not picks:
        return Model({})
    order = {r["name"]: (r["long"], r["h"], r["name"]) for r in picks}
    rows = usable.where(F.col("name").isin(list(order))).select("name", "label", F.substring("t", 1, SAMPLE_SYMBOLS).alias("t")).dropDuplicates(["name"]).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: order[r["name"]]):
        samples.setdefault(r["label"], []).append(r["t"])
    return Model(samples)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            names, scores = [], []
            for i, j in steps(offsets):
                name, score = model.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names += name
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def in_known_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents to which a language can be given, with all their columns."""
    small_batches(docs.sparkSession)
    return kept_rows(docs, text, lambda data, offsets: np.array([x != UNKNOWN for x in model.predict(data, offsets)[0]], bool))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
