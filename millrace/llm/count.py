"""Token counts by a tokenizer compiled into finite-state transducers.

Two transducers, run one after the other, do what a BPE tokenizer with word ends does to a text.

`Splitter` finds where pieces start (letters, single numbers, other marks, contractions). The text is cut into chunks; for
each chunk the map from every entry state to its exit state is computed, the maps are composed by a parallel prefix scan,
and each chunk then runs from the entry state that the scan gives it, annotating transitions with piece starts.

`Counter` reads the bytes of a piece and annotates each transition with the change in the number of tokens. A prefix's
last token is the longest token that ends it and may stand behind the last token of the rest (two tokens may adjoin if
merging does not change them), so the last tokens and counts at the places to which a longer token could still reach back
are all that later bytes can ask for: that is the state. States are made when first reached; every piece is an input of its
own, so a piece's exit count needs no composition. A worker remembers the counts of pieces it has met.

Defined cases: null and empty texts have no tokens; special strings inside a text are one token each, as the library has
it; repeated rows are counted each; a text of any length is read whole; an empty table gives one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, documents, mix, small_batches, spread, steps, utf8
from .tokens import LETTER, NUMBER, REMEMBERED, SPACE, Known, classes, code_points, cut_out, tokenizer_path

TOKENIZER, LIMIT, CHUNK = "word_bpe_49k.json", 2048, 128
#: Symbols up to which a piece is named by its rolling hash.
LONG = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# symbols of the splitter
BLANK, PLAIN, DIGIT, MARK, QUOTE, ONE, TWO, E, L = range(9)
# its states: between pieces, in letters, in marks, at a lone quote, behind quote and r or v, behind quote and l
START, WORD, MARKS, LONE, AWAIT_E, AWAIT_L = range(6)
HERE, BEFORE = 1, 2  # a piece starts at this symbol, at the one before


@lru_cache(1)
def symbols() -> np.ndarray:
    kinds = classes()
    table = np.full(0x110000, MARK, np.uint8)
    table[kinds == SPACE], table[kinds == LETTER], table[kinds == NUMBER] = BLANK, PLAIN, DIGIT
    table[39] = QUOTE
    for letters, symbol in (("stmd", ONE), ("rv", TWO), ("e", E), ("l", L)):
        table[[ord(c) for c in letters]] = symbol
    return table


@lru_cache(1)
def lower_case() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c)) in ("Lu", "Lt", "So", "Nl") and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


class Splitter:
    """The transducer of the pattern 's|'t|'re|'ve|'m|'ll|'d|letters|one number|other marks, white space left out."""

    def __init__(self):
        self.next, self.out = np.zeros((9, 6), np.uint8), np.zeros((9, 6), np.uint8)
        plain = {BLANK: (START, 0), DIGIT: (START, HERE), MARK: (MARKS, HERE), QUOTE: (LONE, HERE)}
        for symbol in range(9):
            fresh, inside = plain.get(symbol, (WORD, HERE)), plain.get(symbol, (WORD, 0))
            late = (inside[0], inside[1] | BEFORE)
            marks = (MARKS, 0) if symbol in (MARK, QUOTE) else fresh
            lone = {ONE: (START, 0), TWO: (AWAIT_E, 0), L: (AWAIT_L, 0), MARK: (MARKS, 0), QUOTE: (MARKS, 0)}.get(symbol, fresh)
            row = [fresh, inside, marks, lone, (START, 0) if symbol == E else late, (START, 0) if symbol == L else late]
            self.next[symbol], self.out[symbol] = zip(*row, strict=True)

    def scan(self, inputs: np.ndarray) -> np.ndarray:
        """The state in which each chunk is entered, from the chunks' state maps. inputs: (CHUNK, chunks)."""
        chunks = inputs.shape[1]
        maps = np.repeat(np.arange(6, dtype=np.uint8)[:, None], chunks, 1)
        flat = self.next.ravel()
        for symbol in inputs:
            maps = flat[symbol * np.uint8(6) + maps]
        reach = 1
        while reach < chunks:
            maps = np.concatenate([maps[:, :reach], _composed(maps[:, reach:], maps[:, :-reach])], 1)
            reach *= 2
        return np.concatenate([np.zeros(1, np.uint8), maps[START, :-1]])

    def starts(self, inputs: np.ndarray) -> np.ndarray:
        """Where pieces start among the symbols."""
        n = len(inputs)
        chunks = -(-n // CHUNK)
        padded = np.zeros(chunks * CHUNK, np.uint8)
        padded[:n] = inputs
        columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        state, moves, outs = self.scan(columns), self.next.ravel(), self.out.ravel()
        marks = np.empty_like(columns)
        for t, symbol in enumerate(columns):
            at = symbol * np.uint8(6) + state
            marks[t], state = outs[at], moves[at]
        marks = marks.T.ravel()
        begins = (marks & HERE).astype(bool)
        begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return np.flatnonzero(begins[:n])


def _composed(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """state -> later(earlier(state)), column by column."""
    return later[earlier, np.arange(later.shape[1])]


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that print stand for themselves, the others, in order, for code points from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


END = 256  # added to the last byte of a piece


class Counter:
    """The lazily determinised transducer of a BPE with word ends, from the vocabulary's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, suffix = byte_letters(), model["end_of_word_suffix"]

        def of(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix)
            own = [letters[c] for c in (token.removesuffix(suffix) if ends else token)]
            return (*own[:-1], own[-1] + END) if ends else tuple(own)

        self.rank: dict[tuple, int] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((of(left), of(right)), i)
        made = {a + b for a, b in self.rank}
        self.tokens = {(b,) for b in range(512)} | {t for t in made if self.merged(t) == (t,)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.adjoin: dict[tuple, bool] = {}
        self.states: dict[tuple, int] = {((), ((None, 0),)): 0}
        self.content = [((), ((None, 0),))]
        self.edges = Known()
        self.target, self.emit = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def merged(self, symbols: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
        """Merge pair after pair, the pair of least rank first and the leftmost of equal ones."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, 1 << 30) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(parts)

    def may_adjoin(self, a: tuple, b: tuple) -> bool:
        if (a, b) not in self.adjoin:
            self.adjoin[a, b] = self.merged(a + b) == (a, b)
        return self.adjoin[a, b]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change in the number of tokens)."""
        tail, behind = self.content[state]  # behind[k]: last token and relative count k symbols back
        longer = (*tail, symbol)
        for size in range(len(longer), 0, -1):
            token = longer[len(longer) - size :]
            last, count = behind[size - 1]
            if token in self.tokens and (last is None or self.may_adjoin(last, token)):
                break
        change = count + 1
        keep = next(k for k in range(len(longer), -1, -1) if longer[len(longer) - k :] in self.prefixes)
        content = (longer[len(longer) - keep :], ((token, 0), *((t, c - change) for t, c in behind[:keep])))
        if content not in self.states:
            self.states[content] = len(self.content)
            self.content.append(content)
        return self.states[content], change

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece, all pieces read side by side."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        for t, n in enumerate(active.tolist()):
            symbol = data[starts[:n] + t].astype(np.int64)
            symbol[lengths[:n] == t + 1] += END
            edge = state[:n] * 512 + symbol
            names = mix(edge.astype(np.uint64) + np.uint64(1))
            rows = self.edges.find(names)
            if (new := np.flatnonzero(rows < 0)).size:
                fresh, first = np.unique(names[new], return_index=True)
                made = [self.step(e // 512, e % 512) for e in edge[new[first]].tolist()]
                k = self.edges.n
                while k + len(made) > len(self.target):
                    self.target, self.emit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.target, self.emit))
                self.target[k : k + len(made)], self.emit[k : k + len(made)] = zip(*made, strict=True)
                self.edges.add(fresh)
                rows[new] = self.edges.find(names[new])
            total[:n] += self.emit[rows]
            state[:n] = self.target[rows]
        out = np.empty_like(total)
        out[order] = total
        return out


class Compiled:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.special = {t.content.encode(): i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
        self.splitter, self.path = Splitter(), path
        self.forget()

    def forget(self) -> None:
        self.counter, self.known, self.counts = Counter(self.path), Known(), np.zeros(1 << 14, np.int64)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of UTF-8 text."""
        inner, cuts = cut_out(data, offsets, self.special)
        if not cuts:
            return self._tokens(data, offsets)
        lengths = np.diff(inner)
        special = np.array([int(a) in cuts and n > 0 for a, n in zip(inner[:-1].tolist(), lengths.tolist(), strict=True)], bool)
        own = np.where(special, 0, lengths)
        kept = data[spread(inner[:-1], own)]
        each = np.where(special, 1, self._tokens(kept, np.concatenate([[0], np.cumsum(own)])))
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.searchsorted(inner, offsets, "left")
        return np.diff(total[ends])

    def _normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased code points in form NFC."""
        codes, at, text = code_points(data, offsets)
        if codes.dtype != np.uint8 and not (unicodedata.is_normalized("NFC", text) and "İ" not in text):
            rows = [unicodedata.normalize("NFC", text[a:b]).replace("İ", "i̇") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            codes, at = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return lower_case()[codes], at

    def _tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.known.n > REMEMBERED or len(self.counter.content) > REMEMBERED:
            self.forget()
        codes, at = self._normalised(data, offsets)
        rows = len(at) - 1
        spaced = np.zeros(len(codes) + rows, np.uint8)  # a blank behind each row
        place = np.arange(len(codes)) + np.repeat(np.arange(rows), np.diff(at))
        spaced[place] = symbols()[codes]
        starts = self.splitter.starts(spaced)
        if not len(starts):
            return np.zeros(rows, np.int64)
        # a piece ends where the next starts or a blank stands
        blank = np.flatnonzero(spaced == BLANK)
        ends = np.minimum(np.append(starts[1:], len(spaced)), blank[np.searchsorted(blank, starts)])
        back = np.zeros(len(spaced), np.int64)
        back[place] = np.arange(len(codes))
        first = back[starts]
        names = Rolling(codes).of(first, first + (ends - starts))
        for k in np.flatnonzero(ends - starts > LONG).tolist():  # sums of powers modulo 2^64 are equal for some long pieces, whatever the base
            piece = codes[first[k] : first[k] + ends[k] - starts[k]].tobytes()
            names[k] = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
        found = self.known.find(names)
        if (new := np.flatnonzero(found < 0)).size:
            fresh, one = np.unique(names[new], return_index=True)
            one = new[one]
            lengths = (ends - starts)[one]
            text = codes[spread(first[one], lengths)].astype("<u4").tobytes().decode("utf-32-le")
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            cut = lead[np.concatenate([[0], np.cumsum(lengths)])]
            k = self.known.n
            while k + len(fresh) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[k : k + len(fresh)] = self.counter.count(raw, cut[:-1], np.diff(cut))
            self.known.add(fresh)
            found[new] = self.known.find(names[new])
        total = np.concatenate([[0], np.cumsum(self.counts[found])])
        bounds = np.searchsorted(starts, at + np.arange(rows + 1))
        return np.diff(total[bounds])


_compiled: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [compiled(path).tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
