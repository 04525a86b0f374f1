"""Token ids of whole texts as the tokenizers library gives them, with each distinct piece encoded once per worker.

A byte-level BPE works on pieces (words, numbers, marks, white space) that never influence each other. Pieces are found for
millions of code points at a time with array operations; the library encodes only pieces that the worker has not met.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from .common import Rolling, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Pieces that a worker remembers; then it starts afresh.
REMEMBERED = 1 << 19
#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """Code points of UTF-8 bytes, the rows' offsets among them, and the text itself."""
    if not len(data) or int(data.max()) < 128:
        return data, offsets, data.tobytes().decode("ascii")
    text = data.tobytes().decode("utf-8")
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), before[offsets], text


def pieces(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the byte-level pattern: contractions, runs of letters, numbers or other marks with the space
    before them, and white space."""
    n = len(codes)
    begins = np.zeros(n, bool)
    if not n:
        return np.zeros(0, np.int64)
    kinds = classes()[codes]
    begins[1:] = kinds[1:] != kinds[:-1]
    cuts = offsets[offsets < n]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[n] = True
    begins[cuts] = True
    run = np.flatnonzero(begins)
    run_end = np.append(run[1:], n)
    blank = kinds[run] == SPACE
    start, end = run[blank], run_end[blank]
    inner = ~first[end]  # text of the same row follows
    start, end = start[inner], end[inner]
    begins[end[end - start > 1] - 1] = True
    begins[end[codes[end - 1] == 32]] = False
    lone = (kinds[run] == OTHER) & (run_end - run == 1) & (codes[run] == 39) & begins[run] & ~first[run_end]
    cut_contractions(codes, first, begins, run[lone])
    return np.flatnonzero(begins)


def cut_contractions(codes: np.ndarray, first: np.ndarray, begins: np.ndarray, marks: np.ndarray) -> None:
    """Where an apostrophe at `marks` starts 's 't 'm 'd 're 've or 'll, the piece is that. first: starts of rows, and the end."""
    if not len(marks):
        return
    n = len(codes)
    one = codes[marks + 1]
    more = ~first[marks + 2]
    two = np.where(more, codes[np.minimum(marks + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, size in ((marks[short], 2), (marks[long], 3)):
        begins[at + 1] = False
        after = at + size
        begins[after[after < n]] = True


class Known:
    """Open-addressing table from a 64-bit name to the row number under which its values are kept."""

    def __init__(self, bits: int = 16):
        self.n, self.mask = 0, np.uint64((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, names: np.ndarray) -> np.ndarray:
        slot = names & self.mask
        key = self.keys[slot]
        out = np.where(key == names, self.rows[slot], -1)
        open_ = np.flatnonzero((key != names) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            key = self.keys[slot[open_]]
            hit = key == names[open_]
            out[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, names: np.ndarray) -> None:
        """Distinct names that are not in the table get the next row numbers."""
        rows = np.arange(self.n, self.n + len(names), dtype=np.int32)
        self.n += len(names)
        if self.n * 2 > len(self.keys):
            used = self.keys != 0
            names, rows = np.concatenate([self.keys[used], names]), np.concatenate([self.rows[used], rows])
            bits = int(self.n * 4).bit_length()
            self.mask = np.uint64((1 << bits) - 1)
            self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        slot = names & self.mask
        while len(names):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = names[free]
            won = (self.keys[slot] == names) & free
            self.rows[slot[won]] = rows[won]
            names, rows, slot = names[~won], rows[~won], (slot[~won] + np.uint64(1)) & self.mask


class Ragged:
    """Rows of values, appended to and gathered in bulk."""

    def __init__(self, dtype):
        self.values, self.size = np.zeros(1 << 16, dtype), 0
        self.starts, self.lengths, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        while self.size + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.values[self.size : self.size + len(values)] = values
        self.starts[self.n : self.n + len(lengths)] = self.size + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.size += len(values)
        self.n += len(lengths)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[rows]
        return self.values[spread(self.starts[rows], lengths)], lengths


def cut_out(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, dict[int, int]]:
    """Rows cut at special strings: offsets of all parts, and for the start of each special string its id."""
    raw, found, more = data.tobytes() if special else b"", {}, []
    for at in (m.start() for m in re.finditer(b"|".join(re.escape(w) for w in special), raw)) if special else ():
        word = next(w for w in special if raw.startswith(w, at))
        if at + len(word) <= offsets[np.searchsorted(offsets, at, "right")]:
            found[at] = special[word]
            more += [at, at + len(word)]
    if not found:
        return offsets, found
    kept = offsets.tolist()
    return np.array(sorted(kept + list(set(more) - set(kept))), np.int64), found


class Encoder:
    """ids of rows of UTF-8 text, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.forget()

    def forget(self) -> None:
        self.known, self.ids = Known(), Ragged(np.uint32)

    def _learn(self, names: np.ndarray, words: list[str]) -> None:
        """Words of one space and letters stand side by side in a text as they stand alone; others are encoded one by one."""
        plain = [w[0] == " " and w[1:].isalpha() for w in words]
        order = [i for i, p in enumerate(plain) if p] + [i for i, p in enumerate(plain) if not p]
        n = sum(plain)
        ids, lengths = [], []
        for i in range(0, n, 256):
            got = self.library.encode("".join(words[k] for k in order[i : min(i + 256, n)]), add_special_tokens=False)
            size = np.bincount(np.array(got.word_ids, np.int64), minlength=min(256, n - i))
            if len(size) != min(256, n - i):  # the library cuts one of them otherwise
                alone = [self.library.encode(words[k], add_special_tokens=False).ids for k in order[i : min(i + 256, n)]]
                ids += [np.array(x, np.uint32) for x in alone]
                lengths += [len(x) for x in alone]
                continue
            ids.append(np.array(got.ids, np.uint32))
            lengths += size.tolist()
        for got in self.library.encode_batch_fast([words[k] for k in order[n:]], add_special_tokens=False):
            ids.append(np.array(got.ids, np.uint32))
            lengths.append(len(got.ids))
        self.ids.append(np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array(lengths, np.int64))
        self.known.add(names[order])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, and the n + 1 offsets of the rows among them."""
        inner, cuts = cut_out(data, offsets, self.special)
        if not cuts:
            return self._encode(data, offsets)
        ids, at = self._encode(data, inner)
        parts, lengths = [], []
        for i in range(len(inner) - 1):
            own = np.array([cuts[inner[i]]], np.uint32) if inner[i] in cuts and inner[i + 1] > inner[i] else ids[at[i] : at[i + 1]]
            parts.append(own)
            lengths.append(len(own))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return np.concatenate(parts), total[np.searchsorted(inner, offsets)]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.known.n > REMEMBERED:
            self.forget()
        codes, at, text = code_points(data, offsets)
        starts = pieces(codes, at)
        ends = np.append(starts[1:], len(codes))
        names = Rolling(codes).of(starts, ends)
        rows = self.known.find(names)
        new = np.flatnonzero(rows < 0)
        if len(new):
            distinct, first = np.unique(names[new], return_index=True)
            first = new[first]
            self._learn(distinct, [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            rows[new] = self.known.find(names[new])
        ids, lengths = self.ids.gather(rows)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has learnt serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
