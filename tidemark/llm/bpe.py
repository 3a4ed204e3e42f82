"""Exact token ids of whole texts, learnt piece by piece from the tokenizers library.

The lexer works on whole Arrow buffers: classes of bytes give the places where the library's
pre-tokenizer cuts (letter runs, single digits, runs of other signs; white space is dropped).
Each distinct piece is given to the library's model once per worker; its ids are remembered.
Words on which a byte lexer could differ from the library (an apostrophe, a special string,
letters beyond Latin-1) go to the library as a whole, so normalisation and contractions are its own.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from .textcore import LOWER, WORD, segments, span_hashes, utf8

#: Pieces remembered per Python worker; beyond it the memory is emptied and pieces are asked for again.
MEMO_PIECES = 500_000
SEGMENT = 2 << 20


def byte_alphabet() -> list[str]:
    """The printable sign that byte-level BPE gives each byte: itself where printable in Latin-1, else 256 and up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


_CLASS = np.full(256, 3, np.uint8)
_CLASS[~WORD] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 4
#: ASCII control signs that may count as white space or be cleaned elsewhere are left to the library.
_CLASS[[*range(0, 9), *range(14, 32), 127]] = 4


class Codec:
    """Ids of words under a lower-casing, word-end BPE tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.known, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of pieces, and their numbers
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _ask(self, piece: bytes, hard: bool) -> list[int]:
        if hard:
            return self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        text = piece.decode("ascii") if piece.isascii() else "".join(map(self.signs.__getitem__, piece))
        return [t.id for t in self.model.tokenize(text)]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], hard: np.ndarray) -> None:
        n = len(self.known)
        if n + len(pieces) + 1 >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(n + len(pieces) + 2, np.int64)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.numbers = np.insert(self.known, at, hashes[order]), np.insert(self.numbers, at, n + order)
        for p, is_hard in zip(pieces, hard.tolist(), strict=True):
            got = self._ask(p, is_hard)
            if self.used + len(got) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(got), len(self.ids)), np.uint32)])
            self.ids[self.used : self.used + len(got)] = got
            self.used += len(got)
            n += 1
            self.starts[n] = self.used

    def pieces(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, starts and ends of the pieces, and which of them the library must split itself."""
        n = len(data)
        low, cls = LOWER[data], _CLASS[data]
        lead = np.zeros(n, bool)
        if n and (data >= 128).any():
            lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            after = np.zeros(n, bool)
            after[1:] = lead[:-1]
            cls[lead | after] = 1
            low[after & (data < 0x9F)] += 0x20
        odd = (cls == 4) | (data == 0x27)
        if n > 1:
            odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        cut = np.zeros(n + 1, bool)
        cut[rows] = True
        cut[n] = True
        if odd.any():
            word_start = (cls != 0)
            word_start[1:] &= (cls[:-1] == 0) | cut[1:-1]
            s = np.flatnonzero(word_start)
            number = np.cumsum(word_start) - 1
            hard_word = np.zeros(len(s), bool)
            hard_word[number[odd]] = True
            inside = hard_word[np.maximum(number, 0)] & (cls != 0) if len(s) else np.zeros(n, bool)
            cls = np.where(inside, 5, cls)
            low = np.where(inside, data, low)
        begin = cls != 0
        begin[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == 2) | cut[1:-1]
        end = cls != 0
        end[:-1] &= (cls[1:] != cls[:-1]) | (cls[1:] == 2) | cut[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return low, starts, ends, cls[starts] == 5

    def lookup(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memo numbers of all pieces in order, and the n+1 piece offsets of the rows."""
        low, starts, ends, hard = self.pieces(data, rows[:-1])
        hashes = span_hashes(low, starts, ends) + hard.astype(np.uint64)
        codes, found = pd.factorize(hashes)
        if len(self.known) + len(found) > MEMO_PIECES:
            self.forget()
        numbers = np.full(len(found), -1, np.int64)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            hit = self.known[place] == found
            numbers[hit] = self.numbers[place[hit]]
        new = np.flatnonzero(numbers < 0)
        if len(new):
            first = np.full(len(found), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            raw = low.tobytes()
            base = len(self.known)
            self._learn(found[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], hard[at])
            numbers[new] = np.arange(base, base + len(new))
        return numbers[codes], np.searchsorted(starts, rows)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        return np.concatenate([np.zeros(0, np.int64), *(c for c in self._counts(column))])

    def _counts(self, column: pa.Array):
        data, offsets = utf8(column)
        for first, last in segments(offsets, SEGMENT):
            rows = offsets[first : last + 1] - offsets[first]
            numbers, at = self.lookup(data[offsets[first] : offsets[last]], rows)
            total = np.concatenate([[0], np.cumsum(self.starts[numbers + 1] - self.starts[numbers])])
            yield total[at[1:]] - total[at[:-1]]

    def encode(self, column: pa.Array, most: int = SEGMENT):
        """For runs of rows with about ``most`` bytes: first, last, all their ids (uint32), and the n+1 id offsets of the rows."""
        data, offsets = utf8(column)
        for first, last in segments(offsets, most):
            rows = offsets[first : last + 1] - offsets[first]
            numbers, at = self.lookup(data[offsets[first] : offsets[last]], rows)
            begin = self.starts[numbers]
            length = self.starts[numbers + 1] - begin
            total = np.concatenate([[0], np.cumsum(length)])
            ids = self.ids[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
            yield first, last, ids, total[at]


_codecs: dict[str, Codec] = {}
#: Tasks that this worker has ended since it last asked for a codec.
_idle = 0


def task_ended() -> None:
    """Called after each task: a worker that goes on to other work gives its codecs up."""
    global _idle
    _idle += 1
    if _idle > 1:
        _codecs.clear()


def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file; kept for the next task."""
    global _idle
    _idle = 0
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
