"""Exact token counts of whole texts by a compiled transducer.

``transducer.Transducer`` reads the bytes of a word and annotates every transition with the change
in emitted tokens. White space brings it to its start state from every state, so what a chunk of
text does from any entry state needs only its ends: ``StateMap`` holds the open word at the head
(read when the entry state is known), the tokens emitted in between and the open word at the tail,
which names the exit state. Maps compose associatively. Every text is cut into chunks of ``CHUNK``
bytes, anywhere, also inside a word or a character; each chunk becomes a map, and a tree-shaped scan
joins the maps of a text, over batch ends too, so no task ever holds more than a batch of chunks.

Words on which a byte lexer could differ from the library's pre-tokenizer (an apostrophe, a special
string, letters beyond Latin-1; see ``bpe.Codec.pieces``) are marked by the lexer and asked of the
library as a whole; all other counts are the automaton's own.

Defined cases: a null or empty text has no bytes and no tokens; texts of any length are read whole;
rows pass through one by one, so repeated ids stay; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .bpe import Codec, codec, tokenizer_path
from .shared import col, lean
from .textcore import WORD, segments, span_hashes, utf8
from .transducer import Transducer

CHUNK = 1 << 16
SEGMENT = 2 << 20
#: Counts of marked words that a worker remembers.
MOST_MARKED = 100_000


class StateMap(NamedTuple):
    """What a chunk does from any entry state: ``resets`` is false while it has no white space at all."""

    head: bytes
    emitted: int
    tail: bytes
    resets: bool


class TokenCounter:
    """Counts of words by the automaton; maps of chunks and their composition."""

    def __init__(self, automaton: Transducer, library: Codec):
        self.automaton, self.library = automaton, library
        self.marked: dict[bytes, int] = {}

    def asked(self, word: bytes) -> int:
        if word not in self.marked:
            if len(self.marked) >= MOST_MARKED:
                self.marked.clear()
            self.marked[word] = len(self.library.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return self.marked[word]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row of whole words."""
        data, offsets = utf8(column)
        out = [np.zeros(0, np.int64)]
        for first, last in segments(offsets, SEGMENT):
            rows = offsets[first : last + 1] - offsets[first]
            low, starts, ends, hard = self.library.pieces(data[offsets[first] : offsets[last]], rows[:-1])
            codes, found = pd.factorize(span_hashes(low, starts, ends) + hard.astype(np.uint64))
            at = np.zeros(len(found), np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw, emitted = low.tobytes(), self.automaton.emitted
            each = [self.asked(raw[a:b]) if marked else emitted(raw[a:b]) for a, b, marked in zip(starts[at].tolist(), ends[at].tolist(), hard[at].tolist(), strict=True)]
            total = np.concatenate([[0], np.cumsum(np.array(each, np.int64)[codes])]) if len(codes) else np.zeros(1, np.int64)
            place = np.searchsorted(starts, rows)
            out.append(total[place[1:]] - total[place[:-1]])
        return np.concatenate(out)

    def emitted(self, word: bytes) -> int:
        return int(self.counts(pa.array([word], pa.large_binary()))[0]) if word else 0

    def maps(self, chunks: list[bytes], firsts: list[bool], lasts: list[bool]) -> list[StateMap]:
        """The map of each chunk. A text's first chunk begins, and its last ends, at the start state: nothing is open there."""
        inner, ends = [], []
        for chunk, first, last in zip(chunks, firsts, lasts, strict=True):
            gaps = np.flatnonzero(~WORD[np.frombuffer(chunk, np.uint8)]) if not (first and last) else np.zeros(0, np.int64)
            a = 0 if first else int(gaps[0]) if len(gaps) else len(chunk)
            b = len(chunk) if last else int(gaps[-1]) + 1 if len(gaps) else 0
            resets = bool(len(gaps)) or (first and last)
            if not resets:  # one open word throughout
                a, b = (0, 0) if first else (len(chunk), len(chunk))
            inner.append(chunk[a:b])
            ends.append((chunk[:a], chunk[b:], resets or first))
        each = self.counts(pa.array(inner, pa.large_binary())).tolist()
        return [StateMap(head, n, tail, resets) for n, (head, tail, resets) in zip(each, ends, strict=True)]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.resets:
            return StateMap(a.head + b.head, b.emitted, b.tail, b.resets)
        if not b.resets:
            return StateMap(a.head, a.emitted, a.tail + b.head, True)
        return StateMap(a.head, a.emitted + self.emitted(a.tail + b.head) + b.emitted, b.tail, True)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed, neighbours first: each level halves their number."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def finish(self, m: StateMap) -> int:
        return self.emitted(m.head) + m.emitted + self.emitted(m.tail)

    def count(self, text: bytes, chunk: int = CHUNK) -> int:
        parts = [text[i : i + chunk] for i in range(0, max(len(text), 1), chunk)]
        return self.finish(self.scan(self.maps(parts, [i == 0 for i in range(len(parts))], [i == len(parts) - 1 for i in range(len(parts))])))


_counters: dict[str, TokenCounter] = {}


def counter(path: str, automaton: Transducer | None = None) -> TokenCounter:
    """The worker's counter for a tokenizer file; its states stay from task to task."""
    if path not in _counters:
        _counters[path] = TokenCounter(automaton or Transducer(path), codec(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; one pass, no shuffle."""
    automaton = docs.sparkSession.sparkContext.broadcast(Transducer(path))  # its size is the vocabulary's

    def run(batches):
        c, open_, size = None, [], 0  # the maps and bytes of a text that goes on
        for b in batches:
            c = c or counter(path, automaton.value)
            firsts, lasts = b.column(1).to_pylist(), b.column(2).to_pylist()
            if all(firsts) and all(lasts):
                n, tokens = np.diff(utf8(b.column(3))[1]), c.counts(b.column(3))
                done = np.arange(b.num_rows)
            else:
                chunks, sizes, totals, done = b.column(3).to_pylist(), [], [], []
                for i, (m, last) in enumerate(zip(c.maps(chunks, firsts, lasts), lasts, strict=True)):
                    open_.append(m)
                    size += len(chunks[i])
                    if last:
                        totals.append(c.finish(c.scan(open_)))
                        sizes.append(size)
                        done.append(i)
                        open_, size = [], 0
                open_ = [c.scan(open_)] if open_ else []
                n, tokens, done = (np.array(x, np.int64) for x in (sizes, totals, done))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(done)), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("body"))
    starts = body.select("id", "body", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("body") - 1, F.lit(0)), F.lit(chunk))).alias("at"))
    chunks = starts.select("id", (F.col("at") == 0).alias("first"), (F.col("at") + chunk >= F.octet_length("body")).alias("last"), F.substring("body", F.col("at") + 1, F.lit(chunk)).alias("chunk"))
    return chunks.mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir):
    return token_counts(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
