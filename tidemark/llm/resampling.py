"""Target-distribution importance resampling over word tries.

Every task keeps a trie of the word runs of its texts: a node at depth one, two or three stands for a
run of so many words and holds how often it occurred and the CRC state of its text; a child's state is
its parent's, continued by a blank and one word, so no run is ever spelled out. A task folds its nodes'
counts into hashed buckets, the buckets of all tasks are added up in a tree, for the documents and for
the target alike, and every bucket gets a gain: the scaled logarithm of its share in the target over its
share in the documents. A second pass walks the same tries with gains attached to the nodes and sums
them along each document. Gumbel noise from the id makes the highest scores a draw without replacement
in proportion to the exponent of the weights; the limit of the draw is found by counting bins of scores,
and only the rows above it are sorted.

A node is told by its parent and its word's length and CRC, all that the states below it depend on, so
counts and gains are exact. A trie of more than ``MOST_NODES`` nodes is folded and begun anew: a task's
memory depends on neither its partition nor the corpus.

Defined cases: a null text has no words (no features, weight 0); texts without three words have the shorter
runs only; a null id takes part as the empty string in the noise and comes first among ties; rows equal in
id and score get neighbouring ranks in any order; an empty target or corpus counts as buckets of zero; no
row is drawn where the share of eligible rows is below one; other columns pass unread.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .ranking import kth_largest, numbered
from .shared import col, fresh, lean, tree_sum, written
from .textcore import ALNUM, LOWER, segments, utf8, word_spans
from .token_store import crc_shift

BUCKETS, DEPTH, MOST_NODES = 10_000, 3, 1 << 21
#: Words longer than this get their CRCs one by one.
LONG = 32
_CRC = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
_STEP = _CRC[np.arange(256) ^ 255] ^ np.uint32(0xFF000000)  # the reflected table: crc = table[(crc ^ byte) & 255] ^ crc >> 8
BLANK = zlib.crc32(b" ")


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes, one byte of all spans at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    short = left <= LONG
    first = int(len(left) - short.sum())
    for j in range(int(left[first]) if first < len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # so many spans are longer than j
        c = crc[first:n]
        crc[first:n] = _STEP[(c ^ data[at[first:n] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = ~crc
    for i in order[:first]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


class _Level:
    """Nodes of one depth: their sorted keys with the nodes' numbers, and states, counts and gains by number."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.states, self.counts, self.gains = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would stand, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        there[inside] = self.keys[at[inside]] == keys[inside]
        return at, there

    def grow(self, at: np.ndarray, keys: np.ndarray, states: np.ndarray, gains: np.ndarray | None) -> None:
        new = np.arange(len(self.states), len(self.states) + len(keys))
        self.keys, self.numbers = np.insert(self.keys, at, keys), np.insert(self.numbers, at, new)
        self.states, self.counts = np.concatenate([self.states, states]), np.concatenate([self.counts, np.zeros(len(keys), np.int64)])
        if gains is not None:
            self.gains = np.concatenate([self.gains, gains[states % len(gains)]])


class WordTrie:
    """Runs of one to three words. ``gains`` by bucket are attached to new nodes where they are given."""

    def __init__(self, gains: np.ndarray | None = None):
        self.given, self.levels, self.sizes = gains, [_Level() for _ in range(DEPTH)], np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(len(x.keys) for x in self.levels)

    def _enter(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """The node of every key at this depth, made where it is missing; each counts once for each key."""
        level = self.levels[depth]
        distinct, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        at, there = level.find(distinct)
        if not there.all():
            new = distinct[~there]
            if depth:
                word = (new & np.uint64(0xFFFFFFFF)).astype(np.int64)
                parent = self.levels[depth - 1].states[(new >> np.uint64(32)).astype(np.int64)]
                length = self.sizes[word]
                tail = crc_shift(np.full(len(new), BLANK, np.uint32), length) ^ self.levels[0].states[word]
                states = crc_shift(parent, length + 1) ^ tail
            else:
                states = (new & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                self.sizes = np.concatenate([self.sizes, (new >> np.uint64(32)).astype(np.int64)])
            level.grow(at[~there], new, states, self.given)
            at, _ = level.find(distinct)
        numbers = level.numbers[at]
        level.counts[numbers] += times
        return numbers[place]

    def walk(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Enter all runs of the words (length << 32 | CRC; ``rows`` are the n+1 offsets of the texts); the gains of the runs that begin at each word."""
        begin = np.zeros(len(words), np.int64)
        ends = np.repeat(rows[1:], np.diff(rows))
        place = np.arange(len(words))
        one = node = self._enter(0, words)
        for depth in range(DEPTH):
            if depth:
                longer = place + depth < ends
                node, place, ends = node[longer], place[longer], ends[longer]
                node = self._enter(depth, (node.astype(np.uint64) << np.uint64(32)) | one[place + depth].astype(np.uint64))
            if self.given is not None:
                begin[place] += self.levels[depth].gains[node]
        return begin

    def buckets(self, n: int) -> np.ndarray:
        """The nodes' counts, added up by their states modulo n."""
        out = np.zeros(n, np.int64)
        for x in self.levels:
            np.add.at(out, (x.states % np.uint32(n)).astype(np.int64), x.counts)
        return out


def _tries(column: pa.Array, trie: list, fold) -> list[tuple[np.ndarray, np.ndarray]]:
    """Walk a batch's texts in the task's trie (the list's one entry): words of each text and sums of gains; a trie that has grown too large is folded."""
    data, offsets = utf8(column)
    out = []
    for first, last in segments(offsets):
        part = LOWER[data[offsets[first] : offsets[last]]]
        texts = offsets[first : last + 1] - offsets[first]
        starts, ends = word_spans(part, texts[:-1], ALNUM)
        rows = np.searchsorted(starts, texts)
        words = ((ends - starts).astype(np.uint64) << np.uint64(32)) | span_crcs(part, starts, ends).astype(np.uint64)
        total = np.concatenate([[0], np.cumsum(trie[0].walk(words, rows))])
        out.append((np.diff(rows), total[rows[1:]] - total[rows[:-1]]))
        if len(trie[0]) > MOST_NODES:
            fold(trie[0])
            trie[0] = WordTrie(trie[0].given)
    return out


def bucket_totals(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of the texts fall in each bucket; a row of fixed size for each task is all that travels."""

    def partial(batches):
        total = np.zeros(buckets, np.int64)

        def fold(trie):
            total[:] += trie.buckets(buckets)

        trie = [WordTrie()]
        for b in batches:
            _tries(b.column(0), trie, fold)
        fold(trie[0])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    add = lambda parts: np.sum([np.frombuffer(p, np.int64) for p in parts], axis=0, dtype=np.int64).tobytes()
    found = tree_sum(texts.select(col(text_col).cast("string").alias("text")), partial, add).collect()
    return np.frombuffer(found[0]["sums"], np.int64) if found else np.zeros(buckets, np.int64)


def gains_of(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    n, all_docs, all_target = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_docs + n) / ((s + 1) * (all_target + n)))) for s, t in zip(docs.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _weights(docs: DataFrame, carried: list[str], text_col: str, gains: np.ndarray) -> tuple[DataFrame, list[str]]:
    """The carried columns with words, features and weight of every text, and those three names."""
    names = fresh(carried, "n_words", "n_features", "weight")
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(carried)], col(text_col).cast("string").alias("text"))
    kept = plain.columns[:-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.drop("text").schema)

    def run(batches):
        trie = [WordTrie(gains)]
        for b in batches:
            parts = _tries(b.column(len(kept)), trie, lambda _: None)
            n, w = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (([p[0] for p in parts]), ([p[1] for p in parts])))
            features = sum(np.maximum(n - i, 0) for i in range(DEPTH))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n), pa.array(features), pa.array(w)], names=[*kept, "n_words", "n_features", "weight"])

    out = plain.mapInArrow(lean(run), f"{fields}, n_words long, n_features long, weight long")
    return out.toDF(*carried, *names), names


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", carried: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Every document's carried columns (the id alone by default) with n_features, weight, score and rank (null: not drawn), and those four names."""
    gains = gains_of(bucket_totals(docs, text_col, buckets), bucket_totals(target, target_text, buckets))
    carried = carried or [id_col]
    rows, (n_words, n_features, weight) = _weights(docs, carried, text_col, gains)
    score, rank = fresh(rows.columns, "score", "rank")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(rows.withColumn(score, F.col(weight) + noise), "resample")
    eligible = F.col(n_words) >= least_words
    k = rows.filter(eligible).count() * percent // 100
    shown = [*[col(c) for c in carried], F.col(n_features), F.col(weight), F.col(score)]
    unranked = F.lit(None).cast("long").alias(rank)
    if not k:
        return rows.select(*shown, unranked), [n_features, weight, score, rank]
    near = eligible & (F.col(score) >= kth_largest(rows.filter(eligible), score, k))
    (one,) = fresh(rows.columns, "one")
    top, number = numbered(rows.filter(near).withColumn(one, F.lit(0)), one, [F.desc(score), col(id_col).asc_nulls_first()], "drawn")
    top = top.select(*shown, F.when(F.col(number) < k, F.col(number) + 1).cast("long").alias(rank))
    return rows.filter(~near).select(*shown, unranked).unionByName(top), [n_features, weight, score, rank]


def draw_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all their columns, with one more for the rank."""
    out, (*_, rank) = importance_resample(docs, target, carried=docs.columns, **options)
    return out.filter(F.col(rank).isNotNull()).select(*map(col, docs.columns), F.col(rank))


def op12_importance_resampling(spark, sf_dir):
    settle(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return importance_resample(read("documents"), read("benchmark"))[0]
