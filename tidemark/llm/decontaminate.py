"""Benchmark decontamination through CGK embedding and bit-sampling LSH.

A random walk reads a window of words: at step j it puts out the word at its place and moves on
by a random bit of (j, word). Windows at a small edit distance then agree at most steps, so a few
sampled steps agree with good chance. How many independent walks reach the target recall follows
from simulated windows with as many edits as the similarity allows (``repeats_for``), for each
width. Items are embedded from every offset that leaves a window, texts at every ``width / 4``
words, so four windows of a text at least lie within every occurrence of an item. Windows have the
largest power of two of words that fits the item so, up to ``WIDEST``: edits in long windows lead
walks apart for good, while a long item has many short windows. Windows of a text with too few of
the items' words for any match aren't walked. Candidates are verified exactly, by the word edit
distance between the whole item and stretches of the text around it. A place is the best stretch
of each run of neighbouring ends that are within the allowed distance; all places are reported.

Texts are read whole, without a shuffle; items are broadcast in blocks of at most ``BLOCK_WORDS``
words, one block at a time: where there are several, each block's result is written and its
broadcast freed before the next, at the price of reading the texts again.

Defined cases: null or empty texts and items match nothing; a word is a run of letters and digits
(A-Z lower-cased, bytes from 128 up count as letters); equal rows give equal hits; an item shorter
than four words needs an exact match; a null id is carried as null; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .shared import col, drop_written, lean, map_rows, written
from .textcore import ALNUM, hashed_words, mix

#: The share of occurrences at the limit of similarity that candidates must catch; sampled steps of each walk; the widest window; simulated occurrences.
RECALL, SAMPLED, WIDEST, TRIALS = 0.99, 3, 16, 1000
#: Places of the table that tells which words an item has; a clash only lets a candidate through to verification.
BAG = 1 << 22
BLOCK_WORDS = 500_000


def shortest(w: int) -> int:
    """Words of the shortest item with windows of w words: it holds four window starts of a text wherever they fall."""
    return 2 * w - 1


def widths(m: int) -> int:
    """The window of an item of m words."""
    w = 1
    while w < WIDEST and shortest(2 * w) <= m:
        w *= 2
    return w


@functools.cache
def repeats_for(w: int, share: float, sampled: int, recall: float, most: int = 96) -> int:
    """How many walks find the target share of items with windows of w words: of the shortest such items with as many
    random edits as allowed, counted over ``TRIALS`` simulated occurrences of each length. ``most`` if that isn't enough."""
    rng = np.random.default_rng(w)
    allowed = lambda m: int(share * m) if m >= 4 else 0
    sizes = range(shortest(w), shortest(2 * w))
    steps = sampled_steps(w, most, sampled)
    worst = 1
    for m in sorted({allowed(m): m for m in reversed(sizes)}.values())[:3]:  # the shortest items for each number of edits: longer ones have more windows
        a, b, x, y, trial = [], [], [], [], []
        for t in range(TRIALS if allowed(m) else 1):
            item = rng.integers(1, 1 << 62, m).tolist()
            text = list(zip(item, range(m)))  # words, and the place in the item that a window from here goes with
            for _ in range(allowed(m)):
                at, kind, new = int(rng.integers(0, len(text))), int(rng.integers(0, 3)), int(rng.integers(1, 1 << 62))
                if kind == 0:
                    text[at] = (new, text[at][1])
                elif kind == 1:
                    text.insert(at, (new, text[at][1]))
                else:
                    del text[at]
            stride = max(1, w // 4)
            for i in range(int(rng.integers(0, stride)), len(text), stride):  # where the text's windows happen to fall
                if text[i][1] + w <= m:
                    x.append(len(a) + text[i][1])
                    y.append(len(b) + i)
                    trial.append(t)
            a += item + rng.integers(1, 1 << 62, 2 * w + 2).tolist()
            b += [word for word, _ in text] + rng.integers(1, 1 << 62, 2 * w + 2).tolist()
        a, b, x, y, trial = np.array(a, np.uint64), np.array(b, np.uint64), np.array(x), np.array(y), np.array(trial)
        first = np.full(t + 1, most)
        for r in reversed(range(most)):
            bits_a, bits_b, u, v, step, same = walk_bits(a, r), walk_bits(b, r), x, y, 0, np.ones(len(x), bool)
            for q in steps[r].tolist():
                u, v, step = walk(bits_a, u, step, q), walk(bits_b, v, step, q), q
                same &= a[u] == b[v]
            first[trial[same]] = r
        worst = max(worst, next((n for n in range(1, most) if (first < n).mean() >= recall), most))
    return worst


def sampled_steps(w: int, repeats: int, sampled: int) -> np.ndarray:
    """For each repeat the steps, ascending, whose output makes the key: within 1.5 times the width, so that the walk mostly stays inside."""
    rng = np.random.default_rng(1000 + w)
    most = max(1, w + w // 2)
    return np.sort(np.array([rng.choice(most, min(sampled, most), replace=False) for _ in range(repeats)]), axis=1)


def walk(bits: np.ndarray, place: np.ndarray, step: int, to: int) -> np.ndarray:
    """Places after walking from ``step`` to ``to``; ``bits`` has 64 steps for each word, more than any walk takes."""
    for j in range(step, to):
        place = place + ((bits[place] >> np.uint64(j)) & np.uint64(1)).astype(place.dtype)
    return place


def walk_bits(words: np.ndarray, repeat: int) -> np.ndarray:
    return mix(words + np.uint64((1 + repeat) * 0x9E3779B97F4A7C15 % (1 << 64)))


class ItemBlock:
    """Embedded items: for each width and repeat, the keys of all item windows."""

    def __init__(self, ids: list, words: list[np.ndarray], recall: float, sampled: int, share: float):
        self.ids, self.words, self.share = ids, words, share
        self.edits = [int(share * len(w)) if len(w) >= 4 else 0 for w in words]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(flat)
        self.sizes, self.most = np.array([len(w) for w in words], np.int64), np.array(self.edits, np.int64)
        self.bag = np.zeros(BAG, bool)
        for i, w in enumerate(words):
            self.bag[self.bag_place(np.int64(i), self.symbols(w))] = True
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w):
                by.setdefault(widths(len(w)), []).append(i)
        self.classes = {}
        for w, members in sorted(by.items()):
            repeats = repeats_for(w, share, sampled, recall)
            steps, tables = sampled_steps(w, repeats, sampled), []
            pad = np.zeros(2 * w + 2, np.uint64)
            text = np.concatenate([np.concatenate([words[i], pad]) for i in members])
            begin = np.cumsum([0, *(len(words[i]) + len(pad) for i in members)])[:-1]
            starts = [b + np.arange(len(words[i]) - w + 1) for b, i in zip(begin, members, strict=True)]
            of = np.repeat(members, [len(s) for s in starts])
            offset = np.concatenate([np.arange(len(s)) for s in starts])
            start = np.concatenate(starts)
            symbols = self.symbols(text)
            for r in range(repeats):
                keys = self.keys(walk_bits(text, r), symbols, start, steps[r])
                alive = (keys[:, -1] >= 0)
                order = np.argsort(keys[alive, -1], kind="stable")
                tables.append(([np.unique(keys[alive, q]) for q in range(keys.shape[1])], keys[alive, -1][order], of[alive][order], offset[alive][order]))
            self.classes[w] = (steps, tables)
        self.repeats = max((len(t) for _, t in self.classes.values()), default=0)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the items' vocabulary, from 1; 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def keys(self, bits: np.ndarray, symbols: np.ndarray, start: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The growing key after each sampled step; -1 once an output isn't an item's word."""
        out = np.full((len(start), len(steps)), -1, np.int64)
        place, step, key = start.copy(), 0, np.zeros(len(start), np.int64)
        for q, s in enumerate(steps.tolist()):
            place, step = walk(bits, place, step, s), s
            got = symbols[place]
            key = np.where((key >= 0) & (got > 0), key * (len(self.vocabulary) + 1) + got, -1)
            out[:, q] = key
        return out

    @staticmethod
    def bag_place(item, symbol: np.ndarray) -> np.ndarray:
        return (mix(np.asarray(item, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + symbol.astype(np.uint64)) & np.uint64(BAG - 1)).astype(np.int64)

    def plausible(self, found: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Candidates around whose place enough words are the item's: each unedited word of the item is one of them."""
        row, item, place = found.T
        m, most = self.sizes[item], self.most[item]
        lo = at[row] + np.maximum(place - 2 * most - 1, 0)
        hi = np.minimum(at[row + 1], at[row] + place + m + 2 * most + 1)
        seen = np.zeros(len(found), np.int64)
        for j in range(int((hi - lo).max(initial=0))):
            on = np.flatnonzero(lo + j < hi)
            s = symbols[lo[on] + j]
            seen[on] += self.bag[self.bag_place(item[on], s)] & (s > 0)
        return found[seen >= m - most]

    def windows(self, w: int, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of the windows of w words that can be part of an occurrence.

        An occurrence of a short item has all its edits in the window at worst; a long item has a window with at most
        its share and half as much again."""
        length, stride = np.diff(at), max(1, w // 4)
        n = np.maximum((length - w) // stride + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        start = at[:-1][row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        known = np.concatenate([[0], np.cumsum(symbols > 0)])
        near = known[start + w] - known[start] >= w - int(1.5 * self.share * w) - 1
        return row[near], start[near]

    def candidates(self, words: np.ndarray, at: np.ndarray):
        """(row, item, place of the item's first word) of all key matches; rows have their words at ``at``."""
        text = np.concatenate([words, np.zeros(2 * WIDEST + 2, np.uint64)])
        symbols = self.symbols(text)
        found = []
        windows = {w: self.windows(w, symbols, at) for w in self.classes}
        for r in range(self.repeats):
            bits = walk_bits(text, r)
            for w, (steps, tables) in self.classes.items():
                if r >= len(tables):
                    continue
                row, start = windows[w]
                known, keys, of, offset = tables[r]
                first = np.zeros(len(self.vocabulary) + 1, bool)
                first[known[0]] = True
                first[0] = False
                place, step = start, 0
                alive, key = np.arange(len(start)), None
                for q, s in enumerate(steps[r].tolist()):
                    place, step = walk(bits, place, step, s), s
                    got = symbols[place]
                    if q == 0:
                        keep = first[got]
                        key = got
                    else:
                        key = key * (len(self.vocabulary) + 1) + got
                        near = np.searchsorted(known[q], key)
                        near[near == len(known[q])] = 0
                        keep = (known[q][near] == key) & (got > 0) if len(known[q]) else np.zeros(len(key), bool)
                    alive, place, key = alive[keep], place[keep], key[keep]
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                many = hi - lo
                pick = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                window = np.repeat(alive, many)
                found.append(np.column_stack([row[window], of[pick], start[window] - offset[pick] - at[:-1][row[window]]]))
        if not found:
            return np.zeros((0, 3), np.int64)
        every = np.concatenate(found)
        every = every[np.lexsort(every.T[::-1])]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        return self.plausible(every[new], symbols, at)


def distances(item: list[int], text: list[int], whole: bool = False) -> list[int]:
    """For each end in the text the smallest edit distance of the item to a stretch that ends there (``whole``: to all of the text up to there). Bit-parallel, for any length."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << i
    pv, mv, score, out = full, 0, m, []
    for x in text:
        eq = masks.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | whole) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def occurrences(item: list[int], text: list[int], most: int) -> list[tuple[int, int, int]]:
    """(first word, end, edits) of every place: of each run of neighbouring ends within ``most`` edits the first best, with its nearest best start."""
    scores, out, run = distances(item, text), [], []
    for j, d in enumerate([*scores, most + 1]):
        if d <= most:
            run.append((d, j))
        elif run:
            d, end = min(run)
            back = distances(item[::-1], text[max(0, end + 1 - len(item) - most) : end + 1][::-1], whole=True)
            start = end - min(range(len(back)), key=lambda k: (back[k], k))
            out.append((start, end + 1, d))
            run = []
    return out


def item_blocks(benchmark: DataFrame, similarity: float, recall: float, sampled: int):
    """How many blocks of bounded size the items make, and the blocks, each broadcast when it is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = int(total // (2 * BLOCK_WORDS)) + 1  # a word has a letter and a gap at least

    def each():
        for k in range(blocks):
            part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas().drop_duplicates().sort_values("item_id")
            words = [np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in hashed_words(pa.array([t]), ALNUM))]) for t in part["text"]]
            yield spark.sparkContext.broadcast(ItemBlock(part["item_id"].tolist(), words, recall, sampled, 1 - similarity + 1e-9))

    return blocks, each()


def find(b: ItemBlock, column: pa.Array) -> list[tuple]:
    """(row, item, first word, end, edits) of all places in a column of texts: candidates of an item close together are verified as one region."""
    hits: set[tuple] = set()
    for first, _, words, at in hashed_words(column, ALNUM):
        region: list | None = None
        found = b.candidates(words, at).tolist()
        for row, i, place in [*found, (-1, -1, 0)]:
            m, most = (len(b.words[i]), b.edits[i]) if i >= 0 else (0, 0)
            lo, hi = place - 3 * most - 2, place + m + 3 * most + 2
            if region and region[:2] == [row, i] and lo <= region[3]:
                region[3] = max(region[3], hi)
                continue
            if region:
                r, k, x, y = region
                text = words[at[r] : at[r + 1]]
                x = max(x, 0)
                for s, e, d in occurrences(b.words[k].tolist(), text[x:y].tolist(), b.edits[k]):
                    hits.add((first + r, k, x + s, x + e, d))
            region = [row, i, lo, hi]
    return sorted(hits)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, sampled: int = SAMPLED) -> DataFrame:
    """One row for each item found at a place of a document: id, item_id, first_word, n_words, edits, similarity (1 - edits / item words)."""
    rows = docs.select(col(id_col), col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    out = None
    blocks, each = item_blocks(benchmark, similarity, recall, sampled)
    for block in each:

        def run(batches, block=block):
            b = block.value
            for batch in batches:
                hits = find(b, batch.column(1))
                r, i, s, e, d = zip(*hits, strict=True) if hits else [()] * 5
                m = np.array([len(b.words[x]) for x in i], float)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), pa.array([b.ids[x] for x in i], pa.int64()), pa.array(s, pa.int64()), pa.array(np.subtract(e, s), pa.int64()), pa.array(d, pa.int64()), pa.array(1 - np.array(d, float) / np.maximum(m, 1))], names=[id_col, "item_id", "first_word", "n_words", "edits", "similarity"])

        found = rows.mapInArrow(lean(run), f"`{id_col}` {kind}, item_id long, first_word long, n_words long, edits long, similarity double")
        if blocks > 1:
            found = written(found, "contaminated")
            block.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_col: str = "text", recall: float = RECALL, sampled: int = SAMPLED) -> DataFrame:
    """The documents that hold no item, all columns; no shuffle."""
    blocks, each = item_blocks(benchmark, similarity, recall, sampled)
    before, at = None, docs.columns.index(text_col)
    for block in each:

        def run(batches, block=block):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in find(block.value, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = map_rows(docs, run)
        if blocks > 1:
            docs = written(docs, "clean")
            block.destroy()
            if before is not None:
                drop_written(before)
            before = docs
    return docs


def op9_decontamination(spark, sf_dir):
    return contaminated(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
