"""Class-based bigram language model: exchange clustering of words, class transitions, word emissions.

Counts of all training words are gathered by one aggregation that grows with the corpus. The start:
the most frequent words alone and all others by their ending, clustered on the driver. Then passes
of the exchange algorithm over every training word: its bigrams are counted by the class before and
after it, as one sparse row a word, and each word moves to the class of largest likelihood; a pass
that lowers the likelihood is not kept. P(word | previous) = P(class | previous class) P(word |
class), both smoothed.

Each text is encoded once as places of its words. Classes and counts of frequent words are broadcast
behind a fixed bound (``HEAD`` words); each text's rarer words are joined to their table by hash.

Defined cases: a null or empty text is its end token alone; a row with a null id is in training;
rows with equal ids are scored one by one; without training rows all base probabilities are 1;
unseen words get the smoothing mass in the class their ending started in; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .shared import drop_written, lean, tree_sum, written
from .textcore import LOWER, WORD, mix, segments, span_hashes, utf8, word_spans

#: The start of the clustering: words alone, groups of endings; then passes over all training words.
WORDS, ENDINGS, CLASSES, PASSES = 384, 256, 48, 2
#: Counts of at most so many words are broadcast.
HEAD = 500_000
#: The end token, as a word; its unit is 0.
END = 1
UNITS = 1 + WORDS + ENDINGS
DELTA = 0.3


def tokens(column: pa.Array):
    """For runs of rows: first, last, and of all tokens (an end after each row's words) hash and ending, and the n+1 token offsets of the rows."""
    data, offsets = utf8(column)
    for first, last in segments(offsets):
        low = LOWER[data[offsets[first] : offsets[last]]]
        rows = offsets[first : last + 1] - offsets[first]
        starts, ends = word_spans(low, rows[:-1], WORD)
        words = span_hashes(low, starts, ends).view(np.int64)
        tail = (mix(span_hashes(low, np.maximum(starts, ends - 3), ends)) % np.uint64(ENDINGS)).astype(np.int32)
        at = np.searchsorted(starts, rows) + np.arange(len(rows))
        n = int(at[-1])
        out, ending = np.full(n, END, np.int64), np.zeros(n, np.int32)
        word = np.ones(n, bool)
        word[at[1:] - 1] = False
        out[word], ending[word] = words, tail
        yield first, last, out, ending, at


def word_hash(word: str) -> int:
    return int(next(tokens(pa.array([word])))[2][0])


def exchange(bigrams: np.ndarray, classes: int, passes: int = 6) -> np.ndarray:
    """Classes of units by the exchange algorithm; unit 0 stays alone in class 0."""
    n_units = len(bigrams)
    total = bigrams.sum(1) + bigrams.sum(0)
    cls = np.zeros(n_units, np.int64)
    order = np.argsort(-total, kind="stable")
    order = order[order != 0]
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    to, frm = np.zeros((n_units, classes)), np.zeros((n_units, classes))  # counts of each unit before and after each class
    for c in range(classes):
        to[:, c] = bigrams[:, cls == c].sum(1)
        frm[:, c] = bigrams[cls == c].sum(0)
    g = np.array([[to[cls == a, b].sum() for b in range(classes)] for a in range(classes)])
    for _ in range(passes):
        moved = 0
        for u in order.tolist():
            if not total[u]:
                continue
            own, self_n = cls[u], bigrams[u, u]
            out_u, in_u = to[u].copy(), frm[u].copy()
            out_u[own] -= self_n
            in_u[own] -= self_n
            g[own] -= out_u
            g[:, own] -= in_u
            g[own, own] -= self_n
            rows, cols = g.sum(1), g.sum(0)
            # the likelihood's change if u joins class c: rows and columns of c gain u's counts
            base_row, base_col = f(g).sum(1), f(g).sum(0)
            gain = np.full(classes, -np.inf)
            for c in range(1, classes):
                row, col = g[c] + out_u, g[:, c] + in_u
                corner = g[c, c] + out_u[c] + in_u[c] + self_n
                row[c] = col[c] = corner
                gain[c] = f(row).sum() + f(col).sum() - f(corner) - (base_row[c] + base_col[c] - f(g[c, c])) - (f(rows[c] + out_u.sum() + self_n) - f(rows[c])) - (f(cols[c] + in_u.sum() + self_n) - f(cols[c]))
            best = int(np.argmax(gain)) if gain.max() > gain[own] + 1e-9 else own
            g[best] += out_u
            g[:, best] += in_u
            g[best, best] += self_n
            if best != own:
                moved += 1
                cls[u] = best
                to[:, own] -= bigrams[:, u]
                to[:, best] += bigrams[:, u]
                frm[:, own] -= bigrams[u]
                frm[:, best] += bigrams[u]
        if not moved:
            break
    return cls


def best_classes(g: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """One exchange step of many words against the same class bigrams: the class of largest likelihood for each.

    ``out`` and ``into`` count each word's bigrams with the class after and before it, ``same`` those with itself.
    A word is taken out of its own class first; class 0, the end token's, is neither left nor joined."""
    m, c = out.shape
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    every, out, into = np.arange(m), out.astype(float), into.astype(float)
    out[every, own] -= same
    into[every, own] -= same
    gain = np.zeros((m, c))
    for here, there, cells in ((out, into, g), (into, out, g.T)):
        word, d = np.nonzero(here)
        x, a = here[word, d], own[word]
        cell = cells.T[d].copy()  # one row for each entry: what each class has with class d
        left = d == a
        cell[left] -= there[word[left]]
        cell[np.arange(len(d)), a] -= x + np.where(left, same[word], 0)
        more = f(cell + x[:, None]) - f(cell)
        more[np.arange(len(d)), d] = 0  # the corner follows
        np.add.at(gain, word, more) if len(word) < 64 else _add_runs(gain, word, more)
    corner = np.broadcast_to(np.diag(g), (m, c)).copy()
    corner[every, own] -= out[every, own] + into[every, own] + same
    gain += f(corner + out + into + same[:, None]) - f(corner)
    for here, sums in ((out, g.sum(1)), (into, g.sum(0))):
        n = here.sum(1) + same
        total = np.broadcast_to(sums, (m, c)).copy()
        total[every, own] -= n
        gain -= f(total + n[:, None]) - f(total)
    gain[:, 0] = -np.inf
    best = np.argmax(gain, 1)
    return np.where((own > 0) & (gain[every, best] > gain[every, own] + 1e-9), best, own)


def _add_runs(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to ``total`` by the sorted places ``at``."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    total[at[first]] += np.add.reduceat(rows, first)


def likelihood(g: np.ndarray) -> float:
    """What of the training log likelihood depends on the classes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(g) - f(g.sum(1)) - f(g.sum(0))


def packed(words: np.ndarray, cls: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a word from entries sorted by word: its class and its counts by code, 16 bytes an entry."""
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    data = np.stack([codes.astype("<i8"), n.astype("<i8")], 1)
    narrow = bool((n < 1 << 24).all())
    data = (data[:, 0] | data[:, 1] << 8).astype("<u4") if narrow else data
    width = 4 if narrow else 16
    at = (np.append(first, len(words)) * width).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(words[first], pa.int64()), pa.array(cls[first].astype(np.int32)), pa.array(np.full(len(first), narrow)), blob], names=["word", "cls", "narrow", "counts"])


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, class, code and count of every entry of ``packed`` rows."""
    words, cls, narrow = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    blob = b.column(3).cast(pa.large_binary())
    at = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = np.frombuffer(blob.buffers()[2], np.uint8)[at[0] : at[-1]] if len(blob) else np.zeros(0, np.uint8)
    size = np.diff(at)
    entries = size // np.where(narrow, 4, 16)
    row = np.repeat(np.arange(len(words)), entries)
    byte = np.repeat(narrow, size)
    code, n = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    small = np.frombuffer(data[byte].tobytes(), "<u4").astype(np.int64)
    wide = np.frombuffer(data[~byte].tobytes(), "<i8").reshape(-1, 2)
    code[narrow[row]], n[narrow[row]] = small & 255, small >> 8
    code[~narrow[row]], n[~narrow[row]] = wide[:, 0], wide[:, 1]
    return words[row], cls[row], code, n


def summed(words: np.ndarray, cls: np.ndarray, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by word and code, sorted, with their counts summed."""
    order = np.lexsort((codes, words))
    words, cls, codes, n = words[order], cls[order], codes[order], n[order]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (codes[1:] != codes[:-1]))) if len(words) else np.zeros(0, np.int64)
    return words[first], cls[first], codes[first], np.add.reduceat(n, first) if len(first) else n


#: Tokens whose bigrams a task counts together before they travel.
GATHER = 1 << 20
SAME = 2 * CLASSES  # codes of a word's counts: class after, CLASSES + class before, itself after itself
ROWS = "word long, cls int, narrow boolean, counts binary"


class Heads:
    """What is broadcast of the most frequent words, sorted, and the class each ending starts in."""

    def __init__(self, words: np.ndarray, n: np.ndarray, cls: np.ndarray, of_ending: np.ndarray):
        self.words, self.n, self.cls, self.of_ending = words, n, cls, of_ending

    def read(self, b: pa.RecordBatch):
        """Of all tokens of encoded rows: word, class and count; and the n+1 token offsets of the rows."""
        seq, rare, ending, found = (b.column(b.schema.get_field_index(x)) for x in ("seq", "rare", "ending", "found"))
        data, offsets = utf8(seq)
        at = (offsets - offsets[0]) // 4
        place = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<i4").astype(np.int64) if len(seq) else np.zeros(0, np.int64)
        words = rare.flatten().to_numpy().astype(np.int64)
        tails, cuts = utf8(ending)
        slot_at = cuts - cuts[0]
        cls = self.of_ending[tails[cuts[0] : cuts[-1]].astype(np.int64)].copy()
        cls[words == END] = 0
        n = np.zeros(len(words), np.int64)
        hits = found.flatten()
        if len(hits):
            size = np.diff(found.offsets.to_numpy())
            size[found.is_null().to_numpy(zero_copy_only=False)] = 0
            slot = np.repeat(slot_at[:-1], size) + hits.field("slot").to_numpy()
            n[slot], cls[slot] = hits.field("n").to_numpy(), hits.field("cls").to_numpy()
        slots = np.repeat(slot_at[:-1], np.diff(at)) - 1 - place
        is_rare = place < 0
        out = [np.zeros(len(place), np.int64) for _ in range(3)]
        for got, of_head, of_rare in zip(out, (self.words, self.cls, self.n), (words, cls, n), strict=True):
            got[is_rare] = of_rare[slots[is_rare]]
            got[~is_rare] = of_head[place[~is_rare]]
        return *out, at


def before(at: np.ndarray) -> np.ndarray:
    """For every token the place of the one before it; each row's first follows its end token."""
    out = np.arange(-1, int(at[-1]) - 1)
    out[at[:-1]] = at[1:] - 1
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, report: list | None = None, model: dict | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows whose crc32(id) mod folds isn't ``held``.

    ``report`` gets the likelihood of the classes before and after each pass; ``model`` the model itself, for corpora
    that fit on the driver: class and count of every training word's hash, class bigrams, and ``start``, the class of an unseen word."""
    spark = docs.sparkSession
    out_of = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    train = docs.filter(~out_of).select(text_col)

    def count(batches):
        for b in batches:
            parts = []
            for _, _, words, ending, _ in tokens(b.column(0)):
                codes, found = pd.factorize(words)
                last = np.zeros(len(found), np.int32)
                last[codes] = ending
                parts.append((found, last, np.bincount(codes, minlength=len(found))))
            if parts:
                words, ending, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                codes, found = pd.factorize(words)
                last = np.zeros(len(found), np.int32)
                last[codes] = ending
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(last), pa.array(np.bincount(codes, n, len(found)).astype(np.int64))], names=["word", "ending", "n"])

    counts = written(train.mapInArrow(lean(count), "word long, ending int, n long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")), "lm-counts")
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).toPandas().sort_values("power")
    n, v = int(sizes["n"].sum()), int(sizes["v"].sum())
    above = sizes["v"][::-1].cumsum()[::-1]
    least = 1 << int(sizes["power"][above <= HEAD].min()) if (above <= HEAD).any() else 1 << 62
    frequent = counts.filter(F.col("n") >= least).toPandas().sort_values("word")  # at most HEAD rows
    head, head_n = frequent["word"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    no_end = frequent[frequent["word"] != END]
    top = no_end.sort_values(["n", "word"], ascending=[False, True]).head(WORDS)["word"].to_numpy(np.int64)
    unit = 1 + WORDS + frequent["ending"].to_numpy(np.int64)
    unit[np.searchsorted(head, top)] = 1 + np.arange(len(top))
    unit[head == END] = 0
    words_of = spark.sparkContext.broadcast(head)

    def encode(batches):
        heads = words_of.value
        for b in batches:
            for first, last, words, ending, at in tokens(b.column(2)):
                codes, found = pd.factorize(words)
                place = np.searchsorted(heads, found)
                place[place == len(heads)] = 0
                hit = heads[place] == found if len(heads) else np.zeros(len(found), bool)
                seq = place[codes]
                rare = np.flatnonzero(~hit[codes])
                row = np.searchsorted(at, rare, "right") - 1
                order = np.lexsort((words[rare], row))
                r, w = row[order], words[rare][order]
                new = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])) if len(r) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                lists = np.searchsorted(r[begin], np.arange(last - first + 1)).astype(np.int32)
                seq[rare[order]] = -1 - (np.cumsum(new) - 1 - lists[r])
                tails = ending[rare[order]][begin].astype(np.uint8)
                blob = lambda x, ends: pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0)[first:last], b.column(1)[first:last], blob(seq.astype("<i4"), at * 4), pa.ListArray.from_arrays(pa.array(lists), pa.array(w[begin], pa.int64())), blob(tails, lists)], names=[id_col, "held_out", "seq", "rare", "ending"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(docs.select(id_col, out_of.alias("held_out"), text_col).mapInArrow(lean(encode), f"`{id_col}` {kind}, held_out boolean, seq binary, rare array<long>, ending binary").withColumn("rid", F.monotonically_increasing_id()), "lm-rows")
    none = F.lit(None).cast("array<struct<slot:int,n:bigint,cls:int>>").alias("found")
    learn = rows.filter(~F.col("held_out")).select("seq", "rare", "ending", none)
    units_of = spark.sparkContext.broadcast(Heads(head, head_n, unit, 1 + WORDS + np.arange(ENDINGS)))

    def square(size, pairs, frame):
        """The sum of square count tables of fixed size, one row of sums a used table row."""

        def some(batches):
            total = np.zeros(size * size, np.int64)
            for b in batches:
                total += pairs(b)
            table = total.reshape(size, size)
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([table[i].astype("<i8").tobytes() for i in used.tolist()], pa.binary())], names=["slot", "sums"])

        table = np.zeros((size, size))
        for r in tree_sum(frame, some, lambda rows: np.sum([np.frombuffer(x, "<i8") for x in rows], axis=0).astype("<i8").tobytes()).collect():
            table[r["slot"]] = np.frombuffer(r["sums"], "<i8")
        return table

    def class_pairs(heads, size):
        def pairs(b):
            _, cls, _, at = heads.value.read(b)
            return np.bincount(cls[before(at)] * size + cls, minlength=size * size) if len(cls) else 0

        return pairs

    # the start: the most frequent words alone, all others with their ending, clustered on the driver
    start = exchange(square(UNITS, class_pairs(units_of, UNITS), learn), CLASSES)
    of_ending = start[1 + WORDS :]
    heads = spark.sparkContext.broadcast(Heads(head, head_n, start[unit], of_ending))
    place = F.when(F.col("word") == END, 0).otherwise(F.get(F.lit([int(x) for x in of_ending]), F.col("ending"))).cast("int")
    tail = counts.filter(F.col("n") < least).select("word", "n", place.alias("cls"))

    def resolved(frame, tail):
        """Encoded rows with the class and count of their rarer words."""
        slots = frame.select("rid", F.posexplode("rare").alias("slot", "word"))
        found = slots.join(tail, "word").groupBy("rid").agg(F.collect_list(F.struct("slot", "n", "cls")).alias("found"))
        return frame.join(found, "rid", "left")

    def vectors(heads):
        def counted(held):
            words, cls, prev = (np.concatenate(x) for x in zip(*held, strict=True))
            codes, found = pd.factorize(words)
            of = np.zeros(len(found), np.int64)
            of[codes] = cls
            same = words[prev] == words
            each, key = pd.factorize(np.concatenate([codes[prev] * 256 + cls, codes * 256 + CLASSES + cls[prev], codes[same] * 256 + SAME]))
            order = np.argsort(key)
            key, times = key[order], np.bincount(each, minlength=len(key))[order]
            w = key >> 8
            return packed(found[w], of[w], key & 255, times)

        def run(batches):
            held, n = [], 0
            for b in batches:
                words, cls, _, at = heads.value.read(b)
                held.append((words, cls, before(at) + n))
                n += len(words)
                if n >= GATHER:
                    yield counted(held)
                    held, n = [], 0
            if n:
                yield counted(held)

        return run

    def merge(batches):
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            held = summed(*(np.concatenate(x) for x in zip(held, unpacked(b), strict=True)))
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on
                yield packed(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        yield packed(*held)

    def of_words(b):
        _, cls, code, times = unpacked(b)
        after = code < CLASSES
        return np.bincount(cls[after] * CLASSES + code[after], times[after], CLASSES * CLASSES).astype(np.int64)

    def moves(g):
        def run(batches):
            for b in batches:
                words, cls, code, times = unpacked(b)
                first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
                bounds = np.append(first, len(words))
                for lo in range(0, len(first), 4096):
                    hi = min(lo + 4096, len(first))
                    part = slice(bounds[lo], bounds[hi])
                    row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                    dense = np.zeros((hi - lo, SAME + 1))
                    dense[row, code[part]] = times[part]
                    own = cls[bounds[lo:hi]].astype(np.int64)
                    best = best_classes(g, own, dense[:, :CLASSES], dense[:, CLASSES:SAME], dense[:, SAME])
                    yield pa.RecordBatch.from_arrays([pa.array(words[bounds[lo:hi]]), pa.array(dense[:, :CLASSES].sum(1).astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "n", "cls"])

        return run

    fit = rows.filter(~F.col("held_out")).select("rid", "seq", "rare", "ending")
    whole = None
    kept = None  # the best classes so far: their bigrams, head classes, and the rest as a table
    for step in range(PASSES + 1):
        if step == PASSES:  # all rows: what the last pass gives is scored as it is read here
            whole = written(resolved(rows, tail), "lm-resolved")
            frame = whole.filter(~F.col("held_out"))
        else:  # the start's classes follow from the endings; written, so that the shuffles before and after it don't add up
            frame = written(resolved(fit, tail).drop("rid"), "lm-resolved") if step else learn
        if step < PASSES:
            vec = written(frame.mapInArrow(lean(vectors(heads)), ROWS).repartition("word").sortWithinPartitions("word").mapInArrow(lean(merge), ROWS), "lm-vectors")
            g = square(CLASSES, of_words, vec)
        else:
            g = square(CLASSES, class_pairs(heads, CLASSES), frame)
        if report is not None:
            report.append(likelihood(g))
        worse = kept is not None and likelihood(g) < likelihood(kept[0])
        if not worse:
            kept = (g, heads, tail)
        if step < PASSES and not worse:
            moved = written(vec.mapInArrow(lean(moves(g)), "word long, n long, cls int"), "lm-classes")
            cls = moved.filter(F.col("n") >= least).select("word", "cls").toPandas().sort_values("word")["cls"].to_numpy(np.int64)
            heads, tail = spark.sparkContext.broadcast(Heads(head, head_n, cls, of_ending)), moved.filter(F.col("n") < least)
        if step < PASSES:
            drop_written(vec, *([frame] if step else []))
        if worse:
            break
    g, heads, tail = kept
    if model is not None:
        rest = tail.toPandas()
        model |= {"cls": dict(zip(head.tolist(), heads.value.cls.tolist())) | dict(zip(rest["word"].tolist(), rest["cls"].tolist())), "count": dict(zip(head.tolist(), head_n.tolist())) | dict(zip(rest["word"].tolist(), rest["n"].tolist())), "bigrams": g, "start": lambda word: int(of_ending[next(tokens(pa.array([word])))[3][0]])}
    by_class = tail.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    n_class = np.bincount(heads.value.cls, head_n, CLASSES) + np.bincount(by_class["cls"].to_numpy(np.int64), by_class["n"].to_numpy(float), CLASSES)
    v_class = np.bincount(heads.value.cls, minlength=CLASSES) + np.bincount(by_class["cls"].to_numpy(np.int64), by_class["v"].to_numpy(float), CLASSES)
    share = (n_class + 1) / (n_class.sum() + CLASSES)
    log_to = np.log10((g + 5 * share) / (g.sum(1, keepdims=True) + 5))
    log_den = np.log10(n_class + DELTA * (v_class + 1))

    def score(batches):
        den = np.log10(n + v + 1)
        for b in batches:
            _, cls, times, at = heads.value.read(b)
            logs = log_to[cls[before(at)], cls] + np.log10(times + DELTA) - log_den[cls]
            base, known = np.log10(times + 1) - den, (times > 0).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (base, logs, known)]
            base, logs, known = (s[at[1:]] - s[at[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at), pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(b.num_rows, n), pa.int64()), pa.array(base), pa.array(logs)],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    if whole is not None and worse:  # it has classes that aren't kept
        drop_written(whole)
        whole = None
    scored = resolved(rows, tail) if whole is None else whole
    return scored.select(id_col, "held_out", "seq", "rare", "ending", "found").mapInArrow(
        lean(score), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_class_lm(spark, sf_dir):
    return score_texts(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"))
