"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows (at most ``max_labelled`` rows and ``max_postings`` different words
of rows together, both in the order of a hash of the id) are the examples. Every word of every
example is a term; none is selected. A term's weight is 1 + ln(count) times its inverse document
frequency. By default that is delta TF-IDF (Martineau and Finin 2009): the distance between the
term's inverse document frequencies among examples of either label, so that words which both kinds
share weigh little; ``delta=False`` takes the plain inverse document frequency.

The examples stand in an inverted index in blocks of ``BLOCK``; postings lie by term and block, and
each (term, block) cell knows its largest weight. A query's terms are read in waves: rarer terms,
largest bound first, and at last the frequent ones (in more than one example in ``FREQUENT``), whose
cells are kept dense, as counts and in single precision for a first look. After each wave the k-th best cosine so far rules out every block
whose best partial cosine plus the maxima of its unread cells stays below it, and in the last wave
every example by itself; what is ruled out is never read. The rest is read whole, so the k nearest
and their cosines are exact. Votes weigh by distance; isotonic regression on a fold that is not in
the index turns them into probabilities. The nearest examples and their cosines are the evidence.

Defined cases: a null or empty text, or one without any word of the examples, has no neighbours and
gets the calibrated share of label 1 among the examples; words that no example has don't count;
equal cosines rank by example id; without labels of both kinds every score is the share of label 1
(0 without labels); repeated rows are scored one by one; ids are numbers (others, like nulls, are
held in and never learnt from); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .quality import bounded_sample, pav
from .shared import lean, map_rows, tidy, written
from .textcore import ALNUM, LOWER, segments, span_hashes, utf8, word_spans

BLOCK, FREQUENT = 64, 32
#: Postings of rarer terms after which the bounds are looked at for the first time.
FIRST_WAVE = 6_000
_LOGS = np.concatenate([[0.0], 1 + np.log(np.arange(1, 1 << 16))])


def term_counts(column: pa.Array, vocabulary: np.ndarray | None = None):
    """For runs of rows: first, last, and for their (row, term) pairs the row, the term (its place in the sorted vocabulary, or its hash) and the count."""
    data, offsets = utf8(column)
    for first, last in segments(offsets):
        low = LOWER[data[offsets[first] : offsets[last]]]
        rows = offsets[first : last + 1] - offsets[first]
        starts, ends = word_spans(low, rows[:-1], ALNUM)
        of, words = np.searchsorted(rows, starts, "right") - 1, span_hashes(low, starts, ends)
        if vocabulary is not None:
            place = np.searchsorted(vocabulary, words)
            place[place == len(vocabulary)] = 0
            hit = vocabulary[place] == words if len(vocabulary) else np.zeros(len(words), bool)
            of, words = of[hit], place[hit]
        order = np.lexsort((words, of))
        of, words = of[order], words[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (words[1:] != words[:-1])
        begin = np.flatnonzero(new)
        yield first, last, of[begin], words[begin], np.diff(np.append(begin, len(of)))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def inverse_frequency(df: np.ndarray, positive: np.ndarray, n: int, n_positive: int, delta: bool) -> np.ndarray:
    """The weight of terms that stand in ``df`` of n examples, ``positive`` of them with label 1 (of ``n_positive``)."""
    if not delta:
        return np.log((1 + n) / (1 + df)) + 1
    return np.abs(np.log((n_positive + 1) / (positive + 1)) - np.log((n - n_positive + 1) / (df - positive + 1)))


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors, in blocks: cells of a term and a block hold postings and know their maximum."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.terms, self.idf, self.ids, self.labels = terms, idf, ids, labels
        self.blocks = max(1, -(-len(ids) // BLOCK))
        self.read = self.all = 0  # postings, for tests
        self.buffer: np.ndarray | None = None

    def weigh(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt(np.bincount(rows, w * w, minlength=n))
        return np.divide(w, norm[rows], out=np.zeros(len(w)), where=norm[rows] > 0)

    def load(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Take the examples' (row, term, count) pairs."""
        n, v = len(self.ids), len(self.terms)
        w = self.weigh(rows, terms, counts, n)
        raw = (1 + np.log(counts)) * self.idf[terms]
        size = np.sqrt(np.bincount(rows, raw * raw, minlength=n))
        self.inverse_norm = np.zeros(self.blocks * BLOCK)
        self.inverse_norm[:n] = np.divide(1, size, out=np.zeros(n), where=size > 0)
        largest = np.zeros(v)
        np.maximum.at(largest, terms, counts)
        often = (np.bincount(terms, minlength=v) > n / FREQUENT) & (largest < len(_LOGS))
        self.dense = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.counts = np.zeros((int(often.sum()), self.blocks * BLOCK), np.uint16)
        on = often[terms]
        self.counts[self.dense[terms[on]], rows[on]] = counts[on]
        self.screen = np.stack([(_LOGS[c] * self.inverse_norm).astype(np.float32) for c in self.counts]) if len(self.counts) else np.zeros((0, self.blocks * BLOCK), np.float32)
        self.dense_most = np.stack([(_LOGS[c] * self.inverse_norm).reshape(-1, BLOCK).max(1) for c in self.counts]) if len(self.counts) else np.zeros((0, self.blocks))
        rows, terms, w = rows[~on], terms[~on], w[~on]
        order = np.lexsort((rows, terms))
        rows, terms, w = rows[order], terms[order], w[order]
        block = rows // BLOCK
        first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1]))) if len(rows) else np.zeros(0, np.int64)
        self.example, self.weight = rows.astype(np.int32), w
        self.cell_block, self.cell_at = block[first].astype(np.int32), np.append(first, len(rows)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(w, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(terms[first], np.arange(v + 1)).astype(np.int32)
        self.most = np.zeros(v)
        np.maximum.at(self.most, terms[first], self.cell_most)

    def screened(self, row: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The frequent terms' part of all cosines, in single precision."""
        share, out = share.astype(np.float32), np.zeros(self.screen.shape[1], np.float32)
        if self.buffer is None:
            self.buffer = np.zeros((128, self.screen.shape[1]), np.float32)
        for i in range(0, len(row), 128):
            part = self.buffer[: len(row[i : i + 128])]
            np.take(self.screen, row[i : i + 128], axis=0, out=part, mode="clip")
            out += share[i : i + 128] @ part
        return out

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, nearest first."""
        row = self.dense[terms]
        often = row >= 0
        row, share = row[often], w[often] * self.idf[terms[often]]
        left_dense = share @ self.dense_most[row]
        terms, w = terms[~often], w[~often]
        order = np.argsort(-w * self.most[terms], kind="stable")
        terms, w = terms[order], w[order]
        begin, end = self.cells[terms], self.cells[terms + 1]
        upto = np.cumsum(self.cell_at[end] - self.cell_at[begin])  # a term's postings follow one another
        self.all += int(upto[-1] if len(upto) else 0) + len(row) * len(self.ids)
        cos, kth, n = np.zeros(self.blocks * BLOCK), -1.0, len(terms)
        stop = min(int(np.searchsorted(upto, FIRST_WAVE)) + 1, n) if n else 0
        if stop:
            many = self.cell_at[end[:stop]] - self.cell_at[begin[:stop]]
            posting = spread(self.cell_at[begin[:stop]], many)
            cos += np.bincount(self.example[posting], np.repeat(w[:stop], many) * self.weight[posting], minlength=len(cos))
            self.read += len(posting)
        if stop < n:
            cell = spread(begin[stop:], end[stop:] - begin[stop:])
            weight, block = np.repeat(w[stop:], end[stop:] - begin[stop:]), self.cell_block[cell]
            if len(cos) > k:
                kth = np.partition(cos, -k)[-k]
                left = np.bincount(block, weight * self.cell_most[cell], minlength=self.blocks) + left_dense
                alive = cos.reshape(-1, BLOCK).max(1) + left >= kth - 1e-9
                on = alive[block]
                cell, weight = cell[on], weight[on]
            many = self.cell_at[cell + 1] - self.cell_at[cell]
            posting = spread(self.cell_at[cell], many)
            cos += np.bincount(self.example[posting], np.repeat(weight, many) * self.weight[posting], minlength=len(cos))
            self.read += len(posting)
        kth = np.partition(cos, -k)[-k] if len(cos) > k else 0.0
        found = np.flatnonzero(cos + np.repeat(left_dense, BLOCK) >= kth - 1e-9)
        self.read += len(row) * len(found)
        if len(row) and len(cos) > k and 8 * len(found) > len(cos):  # many are left: single precision tells most of them apart, with a wide margin
            near = cos + self.screened(row, share)
            found = np.flatnonzero(near >= np.partition(near, -k)[-k] - 1e-5)
        cos = cos[found]
        if len(row):
            cos = cos + share @ _LOGS[self.counts[row[:, None], found]] * self.inverse_norm[found]
        found, cos = found[cos > 0], cos[cos > 0]
        best = np.lexsort((self.ids[found], -np.round(cos, 12)))[:k]
        return found[best], np.minimum(cos[best], 1.0)


class ToxicityModel:
    def __init__(self, index: BlockMaxIndex | None, prior: float, k: int):
        self.index, self.prior, self.k = index, prior, k
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def vote(self, places: np.ndarray, cos: np.ndarray) -> float:
        if not len(places):
            return self.prior
        w = 1 / (1.05 - cos)
        far = max(0.0, 1.0 - cos[0])  # few or distant neighbours leave room for the prior
        return float((w @ self.index.labels[places] + far * self.prior) / (w.sum() + far))

    def votes(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int):
        """Vote, places and cosines of each of n texts, from their (row, term, count) pairs."""
        w = self.index.weigh(rows, terms, counts, n)
        at = np.searchsorted(rows, np.arange(n + 1)).tolist()
        for i, j in zip(at[:-1], at[1:], strict=True):
            places, cos = self.index.nearest(terms[i:j], w[i:j], self.k) if j > i else (np.zeros(0, np.int64), np.zeros(0))
            yield self.vote(places, cos), places, cos

    def raw(self, column: pa.Array, evidence: int = 0):
        """Votes of each text, and its nearest examples' ids and cosines."""
        votes, ids, cosines = np.full(len(column), self.prior), [[]] * len(column), [[]] * len(column)
        if self.index is None or not len(self.index.terms):
            return votes, ids, cosines
        for first, last, rows, terms, counts in term_counts(column, self.index.terms):
            for i, (vote, places, cos) in enumerate(self.votes(rows, terms, counts, last - first), first):
                votes[i] = vote
                if evidence:
                    ids[i], cosines[i] = self.index.ids[places[:evidence]].tolist(), cos[:evidence].tolist()
        return votes, ids, cosines

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(votes, self.knots, self.values), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_labelled: int, max_postings: int, k: int, delta: bool) -> ToxicityModel:
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")).withColumn("fold", fold).filter("fold != 0")  # of several labels the larger
    sample = written(bounded_sample(known, "id", max_labelled), "toxicity-labels")  # at most max_labelled rows of 16 bytes: broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "fold", "text")

    def counted(batches):
        for b in batches:
            for first, last, of, t, n in term_counts(b.column(3)):
                at = pa.array(np.searchsorted(of, np.arange(last - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(t.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*(b.column(i)[first:last] for i in range(3)), *lists], names=["id", "label", "fold", "terms", "counts"])

    vectors = written(rows.mapInArrow(lean(counted), "id long, label int, fold int, terms array<long>, counts array<int>"), "toxicity-terms")
    order = F.struct(F.xxhash64("id", F.lit(11)), "id")
    sizes = vectors.select(order.alias("at"), F.size("terms").cast("long").alias("n"), "label").toPandas()  # at most max_labelled rows
    y, n = int(sizes["label"].sum()), len(sizes)
    if not n or y in (0, n):
        return ToxicityModel(None, y / n if n else 0.0, k)
    if sizes["n"].sum() > max_postings:
        sizes = sizes.sort_values("at", key=lambda c: c.map(tuple))
        last = sizes["at"][(sizes["n"].cumsum() <= max_postings).to_numpy()].iloc[-1:]
        vectors = vectors.filter(F.xxhash64("id", F.lit(11)) <= int(last.iloc[0][0])) if len(last) else vectors.limit(0)
    got = vectors.orderBy("id").toArrow().combine_chunks()
    if not got.num_rows:
        return ToxicityModel(None, y / n, k)
    ids, label, folds = (got.column(c).to_numpy() for c in ("id", "label", "fold"))
    lists = got.column("terms").combine_chunks() if isinstance(got.column("terms"), pa.ChunkedArray) else got.column("terms")
    of = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    hashes, counts = lists.flatten().to_numpy().view(np.uint64), got.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    inside = folds != 4 if (folds != 4).any() else np.ones(len(folds), bool)
    index, held = _index(ids, label, of, hashes, counts, inside, delta)
    model = ToxicityModel(index, float(label[inside].mean()), k)
    if (~inside).any():
        model.knots, model.values = pav(np.array([v for v, _, _ in model.votes(*held, int((~inside).sum()))]), label[~inside].astype(float))
    return model


def _index(ids, label, of, hashes, counts, inside, delta):
    """The index of the examples, and the (row, term, count) pairs of those that calibrate."""
    mine = inside[of]
    terms, places = np.unique(hashes[mine], return_inverse=True)
    df = np.bincount(places, minlength=len(terms))
    positive = np.bincount(places, label[of[mine]], minlength=len(terms))
    index = BlockMaxIndex(terms, inverse_frequency(df, positive, int(inside.sum()), int(label[inside].sum()), delta), ids[inside], label[inside].astype(float))
    index.load((np.cumsum(inside) - 1)[of[mine]], places, counts[mine])
    place = np.searchsorted(terms, hashes[~mine])
    place[place == len(terms)] = 0
    hit = terms[place] == hashes[~mine] if len(terms) else np.zeros(len(place), bool)
    rows, place, c = (np.cumsum(~inside) - 1)[of[~mine]][hit], place[hit], counts[~mine][hit]
    order = np.lexsort((place, rows))
    return index, (rows[order], place[order], c[order])


MAX_LABELLED, MAX_POSTINGS, NEAREST, THRESHOLD = 5_000, 3_000_000, 21, 0.5


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_postings: int = MAX_POSTINGS, k: int = NEAREST, threshold: float = THRESHOLD, evidence: int = 3, delta: bool = True) -> DataFrame:
    """id, held_out, score, predicted, and the ids and cosines of the nearest examples of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col, max_labelled, max_postings, k, delta))
    tidy()  # the driver's own copy

    def run(batches):
        m = model.value
        for b in batches:
            votes, ids, cosines = m.raw(b.column(1), evidence)
            s = m.score(votes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=[id_col, "score", "predicted", "evidence_ids", "evidence_cosines"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", "predicted", "evidence_ids", "evidence_cosines")


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_postings: int = MAX_POSTINGS, k: int = NEAREST, threshold: float = THRESHOLD, delta: bool = True) -> DataFrame:
    """The documents that score below the threshold, all columns; one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col, max_labelled, max_postings, k, delta))
    tidy()  # the driver's own copy

    at = docs.columns.index(text_col)

    def run(batches):
        m = model.value
        for b in batches:
            s = m.score(m.raw(b.column(at))[0])
            yield b.filter(pa.array(s < threshold, pa.bool_()))

    return map_rows(docs, run)


def op6_toxicity(spark, sf_dir):
    return score_toxicity(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
