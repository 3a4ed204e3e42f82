"""Topic models: non-negative factorisation on Spark, frozen transform, LDA, alignment, stability, keyword clusters."""

from __future__ import annotations

import itertools
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import hash_order


def rows_of(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx array, weight array): one sparse row per document."""
    return weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("x")).select(key, F.col("x.idx").alias("idx"), F.col("x.weight").alias("w"))


#: Non-zero cells of the samples whose many runs a study gives a task each (16 bytes a cell); with larger samples every run is fitted by all tasks, one after the other.
TASK_CELLS = 40_000_000
#: A fit's blocks: cells that a task has at least, documents of a block, and partial sums that are added at once. Cells that a product gathers at once.
LEAST_CELLS, BLOCK_ROWS, FAN, GATHERED = 25_000, 4096, 16, 1 << 14


def _csr(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx, w = batch.column("idx"), batch.column("w")
    rows = np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy()))
    return rows, idx.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy().astype(float)


def _rectangles(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells in order of their rows as rectangles (rows, columns, weights) of rows of like length, short ones filled with weight 0."""
    size = np.bincount(row, minlength=n)
    at, order, out, i = np.cumsum(size) - size, np.argsort(-size, kind="stable"), [], 0
    order = order[size[order] > 0]
    while i < len(order):
        most = int(size[order[i]])
        part = order[i : i + max(1, GATHERED // most)]
        part = part[: np.searchsorted(-size[part], -most / 2, "right")]
        inside = np.arange(most) < size[part][:, None]
        place = np.where(inside, at[part][:, None] + np.arange(most), 0)
        out.append((part.astype(np.int32), col[place].astype(np.int32), np.where(inside, w[place], 0).astype(w.dtype)))
        i += len(part)
    return out


def _product(rectangles, n: int, dense: np.ndarray) -> np.ndarray:
    """Rows of cells times a dense matrix: gathered rows, then one small product a row."""
    out, dense = np.zeros((n, dense.shape[1])), np.ascontiguousarray(dense, dtype=float)
    for part, col, w in rectangles:
        out[part] = np.matmul(w[:, None, :].astype(float), dense[col])[:, 0]
    return out


class Cells:
    """The non-zero cells X of a block of ``n`` documents, laid out once by documents and once by terms for many products; ``w``, if kept, is where the next fit of its documents starts."""

    def __init__(self, csr, n: int, n_terms: int, keep: bool = False):
        rows, idx, w = csr
        self.n, self.n_terms, self.keep, self.w = n, n_terms, keep, None
        self.sum, self.squares = float(w.sum(dtype=float)), float((w.astype(float) ** 2).sum())
        self.by_row = _rectangles(rows, idx, w, n)
        order = np.argsort(idx, kind="stable")
        self.by_term = _rectangles(idx[order], rows[order], w[order], n_terms)

    def times(self, dense: np.ndarray) -> np.ndarray:
        """X times a dense matrix with one row per term."""
        return _product(self.by_row, self.n, dense)

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        """X' times a dense matrix with one row per document."""
        return _product(self.by_term, self.n_terms, dense)


def _cells(block, n: int, n_terms: int) -> Cells:
    """A block of ``n`` documents, given as it is or as (rows, idx, w)."""
    return block if isinstance(block, Cells) else Cells(block, n, n_terms)


def nnls_rows(xh: np.ndarray, hh: np.ndarray, start: np.ndarray, sweeps: int = 200, tol: float = 1e-10) -> np.ndarray:
    """min |x - w H| with w >= 0 for every row, by cyclic coordinate descent; rows don't touch each other, and those that have settled are left out once they are half of all."""
    w = np.array(start.T, dtype=float, order="C")
    live, a, x = np.arange(len(start)), w.copy(), np.ascontiguousarray(xh.T, dtype=float)
    for _ in range(sweeps if len(start) else 0):
        most = np.zeros(len(live))
        for k in range(len(hh)):
            if hh[k, k] <= 0:
                a[k] = 0
                continue
            new = np.maximum(0, a[k] + (x[k] - hh[k] @ a) / hh[k, k])
            np.maximum(most, np.abs(new - a[k]), out=most)
            a[k] = new
        moving = most >= tol
        if 2 * np.count_nonzero(moving) <= len(live):
            w[:, live] = a
            live, a, x = live[moving], a[:, moving], x[:, moving]
            if not len(live):
                break
    w[:, live] = a
    return np.ascontiguousarray(w.T)


def unconstrained(xh: np.ndarray, hh: np.ndarray) -> np.ndarray:
    """Where descent starts: the least-squares solution without bounds, cut off at zero."""
    return np.maximum(0, xh @ np.linalg.pinv(hh, hermitian=True))


def nndsvd(total, n_terms: int, k: int, rounds: int = 6, extra: int = 10, seed: int = 0) -> np.ndarray:
    """The non-negative start of H (Boutsidis and Gallopoulos 2008) from a randomised decomposition.

    X'X is only ever multiplied with k + ``extra`` vectors, so nothing is as large as the square of
    the vocabulary; of the positive and negative parts of a pair of singular vectors the heavier
    pair counts, for which one more pass sums the parts of the left vectors."""
    p = min(n_terms, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, p)))[0]
    for _ in range(rounds):
        got = total(lambda block, n, q=q: [(lambda x: x.transposed_times(x.times(q)))(_cells(block, n, n_terms))])
        if got is None:
            return np.zeros((k, n_terms))
        y = got[0]
        values, u = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        vectors = q @ u
        q = np.linalg.qr(y)[0]
    order = np.argsort(values)[::-1][:k]
    s, v = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    plus, minus = total(lambda block, n: [(lambda left: np.stack([(np.maximum(left, 0) ** 2).sum(0), (np.maximum(-left, 0) ** 2).sum(0)]))(_cells(block, n, n_terms).times(v))])[0]
    h = np.zeros((k, n_terms))
    for i in range(len(order)):
        if s[i] <= 0:
            continue
        if i == 0:
            h[0] = np.sqrt(s[0]) * np.abs(v[:, 0])
            continue
        up, down = np.maximum(v[:, i], 0), np.maximum(-v[:, i], 0)
        a, b = np.sqrt(plus[i]) / s[i] * np.linalg.norm(up), np.sqrt(minus[i]) / s[i] * np.linalg.norm(down)
        part, m = (up, a) if a >= b else (down, b)
        if m > 0:
            h[i] = np.sqrt(s[i] * m) * part / np.linalg.norm(part)
    return np.where(h > 1e-8, h, 0)


class TopicModel:
    """A frozen basis H (topics by terms)."""

    def __init__(self, h: np.ndarray, objective: list[float], converged: bool):
        self.h, self.objective, self.converged = h, objective, converged

    def project(self, rows: np.ndarray, idx: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        xh, hh = _product(_rectangles(rows, idx, w, n), n, self.h.T), self.h @ self.h.T
        return nnls_rows(xh, hh, unconstrained(xh, hh))

    def table(self, spark, vocab: DataFrame) -> DataFrame:
        """topic, idx, term, weight of the basis."""
        k, v = self.h.shape
        long = spark.createDataFrame(pd.DataFrame({"topic": np.repeat(np.arange(k), v), "idx": np.tile(np.arange(v), k), "weight": self.h.ravel()}))
        return long.join(F.broadcast(vocab.select("idx", "term")), "idx")


#: Starts of a fit: the decomposition as it is; its zeros filled with the mean weight; with random shares of a hundredth of it; or all random.
STARTS = ("nndsvd", "nndsvda", "nndsvdar", "random")


def _first_basis(total, n_terms: int, k: int, start: str, seed: int | None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if start == "random":
        return np.abs(rng.normal(size=(k, n_terms))) * 0.1
    h = nndsvd(total, n_terms, k)
    if start != "nndsvd":
        got = total(lambda block, n: [np.array([_cells(block, n, n_terms).sum, float(n)])])
        mean = got[0][0] / (max(1.0, got[0][1]) * n_terms) if got else 0.0
        h = np.where(h > 0, h, mean if start == "nndsvda" else rng.random(h.shape) * mean / 100)
    return np.where(h.any(1, keepdims=True), h, 1.0 / n_terms)


def _alternate(total, n_terms: int, k: int, limits: list[int], tol: float, start: str = "nndsvd", seed: int | None = None) -> list[TopicModel]:
    """Alternating least squares where ``total(make)`` sums ``make(block, n)`` over all blocks of documents; the model as it stands at each of the rising limits of iterations.

    Given H, rows of W are independent: a block solves its own and gives W'W, W'X and its squared error. The fit
    has converged when the projected gradient of H is at most ``tol`` of the first one; later limits then have the
    same model. Without documents all bases are zero."""
    h = _first_basis(total, n_terms, k, start, seed)
    objective: list[float] = []
    first, models = None, []
    for i in range(max(limits)):

        def step(block, n, h=h):
            x = _cells(block, n, n_terms)
            hh = h @ h.T
            xh = x.times(h.T)
            ww = nnls_rows(xh, hh, unconstrained(xh, hh) if x.w is None else x.w, tol=1e-8)
            if x.keep:
                x.w = ww
            wx, wtw = x.transposed_times(ww), ww.T @ ww
            return [wtw, wx, np.array([x.squares - 2 * (wx.T * h).sum() + (wtw * hh).sum()])]

        got = total(step)
        if got is None:
            return [TopicModel(np.zeros((k, n_terms)), [], True)] * len(limits)
        wtw, xtw, error = got
        objective.append(float(error[0]))
        gradient = wtw @ h - xtw.T
        slope = float(np.abs(np.where(h > 0, gradient, np.minimum(gradient, 0))).sum())
        first = slope if first is None else first
        if slope <= tol * first:
            return models + [TopicModel(h, objective, True)] * (len(limits) - len(models))
        h = nnls_rows(xtw, wtw, h.T.copy(), sweeps=20).T
        if i + 1 in limits:
            models.append(TopicModel(h, objective[:], False))
    return models


def _summed(parts):
    out = None
    for p in parts:
        out = p if out is None else [x + y for x, y in zip(out, p, strict=True)]
    return out


def _in_task(batches, n_terms: int, k: int, limits: list[int], tol: float, start: str, seed: int | None) -> list[TopicModel]:
    """The whole fit over one task's documents (idx, w), whose weights are held in single precision; a block's W is the start of its next."""
    blocks, held, n = [], [], 0

    def pack():
        row, idx, w = (np.concatenate(x) for x in zip(*held, strict=True))
        blocks.append(Cells((row, idx, w), n, n_terms, keep=True))

    for b in batches:
        row, idx, w = _csr(b)
        held.append((row + n, idx.astype(np.int32), w.astype(np.float32)))
        n += b.num_rows
        if n >= 2 * BLOCK_ROWS:
            pack()
            held, n = [], 0
    if n:
        pack()
    return _alternate(lambda make: _summed(make(x, x.n) for x in blocks), n_terms, k, limits, tol, start, seed)


FITTED = "run long, step int, h binary, objective array<double>, converged boolean"


def fit_runs(rows: DataFrame, n_terms: int, k: int, starts: list[tuple[str, int | None]], limits: list[int], tol: float = 1e-4) -> dict[int, list[TopicModel]]:
    """The models at each limit of iterations for each ``run`` of (run, idx, w), all at once, each in a task of its own; run r starts as ``starts[r]`` says.

    Every run must hold at most ``TASK_CELLS`` cells, which the caller has counted."""

    def solve(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            r = first.column("run")[0].as_py()
            got = _in_task(itertools.chain([first], batches), n_terms, k, limits, tol, *starts[r])
            yield pa.RecordBatch.from_pydict({"run": pa.array([r] * len(got), pa.int64()), "step": pa.array(range(len(got)), pa.int32()), "h": pa.array([m.h.astype("<f8").tobytes() for m in got], pa.binary()), "objective": pa.array([m.objective for m in got], pa.list_(pa.float64())), "converged": [m.converged for m in got]})

    # by number, not by hash, so that no task has two runs
    dealt = rows.select(F.col("run").cast("int").alias("run"), "idx", F.col("w").cast("array<float>").alias("w")).repartitionById(len(starts), "run")
    got = dealt.mapInArrow(solve, FITTED).collect()  # a K x V basis each
    out: dict[int, list[TopicModel]] = {}
    for r in sorted(got, key=lambda r: (r["run"], r["step"])):
        out.setdefault(r["run"], []).append(TopicModel(np.frombuffer(r["h"]).reshape(k, n_terms).copy(), list(r["objective"]), r["converged"]))
    return out


def cells(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()[0]


def _packed(rows: DataFrame, n_terms: int) -> DataFrame:
    """Blocks of documents as bytes of ``Cells``, dealt evenly over tasks: what a fit keeps on the executors."""
    spark, n = rows.sparkSession, cells(rows)
    tasks = max(1, min(-(-n // LEAST_CELLS), max(spark.sparkContext.defaultParallelism, n // (40 * LEAST_CELLS))))

    def run(batches):
        for b in batches:
            for part in pa.Table.from_batches([b]).to_batches(max_chunksize=BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Cells(_csr(part), part.num_rows, n_terms), 5)], pa.binary())], names=["block"])

    return rows.select("idx", "w").repartition(tasks).mapInArrow(run, "block binary")


def _spark_sums(blocks: DataFrame):
    """``total(make)`` for ``_alternate``: every task adds up what ``make(block, n)`` gives for its blocks; the tasks' sums, of fixed size, are added ``FAN`` at a time until ``FAN`` are left for the driver."""
    n_parts = blocks.rdd.getNumPartitions()
    kind = "sums array<binary>, shapes array<string>"

    def read(sums, shapes):
        return [np.frombuffer(x).reshape([int(n) for n in d.split(",")]) for x, d in zip(sums, shapes, strict=True)]

    def add(key, table):
        sums, shapes = table.column("sums").to_pylist(), table.column("shapes").to_pylist()
        out = _summed(read(s, d) for s, d in zip(sums, shapes, strict=True))
        return pa.table({"part": [key[0].as_py() // FAN], "sums": [[x.tobytes() for x in out]], "shapes": [shapes[0]]}, schema=pa.schema([("part", pa.int64()), ("sums", pa.list_(pa.binary())), ("shapes", pa.list_(pa.string()))]))

    def total(make):
        def run(batches):
            def each():
                for b in batches:
                    for x in b.column(0):
                        cells = pickle.loads(x.as_buffer())  # written by ``_packed``
                        yield make(cells, cells.n)

            got = _summed(each())
            if got is not None:
                yield pa.RecordBatch.from_pydict({"sums": [[x.astype("<f8").tobytes() for x in got]], "shapes": [[",".join(map(str, x.shape)) for x in got]]})

        parts, left = blocks.mapInArrow(run, kind), n_parts
        if left > FAN:
            parts = parts.withColumn("part", F.floor(F.spark_partition_id() / FAN).cast("long"))
            while left > FAN:
                parts, left = parts.groupBy("part").applyInArrow(add, "part long, " + kind), -(-left // FAN)
        return _summed(read(r["sums"], r["shapes"]) for r in parts.select("sums", "shapes").collect())

    return total


def fit_nmf(rows: DataFrame, n_terms: int, k: int, max_iter: int = 400, tol: float = 1e-4, start: str = "nndsvd", seed: int | None = None) -> TopicModel:
    """X ~ W H by alternating non-negative least squares; without rows the basis is zero."""
    return fit_nmf_steps(rows, n_terms, k, [max_iter], tol, start, seed)[0]


def fit_nmf_steps(rows: DataFrame, n_terms: int, k: int, limits: list[int], tol: float = 1e-4, start: str = "nndsvd", seed: int | None = None) -> list[TopicModel]:
    """The models of one fit at each of the rising limits of iterations: what separate fits would give, for the work of the longest.

    The sample's blocks stay on the executors; an iteration is a Spark job that sends K x V sums. W is solved anew in every
    block from its least-squares solution, so nothing but the blocks has to be kept or, after a loss, made again."""
    blocks = _packed(rows, n_terms).persist()
    try:
        return _alternate(_spark_sums(blocks), n_terms, k, limits, tol, start, seed)
    finally:
        blocks.unpersist()


def transform(rows: DataFrame, model: TopicModel, key: str = "doc_id", raw: bool = False) -> DataFrame:
    """key, topics (shares summing to 1, or the weights themselves if ``raw``) and valid: documents without weight on any topic are not valid."""
    basis = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            w = basis.value.project(*_csr(b), b.num_rows)
            total = w.sum(1, keepdims=True)
            share = w if raw else np.divide(w, total, out=np.zeros_like(w), where=total > 0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(share), pa.list_(pa.float64())), pa.array(total[:, 0] > 0)], names=[key, "topics", "valid"])

    return rows.mapInArrow(run, f"`{key}` {kind}, topics array<double>, valid boolean")


def mean_shares(docs: DataFrame, by: str, k: int) -> DataFrame:
    """Mean topic shares of the valid documents of each period, renormalised to sum 1; with all and valid counts."""
    means = [F.avg(F.when(F.col("valid"), F.get("topics", F.lit(i)))).alias(f"topic_{i}") for i in range(k)]
    g = docs.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.coalesce("valid", F.lit(False))).alias("n_valid"), *means)
    total = sum((F.coalesce(f"topic_{i}", F.lit(0.0)) for i in range(k)), F.lit(0.0))
    return g.select(by, "n_docs", "n_valid", *[F.try_divide(F.col(f"topic_{i}"), total).alias(f"topic_{i}") for i in range(k)])


def fit_lda(rows: DataFrame, n_terms: int, k: int, max_iter: int = 10, seed: int = 42):
    """Online variational LDA on binary counts; ``lda_documents`` infers documents' topics under it."""
    from pyspark.ml.clustering import LDA

    vectors = count_vectors(spread(rows), n_terms).persist()  # every iteration samples them
    try:
        return LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online", featuresCol="features").fit(vectors)
    finally:
        vectors.unpersist()


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive x, by its recurrence and its series from 6 on."""
    y = x + 6
    v = 1 / (y * y)
    return np.log(y) - 0.5 / y - v * (1 / 12 - v * (1 / 120 - v * (1 / 252 - v * (1 / 240 - v / 132)))) - sum(1 / (x + i) for i in range(6))


def _lgamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.fromiter(map(math.lgamma, x.ravel()), float, x.size).reshape(x.shape)


def _log_shares(gamma: np.ndarray) -> np.ndarray:
    """Expected logarithms of shares with these Dirichlet weights in each row."""
    return digamma(gamma) - digamma(gamma.sum(1, keepdims=True))


def lda_inference(at: np.ndarray, idx: np.ndarray, beta: np.ndarray, alpha: np.ndarray, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """For documents of the distinct terms ``idx[at[i] : at[i + 1]]``: their topics' variational weights, and the expected log probability of their words.

    The fixed point that the library iterates, and its limit (a mean change of ``tol``), from weights of one, the mean of its
    random starts. Documents of like length are solved together. ``beta``: V x K exponentials of expected logarithms."""
    k, size = len(alpha), np.diff(at)
    padded = np.vstack([beta, np.zeros(k)])  # the last row fills short documents
    gamma, logs, order, first = np.tile(alpha, (len(size), 1)), np.zeros(len(size)), np.argsort(-size, kind="stable"), 0
    order = order[size[order] > 0]
    while first < len(order):
        length = size[order[first]]
        rows = order[first : first + max(1, GATHERED // length)]
        first += len(rows)
        place = at[rows][:, None] + np.arange(length)
        b = padded[np.where(np.arange(length) < size[rows][:, None], idx[np.minimum(place, len(idx) - 1)], len(beta))]
        g = np.ones((len(rows), k))
        t, open_ = np.exp(_log_shares(g)), np.ones(len(rows), bool)
        while True:
            phi = np.matmul(b, t[:, :, None])[:, :, 0] + 1e-100
            new = t * np.matmul((1 / phi)[:, None, :], b)[:, 0] + alpha
            t = np.exp(_log_shares(new))
            settled = open_ & (np.abs(new - g).mean(1) <= tol)
            g = new
            if not settled.any():
                continue
            done = rows[settled]
            gamma[done] = g[settled]
            phi = np.matmul(b[settled], t[settled][:, :, None])[:, :, 0] + 1e-100
            logs[done] = np.where(np.arange(length) < size[done][:, None], np.log(phi), 0.0).sum(1)
            open_ &= ~settled
            if not open_.any():
                break
            if 2 * open_.sum() <= len(rows):
                length = size[rows[open_]].max()
                rows, b, g, t = rows[open_], np.ascontiguousarray(b[open_, :length]), g[open_], t[open_]
                open_ = np.ones(len(rows), bool)
    return gamma, logs


def lda_documents(rows: DataFrame, model, keys: list[str] = ("doc_id",)) -> DataFrame:
    """The keys of the rows (binary counts of the terms in ``idx``), shares of the model's topics, number of terms, and the document's part of the bound on the log likelihood."""
    alpha = model.estimatedDocConcentration().toArray()
    beta = rows.sparkSession.sparkContext.broadcast(np.exp(_log_shares(model.topicsMatrix().toArray().T)).T.copy())  # capped terms by topics

    def run(batches):
        constant = math.lgamma(alpha.sum()) - _lgamma(alpha).sum()
        for b in batches:
            lists = b.column(b.num_columns - 1)
            at, idx = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)
            gamma, logs = lda_inference(at - at[0], idx, beta.value, alpha)
            total, size = gamma.sum(1), np.diff(at)
            bound = logs + ((alpha - gamma) * _log_shares(gamma)).sum(1) + _lgamma(gamma).sum(1) - _lgamma(total) + constant
            bound[size == 0] = 0.0
            shares = np.where(size[:, None] > 0, gamma / total[:, None], 0.0)
            topics = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(alpha)), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], topics, pa.array(size), pa.array(bound)], names=[*keys, "topics", "n_terms", "bound"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    return rows.select(*keys, "idx").mapInArrow(run, f"{kinds}, topics array<double>, n_terms long, bound double")


def lda_log_perplexity(documents: DataFrame, model, by: str) -> dict:
    """For each value of ``by`` of ``lda_documents``: the bound on the negative log likelihood of a word, the topics' own part included."""
    lam, eta = model.topicsMatrix().toArray(), model.getTopicConcentration() if model.isSet("topicConcentration") else 1 / model.getK()
    topics = ((eta - lam) * _log_shares(lam.T).T).sum() + (_lgamma(lam) - math.lgamma(eta)).sum() + (math.lgamma(eta * len(lam)) - _lgamma(lam.sum(0))).sum()
    sums = documents.groupBy(by).agg(F.sum("bound").alias("bound"), F.sum("n_terms").alias("n")).collect()
    return {r[by]: -(r["bound"] + topics) / r["n"] for r in sums if r["n"]}


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, four tasks each: files are as few as their bytes, not as the work that their rows make."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def count_vectors(rows: DataFrame, n_terms: int, keys: list[str] = ("doc_id",)) -> DataFrame:
    """Sparse binary vectors of the terms that stand in each row."""
    from pyspark.ml.feature import CountVectorizerModel

    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_terms)], inputCol="__words", outputCol="features", minTF=1.0, binary=True)
    return model.transform(rows.select(*keys, F.col("idx").cast("array<string>").alias("__words"))).select(*keys, "features")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """For each row the column of a cheapest one-to-one assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while match[j0]:
            used[j0] = True
            i0, best, j1 = match[j0], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < best:
                        best, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += best
                    v[j] -= best
                else:
                    least[j] -= best
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def align(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """left, right, cosine: topics of two models matched one to one for the largest total cosine; a few topics each."""
    from tidemark.operators.text import cosine_matrix

    both = left.select((F.col(key) * 2).alias("k"), values).unionByName(right.select((F.col(key) * 2 + 1).alias("k"), values))
    pairs = cosine_matrix(both, "k", values).filter("a % 2 = 0 AND b % 2 = 1")

    def run(pdf):
        m = pdf.pivot(index="a", columns="b", values="cosine").sort_index().sort_index(axis=1)
        n = max(m.shape)
        cost = np.zeros((n, n))
        cost[: m.shape[0], : m.shape[1]] = -m.to_numpy()
        match = hungarian(cost)
        keep = [(i, j) for i, j in enumerate(match) if i < m.shape[0] and j < m.shape[1]]
        return pd.DataFrame({"left": [int(m.index[i]) // 2 for i, _ in keep], "right": [int(m.columns[j]) // 2 for _, j in keep], "cosine": [float(m.iloc[i, j]) for i, j in keep]})

    return pairs.groupBy().applyInPandas(run, "left int, right int, cosine double")


def match_bases(a: np.ndarray, b: np.ndarray) -> list[dict]:
    """Topics of two bases matched one to one for the largest total cosine.

    Each pair has its cosine, the Jaccard similarity of its 10 and 20 heaviest terms (ties by index), the weighted one over
    the union of the 20 heaviest with weights renormalised there, the next best topic and the margin to it."""
    unit = lambda h: h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-15)
    cosine = np.clip(unit(a) @ unit(b).T, 0, 1)
    tops = lambda h, n: [np.argsort(-row, kind="stable")[:n] for row in h]
    (a10, b10), (a20, b20) = ((tops(a, n), tops(b, n)) for n in (10, 20))
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))
    out = []
    for i, j in enumerate(hungarian(-cosine)):
        both = np.union1d(a20[i], b20[j])
        x, y = a[i, both], b[j, both]
        x, y = x / (x.sum() or 1), y / (y.sum() or 1)
        most = np.maximum(x, y).sum()
        rest = np.delete(np.arange(len(b)), j)
        second = int(rest[np.argmax(cosine[i, rest])]) if len(rest) else None
        next_best = None if second is None else float(cosine[i, second])
        out.append({"left": i, "right": int(j), "cosine": float(cosine[i, j]), "jaccard_10": jaccard(a10[i], b10[j]), "jaccard_20": jaccard(a20[i], b20[j]), "weighted_jaccard": float(np.minimum(x, y).sum() / most) if most > 0 else 0.0,
            "second": second, "margin": None if next_best is None else float(cosine[i, j]) - next_best})
    return out


def study_runs(subsamples: int = 10, filled: int = 1, jittered: int = 5, restarts: int = 5) -> list[tuple[str, str, int | None]]:
    """(kind, start, seed) of every run of a stability study: the base, subsamples, and other starts on all rows."""
    out: list[tuple[str, str, int | None]] = [("base", "nndsvd", None), *[("subsample", "nndsvd", None)] * subsamples]
    for kind, n in (("nndsvda", filled), ("nndsvdar", jittered), ("random", restarts)):
        out += [(kind, kind, len(out) + i) for i in range(n)]
    return out


def fit_study(rows: DataFrame, n_terms: int, k: int, runs: list[tuple[str, str, int | None]], share: float = 0.8, max_iter: int = 400) -> list[np.ndarray]:
    """The basis of each run; subsamples are chosen by hashes of the ids. All runs are fitted at once where the sample fits a task, else one after the other."""
    in_run = lambda r: F.conv(F.substring(hash_order(F.col("doc_id"), 100 + r), 1, 6), 16, 10).cast("long") < int(share * (1 << 24))
    keep = [in_run(r) if kind == "subsample" else F.lit(True) for r, (kind, _, _) in enumerate(runs)]
    rows = rows.select("doc_id", "idx", "w").persist()
    if cells(rows) <= TASK_CELLS:
        each = F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in enumerate(keep)]), lambda r: r.isNotNull()))
        models = {r: m[0] for r, m in fit_runs(rows.select(each.alias("run"), "idx", "w"), n_terms, k, [x[1:] for x in runs], [max_iter]).items()}
    else:
        models = {r: fit_nmf(rows.filter(c), n_terms, k, max_iter, start=runs[r][1], seed=runs[r][2]) for r, c in enumerate(keep)}
    rows.unpersist()
    return [models[r].h if r in models else np.zeros((k, n_terms)) for r in range(len(runs))]


def stability(rows: DataFrame, n_terms: int, k: int, runs: list[tuple[str, str, int | None]], share: float = 0.8, max_iter: int = 400) -> DataFrame:
    """A base model, refits on subsamples and from other starts; each against the base and within its kind.

    One row per pair of runs: kind, run_a, run_b (0 is the base), mean, least and largest cosine of the matched topics,
    their mean Jaccard similarities, and how many pairs reach 0.8 and 0.9."""
    h = fit_study(rows, n_terms, k, runs, share, max_iter)
    names, out = [kind for kind, _, _ in runs], []
    for a, b in itertools.combinations(range(len(names)), 2):
        if a and names[a] != names[b]:
            continue
        m = match_bases(h[a], h[b])
        cos = [x["cosine"] for x in m]
        mean = lambda c: float(np.mean([x[c] for x in m]))  # noqa: B023, E731
        out.append((names[b] if a else f"base-{names[b]}", a, b, float(np.mean(cos)), min(cos), max(cos), mean("jaccard_10"), mean("jaccard_20"), mean("weighted_jaccard"), sum(x >= 0.8 for x in cos), sum(x >= 0.9 for x in cos)))
    return rows.sparkSession.createDataFrame(out, "kind string, run_a int, run_b int, mean_cosine double, least_cosine double, largest_cosine double, jaccard_10 double, jaccard_20 double, weighted_jaccard double, from_80 int, from_90 int")


def bases_table(spark, h: list[np.ndarray], vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All runs' bases as one table (run, topic, term, weight), and the topic of each run that matches each topic of the first (run, topic, base_topic, cosine)."""
    k = len(h[0])
    cells = [pd.DataFrame({"run": r, "topic": t, "idx": i, "weight": x[t, i]}) for r, x in enumerate(h) for t in range(k) for i in [np.flatnonzero(x[t])] if len(i)]
    long = spark.createDataFrame(pd.concat(cells) if cells else [], "run int, topic int, idx int, weight double")
    matched = [(r, m["right"], m["left"], m["cosine"]) for r, x in enumerate(h) for m in match_bases(h[0], x)]
    return long.join(vocab.select("idx", "term"), "idx").select("run", "topic", "term", "weight"), spark.createDataFrame(matched, "run int, topic int, base_topic int, cosine double")


def convergence(rows: DataFrame, n_terms: int, k: int, limits: list[int], further: list[int] = (), tol: float = 1e-4) -> DataFrame:
    """One continued fit seen at every two limits of iterations, each limit against itself too: iterations used and squared
    error at the later, convergence, the largest and mean change of the basis between the two, its relative Frobenius
    distance and the similarities of the matched topics. ``further`` limits are only gone to where the last of ``limits`` hasn't converged."""
    every = [*limits, *further]
    models = fit_nmf_steps(rows, n_terms, k, every, tol)
    if models[len(limits) - 1].converged:
        models = models[: len(limits)]
    out = []
    for i, j in itertools.combinations_with_replacement(range(len(models)), 2):
        base, model = models[i].h, models[j]
        d, size = np.abs(model.h - base), np.linalg.norm(base)
        match = match_bases(base, model.h)
        cos = [x["cosine"] for x in match]
        out.append((every[i], every[j], len(model.objective), model.objective[-1] if model.objective else None, model.converged, float(d.max()), float(d.mean()), float(np.linalg.norm(d) / size) if size else None, float(np.mean(cos)), min(cos), float(np.mean([x["jaccard_10"] for x in match])), float(np.mean([x["jaccard_20"] for x in match])), float(np.mean([x["weighted_jaccard"] for x in match])), all(x["left"] == x["right"] for x in match)))
    return rows.sparkSession.createDataFrame(out, "base_iter int, max_iter int, iterations int, error double, converged boolean, h_change double, h_mean_change double, h_distance double, mean_cosine double, least_cosine double, jaccard_10 double, jaccard_20 double, weighted_jaccard double, same_order boolean")


def average_linkage(d: np.ndarray, n_clusters: int) -> np.ndarray:
    """Labels of average-linkage clusters from a square of distances, by chains of nearest neighbours: quadratic.

    A chain ends at two clusters that are each other's nearest, which average linkage joins sooner or later; the joins in
    the order of their distances are the tree, of which the last ``n_clusters - 1`` are undone. The square is overwritten."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, live, chain, joins = np.ones(n), np.ones(n, bool), [], []
    while len(joins) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            i = chain[-1]
            j = int(np.argmin(d[i]))
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        joins.append((float(d[i, j]), i, j))
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        i, j = min(i, j), max(i, j)
        d[i], d[:, i], d[i, i] = row, row, np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        live[j] = False
        d[i, ~live] = np.inf
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, i, j in sorted(joins, key=lambda x: x[0])[: max(0, n - n_clusters)]:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], int)


def keyword_clusters(series: DataFrame, n_clusters: int) -> DataFrame:
    """term, cluster, peak month: average-linkage clusters of monthly z series by cosine, for a bounded set of terms.

    ``series`` has (term, month, share) on a full grid; z scores within each term."""
    w = Window.partitionBy("term")
    z = series.withColumn("z", F.try_divide(F.col("share") - F.avg("share").over(w), F.stddev_samp("share").over(w)))

    def run(pdf):
        m = pdf.pivot(index="term", columns="month", values="z").sort_index().fillna(0.0)
        x = m.to_numpy()
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        label = average_linkage(1 - x @ x.T, n_clusters)
        names = {c: n for n, c in enumerate(dict.fromkeys(label.tolist()))}
        mean = pdf.assign(cluster=pdf["term"].map(dict(zip(m.index, label.tolist(), strict=True)))).groupby(["cluster", "month"])["z"].mean()
        peak = {c: mean[c].sort_index().idxmax() for c in names}
        return pd.DataFrame({"term": m.index, "cluster": [names[c] for c in label.tolist()], "peak_month": [peak[c] for c in label.tolist()]})

    return z.select("term", "month", "z").groupBy().applyInPandas(run, "term string, cluster int, peak_month string")
