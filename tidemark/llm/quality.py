"""Document quality: ridge regression on random Fourier features of text statistics, calibrated isotonically.

Every text gives ``len(STATISTICS)`` numbers. Random Fourier features of the standardised numbers
approximate a Gaussian kernel; each partition of the labelled rows sums its part of the normal
equations, apart for each of four folds, and the driver adds and solves them. As the equations
add up, leaving out one fold gives out-of-fold scores for free; isotonic regression of the labels
on these calibrates the scores.

``max_labelled`` bounds the labelled rows that are fitted (chosen by a hash of the id); all rows
are scored. Statistics come from whole texts and nothing else.

Beyond the range of the fitted rows a kernel's features mean nothing, so each statistic counts as the
nearer end of its range there.

Defined cases: a text without words (null, empty, white space) has nothing to judge and scores 0; a
text of one letter or of any length is judged within the range of the fitted rows;
without labels of both kinds all other scores are the share of label 1 (0.5 without labels); a row
with a null id is held in, never fitted and scored; repeated ids are scored one by one; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .shared import lean, written
from .textcore import LOWER, WORD, mix, segments, span_hashes, utf8, word_spans

STATISTICS = ("log_bytes", "log_words", "upper", "digit", "stop", "exclaim", "bar", "sign", "high", "word_length", "repeated_words", "twice_running", "repeated_pairs", "repeated_lines", "line_words", "odd_ends")
FEATURES = 192
_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "exclaim": b"!", "bar": b"|", "sign": b"*#$%&@~^_=+<>/\\{}[]`"}
_MARK = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _SETS.items()} | {"high": np.arange(256) >= 128}
_LINE = np.ones(256, bool)
_LINE[10] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = _LETTER | np.isin(np.arange(256), np.frombuffer(b".,;:?!0123456789", np.uint8))


def _share(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def _repeats(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries of each row that stood in the row before."""
    of = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    return _share(pd.Series(mix(hashes + mix(of + np.uint64(1)))).duplicated().to_numpy(), at)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, offsets = utf8(column)
    out = [np.zeros((0, len(STATISTICS)))]
    for first, last in segments(offsets):
        raw = data[offsets[first] : offsets[last]]
        rows = offsets[first : last + 1] - offsets[first]
        low = LOWER[raw]
        starts, ends = word_spans(raw, rows[:-1], WORD)
        at = np.searchsorted(starts, rows)
        words = span_hashes(low, starts, ends)
        ls, le = word_spans(low, rows[:-1], _LINE)
        line_at = np.searchsorted(ls, rows)
        n_bytes = np.diff(rows).astype(float)
        n = np.diff(at).astype(float)
        per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n, 1)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[at[:-1][at[:-1] < len(words)]] = False
        pairs = mix(words + np.roll(words, 1) * np.uint64(3))
        c = {k: _share(v[raw], rows) for k, v in _MARK.items()}
        lines = np.maximum(np.diff(line_at), 1)
        letters = np.maximum(_share(_LETTER[raw], rows), 1)
        out.append(np.column_stack([
            np.log1p(n_bytes), np.log1p(n), c["upper"] / letters, c["digit"] / per_byte, c["stop"] / per_word, c["exclaim"] / per_word,
            c["bar"] / per_word, c["sign"] / per_word, c["high"] / per_byte, _share(ends - starts, at) / per_word,
            _repeats(words, at) / per_word, _share(same, at) / per_word, _repeats(pairs, at) / per_word,
            _repeats(span_hashes(low, ls, le), line_at) / lines, np.log1p(n / lines), _share(~_END[raw[ends - 1]], at) / per_word]))
    return np.concatenate(out)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``stats`` (array of doubles) of every row; no shuffle."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=[id_col, "stats"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, stats array<double>")


def pav(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling: knots (mean x of each block) and their values, for linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            p = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], p, strict=True)]
    sums = np.array(blocks).reshape(-1, 3)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


class QualityModel:
    """Scores rows of STATISTICS; small enough to travel inside a task."""

    def __init__(self, mean, scale, low=None, high=None, seed: int = 7, width: float = 4.0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean, float), np.asarray(scale, float)
        self.low, self.high = (np.full(len(self.mean), x) if e is None else np.asarray(e, float) for e, x in ((low, -np.inf), (high, np.inf)))
        self.w = rng.normal(size=(len(self.mean), FEATURES)) / width
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.knots, self.values = np.zeros(FEATURES + len(self.mean) + 1), np.zeros(1), np.full(1, 0.5)

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.clip(x, self.low, self.high) - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(z)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b) * 4])

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip(np.interp(self.lift(x) @ self.weights, self.knots, self.values), 0, 1)
        return np.where(x[:, STATISTICS.index("log_words")] > 0, s, 0.0)


def fit(labelled: DataFrame, ridge: float = 1.0) -> QualityModel:
    """Fit on rows (stats, label 0/1, fold): sums of each partition travel, rows stay."""
    k = len(STATISTICS)
    m = labelled.agg(*[f(F.get("stats", F.lit(i))).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("low", F.min), ("high", F.max))], F.avg("label").alias("y"), F.count("label").alias("n")).first()
    each = lambda n, other: [m[f"{n}{i}"] if m[f"{n}{i}"] else other for i in range(k)]
    model = QualityModel(each("m", 0), each("s", 1), each("low", 0), each("high", 0))
    if not m["n"] or m["y"] in (0, 1):
        model.values = np.full(1, 0.5 if not m["n"] else float(m["y"]))
        return model

    def sums(frames):
        total: dict[int, np.ndarray] = {}
        for f in frames:
            z = np.column_stack([model.lift(np.stack(f["stats"].to_numpy())), f["label"].to_numpy(float)]) if len(f) else np.zeros((0, 1))
            for fold in f["fold"].unique():
                part = z[(f["fold"] == fold).to_numpy()]
                total[int(fold)] = total.get(int(fold), 0) + part.T @ part
        yield pd.DataFrame({"fold": list(total), "sums": [t.tobytes() for t in total.values()]})

    d = FEATURES + k + 1
    grams: dict[int, np.ndarray] = {}
    for r in labelled.mapInPandas(sums, "fold int, sums binary").collect():
        grams[r["fold"]] = grams.get(r["fold"], 0) + np.frombuffer(r["sums"]).reshape(d + 1, d + 1)
    whole = sum(grams.values())
    penalty = ridge * np.diag(np.r_[1e-6, np.ones(d - 1)])
    solve = lambda g: np.linalg.solve(g[:d, :d] + penalty, g[:d, d])
    model.weights = solve(whole)
    by_fold = {f: solve(whole - g) if len(grams) > 1 else model.weights for f, g in grams.items()}

    def raw(frames):
        for f in frames:
            z = model.lift(np.stack(f["stats"].to_numpy())) if len(f) else np.zeros((0, d))
            w = np.array([by_fold[x] for x in f["fold"]]).reshape(-1, d)
            yield pd.DataFrame({"raw": (z * w).sum(1), "label": f["label"].to_numpy(float)})

    held = labelled.mapInPandas(raw, "raw double, label double").toPandas()  # at most max_labelled rows
    model.knots, model.values = pav(held["raw"].to_numpy(), held["label"].to_numpy())
    return model


def bounded_sample(labels: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key: all where there are no more."""
    n = labels.count()
    if n <= most:
        return labels
    share = int((1 << 31) * 0.95 * most / n)
    return labels.filter(F.xxhash64(key).bitwiseAND(F.lit((1 << 31) - 1)) < share)


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 100_000, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score and predicted of every document; learns only from rows whose crc32(id) mod 5 isn't 0. Of several labels of one id the larger counts."""
    stats = written(document_statistics(docs, id_col, text_col), "quality-stats")
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)).cast("int")
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)").groupBy(id_col).agg(F.max("label").alias("label")).withColumn("fold", fold).filter("fold != 0")
    sample = bounded_sample(known, id_col, max_labelled)
    model = fit(written(stats.join(sample, id_col).select("stats", "label", "fold").repartition(16), "quality-fit"))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS)) if b.num_rows else np.zeros((0, len(STATISTICS)))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = stats.schema[id_col].dataType.simpleString()
    scored = stats.mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int")
    return scored.select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_quality_classifier(spark, sf_dir):
    return score_quality(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
