"""Packing documents into sequences of bounded length by a grouping genetic algorithm.

A document's ids and its end id are one piece; only longer ones are cut into full pieces. The
pieces are dealt into shards of about ``SHARD_PIECES``. Each shard is evolved on ``ISLANDS``
islands, each a group of its own: a crossover injects whole well-filled bins of one parent into
the other, removes the bins that hold duplicates of the injected pieces and best-fits the
displaced pieces, largest first. Between epochs each island sends its elite to its neighbour; at
the end the islands of a shard meet. Bins that are then still not well filled are taken apart and
their pieces dealt anew among all shards of the next level, so slack is pooled over all data.

Defined cases: a null or empty text is one piece that holds the end id alone; ids are numbers
(others become null); rows with equal ids are packed one by one; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .bpe import codec, tokenizer_path
from .shared import lean, written

#: Bytes of text that are cut into ids at a time.
SEGMENT = 1 << 19
SHARD_PIECES, ISLANDS, LEVELS = 2000, 2, 3
POPULATION, GENERATIONS = 6, 8
#: A bin is well filled if at most this share of it is free.
FREE = 1 / 256


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            all_ids = b.column(0).to_pylist()
            for first, last, ids, at in codec(path).encode(b.column(1), SEGMENT):
                out: list[tuple] = []
                raw, end = ids.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
                for i in range(last - first):
                    body = raw[4 * at[i] : 4 * at[i + 1]] + end
                    for k, s in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[s : s + 4 * capacity]
                        out.append((all_ids[first + i], k, s // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, and what each has free."""

    def __init__(self, bins: list[list[int]], free: list[int]):
        self.bins, self.free = bins, free

    @classmethod
    def of(cls, labels: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
        order = np.argsort(labels, kind="stable")
        cut = np.flatnonzero(np.diff(labels[order])) + 1
        bins = [g.tolist() for g in np.split(order, cut)]
        return cls(bins, [capacity - int(sizes[g].sum()) for g in bins])

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins, then more uneven ones: slack gathered in few bins can still take pieces."""
        return -len(self.bins), float(np.sum((1 - np.array(self.free) / capacity) ** 2))


def best_fit(p: Packing, items: list[int], sizes: list[int], capacity: int) -> None:
    """Put each item where the least stays free, in the order given; open a bin where none has room."""
    room = sorted((f, i) for i, f in enumerate(p.free) if f > 0)
    for x in items:
        at = bisect.bisect_left(room, (sizes[x], -1))
        if at == len(room):
            p.bins.append([x])
            p.free.append(capacity - sizes[x])
            left, i = p.free[-1], len(p.bins) - 1
        else:
            left, i = room.pop(at)
            left -= sizes[x]
            p.bins[i].append(x)
            p.free[i] = left
        if left:
            bisect.insort(room, (left, i))


def cross(a: Packing, b: Packing, rng: np.random.Generator, sizes: list[int], capacity: int) -> Packing:
    """Inject some of b's best-filled bins into a; best-fit what that displaces."""
    order = np.argsort(b.free, kind="stable")
    few = max(1, len(order) // 2)
    chosen = order[:few][rng.random(few) < rng.uniform(0.2, 0.8)]
    injected = {x for i in chosen for x in b.bins[i]}
    child = Packing([b.bins[i] for i in chosen], [b.free[i] for i in chosen])
    displaced = []
    worst = np.sort(a.free)[-max(1, len(a.free) // 50)]
    for items, free in zip(a.bins, a.free, strict=True):
        if free >= max(worst, 1) or not injected.isdisjoint(items):
            displaced += [x for x in items if x not in injected]
        else:
            child.bins.append(items)
            child.free.append(free)
    child.bins = [list(x) for x in child.bins]
    best_fit(child, sorted(displaced, key=lambda x: -sizes[x]), sizes, capacity)
    return child


def evolve(start: list[Packing], sizes: np.ndarray, capacity: int, seed: int) -> Packing:
    rng, size = np.random.default_rng(seed), sizes.tolist()
    population, bound = list(start), -(-int(sizes.sum()) // capacity)
    while len(population) < POPULATION:
        noise = 1 if not population else rng.uniform(0.8, 1.2, len(sizes))
        p = Packing([], [])
        best_fit(p, np.argsort(-sizes * noise, kind="stable").tolist(), size, capacity)
        population.append(p)
    fit = lambda p: p.fitness(capacity)
    population.sort(key=fit, reverse=True)
    for _ in range(GENERATIONS):
        if len(population[0].bins) <= bound:
            break
        for _ in range(2):
            i, j = rng.choice(len(population), 2, replace=False, p=np.arange(len(population), 0, -1) / (len(population) * (len(population) + 1) / 2))
            population.append(cross(population[i], population[j], rng, size, capacity))
        population = sorted(population, key=fit, reverse=True)[:POPULATION]
    return population[0]


_COLS = "rid long, length long"


def _epoch(capacity: int, level: int, last: bool):
    """One group's rows: each piece once for each individual that came in (``role``); the best individual goes out."""

    def run(key, pdf):
        roles = sorted(pdf["role"].unique().tolist())
        pdf = pdf.sort_values(["role", "rid"], kind="stable")
        items = pdf[pdf["role"] == roles[0]].reset_index(drop=True)
        sizes = items["length"].to_numpy(np.int64)
        start = [Packing.of(labels, sizes, capacity) for r in roles if (labels := pdf.loc[pdf["role"] == r, "bin"].to_numpy())[0] >= 0]
        best = evolve(start, sizes, capacity, seed=hash((level, last, *map(int, key))) & 0x7FFFFFFF)
        label, free = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for i, (b, f) in enumerate(zip(best.bins, best.free, strict=True)):
            label[b], free[b] = i, f
        return items.assign(bin=label, free=free).drop(columns="role")

    return run


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows of ``pieces``."""
    parts = written(parts.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    names = [f.split()[0] for f in _COLS.split(", ")]
    done = [parts.filter(F.col("length") == capacity).select(*names, (F.lit(LEVELS << 56) + F.col("rid")).alias("sequence_id"))]
    rest, out_cols = parts.filter(F.col("length") < capacity).select(*names), f"shard long, island int, {_COLS}, bin long, free long"
    for level in range(LEVELS):
        n = rest.count()
        if not n:
            break
        shards = -(-n // SHARD_PIECES)
        shard = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(shards))
        first = rest.select(shard.alias("shard"), F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), *names, F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("free"), F.lit(0).alias("role"))
        elites = first.groupBy("shard", "island").applyInPandas(_epoch(capacity, level, False), out_cols)
        elites = written(elites, "elites")
        migrants = elites.select("shard", F.explode(F.array(F.struct("island", F.lit(0).alias("role")), F.struct(F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.lit(1).alias("role")))).alias("to"), *names, "bin", "free").select("shard", "to.*", *names, "bin", "free")
        again = migrants.groupBy("shard", "island").applyInPandas(_epoch(capacity, level, False), out_cols)
        meet = again.withColumn("role", F.col("island")).withColumn("island", F.lit(0)).groupBy("shard").applyInPandas(_epoch(capacity, level, True), out_cols)
        meet = written(meet, "packed")
        good = F.lit(level == LEVELS - 1 or shards == 1) | (F.col("free") <= int(capacity * FREE))
        done.append(meet.filter(good).select(*names, (F.lit(level << 56) + F.col("shard") * (1 << 24) + F.col("bin")).alias("sequence_id")))
        rest = meet.filter(~good).select(*names)
        if shards == 1:
            break
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    before = Window.partitionBy("sequence_id").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("rid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset"))
    return parts.join(placed, "rid").drop("rid")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, path or tokenizer_path(), capacity, id_col=id_col, text_col=text_col), capacity)


def op4_best_fit_packing(spark, sf_dir):
    return pack_documents(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"))
