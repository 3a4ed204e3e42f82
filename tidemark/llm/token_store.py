"""A content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream into chunks, so equal
passages give equal chunks wherever they stand. Files (Parquet, in the folder of the store):

* ``chunks``: hash (blake2b, 16 bytes), ids (little-endian, ``width`` bytes each), each once;
* ``recipes``: root (Merkle root over chunk hashes), hashes (16 bytes each), each once;
* ``documents``: id, n_tokens, root, start, part: in ascending id order, range-partitioned;
* ``manifest``: part, documents, n_tokens, root (Merkle root over blocks of the part's document rows);
* ``root``: one row for the whole store: parts, documents, n_tokens, root (Merkle root over the parts').

Reading back checks everything: each chunk against its hash, each recipe against its root, each
document's token count against its chunks, and, before any of that, the document rows against the
manifest and the manifest against the store's root, block by block (``verify``). The CRC of a
document comes from the CRCs of its chunks as read, joined by the CRC's own algebra, so payloads are
not moved again; ``reconstruct`` gives the ids themselves. A chunk or a recipe that very many
documents share is unique on its own side of each join, and both sides are shuffled for that join
alone, so Spark can split the other side.

Defined cases: a null text counts as empty and holds the end id alone; ids are numbers (others
become null); equal ids are ordered by their root and counted one after the other; a null id sorts
first; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .bpe import codec, tokenizer_path
from .shared import lean, new_path
from .textcore import mix

WINDOW = 16
#: A cut on average every so many ids (a power of two), and at the latest after MOST ids.
MEAN, MOST = 256, 2048
HASH = 16


def _hash(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=HASH).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node is carried up; no leaves give the hash of nothing."""
    if not leaves:
        return _hash(b"")
    level = [_hash(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [_hash(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Chunk ends in ``ids``, whose documents begin and end at ``rows``: where the window's hash is 0 modulo MEAN, at row ends, and every MOST ids."""
    x = mix(ids.astype(np.uint64) + np.uint64(1))
    n = len(ids)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h[i:] += x[: n - i] * np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64))
    begin = np.repeat(rows[:-1], np.diff(rows))
    far = np.arange(n) - begin >= WINDOW - 1  # the window lies inside the document
    ends = np.union1d(np.flatnonzero(far & ((h >> np.uint64(40)) % np.uint64(MEAN) == 0)) + 1, rows[1:])
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    extra = (ends - starts - 1) // MOST
    if extra.any():
        more = np.concatenate([s + MOST * np.arange(1, k + 1) for s, k in zip(starts[extra > 0], extra[extra > 0], strict=True)])
        ends = np.union1d(ends, more)
    return ends


_shift: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The CRCs after so many zero bytes, without pre- and post-inversion: what zlib's crc32_combine does to its first part."""
    if not _shift:
        one = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
        step = lambda m, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint32)) & 1, m, 0), axis=1).astype(np.uint32)
        m = one
        for _ in range(3):
            m = step(m, m)
        for _ in range(48):
            tables = np.stack([step(m, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)])
            _shift.append(tables)
            m = step(m, m)
    out, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        on = (zeros >> k) & 1 == 1
        t, v = _shift[k], out[on]
        out[on] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return out


_ROWS = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])
CHUNK, RECIPE, DOCUMENT = 0, 1, 2


def _encode(path: str, end_id: int, dtype: str):
    """Rows of all three kinds from (id, text) batches; chunks and recipes once per batch."""

    def run(batches):
        words, wide = codec(path), np.dtype(dtype).itemsize
        for b in batches:
            seen: set[bytes] = set()
            all_ids = b.column(0).to_pylist()
            for first, last, ids, at in words.encode(b.column(1)):
                rows_out: list[tuple] = []
                rows = at + np.arange(len(at))  # each document's ids and its end id
                stream = np.full(int(rows[-1]), end_id, np.uint32)
                keep = np.ones(len(stream), bool)
                keep[rows[1:] - 1] = False
                stream[keep] = ids
                ends = cuts(stream, rows)
                begins = np.concatenate([[0], ends[:-1]])
                raw = stream.astype(dtype).tobytes()
                hashes = []
                for s, e in zip((begins * wide).tolist(), (ends * wide).tolist(), strict=True):
                    piece = raw[s:e]
                    hashes.append(h := _hash(piece))
                    if h not in seen:
                        seen.add(h)
                        rows_out.append((CHUNK, h, None, None, piece))
                of = np.searchsorted(ends, rows, "right").tolist()
                for i in range(last - first):
                    recipe = hashes[of[i] : of[i + 1]]
                    root = merkle_root(recipe)
                    if root not in seen:
                        seen.add(root)
                        rows_out.append((RECIPE, root, None, None, b"".join(recipe)))
                    rows_out.append((DOCUMENT, root, all_ids[first + i], int(rows[i + 1] - rows[i]), None))
                cols = zip(*rows_out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

    return run


def _once(batches):
    """Chunks and recipes of a partition once each: equal keys meet in one partition."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for kind, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keep.append(kind == DOCUMENT or key not in seen)
            if kind != DOCUMENT:
                seen.add(key)
        yield b.filter(pa.array(keep, pa.bool_()))


#: Document rows under one node of a part's Merkle tree.
BLOCK_ROWS = 1024


def _leaf(doc_id, n_tokens, root) -> bytes:
    return _hash(repr((doc_id, n_tokens, root)).encode())


def _ordered(batches):
    """Documents of one range partition: their places and starts within it; at its end a manifest row with its Merkle root."""
    start, leaves, blocks, part, n = 0, [], [], None, 0
    schema = pa.schema([("row", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("start", pa.int64())])
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0)[0].as_py()
        tokens = b.column(2).to_numpy(zero_copy_only=False)
        starts = start + np.concatenate([[0], np.cumsum(tokens)[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(["documents"] * b.num_rows), b.column(0), pa.array(np.arange(n, n + b.num_rows)), b.column(1), b.column(2), b.column(3), pa.array(starts, pa.int64())], schema=schema)
        start, n = start + int(tokens.sum()), n + b.num_rows
        leaves += [_leaf(*x) for x in zip(b.column(1).to_pylist(), tokens.tolist(), b.column(3).to_pylist(), strict=True)]
        while len(leaves) >= BLOCK_ROWS:
            blocks.append(merkle_root(leaves[:BLOCK_ROWS]))
            leaves = leaves[BLOCK_ROWS:]
    if n:
        blocks += [merkle_root(leaves)] if leaves else []
        yield pa.RecordBatch.from_arrays([pa.array(["manifest"]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([None], pa.int64()), pa.array([start], pa.int64()), pa.array([merkle_root(blocks)], pa.binary()), pa.array([0], pa.int64())], schema=schema)


_INDEX = "part int, place long, doc_id long, n_tokens long, root binary, start long"


class TokenStore:
    """A written store; every method reads its files."""

    def __init__(self, spark: SparkSession, path: str, dtype: str = "<u2"):
        self.spark, self.path, self.dtype = spark, path, dtype

    @classmethod
    def write(cls, docs: DataFrame, store: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
        spark = docs.sparkSession
        dtype = "<u2" if max(codec(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_encode(tokenizer, end_id, dtype)), _sql(_ROWS))
        place = F.when(F.col("kind") == DOCUMENT, F.xxhash64("doc_id", "n_tokens")).otherwise(F.xxhash64("key"))
        (rows.withColumn("place", place).repartition("place").drop("place").mapInArrow(lean(_once), _sql(_ROWS))
            .write.partitionBy("kind").option("compression", "zstd").parquet(f"{store}/objects"))
        found = spark.read.schema(_sql(_ROWS)).parquet(f"{store}/objects").filter(F.col("kind") == DOCUMENT)
        (found.select("doc_id", "n_tokens", F.col("key").alias("root")).repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
            .select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "root")
            .mapInArrow(lean(_ordered), f"row string, {_INDEX}")
            .write.partitionBy("row").parquet(f"{store}/index"))
        out = cls(spark, store, dtype)
        parts = out.manifest().orderBy("part").collect()  # one row for each written part
        n, documents, tokens, roots = 0, 0, 0, []
        for r in parts:
            n, documents, tokens, roots = n + 1, documents + r["documents"], tokens + r["n_tokens"], [*roots, bytes(r["root"])]
        spark.createDataFrame([(n, documents, tokens, bytearray(merkle_root(roots)))], "parts long, documents long, n_tokens long, root binary").write.parquet(f"{store}/root")
        return out

    def _objects(self, kind: int) -> DataFrame:
        return self.spark.read.schema(_sql(_ROWS)).parquet(f"{self.path}/objects").filter(F.col("kind") == kind)

    def _index(self, row: str) -> DataFrame:
        return self.spark.read.schema(f"{_INDEX}, row string").parquet(f"{self.path}/index").filter(F.col("row") == row)

    def manifest(self) -> DataFrame:
        """One row per part: documents, n_tokens, root; and base, the ids in all parts before it."""
        rows = self._index("manifest").select("part", F.col("place").alias("documents"), "n_tokens", "root")
        before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file part
        return rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def documents(self) -> DataFrame:
        bases = self.manifest().select("part", "base")  # Spark broadcasts it while it is small
        return self._index("documents").join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "root", "part")

    def recipes(self) -> DataFrame:
        """root, k, hash of each recipe, checked against its root."""

        def run(batches):
            for b in batches:
                roots, k, out = [], [], []
                for root, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    leaves = [packed[i : i + HASH] for i in range(0, len(packed), HASH)]
                    if merkle_root(leaves) != root:
                        raise ValueError(f"recipe {root.hex()} doesn't match its root")
                    roots += [root] * len(leaves)
                    k += range(len(leaves))
                    out += leaves
                yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(k, pa.int64()), pa.array(out, pa.binary())], names=["root", "k", "hash"])

        return self._objects(RECIPE).select("key", "body").mapInArrow(lean(run), "root binary, k long, hash binary")

    def chunks(self) -> DataFrame:
        """hash, n_ids and crc (of the ids as 4 bytes each) of each chunk as read, checked against its hash."""
        dtype = self.dtype

        def run(batches):
            for b in batches:
                keys, n, crc = b.column(0).to_pylist(), [], []
                for key, body in zip(keys, b.column(1).to_pylist(), strict=True):
                    if _hash(body) != key:
                        raise ValueError(f"chunk {key.hex()} doesn't match its hash")
                    ids = np.frombuffer(body, dtype)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["hash", "n_ids", "crc"])

        return self._objects(CHUNK).select("key", "body").mapInArrow(lean(run), "hash binary, n_ids long, crc long")

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
        lists = self.recipes().join(self.chunks(), "hash").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("k", "n_ids", "crc"))).alias("parts"))

        def run(batches):
            for b in batches:
                flat = b.column(1).flatten() if b.num_rows else None
                if flat is None:
                    continue
                n, crc = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                lengths = np.diff(b.column(1).offsets.to_numpy())
                ends = np.cumsum(lengths)
                total = np.concatenate([[0], np.cumsum(n)])
                of = np.repeat(np.arange(len(lengths)), lengths)
                after = total[ends][of] - total[1:]
                moved = crc_shift(crc.astype(np.uint32), 4 * after)
                out = np.bitwise_xor.reduceat(moved, ends - lengths)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total[ends] - total[ends - lengths], pa.int64()), pa.array(out.astype(np.int64))], names=["root", "read", "ids_crc32"])

        sums = lists.mapInArrow(lean(run), "root binary, read long, ids_crc32 long")
        short = F.when(F.col("read").eqNullSafe(F.col("n_tokens")), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document isn't whole in the store")).cast("long"))
        return self.documents().join(sums, "root", "left").select("doc_id", "start", short.alias("n_tokens"), "ids_crc32")

    def reconstruct(self, ids: list[int] | None = None) -> DataFrame:
        """doc_id and its ids as an array, in order; of all documents or those listed."""
        dtype = self.dtype
        docs = self.documents()
        docs = docs.filter(F.col("doc_id").isin(ids)) if ids is not None else docs

        def run(batches):
            for b in batches:
                out = [np.concatenate([np.frombuffer(x["body"], dtype) for x in parts]).astype(np.int64).tolist() for parts in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

        parts = docs.join(self.recipes(), "root").join(self._objects(CHUNK).select(F.col("key").alias("hash"), "body"), "hash")
        return parts.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "body"))).alias("parts")).select("doc_id", "parts").mapInArrow(lean(run), "doc_id long, ids array<long>")

    def verify(self) -> TokenStore:
        """Check the document rows against the manifest and the manifest against the store's root; raise where they differ."""

        def block(key, table):
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "doc_id", "n_tokens", "root")), strict=True), key=lambda x: x[0])
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "tokens": pa.array([sum(x[2] for x in rows)], pa.int64()), "root": pa.array([merkle_root([_leaf(*x[1:]) for x in rows])], pa.binary())})

        def part(key, table):
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "n", "tokens", "root")), strict=True))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(x[1] for x in rows)], pa.int64()), "tokens": pa.array([sum(x[2] for x in rows)], pa.int64()), "found": pa.array([merkle_root([x[3] for x in rows])], pa.binary())})

        blocks = self._index("documents").groupBy("part", F.floor(F.col("place") / BLOCK_ROWS).alias("block")).applyInArrow(block, "part int, block long, n long, tokens long, root binary")
        found = blocks.groupBy("part").applyInArrow(part, "part int, n long, tokens long, found binary")
        same = F.col("root").eqNullSafe(F.col("found")) & F.col("documents").eqNullSafe(F.col("n")) & F.col("n_tokens").eqNullSafe(F.col("tokens"))
        both = self.manifest().join(found, "part", "full").select("part", "n", "tokens", "found", same.alias("whole"))
        n, documents, tokens, roots = 0, 0, 0, []
        for r in both.orderBy("part").collect():  # one row for each written part
            if not r["whole"]:
                raise ValueError(f"part {r['part']} of the store doesn't match the manifest")
            n, documents, tokens, roots = n + 1, documents + r["n"], tokens + r["tokens"], [*roots, bytes(r["found"])]
        whole = self.spark.read.parquet(f"{self.path}/root").collect()
        if [(r["parts"], r["documents"], r["n_tokens"], bytes(r["root"])) for r in whole] != [(n, documents, tokens, merkle_root(roots))]:
            raise ValueError("the store's manifest doesn't match its root")
        return self


def _sql(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary", "string": "string"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def op5_token_store(spark, sf_dir):
    docs = settle(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return TokenStore.write(docs, new_path(spark, "store"), tokenizer_path()).verify().checksums()
