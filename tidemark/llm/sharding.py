"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A point is a group of equal texts: its weight is the bytes of all its rows (UTF-8 plus one each), its
place on every metadata dimension the least value of its rows. A node that is to become several shards
is cut along the dimension that is widest in it (its range as a share of the range over all points) at
the weighted quantile that gives either side the bytes of its shards, the median for even numbers; points
that stand at one value are cut by their hash. All nodes of a level are cut together. A cut is found by
histograms: every round sums the weights of some thousand bins over all tasks, the driver takes the bin
in which the quantile lies, and the next round looks into that bin alone, until a single point is left.
So the driver holds bins and cuts, never points, and no task holds a node.

A group that outweighs the mean of the shards still to be filled is a shard by itself; the heaviest come
first and the tree shares what is left among the others, so sizes are as equal as whole groups allow.

Defined cases: a null text counts as empty (size 1, CRC 0) and equals it; null metadata count as 0 or the
empty string; numbers are taken as whole numbers within +-2^60, other values by the first six bytes of
their text; numbers within a shard (``slot``) follow the id, nulls first, then size and CRC; rows equal in
all of these get neighbouring slots in any order; without rows the result is empty; with fewer groups than
shards some shards stay empty; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.session import settle

from .exact_dedup import HOT
from .ranking import numbered
from .shared import col, written

DIMENSIONS = ("source", "lang", "n_chars")
SHARDS = 8
#: Bins of a histogram, over all nodes of a level; values beyond the limit count as the limit.
BINS, LIMIT = 8192, 1 << 60


def coordinate(docs: DataFrame, name: str) -> Column:
    """A column's value as a whole number that keeps its order."""
    if isinstance(docs.schema[name].dataType, NumericType):
        return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.coalesce(col(name).cast("long"), F.lit(0).cast("long"))))
    head = F.hex(F.substring(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary"), 1, 6))
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("long")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, written into the plan as one literal."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def _bins(points: DataFrame, open_: dict, dims: int) -> dict:
    """For each open node its bins in order: (weight, least value, largest value)."""
    room = max(16, BINS // len(open_))
    asked = [(n, o["dim"], o["value"], o["low"], o["high"], (o["high"] - o["low"]) // room + 1) for n, o in open_.items()]
    asked = _small(points.sparkSession, asked, "first int, dim int, value long, low long, high long, step long")
    place = reduce(lambda x, i: x.when(F.col("dim") == i, F.col(f"c{i}")), range(dims), F)  # F.when starts the chain
    v = F.when(F.col("value").isNull(), F.col("place")).otherwise(F.col("hash"))
    inside = points.join(F.broadcast(asked), "first").withColumn("place", place).withColumn("v", v)
    inside = inside.filter((F.col("value").isNull() | (F.col("place") == F.col("value"))) & F.col("v").between(F.col("low"), F.col("high")))
    found: dict = {n: [] for n in open_}
    for r in inside.groupBy("first", F.expr("(v - low) div step").alias("bin")).agg(F.sum("weight").alias("weight"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        found[r["first"]].append((r["bin"], r["weight"], r["low"], r["high"]))
    return {n: [b[1:] for b in sorted(bins)] for n, bins in found.items()}


def _cuts(points: DataFrame, nodes: dict, dims: int) -> list[tuple]:
    """(first, dim, value, hash, whether that point itself goes left, shards on the left) for each node."""
    open_ = {n: o | {"value": None, "before": 0} for n, o in nodes.items()}
    done = []
    while open_:
        for n, bins in _bins(points, open_, dims).items():
            o = open_[n]
            left, k = o["shards"] // 2, o["shards"]
            for weight, low, high in bins:
                if (o["before"] + weight) * k >= o["weight"] * left:
                    break
                o["before"] += weight
            o["low"], o["high"] = low, high
            if low == high and o["value"] is None:  # one value: its points by their hashes
                o |= {"value": low, "low": 0, "high": LIMIT}
            elif low == high:
                done.append((n, o["dim"], o["value"], low, (2 * o["before"] + weight) * k <= 2 * o["weight"] * left, left))
                del open_[n]
    return done


def kd_tree(groups: DataFrame, dims: int, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """The written groups (sha, weight, hash, c0, c1..., first: 0) with their shard in column ``first``."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("weight")).head()[0] or 0
    k = max(1, shards or -(-total // max(1, target_bytes)))
    alone: list = []  # groups that outweigh the mean of what is left: at most k - 1
    left, most = total, 64
    while True:
        top = groups.orderBy(F.desc("weight"), "hash").select("sha", "weight").limit(min(most, k)).collect()
        alone, left = [], total
        for r in top:
            if r["weight"] * (k - len(alone)) <= left:
                break
            alone.append(bytes(r["sha"]))
            left -= r["weight"]
        if len(alone) < most or most >= k:
            break
        most *= 4
    own = _small(spark, [(s.hex(), k - 1 - i) for i, s in enumerate(alone)], "sha string, own int").withColumn("sha", F.unhex("sha"))
    marked = groups.join(F.broadcast(own), "sha", "left")
    points = marked.filter("own IS NULL").drop("own")
    sizes, root = {0: k - len(alone)}, None
    while any(n > 1 for n in sizes.values()):
        ends = [f(f"c{i}").alias(f"{a}{i}") for i in range(dims) for a, f in (("low", F.min), ("high", F.max))]
        seen = {r["first"]: r for r in points.groupBy("first").agg(F.sum("weight").alias("weight"), *ends).collect()}
        if not seen:
            break
        root = root or [max(1, seen[0][f"high{i}"] - seen[0][f"low{i}"]) for i in range(dims)]
        nodes, new = {}, {}
        for n, r in seen.items():
            if sizes[n] == 1:
                new[n] = 1
                continue
            widths = [(r[f"high{i}"] - r[f"low{i}"]) / root[i] for i in range(dims)]
            dim = widths.index(max(widths))
            nodes[n] = {"dim": dim, "low": r[f"low{dim}"], "high": r[f"high{dim}"], "weight": r["weight"], "shards": sizes[n]}
            new |= {n: sizes[n] // 2, n + sizes[n] // 2: sizes[n] - sizes[n] // 2}
        if nodes:
            cuts = _small(spark, _cuts(points, nodes, dims), "first int, dim int, value long, cut long, inclusive boolean, left int")
            place = reduce(lambda x, i: x.when(F.col("dim") == i, F.col(f"c{i}")), range(dims), F)
            goes_left = (place < F.col("value")) | ((place == F.col("value")) & ((F.col("hash") < F.col("cut")) | (F.col("inclusive") & (F.col("hash") == F.col("cut")))))
            points = points.join(F.broadcast(cuts), "first", "left").withColumn("first", F.when(F.col("dim").isNull() | goes_left, F.col("first")).otherwise(F.col("first") + F.col("left")))
            points = points.drop("dim", "value", "cut", "inclusive", "left")
        sizes = new
    return points.unionByName(marked.filter("own IS NOT NULL").drop("first").withColumnRenamed("own", "first").select(*points.columns))


def shard_rows(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, sha, shard) for every row; ``target_bytes`` sets the number of shards where ``shards`` is None."""
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    places = [f"c{i}" for i in range(len(dimensions))]
    rows = written(docs.select(
        col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"),
        *[coordinate(docs, d).alias(c) for d, c in zip(dimensions, places, strict=True)]), "shard-rows")
    hashed = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    groups = rows.groupBy("sha").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(c) for c in places])
    groups = written(groups.withColumns({"hash": hashed, "first": F.lit(0)}), "shard-groups")
    many = max(1000, (groups.agg(F.sum("rows")).head()[0] or 0) // HOT)  # at most HOT groups have more rows
    placed = written(kd_tree(groups, len(dimensions), shards, target_bytes).select("sha", F.col("first").alias("shard"), (F.col("rows") > many).alias("hot")), "shard-leaves")
    hot = placed.filter("hot").select("sha", F.col("shard").alias("hot_shard"))
    rest = placed.filter("NOT hot").select(F.col("sha").alias("key"), "shard")
    found = rows.drop(*places).join(F.broadcast(hot), "sha", "left")
    spread = F.when(F.col("hot_shard").isNull(), F.col("sha")).otherwise(F.concat("sha", F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    found = found.withColumn("key", spread).join(rest, "key", "left")
    return found.select("id", "size", "text_crc32", "sha", F.coalesce("hot_shard", "shard").alias("shard"))


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``)."""
    rows = written(shard_rows(docs, shards, target_bytes, dimensions, id_col, text_col).drop("sha"), "shards")
    out, slot = numbered(rows, "shard", [F.col("id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "slots")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, text_col: str = "text", **options) -> None:
    """The documents as Parquet, one folder ``shard=n`` for each shard; a shard's rows are written by many tasks."""
    digest = F.unhex(F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    leaves = shard_rows(docs, text_col=text_col, **options).select(F.col("sha").alias("__sha"), "shard").distinct()
    docs.withColumn("__sha", digest).join(leaves, "__sha").drop("__sha").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir):
    return shard_documents(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"))


_PREFIX = "CAST('0x' || rpad(substr(hex(encode(coalesce({0}, ''))), 1, 12), 12, '0') AS BIGINT)"
_LEVEL = """, s{0} AS (SELECT first, k, sum(w) AS total, {1} FROM p{0} GROUP BY 1, 2),
 d{0} AS (SELECT p.*, s.total, CASE list_position([w0, w1, w2], greatest(w0, w1, w2)) WHEN 1 THEN c0 WHEN 2 THEN c1 ELSE c2 END AS c FROM p{0} p JOIN (SELECT first, total, {2} FROM s{0}, root) s USING (first)),
 e{0} AS (SELECT *, sum(w) OVER (PARTITION BY first ORDER BY c, h) AS upto FROM d{0}),
 p{3} AS (SELECT sha, w, c0, c1, c2, h, CASE WHEN k = 1 OR goes_left THEN first ELSE first + k // 2 END AS first, CASE WHEN k = 1 THEN 1 WHEN goes_left THEN k // 2 ELSE k - k // 2 END AS k
  FROM (SELECT *, (upto - w) * k < total * (k // 2) AND (2 * upto - w) * k <= 2 * total * (k // 2) AS goes_left FROM e{0}))"""
_ENDS = ", ".join(f"{f}(c{i}) AS {a}{i}" for i in range(3) for a, f in (("lo", "min"), ("hi", "max")))
_WIDTHS = ", ".join(f"(hi{i} - lo{i}) / CAST(r{i} AS DOUBLE) AS w{i}" for i in range(3))
ORACLE = f"""WITH tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) x(i))),
 texts AS MATERIALIZED (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
 crcs AS MATERIALIZED (SELECT t, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(x.t)), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT t, hex(encode(t)) AS hx FROM texts) x, (SELECT t AS tb FROM tab)),
 g AS MATERIALIZED (SELECT sha256(coalesce(text, '')) AS sha, sum(strlen(coalesce(text, '')) + 1) AS w, min({_PREFIX.format("source")}) AS c0, min({_PREFIX.format("lang")}) AS c1, min(coalesce(n_chars, 0)) AS c2, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents GROUP BY 1, 6),
 heavy AS (SELECT sha, i FROM (SELECT sha, i, min(CASE WHEN w * (9 - i) > rest THEN 1 ELSE 0 END) OVER (ORDER BY i) AS own FROM (SELECT sha, w, row_number() OVER (ORDER BY w DESC, h) AS i, sum(w) OVER (ORDER BY w DESC, h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g)) WHERE own = 1 AND i < 9),
 p0 AS (SELECT sha, w, c0, c1, c2, h, 0 AS first, 8 - (SELECT count(*) FROM heavy) AS k FROM g WHERE sha NOT IN (SELECT sha FROM heavy)),
 root AS (SELECT {", ".join(f"greatest(1, max(c{i}) - min(c{i})) AS r{i}" for i in range(3))} FROM p0)""" + "".join(_LEVEL.format(i, _ENDS, _WIDTHS, i + 1) for i in range(3)) + """,
 leaf AS (SELECT sha, first AS shard FROM p3 UNION ALL SELECT sha, 8 - i FROM heavy)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
 FROM (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, crc AS text_crc32, shard FROM documents JOIN crcs ON t = coalesce(text, '') JOIN leaf ON sha = sha256(coalesce(text, '')))
"""
