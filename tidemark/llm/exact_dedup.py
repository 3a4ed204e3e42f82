"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every row to ``hashes`` bit positions of a Bloom filter and marks the
positions that at least two rows set (only 8-byte positions are shuffled, summed before the
shuffle). Pass two tests every row against the marked positions: a row with a position that
no other row set has no copy and passes straight through; only the other rows, repeats and
a few false positives, are shuffled by their SHA-256 and grouped exactly. Both passes see digests alone.
Documents are then tested against a filter of the repeated digests, whose size follows their number and
not the documents': a document without a copy is never moved. A filter beyond ``FILTER_BYTES`` can't be
handed to every task; digests (32 bytes and an id) are then grouped without the first pass, and documents
whose digests can't be told apart before moving move once.

Defined cases: a null text counts as empty; a null id sorts below all others; rows with
equal id and equal text are all ``kept`` in the decisions, and ``drop_exact_copies`` leaves
one of them; an empty table gives an empty result; other columns pass through unread,
whatever they are called (internal names avoid them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .bitmaps import flag, keys_present, keys_seen_twice, size_for
from .shared import col, fresh, written

#: Bits of the filter for each row, and positions of each row.
BITS_PER_ROW, HASHES = 16, 2
#: The largest filter that every task is handed: 67 million rows, or repeated digests.
FILTER_BYTES = 128 << 20
#: At most so many of the largest groups are broadcast; groups beyond them are shuffled, so small that no task is held up.
HOT = 100_000


def digest(text_col: str):
    """The SHA-256 of the text in UTF-8 (null: empty), as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(col(text_col), F.lit("")).cast("binary"), 256))


def _tested(rows: DataFrame, sha: str, keys: DataFrame, n: int, seen) -> tuple[DataFrame, str]:
    """The rows with a column, and its name: whether ``seen`` (a filter's marks from keys and bits) holds their digest; all of them where the filter for ``n`` keys is too large."""
    bits = size_for(n, BITS_PER_ROW)
    if bits // 8 > FILTER_BYTES:
        (maybe,) = fresh(rows.columns, "maybe")
        return rows.withColumn(maybe, F.lit(True)), maybe
    return flag(rows, F.col(sha), written(seen(keys, bits, HASHES), "bloom"), bits, HASHES, most=FILTER_BYTES)


def _plan(docs: DataFrame, id_col: str, text_col: str):
    """Digests with the flag of a possible copy; the exact groups of at least two rows, the hot ones (by size) apart."""
    digests = written(docs.select(col(id_col).alias("id"), digest(text_col).alias("sha")), "digests")
    n = digests.count()
    flagged, maybe = _tested(digests, "sha", digests.select("sha"), n, keys_seen_twice)
    groups = flagged.filter(F.col(maybe)).groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = written(groups.withColumn("hot", F.col("size") > max(1000, n // HOT)), "groups")  # at most HOT hot ones
    return flagged.withColumnRenamed(maybe, "maybe"), groups


def _grouped(rows: DataFrame, id_col: str, sha: str, groups: DataFrame, only_kept: bool = False) -> tuple[DataFrame, str, str]:
    """The rows with their group's id that stays and its size (null without a group), and the names of both: hot groups by broadcast, the rest by a join on the digest, in which rows of hot groups are spread by their ids."""
    keep, size, spread, hot_keep, hot_size = fresh(rows.columns, "keep", "size", "spread", "hot_keep", "hot_size")
    named = lambda which, k, n, key: groups.filter(which).select(F.col("sha").alias(key), F.col("keep").alias(k), F.col("size").alias(n))
    kept = lambda k, n: F.col(n).isNull() | col(id_col).eqNullSafe(F.col(k)) if only_kept else F.lit(True)
    found = rows.join(F.broadcast(named("hot", hot_keep, hot_size, sha)), sha, "left").filter(kept(hot_keep, hot_size))
    elsewhere = F.concat(F.col(sha), F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary"))
    found = found.withColumn(spread, F.when(F.col(hot_size).isNull(), F.col(sha)).otherwise(elsewhere)).join(named("NOT hot", keep, size, spread), spread, "left").filter(kept(keep, size))
    first = F.when(F.col(hot_size).isNotNull(), F.col(hot_keep)).otherwise(F.col(keep))
    return found.withColumns({keep: first, size: F.coalesce(hot_size, size)}).drop(spread, hot_keep, hot_size), keep, size


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One decision per row: id, keep_id, group_size, kept, text_sha256; the largest id of equal texts stays."""
    flagged, groups = _plan(docs, id_col, text_col)
    alone = flagged.filter("NOT maybe").select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"))
    rest = _grouped(flagged.filter("maybe").drop("maybe"), "id", "sha", groups)[0].select(
        "id", "sha", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    return alone.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their copies, all columns; rows without a copy (but for a few) are not shuffled."""
    _, groups = _plan(docs, id_col, text_col)
    (sha,) = fresh(docs.columns, "sha")
    rows, maybe = _tested(docs.select("*", digest(text_col).alias(sha)), sha, groups.select("sha"), groups.count(), keys_present)
    columns = [col(c) for c in docs.columns]
    again = _grouped(rows.filter(col(maybe)), id_col, sha, groups, only_kept=True)[0].dropDuplicates([id_col, sha])  # rows may be equal in id and text
    return rows.filter(~col(maybe)).select(*columns).unionByName(again.select(*columns))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
