"""Sets of 64-bit keys as bitmap rows, built and tested with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col, fresh, written

#: Bits of one row of a bitmap table; fixed by bitmap_construct_agg.
BITMAP_BITS = 32768
#: Bitmaps are broadcast up to this size, and joined by bucket beyond it.
BROADCAST_BYTES = 16 << 20


def size_for(rows: int, bits_per_row: int) -> int:
    """Bits, a power of two."""
    return 1 << max(16, (max(rows, 1) * bits_per_row - 1).bit_length())


def positions(key, bits: int, seed: int = 0):
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(bits - 1))


def bitmap(marks: DataFrame) -> DataFrame:
    """(bucket, bitmap) rows of the bit positions in column ``pos``."""
    return marks.groupBy(F.shiftright("pos", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("pos").bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bitmap"))


def keys_seen_twice(keys: DataFrame, bits: int, hashes: int = 1) -> DataFrame:
    """The bitmap of keys (the frame's one column) that may occur in two rows: only positions are shuffled, counted before that."""
    key = col(keys.columns[0])
    pos = keys.select(F.explode(F.array(*[positions(key, bits, i) for i in range(hashes)])).alias("pos"))
    return bitmap(pos.groupBy("pos").count().filter("count > 1"))


def keys_present(keys: DataFrame, bits: int, hashes: int = 1) -> DataFrame:
    key = col(keys.columns[0])
    return bitmap(keys.select(F.explode(F.array(*[positions(key, bits, i) for i in range(hashes)])).alias("pos")))


def flag(rows: DataFrame, key: Column, marked: DataFrame, bits: int, hashes: int = 1, mixed: bool = False, most: int = BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """The rows with one more column, and its name: whether all bits of the key are set. Rows are shuffled only if the bitmap is too large to broadcast (``most`` bytes).

    A key that is ``mixed``, a well-mixed 64-bit hash itself, stands at its own low bits."""
    small = bits // 8 <= most
    columns, holds = rows.columns, F.lit(True)
    out, *names = fresh(columns, "maybe", *[f"{x}{i}" for i in range(hashes) for x in ("at", "bucket", "bits")])
    for i in range(hashes):
        at, bucket, bits_of = names[3 * i : 3 * i + 3]
        side = marked.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bits_of))
        rows = rows.withColumn(at, key.bitwiseAND(F.lit(bits - 1)) if mixed else positions(key, bits, i)).withColumn(bucket, F.shiftright(at, 15))
        rows = rows.join(F.broadcast(side) if small else side, bucket, "left")
        inside = F.col(at).bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bits_of), F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
        holds = holds & F.coalesce(F.call_function("getbit", byte, inside.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.select(*map(col, columns), holds.alias(out)), out


def may_hold(rows: DataFrame, key: Column, marked: DataFrame, bits: int, mixed: bool = False) -> DataFrame:
    """The rows whose key's bit is set."""
    flagged, maybe = flag(rows, key, marked, bits, mixed=mixed)
    return flagged.filter(col(maybe)).drop(maybe)


def split(rows: DataFrame, key_col: str, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By the keys of ``keys`` (a written one-column frame without repeats): rows that pass by unshuffled, rows with another key after all, rows with one of the keys.

    Only rows whose bit is set are shuffled. Null keys are no keys."""
    bits = size_for(keys.count(), 16)
    flagged, maybe = flag(rows, col(key_col), written(keys_present(keys, bits), "keys"), bits)
    (wanted,) = fresh(flagged.columns, "wanted")
    one = keys.select(col(keys.columns[0]).alias(wanted))
    asked = flagged.filter(col(maybe)).drop(maybe)
    return flagged.filter(~col(maybe)).drop(maybe), asked.join(one, col(key_col) == col(wanted), "left_anti"), asked.join(one, col(key_col) == col(wanted), "left_semi")


def without(rows: DataFrame, key_col: str, dropped: DataFrame) -> DataFrame:
    """Rows whose key isn't in ``dropped`` (a written one-column frame without repeats); null keys stay."""
    through, others, _ = split(rows, key_col, dropped)
    return through.unionByName(others)
