"""Audit checks as rows, verdicts, manifests, and guards for files."""

from __future__ import annotations

import hashlib
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, FAIL, NONE = "PASS", "FAIL", "INSUFFICIENT EVIDENCE"


def check(name: str, one: DataFrame) -> DataFrame:
    """A one-row frame with a boolean ``ok`` as a check; null is no evidence."""
    status = F.when(F.col("ok").isNull(), NONE).when(F.col("ok"), PASS).otherwise(FAIL)
    return one.select(F.lit(name).alias("name"), status.alias("status"))


def no_evidence(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name, NONE)], "name string, status string")


def checks(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def verdict(rows: DataFrame) -> DataFrame:
    """The checks and an overall row: any failure fails, else any gap in the evidence counts."""
    status = F.when(F.bool_or(F.col("status") == FAIL), FAIL).when(F.bool_or(F.col("status") != PASS), NONE).otherwise(PASS)
    return rows.unionByName(rows.agg(status.alias("status")).select(F.lit("overall").alias("name"), "status"))


def recheck(shown: DataFrame, computed: DataFrame, keys: list[str], columns: list[str], digits: int) -> DataFrame:
    """Every rendered cell against its recomputed value: keys, column, shown text, value and ``ok``.

    A cell is right when its text is the value within half a unit of the last digit, or empty where the value is null;
    a row that only one side has is wrong in all its cells."""
    cell = lambda c, kind: F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("v"))
    long = lambda df, kind, name: df.select(*keys, F.explode(F.array(*[cell(c, kind) for c in columns])).alias("c"), F.lit(True).alias(f"has_{name}")).select(*keys, "c.column", F.col("c.v").alias(name), f"has_{name}")
    j = long(shown, "string", "shown").join(long(computed, "double", "value"), [*keys, "column"], "full")
    near = F.abs(F.col("shown").try_cast("double") - F.col("value")) <= 0.5 * 10**-digits * (1 + 1e-6) + 1e-9
    ok = F.col("has_shown") & F.col("has_value") & F.when(F.col("value").isNull(), F.coalesce(F.col("shown"), F.lit("")) == "").otherwise(near)
    return j.select(*keys, "column", "shown", "value", F.coalesce(ok, F.lit(False)).alias("ok"))


def manifest(rows: DataFrame, part: str, facts: list, total: str = "all") -> DataFrame:
    """Rows and facts of each part and of all parts, and whether the parts' rows add up to the table's; rows without a part count in the total alone."""
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), *facts).select(F.lit(total).alias("part"), "*")
    parts = rows.filter(F.col(part).isNotNull()).groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("rows"), *facts)
    sums = rows.agg((F.count(F.lit(1)) == F.count(part)).alias("total_ok"))
    return parts.unionByName(whole).crossJoin(F.broadcast(sums))


def file_manifest(df: DataFrame) -> DataFrame:
    """file, bytes, rows of every file that a scan reads, from Spark's file metadata; files without rows aren't seen."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))


def reconcile(found: DataFrame, expected: DataFrame, total: int | None = None) -> DataFrame:
    """One row: files, rows, missing and extra files, files with other row counts, and whether all agrees (with ``total``, its sum too). Both sides have (file, rows)."""
    f, e = found.select("file", F.col("rows").alias("found")), expected.select("file", F.col("rows").alias("expected"))
    g = f.join(e, "file", "full").agg(
        F.count("found").alias("files"), F.coalesce(F.sum("found"), F.lit(0)).alias("rows"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("extra"), F.count_if(F.col("found") != F.col("expected")).alias("different"))
    sums = F.lit(True) if total is None else F.col("rows") == total
    return g.withColumn("total_ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("different") == 0) & sums)


def file_hash(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def snapshot(paths: list[str | Path]) -> dict[str, str]:
    """SHA-256 of protected files, to compare before and after a run."""
    return {str(p): file_hash(p) for p in sorted(map(Path, paths))}


def changed(before: dict[str, str], after: dict[str, str]) -> list[str]:
    return sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))


def export(source: str | Path, root: str | Path, name: str) -> Path:
    """Copy a file below a folder and check the copy; names that lead out of the folder raise."""
    root = Path(root).resolve()
    target = (root / name).resolve()
    if not target.is_relative_to(root):
        raise ValueError(f"{name!r} leads out of {root}")
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    if file_hash(source) != file_hash(target):
        raise OSError(f"the copy of {source} differs")
    return target


def leakage(rows: DataFrame, learned: str, period: str, train: str = "Train") -> DataFrame:
    """Rows of what was learned that come from outside the training period: none may be left."""
    return rows.filter(F.col(learned) & (F.col(period) != train)).groupBy(period).agg(F.count(F.lit(1)).alias("leaks"))
