"""Row numbers within ordered groups without bringing a group to one task, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, written

#: Bits that monotonically_increasing_id() leaves for the rows of one partition.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[Column], label: str = "numbered") -> tuple[DataFrame, str]:
    """The rows with their number in their group, from 0 in the given order, and that column's name.

    Rows are range-partitioned by group and order, so a large group takes many partitions; the numbers are a
    row's place in its partition after those of the group's earlier partitions, of which there is one row each
    (the broadcast's bound is partitions plus groups). Full ties are spread by their places in ``rows``, which
    should be a written table, and get numbers in any order.
    """
    at, part, start, before, number, tie = fresh(rows.columns, "at", "part", "start", "before", "number", "tie")
    keys = [F.col(group), *order, F.col(tie)]
    laid = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = written(laid.drop(tie).withColumn(at, F.monotonically_increasing_id()), label).withColumn(part, F.shiftright(at, ROW_BITS))
    each = laid.groupBy(group, part).agg(F.min(at).alias(start), F.count(F.lit(1)).alias(number))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(group, part, start, F.coalesce(F.sum(number).over(earlier), F.lit(0)).alias(before))
    out = laid.join(F.broadcast(each), [group, part]).withColumn(number, F.col(before) + F.col(at) - F.col(start))
    return out.drop(at, part, start, before), number


def kth_largest(rows: DataFrame, value: str, k: int, bins: int = 4096) -> int:
    """The k-th largest of a column of whole numbers, repeats counted (1 <= k <= their number): counts of bins are summed by all tasks, round after round within the bin that holds it."""
    low, high = rows.agg(F.min(value), F.max(value)).head()
    above = 0
    while low < high:
        step = (high - low) // bins + 1
        found = rows.filter(F.col(value).between(low, high)).groupBy(F.expr(f"(`{value}` - {low}) div {step}").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low
