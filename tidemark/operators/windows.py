"""Sequence operators on ordered series. ``keys`` part independent series; none means one small series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio


def ordered(order: str | list[str], keys: list[str] = ()) -> Window:
    """The window of a series; only for series of calendar length, never for a corpus."""
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)


def whole(keys: list[str] = ()) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def diff(x: Column, w, k: int = 1) -> Column:
    return x - F.lag(x, k).over(w)


def log_diff(x: Column, w) -> Column:
    """100 (ln x - ln previous x); null where a logarithm is undefined."""
    ln = F.when(x > 0, F.ln(x))
    return 100 * (ln - F.lag(ln).over(w))


def ratio_change(x: Column, w, k: int = 12) -> Column:
    return 100 * (ratio(x, F.lag(x, k).over(w)) - 1)


def full_window_std(x: Column, w, n: int) -> Column:
    """Sample deviation of the last n values; null unless all n are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.stddev_samp(x).over(frame))


def scaled_by_lagged(x: Column, scale: Column, w) -> Column:
    """x over the scale known one step before: no look-ahead."""
    return ratio(x, F.lag(scale).over(w))


def zscore(x: Column, keys: list[str] = ()) -> Column:
    w = whole(keys)
    return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def train_zscore(x: Column, train: Column, keys: list[str] = ()) -> Column:
    """z with mean and sample deviation of the training rows only."""
    w, seen = whole(keys), F.when(train, x)
    return ratio(x - F.avg(seen).over(w), F.stddev_samp(seen).over(w))


def first_by_rank(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each group under a total order: ties never depend on arrival."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def best_two(df: DataFrame, keys: list[str], value: str, name: str, order: list[Column]) -> DataFrame:
    """Best and second-best name and value per group, and their margin."""
    top = first_by_rank(df, keys, order, 2)
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    return top.groupBy(*keys).agg(pick(name, 1).alias("best"), pick(value, 1).alias("best_value"), pick(name, 2).alias("second"), pick(value, 2).alias("second_value")).withColumn("margin", F.col("best_value") - F.col("second_value"))


def holm(df: DataFrame, p: str = "p", family: list[str] = (), out: str = "p_holm", tie: list[str] = ()) -> DataFrame:
    """Holm's step-down within each family; null p values are outside the family and stay null."""
    known = F.col(p).isNotNull()
    parts = [*family, known]
    order = Window.partitionBy(*parts).orderBy(F.col(p), *tie)
    rank, m = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy(*parts))
    step = F.least(F.lit(1.0), F.col(p) * (m - rank + 1))
    stepped = df.withColumn("__step", step)
    return stepped.withColumn(out, F.when(known, F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__step")


def average_rank(x: Column, keys: list[str] = ()) -> Column:
    """Ranks from 1; ties share their mean rank."""
    by = Window.partitionBy(*keys).orderBy(x) if keys else Window.partitionBy(F.lit(0)).orderBy(x)
    same = Window.partitionBy(*keys, x) if keys else Window.partitionBy(x)
    return F.rank().over(by) + (F.count(F.lit(1)).over(same) - 1) / 2
