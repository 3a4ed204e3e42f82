"""Panels: calendar grids, guarded joins and pivots, quality checks, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio


def month_grid(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every month from first to last as yyyy-MM."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))


def on_grid(grid: DataFrame, *panels: DataFrame, key: str = "month") -> DataFrame:
    """The grid with each panel left-joined; panels are of calendar length."""
    for p in panels:
        grid = grid.join(p, key, "left")
    return grid


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame, after a check that no key occurs twice."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate keys in {keys}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of sides that each hold a key once; raises otherwise."""
    return assert_unique(left, [key]).join(assert_unique(right, [key]), key, how)


def pivot_once(df: DataFrame, key: str, column: str, values: list, value: str) -> DataFrame:
    """Long to wide where each cell has one row; a second row raises."""
    return assert_unique(df, [key, column]).groupBy(key).pivot(column, values).agg(F.first(value))


def coverage_gaps(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def stack(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("s")).select(*keys, f"s.{name}", f"s.{value}")


def map_lookup(df: DataFrame, column: str, mapping: dict[str, str], out: str) -> DataFrame:
    """A literal dictionary as a column; keys without entry give null."""
    entries = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(entries, F.col(column)))


def forward_events(series: DataFrame, order: str, event: str, warn: Column, keys: list[str] = ()) -> DataFrame:
    """Each row's warning, whether ``event`` holds in the next one or two rows, the lead time, and whether two rows follow."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    one, two = F.lead(event, 1).over(w), F.lead(event, 2).over(w)
    return series.withColumns({"warning": F.coalesce(warn, F.lit(False)), "evaluable": two.isNotNull(), "hit": F.coalesce(one | two, F.lit(False)), "lead": F.when(one, 1).when(two, 2)})


def event_recall(series: DataFrame, order: str, event: str, warn: Column, keys: list[str] = ()) -> DataFrame:
    """Each event with whether a warning stood one or two rows before it."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    s = series.withColumn("__w", F.coalesce(warn, F.lit(False)))
    b1, b2 = F.coalesce(F.lag("__w", 1).over(w), F.lit(False)), F.coalesce(F.lag("__w", 2).over(w), F.lit(False))
    return s.withColumns({"warned": b1 | b2, "lead": F.when(b1, 1).when(b2, 2)}).filter(F.col(event)).drop("__w")


def split_pct(n: Column, total: Column) -> Column:
    return 100 * ratio(n, total)
