"""From article exports to a corpus: clean, filter by range and flags, drop empties, keep first seen; counters per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import contains_any, in_range, month_key, safe_date, strip_all
from tidemark.operators.windows import first_by_rank

#: Flags that exclude an article.
EXCLUDED = ["예외", "중복"]
#: The columns that are filled and stripped.
TEXT = ["source", "title", "url", "keywords", "features", "content"]


def clean_articles(raw: DataFrame) -> DataFrame:
    """Text columns filled and stripped, dates parsed (null where unreadable), month key."""
    d = raw.withColumns({c: strip_all(F.col(c)) for c in TEXT if c in raw.columns} | {c: F.coalesce(c, F.lit("")) for c in ("exclude_flag",) if c in raw.columns})
    return d.withColumn("date", safe_date(F.col("date"))).withColumn("month", month_key(F.col("date")))


def article_key() -> Column:
    """The link where there is one, else date, source and title."""
    link = F.lower("url")
    return F.when(link.startswith("http"), link).otherwise(F.concat_ws("|", F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")), "source", "title"))


def build_corpus(raw: DataFrame, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """The corpus, and how many rows each stage left. Order matters: range, flags, empty keywords, then first seen by (folder, name, row)."""
    d = clean_articles(raw)
    inside = in_range(F.col("date"), F.lit(first).cast("date"), F.lit(last).cast("date"))
    flagged = contains_any(F.col("exclude_flag"), EXCLUDED)
    filled = F.length("keywords") > 0
    kept = first_by_rank(d.filter(inside & ~flagged & filled).withColumn("key", article_key()), ["key"], [F.col("folder"), F.col("name"), F.col("row")]).drop("rank")
    counters = d.agg(F.count(F.lit(1)).alias("raw"), F.count_if(inside).alias("in_range"), F.count_if(inside & ~flagged).alias("not_excluded"), F.count_if(inside & ~flagged & filled).alias("filled"))
    return kept.drop("key"), counters.crossJoin(kept.agg(F.count(F.lit(1)).alias("unique")))


def load_order(corpus: DataFrame) -> DataFrame:
    """Complete rows, one per article: the first by (month, article_id, keywords)."""
    d = corpus.dropna(subset=["article_id", "month", "keywords"]).filter(F.length(F.trim("keywords")) > 0)
    return first_by_rank(d, ["article_id"], [F.col("month"), F.col("article_id"), F.col("keywords")]).drop("rank")


def replay(rows: DataFrame, sample: DataFrame, key: str, order: list[str]) -> DataFrame:
    """place, key, position: a stored sample's rows, in the sample's order, with their positions in the whole in its stable order; an id that is gone has a null position.

    ``sample`` has (place, key). Positions are numbers within range partitions after the sizes of those before."""
    from tidemark.operators.text import systematic_sample

    positions = systematic_sample(rows.select(key, *[c for c in order if c != key]), order, 1).select(key, F.col("pos").alias("position"))
    return sample.select("place", key).join(positions, key, "left").select("place", key, "position")
