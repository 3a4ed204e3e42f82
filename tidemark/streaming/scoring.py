"""An extension: scoring arriving documents with a frozen topic model, in weekly windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import words
from tidemark.operators.topics import TopicModel, transform


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that appear below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_arriving(stream: DataFrame, vocab_idf: DataFrame, model: TopicModel, text: str = "text") -> DataFrame:
    """The stream's documents with topic shares. The vocabulary has a fixed cap and travels as one map column of a static row, so a document is scored without state."""
    lookup = vocab_idf.agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("idx", "idf")))).alias("vocab"))
    found = F.filter(F.transform(words(F.col(text), 3), lambda t: F.try_element_at(F.col("vocab"), t)), lambda e: e.isNotNull())
    entries = stream.crossJoin(F.broadcast(lookup)).withColumn("e", F.array_sort(found))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, e: s + e["idf"] * e["idf"]))
    rows = entries.select("doc_id", "ts", F.transform("e", lambda e: e["idx"]).alias("idx"), F.transform("e", lambda e: e["idf"] / norm).alias("w"))
    basis = rows.select(F.struct("doc_id", "ts").alias("key"), "idx", "w")
    return transform(basis, model, "key").select("key.*", "topics", "valid")


def weekly_shares(scored: DataFrame, k: int, late: str = "1 day") -> DataFrame:
    """Mean topic shares of valid documents per week; rows later than the watermark are dropped, state is bounded by it."""
    return scored.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("week")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("valid").alias("n_valid"), *[F.avg(F.when(F.col("valid"), F.get("topics", F.lit(i)))).alias(f"topic_{i}") for i in range(k)])
