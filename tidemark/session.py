"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    #: What a Python worker holds at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    #: A written table ends the shuffles it came from: their files go with the job.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Those that a running session can still take on, with Spark's defaults: a session that asks for something else keeps it.
LATE = {"spark.sql.execution.arrow.maxBytesPerBatch": "67108864b", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "false"}


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """A new or running session; settings with dots are given as ``**{"spark.x": "y"}`` and win."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Give a session that wasn't made here the settings of ``LATE`` where it has Spark's defaults. Only registered queries and the pipeline do this, for the session they run in; operators leave sessions as they are."""
    for key, default in LATE.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, SETTINGS[key])
    return spark
