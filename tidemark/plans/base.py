"""What the queries start from: driver tables as corpus, panels and series, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import iso_week_key, month_key, words
from tidemark.tables import stored

TRAIN_MONTHS, MONTHS = 48, 67


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    """Documents as articles: a synthetic month from the id, the first 48 of 67 months are training."""
    at = (F.col("doc_id") % MONTHS).cast("int")
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", month_key(F.add_months(F.lit("2021-01-01").cast("date"), at)).alias("month"), F.when(at < TRAIN_MONTHS, "Train").otherwise("Eval").alias("period"))


def tokens(spark, d, least: int = 3) -> DataFrame:
    """Each distinct word of each document."""
    return docs(spark, d).select("doc_id", "month", "period", "source", "lang", F.explode(words(F.col("text"), least)).alias("term"))


def corpus(spark, d, least: int = 3) -> DataFrame:
    """Documents with their distinct words as an array, cut into words once and stored: what all counts of a query read."""
    kept = docs(spark, d).select("doc_id", "month", "period", "source", "lang", words(F.col("text"), least).alias("terms"))
    return stored(kept, "corpus")


def exploded(corpus: DataFrame) -> DataFrame:
    """Each distinct word of each document of ``corpus``."""
    return corpus.select("doc_id", "month", "period", "source", "lang", F.explode("terms").alias("term"))


def months(spark, d) -> DataFrame:
    """Orders by month: number, sum and mean of prices; 80 months."""
    return table(spark, d, "orders").groupBy(month_key(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("level")).withColumn("period", F.when(F.col("month") <= "1998-12", "Train").otherwise("Eval"))


def ship_months(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(month_key(F.col("l_shipdate")).alias("month")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("revenue"), F.avg("l_discount").alias("discount"))


def weeks(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(iso_week_key(F.col("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("level")).withColumn("period", F.when(F.col("week") < "1999-W01", "Train").otherwise("Eval"))


#: Order priorities play the regimes, in this fixed order.
REGIMES = ("urgent", "high", "medium", "not_specified", "low")


def slug(c):
    return F.replace(F.lower(F.regexp_replace(c, r"^\d+-", "")), F.lit(" "), F.lit("_"))


def shares(spark, d) -> DataFrame:
    """Share of each regime in each month's orders."""
    counts = table(spark, d, "orders").groupBy(month_key(F.col("o_orderdate")).alias("month"), slug(F.col("o_orderpriority")).alias("regime")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("month").agg(F.sum("n").alias("total"))
    return counts.join(total, "month").select("month", F.when(F.col("month") <= "1998-12", "Train").otherwise("Eval").alias("period"), "regime", (F.col("n") / F.col("total")).alias("share"))


CTE = {
    "docs": "SELECT doc_id, text, source, lang, strftime(DATE '2021-01-01' + to_months(CAST(doc_id % 67 AS INTEGER)), '%Y-%m') AS month, CASE WHEN doc_id % 67 < 48 THEN 'Train' ELSE 'Eval' END AS period FROM documents",
    "tokens": "SELECT doc_id, month, period, source, lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿœß]+'), lambda x: length(x) >= 3))) AS term FROM docs",
    "months": "SELECT *, CASE WHEN month <= '1998-12' THEN 'Train' ELSE 'Eval' END AS period FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS level FROM orders GROUP BY 1)",
    "ship_months": "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines, sum(l_extendedprice) AS revenue, avg(l_discount) AS discount FROM lineitem GROUP BY 1",
    "weeks": "SELECT *, CASE WHEN week < '1999-W01' THEN 'Train' ELSE 'Eval' END AS period FROM (SELECT isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week, count(*) AS n, avg(o_totalprice) AS level FROM orders GROUP BY 1)",
    "shares": "SELECT month, CASE WHEN month <= '1998-12' THEN 'Train' ELSE 'Eval' END AS period, regime, n / sum(n) OVER (PARTITION BY month) AS share FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, replace(lower(regexp_replace(o_orderpriority, '^[0-9]+-', '')), ' ', '_') AS regime, count(*) AS n FROM orders GROUP BY 1, 2)",
    "z": "SELECT month, period, regime, share, (share - avg(share) FILTER (period = 'Train') OVER (PARTITION BY regime)) / stddev_samp(share) FILTER (period = 'Train') OVER (PARTITION BY regime) AS z, list_position(['urgent', 'high', 'medium', 'not_specified', 'low'], regime) AS pos FROM shares",
}
_NEEDS = {"tokens": ["docs"], "z": ["shares"]}


def sql(names: str, body: str) -> str:
    """DuckDB text with the named CTEs in front."""
    out: list[str] = []
    for n in names.split():
        out += [x for x in [*_NEEDS.get(n, []), n] if x not in out]
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in out) + " " + body
