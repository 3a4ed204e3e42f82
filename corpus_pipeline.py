"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the nearest labelled examples call toxic go (score 0.5 or more).
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. n-gram Jaccard join: of documents linked at five words and 0.8, directly or through others, the smallest doc_id stays.
4. benchmark decontamination: documents that hold a benchmark item within 0.8 word similarity go.
5. best-fit packing: what is left becomes sequences of at most 2048 tokens.

Each stage works on all rows its predecessor kept. Defined cases: a null text counts as empty; an
empty text is never toxic or contaminated, stays once in the exact stage (the largest id; nulls
lowest), links with nothing and is packed as its end id alone. Of rows equal in id and text one
stays; rows with equal ids and different texts are judged one by one; a row with a null id is judged
like any other and comes last where a group keeps one row. Extra columns pass through the first four
stages whatever they are called. Empty tables give an empty result; without labels nothing is
toxic, without benchmark items nothing is contaminated. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.jaccard_join import drop_near_copies
from tidemark.llm.packing import pack_documents
from tidemark.llm.shared import tidy, written
from tidemark.llm.toxicity import drop_toxic
from tidemark.session import settle


def _ready(spark: SparkSession) -> SparkSession:
    """The session with its settings, and a driver without what the stage before has left in its memory."""
    tidy()
    return settle(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, _ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_near_copies(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, _ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontaminate), ("best-fit packing", packing)]

#: Scores, random walks and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = settle(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
