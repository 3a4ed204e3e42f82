"""Tidemark: a Spark-first engine for text corpora and time-series panels."""
