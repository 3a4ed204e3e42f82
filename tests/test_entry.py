"""The driver's contract, with or without the training-data subpackage."""

import importlib.util

import __spark_entry__ as entry


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_data_queries_come_with_their_package():
    present = importlib.util.find_spec("tidemark.llm") is not None
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()}
    assert numbers == (set(range(1, 14)) if present else set())
    assert present or "pipeline" not in entry.queries()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "active" in df.columns
