"""Checks that must fail where something is wrong; arrays as files; manifests."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, regimes
from tidemark.plans import checks
from tidemark.sources import arrays


@pytest.fixture(scope="module")
def basis(spark):
    rows = [(0, "rate", 3.0), (0, "chip", 1.0), (1, "chips", 2.0), (1, "rates", 1.9), (2, "sea", 1.0), (3, "home", 1.0), (3, "homes", 2.0)]
    dictionary = {"macro": {"m": ["rate"]}, "tech": {"t": ["chip", "c"]}, "estate": {"e": ["home"]}}
    return spark.createDataFrame(rows, "topic int, term string, weight double"), regimes.domain_pairs(spark, dictionary)


def test_two_rules_of_mapping_agree(spark, basis):
    weights, pairs = basis
    claims = regimes.claim_terms(weights.select("term").distinct(), pairs)
    assert {r["term"]: r["keyword"] for r in claims.collect()} == {"rate": "rate", "rates": "rate", "chip": "chip", "chips": "chip", "home": "home", "homes": "home"}
    first = {r["topic"]: (r["status"], r["best"] if r["status"] == "assigned" else None, r["best_mass"]) for r in regimes.map_topics(weights, claims).collect()}
    again = {r["topic"]: (r["status"], r["domain"], r["best_mass"]) for r in regimes.map_topics_again(weights, pairs).collect()}
    assert first == again == {0: ("assigned", "macro", 3.0), 1: ("ambiguous", None, 2.0), 2: ("residual", None, 0.0), 3: ("assigned", "estate", 3.0)}


def test_renumbered_topics(spark, basis):
    weights, pairs = basis
    claims = regimes.claim_terms(weights.select("term").distinct(), pairs)
    got = regimes.equivariance(weights, claims, 3).collect()
    assert sorted((r["copy"], r["topics"], r["changed"]) for r in got) == [(1, 4, 0), (2, 4, 0), (3, 4, 0)]
    _, names = regimes.permuted(weights, 3)
    assert {tuple(r) for r in names.groupBy("copy").agg(F.countDistinct("number"), F.min("number"), F.max("number")).collect()} == {(c, 4, 1, 4) for c in (1, 2, 3)}


def test_a_look_ahead_shows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{i:02d}", float(v)) for i, v in enumerate(rng.normal(size=30))]
    honest = [("ar1", "y", [("y", 1)], True)]
    series = spark.createDataFrame(rows, "month string, y double")
    assert checks.future_hidden(series, "month", ["y"], honest, 20).agg(F.max("change")).head()[0] == 0
    cheat = [("cheat", "y", [("y", 0)], True)]  # knows its own month's value
    got = checks.future_hidden(series, "month", ["y"], cheat, 20).agg(F.count(F.lit(1)), F.min("change")).head()
    assert got[0] == 10 and got[1] > 1e5


def test_report_checks_find_faults(spark):
    report = spark.createDataFrame([("R1", "a", "1.0000", "0.5000", "")], "run_id string, model string, rmse string, mae string, bias string")
    errors = spark.createDataFrame([("a", 1.00004, 0.5, None)], "model string, rmse double, mae double, bias double")
    mapping = spark.createDataFrame([(0, "R1"), (1, "R1")], "topic int, run_id string")
    said = lambda *a: [r["status"] for r in checks.report_checks(*a).orderBy("name").collect()]
    assert said(report, errors, mapping, 2, "R1", [report, mapping]) == ["PASS"] * 4
    other = spark.createDataFrame([(0, "R2"), (0, None)], "topic int, run_id string")
    assert said(report, errors.withColumn("mae", F.lit(0.6)), other, 2, "R1", [report, other]) == ["FAIL"] * 4


def test_array_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    for kind, order in (("<f8", "C"), ("<f4", "F"), (">i4", "C"), ("<i8", "F"), ("<u2", "C")):
        a = np.array(rng.integers(0, 1000, size=(37, 5)), dtype=kind, order=order)
        path = str(tmp_path / f"a-{kind[1:]}{order}.npy")
        np.save(path, a)
        got = arrays.read_arrays(spark, path, rows=10)
        assert got.rdd.getNumPartitions() == 4
        assert [r["values"] for r in got.orderBy("row").collect()] == a.astype(float).tolist()
        assert arrays.read_rows(path, 8, 19).tolist() == a[8:19].tolist()
        assert arrays.digest(path) == hashlib.sha256(np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()).hexdigest()
    np.save(tmp_path / "vector.npy", np.arange(5.0))
    assert [r["values"] for r in arrays.read_arrays(spark, f"file://{tmp_path}/vector.npy").orderBy("row").collect()] == [[float(i)] for i in range(5)]


def test_array_files_that_are_none(tmp_path):
    bad = tmp_path / "bad.npy"
    bad.write_bytes(b"not an array at all, but long enough")
    with pytest.raises(ValueError, match="no array file"):
        arrays.header(str(bad))
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(ValueError, match="matrix"):
        arrays.header(str(tmp_path / "cube.npy"))
    np.save(tmp_path / "cut.npy", np.zeros((4, 4)))
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-8])
    with pytest.raises(ValueError, match="header says"):
        arrays.header(str(tmp_path / "cut.npy"))


def test_arrays_written_by_tasks_come_back(spark, tmp_path):
    rows = [(i, [float(i), i / 2, -1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    made = arrays.write_arrays(df, f"file://{tmp_path}/out", "id", "v")
    assert sum(m[1] for m in made) == 100 and all(arrays.digest(f"{tmp_path}/out/{m[0]}") == m[2] for m in made)
    got = arrays.read_arrays(spark, f"file://{tmp_path}/out", rows=6)
    assert sorted(r["values"] for r in got.collect()) == [v for _, v in rows]
    assert arrays.write_arrays(df.limit(0), f"file://{tmp_path}/none", "id", "v") == [] and arrays.read_arrays(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="different lengths"):
        arrays.write_arrays(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").coalesce(1), f"file://{tmp_path}/odd", "id", "v")


def test_file_manifest(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(100).repartition(4).write.parquet(path)
    found = audit.file_manifest(spark.read.parquet(path)).collect()
    assert len(found) == 4 and sum(r["rows"] for r in found) == 100 and all(r["bytes"] > 0 for r in found)
    f = spark.createDataFrame([(r["file"], r["rows"]) for r in found], "file string, rows long")
    assert audit.reconcile(f, f, 100).head().asDict() == {"files": 4, "rows": 100, "missing": 0, "extra": 0, "different": 0, "total_ok": True}
    first = found[0]["file"]
    e = f.filter(F.col("file") != first).unionByName(spark.createDataFrame([("gone", 3)], "file string, rows long")).withColumn("rows", F.when(F.col("file") == found[1]["file"], F.col("rows") + 1).otherwise(F.col("rows")))
    assert audit.reconcile(f, e).head().asDict() == {"files": 4, "rows": 100, "missing": 1, "extra": 1, "different": 1, "total_ok": False}
    assert not audit.reconcile(f, f, 99).head()["total_ok"]


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    """Tables in folders of several parts, one of them empty, are reported as their SQL has it."""
    from tidemark.plans import checks

    for n, name in enumerate(checks.MANIFEST):
        spark.range(10 * n).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["name"]: (r["files"], r["rows"], r["missing"], r["extra"], r["different"], r["total_ok"]) for r in checks.file_manifest(spark, f"{tmp_path}").collect()}
    assert got == {name: (1, 10 * n, 0, 0, 0, True) for n, name in enumerate(checks.MANIFEST)}
