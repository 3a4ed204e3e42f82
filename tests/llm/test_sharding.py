"""Sharding against its SQL twin, and what must hold on odd tables."""

import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding as S

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, weight double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 5}", len(t or ""), "x", 0.5) for i, t in rows], DOC).repartition(3)


def held(out, rows, shards):
    """What any sharding must satisfy; the bytes of each shard."""
    got = out.collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, of, size = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
        of[r["size"], r["text_crc32"]].add(r["shard"])
        size[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in of.values())
    for s in slots.values():
        assert [x[0] for x in sorted(s)] == list(range(len(s))) and [x[1:] for x in sorted(s)] == sorted(x[1:] for x in s)
    return size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_twin(spark, sf):
    d = f"/root/testdata/{sf}"
    got = S.op13_sharding(spark, d)
    want = duckdb.sql(S.ORACLE.replace("FROM documents", f"FROM '{d}/documents.parquet'"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    size = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(size) == 8 and max(size) - min(size) < 0.1 * sum(size) / 8


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 8])
def test_near_equal_for_any_number(spark, shards):
    rows = [(i, f"text {i} " * (i % 9 + 1)) for i in range(400)] + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(0, 400, 3)]
    size = held(S.shard_documents(table(spark, rows), shards), rows, shards)
    assert len(size) == shards and max(size.values()) - min(size.values()) <= 8 * 200


def test_heavy_groups_have_shards_of_their_own(spark):
    rows = [(i, "copy " * 40) for i in range(300)] + [(i, "y" * 9000) for i in range(500, 502)] + [(1000 + i, f"t{i}" * 20) for i in range(400)]
    size = held(S.shard_documents(table(spark, rows)), rows, 8)
    *rest, second, most = sorted(size.values())
    assert most == 300 * 201 and second == 2 * 9001 and max(rest) - min(rest) < 400


def test_target_bytes_and_few_groups(spark):
    rows = [(i, "a" * 99 + str(i)) for i in range(10, 60)]
    assert len(held(S.shard_documents(table(spark, rows), shards=None, target_bytes=1000), rows, 6)) == 6
    few = [(1, "a"), (2, "a"), (3, "b")]
    assert sorted(held(S.shard_documents(table(spark, few)), few, 8).values()) == [2, 4]


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, None), (1, None), (2, "é"), (3, "x" * 100_000), (3, "x"), *[(i, f"d{i}") for i in range(50)]]
    held(S.shard_documents(table(spark, rows)), rows, 8)
    assert S.shard_documents(table(spark, [])).collect() == []
    df = spark.createDataFrame([(1, "a", None), (2, "b", 7.5)], "`id.x` int, `te``xt` string, m double")
    assert S.shard_documents(df, 2, dimensions=("m",), id_col="id.x", text_col="te`xt").select("shard", "slot").orderBy("shard").collect() == [(0, 0), (1, 0)]


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(100)] + [(7, None)]
    df = table(spark, rows).drop("shard")
    S.write_shards(df, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == 101 and back.select("shard").distinct().count() == 4


def test_only_built_in_functions(spark):
    plan = S.op13_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "ExistingRDD" not in plan
