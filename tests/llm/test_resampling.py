"""Importance resampling against runs counted one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import resampling as R
from tidemark.llm.ranking import kth_largest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, rank string, weight long"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall((text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(c % buckets for c in runs(x)[1])
    for x in target:
        t.update(c % buckets for c in runs(x)[1])
    n, m = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, x in docs:
        words, crcs = runs(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(c % buckets) for c in crcs)
        out.append([i, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéXY7") for _ in range(rng.randint(1, 6)))
    some = [word() for _ in range(60)]
    out = [(i, " ".join(rng.choice(some) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    out += [(None, None), (None, " ".join(some)), (1000, ""), (1001, "one"), (1002, "two words"), (1003, "x" * 100_000 + " " + "y" * 33 + " z" * 30), (1004, "İstanbul ÀB-cd_EF\x7fgh " * 3000)]
    return out + [(2000, " ".join(some))] * 7


def test_equals_brute_force(spark):
    docs, target = documents(), [" ".join(t.split()[:30]) for _, t in documents()[:5] if t] + [None, ""]
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], DOC).repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out, names = R.importance_resample(df, bench, percent=30)
    assert names == ["n_features", "weight", "score", "rank"]
    assert rows(out) == brute(docs, target, 30)
    drawn = R.draw_documents(df, bench, percent=30)
    assert drawn.columns == [*df.columns, "rank_"] and drawn.count() == out.filter("rank IS NOT NULL").count()
    assert rows(drawn.select("doc_id", "rank_")) == rows(out.filter("rank IS NOT NULL").select("doc_id", "rank"))


def test_no_rows(spark):
    none, bench = spark.createDataFrame([], DOC), spark.createDataFrame([("a b c",)], "text string")
    assert R.importance_resample(none, bench)[0].collect() == []
    one = spark.createDataFrame([(1, "a b c", "", 0)], DOC)
    assert rows(R.importance_resample(one, bench.limit(0))[0]) == brute([(1, "a b c")], [])


def test_tries_are_exact_and_may_be_folded():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 40) for _ in range(rng.randint(0, 50))) for _ in range(60)]
    want = Counter(c % 97 for t in texts for c in runs(t)[1])
    gains = np.arange(97) * 3 - 50
    small, R.MOST_NODES = R.MOST_NODES, 500
    try:
        total, folds, trie, sums = np.zeros(97, np.int64), [], [R.WordTrie(gains)], []
        for i in range(0, 60, 5):
            sums += [int(w) for _, part in R._tries(pa.array(texts[i : i + 5]), trie, lambda t: folds.append(t.buckets(97))) for w in part]
        total = sum(folds) + trie[0].buckets(97)
    finally:
        R.MOST_NODES = small
    assert len(folds) > 1 and total.tolist() == [want[b] for b in range(97)]
    assert sums == [sum(int(gains[c % 97]) for c in runs(t)[1]) for t in texts]


@pytest.mark.parametrize("k", [1, 2, 5, 17, 40])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.randint(-(10**12), 10**12), rng.randint(-3, 3)]) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert kth_largest(df, "v", k, bins=4) == sorted(values, reverse=True)[k - 1]


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert rows(R.op12_importance_resampling(spark, SF)) == brute(docs, target)
