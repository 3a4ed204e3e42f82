"""What each method adds beyond its contract's columns, against direct evaluation; odd tables for fitted models."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_joins import CLASH
from test_llm import odd_rows, words

D = "/root/testdata/sf0.01"


def terms(text):
    return collections.Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


@pytest.mark.parametrize("delta", [True, False])
def test_toxicity_is_the_dense_cosine(spark, delta):
    """Neighbours, cosines and scores of every document against a dense table over all words of all examples."""
    from tidemark.llm.quality import pav
    from tidemark.llm.toxicity import score_toxicity

    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels, delta=delta, evidence=21).collect()}
    text = {r["doc_id"]: terms(r["text"]) for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1) and r["doc_id"] in text}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in toxic}
    known = sorted(i for i in toxic if fold[i] != 0)
    inside, held = [i for i in known if fold[i] != 4], [i for i in known if fold[i] == 4]
    place = {w: n for n, w in enumerate(sorted({w for i in inside for w in text[i]}))}
    df, pos = np.zeros(len(place)), np.zeros(len(place))
    for i in inside:
        for w in text[i]:
            df[place[w]] += 1
            pos[place[w]] += toxic[i]
    n, n1 = len(inside), sum(toxic[i] for i in inside)
    idf = np.abs(np.log((n1 + 1) / (pos + 1)) - np.log((n - n1 + 1) / (df - pos + 1))) if delta else np.log((1 + n) / (1 + df)) + 1

    def vector(counts):
        v = np.zeros(len(place))
        for w, c in counts.items():
            if w in place:
                v[place[w]] = (1 + math.log(c)) * idf[place[w]]
        size = np.sqrt(v @ v)
        return v / size if size else v

    table, y = np.stack([vector(text[i]) for i in inside]), np.array([toxic[i] for i in inside], float)
    ids, prior = np.array(inside), y.mean()

    def nearest(i):
        cos = table @ vector(text[i])
        best = np.lexsort((ids, -np.round(cos, 12)))[:21]
        return best[cos[best] > 1e-15], cos

    def vote(i):
        best, cos = nearest(i)
        if not len(best):
            return prior
        c = np.minimum(cos[best], 1)
        w, far = 1 / (1.05 - c), max(0.0, 1 - c[0])
        return (w @ y[best] + far * prior) / (w.sum() + far)

    knots, values = pav(np.array([vote(i) for i in held]), np.array([toxic[i] for i in held], float))
    for i in text:
        best, cos = nearest(i)
        assert np.allclose(got[i]["evidence_cosines"], np.minimum(cos[best], 1), atol=1e-9)
        assert np.allclose(sorted(cos[np.searchsorted(ids, got[i]["evidence_ids"])]), sorted(cos[best]), atol=1e-9)
        assert math.isclose(got[i]["score"], min(max(np.interp(vote(i), knots, values), 0), 1), abs_tol=1e-6)


def test_blocks_are_skipped_without_loss():
    from tidemark.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(3)
    n, v = 4000, 300
    rows, t = np.nonzero(np.concatenate([rng.random((n, 100)) < 0.5, rng.random((n, v - 100)) < 0.01], axis=1))
    idf = np.concatenate([np.full(100, 0.02), np.full(v - 100, 5.0)])
    index = BlockMaxIndex(np.arange(v, dtype=np.uint64), idf, np.arange(n), np.zeros(n))
    index.load(rows, t, np.ones(len(rows)))
    dense = np.zeros((n, v))
    dense[rows, t] = index.weigh(rows, t, np.ones(len(rows)), n)
    for q in range(20):
        at = np.flatnonzero(dense[q * 7])
        places, cos = index.nearest(at, dense[q * 7][at], 5)
        want = dense @ dense[q * 7]
        assert np.allclose(cos, np.minimum(np.sort(want)[::-1][: len(cos)], 1)) and np.allclose(want[places], cos, atol=1e-9)
    assert index.read < 0.8 * index.all


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    odd = spark.createDataFrame([(None if i is None else 10_000_000 + i, t) for i, t in odd_rows()], "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(odd), labels


def test_fitted_models_on_odd_texts(spark, fitted):
    from tidemark.llm.quality import score_quality
    from tidemark.llm.toxicity import drop_toxic, score_toxicity

    docs, labels = fitted
    for f in (score_quality, score_toxicity):
        rows = collections.defaultdict(list)
        for r in f(docs, labels).collect():
            rows[r["doc_id"]].append(r)
        assert all(0 <= r["score"] <= 1 for x in rows.values() for r in x)
        assert len(rows[10_000_011]) == 2 and len({r["score"] for r in rows[10_000_011]}) == 1 and not rows[None][0]["held_out"]
        empty = {rows[10_000_000 + i][0]["score"] for i in (1, 2, 3, 8)}
        assert empty == {0.0} if f is score_quality else len(empty) == 1 and max(empty) < 0.5
    named = docs.selectExpr("doc_id", "text", *[f"cast(null as {c.rsplit(' ', 1)[1]}) as {c.rsplit(' ', 1)[0]}" for c in CLASH.split(", ")])
    kept = drop_toxic(named, labels)
    assert kept.columns == named.columns and {10_000_001, 10_000_002, 10_000_014} <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_quality_solves_the_normal_equations(spark):
    from tidemark.llm import quality as Q

    rng = np.random.default_rng(5)
    k = len(Q.STATISTICS)
    x = rng.random((300, k))
    y = (x[:, 0] + 0.3 * rng.random(300) > 0.6).astype(int)
    fold = rng.integers(1, 5, 300)
    frame = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold)], "stats array<double>, label int, fold int").repartition(3)
    model = Q.fit(frame)
    z = model.lift(x)
    penalty = np.diag(np.r_[1e-6, np.ones(z.shape[1] - 1)])
    solve = lambda m: np.linalg.solve(z[m].T @ z[m] + penalty, z[m].T @ y[m])
    assert np.allclose(model.weights, solve(np.ones(300, bool)), atol=1e-6)
    raw = np.array([z[i] @ solve(fold != fold[i]) for i in range(300)])
    knots, values = Q.pav(raw, y.astype(float))
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.values, values, atol=1e-6)


def test_pooling_is_the_isotonic_optimum():
    from tidemark.llm.quality import pav

    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        y = rng.integers(0, 2, n).astype(float)
        _, values = pav(np.arange(n, dtype=float), y)
        best = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # max-min formula
        assert np.allclose(sorted(set(np.round(values, 9))), sorted(set(np.round(best, 9))))


def test_transducer_on_random_strings_and_cuts():
    from tidemark.llm import transducer as T
    from tidemark.llm.bpe import codec, tokenizer_path
    from tidemark.llm.token_counts import TokenCounter

    path = tokenizer_path()
    library = codec(path)
    c = TokenCounter(T.Transducer(path), library)
    rng = random.Random(9)
    signs = "abcdefghijklmnopqrstuvwxyzthheingerantion" * 3 + "ABCéüßÉÖñ  '’-.,;:!?123½日本<|endoftext|>\t\n\x85\x00ſ"
    known = [t.removesuffix("</w>") for t in library.tokenizer.get_vocab() if t.isascii()]
    for n in range(1500):
        text = "".join(rng.choice(signs if n % 2 else known) for _ in range(rng.randint(0, 40 if n % 2 else 8)))
        assert c.count(text.encode(), rng.choice([1, 2, 3, 7, 64])) == len(library.tokenizer.encode(text, add_special_tokens=False).ids), text
    assert len(c.automaton.moves) > 100 and {(v & 255) - 128 for v in c.automaton.moves.values()} > {0, 1}
    before, T.MOST_STATES = T.MOST_STATES, 50  # compiled anew again and again
    try:
        small = T.Transducer(path)
        for w in ("internationalisation", "straightforwardness", "unbelievably", "thoroughly"):
            assert small.emitted(w.encode()) == len(library.tokenizer.encode(w, add_special_tokens=False).ids)
        assert len(small.states) <= 51
    finally:
        T.MOST_STATES = before


def test_state_maps_compose_in_any_order():
    from tidemark.llm.bpe import codec, tokenizer_path
    from tidemark.llm.token_counts import TokenCounter
    from tidemark.llm.transducer import Transducer

    m = TokenCounter(Transducer(tokenizer_path()), codec(tokenizer_path()))
    a, b, c = m.maps([b"one tw", b"othr", b"ee four "], [True, False, False], [False, False, True])
    assert m.compose(m.compose(a, b), c) == m.compose(a, m.compose(b, c)) and m.finish(m.scan([a, b, c])) == m.count(b"one twothree four ")


def test_long_texts_go_through_many_chunks(spark):
    from tidemark.llm.bpe import codec, tokenizer_path
    from tidemark.llm.token_counts import token_counts

    rows = [(i, t) for i, t in odd_rows() if not t or len(t) < 20_000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # texts go on over batch ends
    try:
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(df, tokenizer_path(), chunk=16).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tok = codec(tokenizer_path()).tokenizer
    assert got == collections.Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_a_changed_store_is_noticed(spark):
    from tidemark.llm.bpe import tokenizer_path
    from tidemark.llm.shared import new_path
    from tidemark.llm.token_store import TokenStore

    df = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(3000)], "doc_id long, text string")
    path = new_path(spark, "t")
    store = TokenStore.write(df, path, tokenizer_path()).verify()
    assert store.checksums().count() == 3000
    index = spark.read.parquet(f"{path}/index")
    kinds = index.select("row", "part", "place", "doc_id", "n_tokens", "root", "start")
    for change in ("NOT (row = 'documents' AND doc_id = 2000)", "row = 'documents' OR part <> 0"):
        other = new_path(spark, "t")
        kinds.filter(change).write.partitionBy("row").parquet(f"{other}/index")
        for part in ("objects", "root"):
            spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
        with pytest.raises(ValueError, match="doesn't match"):
            TokenStore(spark, other).verify()


def test_recall_at_the_limit_and_all_places(spark):
    """Items of all lengths with as many edits as allowed; two places of one item in a text; a very long text."""
    from tidemark.llm import decontaminate as C

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([7, 9, 12, 15, 18, 20, 25, 31, 40, 60, 100, 250, 600, 1200] * 8)}
    docs = []
    for i, w in items.items():
        planted = list(w)
        for _ in range(int(0.2 * len(w))):
            at, kind = rng.randrange(len(planted)), rng.randint(0, 2)
            planted[at : at + (kind != 1)] = [] if kind == 2 else [word()]
        docs.append((i, " ".join([*(word() for _ in range(rng.randint(0, 60))), *planted, *(word() for _ in range(30))])))
    again = items[5]
    docs += [(1000, " ".join([*again, "x", *again])), (1001, " ".join([word() for _ in range(60_000)] + items[9]))]
    found = C.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    own = {(r["doc_id"], r["item_id"]) for r in found}
    assert sum((i, i) in own for i in items) >= 0.97 * len(items)
    assert sorted((r["first_word"], r["n_words"], r["edits"]) for r in found if r["doc_id"] == 1000 and r["item_id"] == 5) == [(0, 20, 0), (21, 20, 0)]
    assert [(r["first_word"], r["edits"]) for r in found if r["doc_id"] == 1001] == [(60_000, 0)]


def test_items_in_many_blocks(spark, monkeypatch):
    from tidemark.llm import decontaminate as C

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(30)]
    docs = [(i, f"{word()} {items[i][1]} {word()}" if i < 20 else word()) for i in range(40)] + [(None, None), (7, items[3][1])]
    df = spark.createDataFrame([(i, t, *[None] * 15) for i, t in docs], f"doc_id long, text string, {CLASH}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r["doc_id"], r["item_id"]) for r in C.contaminated(df, bench).collect()}
    monkeypatch.setattr(C, "BLOCK_WORDS", 300)
    assert {(r["doc_id"], r["item_id"]) for r in C.contaminated(df, bench).collect()} == one == {(i, i) for i in range(20)} | {(7, 3)}
    clean = C.drop_contaminated(df, bench)
    assert clean.columns == df.columns and collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter([*range(20, 40), None])


def brute_spans(text, L):
    """Labels and best cover by the definition: hits of k-grams on diagonals, merged, covered, told apart."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = {x for _, x in L.brute_base(text)}, 1.0 if L.brute_base(text) else 0.0
    for t, label in L.TEMPLATES.items():
        t = t.split()
        k = 4 if len(t) >= 16 else 2
        hits = sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k])
        runs = []
        for h in hits:
            if runs and h[0] - runs[-1][-1][0] <= min(L.NEAR, len(t) - 1):
                runs[-1].append(h)
            else:
                runs.append([h])
        for r in runs:
            covered = {j + x for _, _, j in r for x in range(k)}
            span = max(i for _, i, _ in r) + k - min(i for _, i, _ in r)
            if len(covered) >= L.COVER * len(t) and span <= len(t) + len(t) // L.ROOM and all(i in covered for i, x in enumerate(t) if x in L.TELLING or x.isdigit()):
                labels.add(label)
                best = max(best, len(covered) / len(t))
    return ",".join(sorted(labels)), best


def test_license_labels_and_scores(spark):
    from tidemark.llm import license_scan as L

    rng = random.Random(14)
    name = {v: k for k, v in L.TEMPLATES.items()}
    texts = ["All rights reserved. " * n for n in (1, 3, 4, 9)]
    texts += ["Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0.", "licensed under the Apache License, Version 2.0", "licensed under the Apache License, Version 1.0", "licenced under the apache license version 2 0 and more", None, ""]
    for label in ("mit-text", "bsd-2-clause-text", "bsd-3-clause-text", "isc-text", "zlib-text", "apache-text", "gpl-3.0-notice"):
        w = name[label].split()
        for edits in (0, 2, 12):
            x = list(w)
            for _ in range(edits):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice([[], ["other"], ["two", "words"]])
            texts.append("copyright 2020 someone " + " ".join(x) + " the end")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, spans = L.scan_licenses(df)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in out.collect()}
    assert got == {i: (a, round(b, 9)) for i, t in enumerate(texts) for a, b in [brute_spans(t, L)]}
    assert all(got[i][0] == "all-rights-reserved" for i in range(4)) and got[5][0] == "cc-by,cc-by-sa-4.0" and got[7][0] == "apache"
    assert "mit-text" in got[11][0] and {r["id"] for r in spans.filter("NOT base").collect()} <= set(range(len(texts)))


def test_language_model_score_is_the_formula(spark):
    """Scores of the whole operator against classes, transitions and emissions evaluated word by word."""
    from tidemark.llm import class_lm as M

    rng = random.Random(15)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("at", "en", "ion", "ous", "ly")]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(60, "unseen words"), (61, None)]
    seen = {}
    got = M.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model=seen).collect()
    cls, count, g = seen["cls"], seen["count"], seen["bigrams"]
    n_class, v_class = np.zeros(M.CLASSES), np.zeros(M.CLASSES)
    for w, c in cls.items():
        n_class[c] += count[w]
        v_class[c] += 1
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    code = lambda w: M.word_hash(w)
    table, direct = np.zeros_like(g), collections.Counter()
    for i, t in rows:
        if i not in held:
            w = [M.END if x is None else code(x) for x in [None, *words(t), None]]
            direct.update(w[1:])
            for a, b in zip(w, w[1:]):
                table[cls[a], cls[b]] += 1
    assert direct == count and np.array_equal(table, g)
    share = (n_class + 1) / (n_class.sum() + M.CLASSES)
    to = np.log10((g + 5 * share) / (g.sum(1, keepdims=True) + 5))
    for r in got:
        total, before = 0.0, cls[M.END]
        for x in [*words(dict(rows)[r["doc_id"]]), None]:
            h = M.END if x is None else code(x)
            c = cls[h] if h in cls else seen["start"](x)
            total += to[before, c] + math.log10(count.get(h, 0) + M.DELTA) - math.log10(n_class[c] + M.DELTA * (v_class[c] + 1))
            before = c
        assert math.isclose(total, r["score"], abs_tol=1e-6)


def test_of_several_labels_the_larger_counts(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.quality import score_quality
    from tidemark.llm.toxicity import score_toxicity

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    low = labels.withColumns({"quality": F.lit(0), "toxic": F.lit(0)})
    odd = labels.unionByName(low.filter("doc_id % 2 = 0")).unionByName(labels.select("doc_id", F.lit(None).cast("long").alias("quality"), F.lit(7).cast("long").alias("toxic")).limit(9)).repartition(3)
    for f in (score_quality, score_toxicity):
        plain, mixed = ({r["doc_id"]: r["score"] for r in f(docs, x).collect()} for x in (labels, odd))
        assert plain.keys() == mixed.keys() and max(abs(plain[i] - mixed[i]) for i in plain) < 1e-9
