"""The training-data operators against brute force, round trips and held-out accuracy, and on odd tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, `__own` string"


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def odd_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "Two words"), (7, "two WORDS"), (None, "no id here at all"), (8, None)]
    rows += [(10, " ".join(base)), (11, " ".join(base)), (11, " ".join(base)), (12, " ".join(base[:60] + ["changed"] + base[61:])), (13, " ".join(base[:50] + ["x"] * 25 + base[75:])), (14, "y" * 300_000), (15, " ".join(word() for _ in range(30_000)))]
    rows += [(20, "don't <|endoftext|> we'll İ É日本 3.14 ½ x\u0085y"), (21, "á café"), (22, "GNU General Public License; Apache-License, cc by cc by MIT license")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "z") for i, t in odd_rows()], DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return (text or "").encode().lower().split()


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[find(b)] = find(a)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return collections.Counter((i, len(s), least.get(find(n)) if s else i) for n, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join(spark, odd, k, percent):
    from tidemark.llm.jaccard_join import jaccard_components

    rng = random.Random(percent)
    rows = [(i, t) for i, t in odd_rows() if not t or len(t) < 100_000]
    for i in range(60):  # families of near copies, small and large sets
        n = rng.choice([3, 8, 12, 20, 40, 200])
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(n)]
        for c in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                copy[rng.randrange(n)] = f"new{rng.randint(0, 9999)}"
            rows.append((100 + 10 * i + c, " ".join(copy)))
    df = spark.createDataFrame([(i, t, None, "s", None, "z") for i, t in rows], DOC).repartition(5)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, k, percent).collect())
    assert got == brute_components(rows, k, percent)


def test_jaccard_group_of_near_copies(spark):
    from tidemark.llm.jaccard_join import drop_near_copies, jaccard_components

    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: i % 190] + [f"e{i}"] + base[i % 190 + 1 :])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["component_id"] for r in jaccard_components(df, 3, 90).collect()} == {0}
    assert [r["doc_id"] for r in drop_near_copies(df).collect()] == [0]


def test_overlaps_are_exact():
    from tidemark.llm import jaccard_join as J

    for p in (50, 80, 90, 100):
        for a in range(1, 40):
            for b in range(J.smallest_partner(a, p), 100 * a // p + 1):
                o = J.overlap(a, b, p)
                assert 100 * o >= p * (a + b - o) and 100 * (o - 1) < p * (a + b - o + 1)
                assert a - o + 1 <= J.prefix(a, p)


def test_quality_and_toxicity_on_held_out_rows(spark):
    from tidemark.llm.quality import score_quality
    from tidemark.llm.toxicity import score_toxicity

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    want = {r["doc_id"]: r for r in labels.collect()}
    for f, col, least in ((score_quality, "quality", 0.97), (score_toxicity, "toxic", 0.85)):
        rows = f(docs, labels).collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        held = [(r["score"], want[r["doc_id"]][col]) for r in rows if r["held_out"] and r["doc_id"] in want]
        pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert auc >= least, (col, auc)


def test_block_max_search_is_exact():
    from tidemark.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(1)
    n, t = 700, 40
    rows, terms = np.nonzero(rng.random((n, t)) < 0.1)
    counts = rng.integers(1, 5, len(rows)).astype(float)
    index = BlockMaxIndex(np.arange(t, dtype=np.uint64), rng.random(t) + 1, np.arange(n) * 3, np.zeros(n))
    index.load(rows, terms, counts)
    dense = np.zeros((n, t))
    dense[rows, terms] = index.weigh(rows, terms, counts, n)
    for _ in range(50):
        q = np.flatnonzero(rng.random(t) < 0.15)
        if not len(q):
            continue
        w = rng.random(len(q))
        w /= np.sqrt(w @ w)
        places, cos = index.nearest(q, w, 10)
        all_cos = dense[:, q] @ w
        best = np.lexsort((np.arange(n), -np.round(all_cos, 12)))[:10]
        best = best[all_cos[best] > 0]
        assert places.tolist() == best.tolist() and np.allclose(cos, np.minimum(all_cos[best], 1))


def test_labels_missing_or_of_one_kind(spark, odd, none):
    from tidemark.llm.quality import score_quality
    from tidemark.llm.toxicity import drop_toxic, score_toxicity

    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (12, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    n, text = len(odd_rows()), dict(odd_rows())
    for labels, q, t in ((nothing, 0.5, 0.0), (ones, 1.0, 0.0)):
        assert all(r["score"] == (q if words(text[r["doc_id"]]) else 0.0) for r in score_quality(odd, labels).collect())
        assert {r["score"] for r in score_toxicity(odd, labels).collect()} == {t}
        assert drop_toxic(odd, labels).count() == n and drop_toxic(odd, labels).columns == odd.columns
    assert score_quality(none, ones).count() == 0 and score_toxicity(none, ones).count() == 0


def test_token_counts(odd, none, tok):
    from tidemark.llm.bpe import codec, tokenizer_path
    from tidemark.llm.token_counts import TokenCounter, token_counts
    from tidemark.llm.transducer import Transducer

    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(odd, tokenizer_path()).collect())
    want = collections.Counter()
    for i, t in odd_rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert got == want and token_counts(none, tokenizer_path()).count() == 0
    machine = TokenCounter(Transducer(tokenizer_path()), codec(tokenizer_path()))
    for _, t in odd_rows():
        for chunk in (3, 64, 5000):
            if t and len(t) < 5000:
                assert machine.count(t.encode(), chunk) == len(tok.encode(t, add_special_tokens=False).ids)


def test_packing(odd, none, tok):
    from tidemark.llm.packing import pack_documents

    rows = pack_documents(odd).collect()
    want = collections.Counter()
    for i, t in odd_rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            want[i, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert pack_documents(none).count() == 0


def test_store_round_trip(spark, odd, none, tok):
    from tidemark.llm.bpe import tokenizer_path
    from tidemark.llm.shared import new_path
    from tidemark.llm.token_store import TokenStore

    store = TokenStore.write(odd, new_path(spark, "t"), tokenizer_path())
    ids = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in odd_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(store.checksums().collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in ids]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    back = {r["doc_id"]: r["ids"] for r in store.reconstruct([10, 20, 15]).collect()}
    assert all(back[i] == x for i, x in ids if i in back) and set(back) == {10, 20, 15}
    store.verify()
    chunks = store._objects(0)
    assert chunks.count() == chunks.select("key").distinct().count()
    assert TokenStore.write(none, new_path(spark, "t"), tokenizer_path()).checksums().count() == 0


def test_crc_algebra():
    from tidemark.llm.token_store import crc_shift, cuts, merkle_root

    rng = np.random.default_rng(2)
    a, b = rng.bytes(1000), rng.bytes(777)
    joined = crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([777])) ^ np.uint32(zlib.crc32(b))
    assert int(joined[0]) == zlib.crc32(a + b)
    ids = rng.integers(0, 40000, 20_000).astype(np.uint32)
    one = cuts(ids, np.array([0, 20_000]))
    moved = cuts(np.concatenate([ids[:5], ids]), np.array([0, 20_005])) - 5
    assert len(set(one.tolist()) & set(moved.tolist())) >= len(one) - 2
    assert merkle_root([b"a", b"b"]) != merkle_root([b"b", b"a"])


def test_language_model(odd, none):
    from tidemark.llm import class_lm

    rows = odd_rows()
    count, texts = collections.Counter(), []
    for i, t in rows:
        w = [*words(t), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        texts.append((i, held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, held, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)) for i, held, w in texts)
    before = class_lm.HEAD
    try:
        for head in (before, 64):  # counts broadcast, and joined
            class_lm.HEAD = head
            got = class_lm.score_texts(odd).collect()
            assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
            assert all(r["score"] < 0 for r in got)
    finally:
        class_lm.HEAD = before
    assert class_lm.score_texts(none).count() == 0


def test_exchange_finds_planted_classes():
    from tidemark.llm.class_lm import exchange

    table = np.zeros((13, 13))
    rng = np.random.default_rng(8)
    table[np.ix_(range(1, 7), range(7, 13))] = rng.integers(1, 30, (6, 6))
    table[np.ix_(range(7, 13), range(1, 7))] = rng.integers(1, 30, (6, 6))
    cls = exchange(table, 3)
    assert len(set(cls[1:7])) == 1 and len(set(cls[7:])) == 1 and cls[1] != cls[7]


def test_exchange_step_moves_each_word_to_its_best_class():
    from tidemark.llm.class_lm import best_classes, likelihood

    rng = np.random.default_rng(3)
    n, c = 30, 5
    table = rng.poisson(0.7, (n, n)).astype(float)
    cls = rng.integers(1, c, n)
    cls[0] = 0
    member = np.eye(c)
    grouped = lambda x: member[x].T @ table @ member[x]
    got = best_classes(grouped(cls), cls, table @ member[cls], table.T @ member[cls], np.diag(table))
    for i in range(n):
        each = [likelihood(grouped(np.where(np.arange(n) == i, k, cls))) for k in range(1, c)]
        assert got[i] == (1 + int(np.argmax(each)) if i else 0)


def test_classes_of_words_beyond_the_start(spark):
    """Two kinds of words, all of one ending and more than the start keeps alone: passes over all words part them, with counts broadcast or joined."""
    from tidemark.llm import class_lm

    rng = np.random.default_rng(4)
    kinds = [[f"{k}{i}xyz" for i in range(400)] for k in "ab"]
    often = np.repeat([4 / 1000, 1 / 1000], 200)
    texts = [" ".join(kinds[j % 2][rng.choice(400, p=often)] for j in range(40)) for _ in range(600)]
    swapped = " ".join(kinds[0][i] for i in range(40))  # never seen: the first kind after itself
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, swapped])], "doc_id long, text string")
    held = [i for i in range(601) if zlib.crc32(str(i).encode()) % 7 == 2]
    before = class_lm.HEAD
    try:
        for head in (before, 512):
            class_lm.HEAD = head
            report = []
            got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in class_lm.score_texts(frame, report=report).collect()}
            assert max(report) > report[0]
            assert np.mean([got[i] for i in held if i < 600]) > got[600] + 0.5
    finally:
        class_lm.HEAD = before


def test_exact_dedup(spark, odd, none):
    import hashlib

    from tidemark.llm.exact_dedup import drop_exact_copies, exact_dedup

    groups = collections.defaultdict(list)
    for i, t in odd_rows():
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    got = exact_dedup(odd).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns and collections.Counter(r["text"] or "" for r in kept.collect()) == collections.Counter(dict.fromkeys(groups, 1))
    assert exact_dedup(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_copies_pass_through_unshuffled(spark):
    from tidemark.llm.exact_dedup import _plan

    df = spark.createDataFrame([(i, f"text {i}") for i in range(5000)] + [(9000, "text 7")], "doc_id long, text string")
    flagged = _plan(df, "doc_id", "text")[0]
    n = flagged.filter("maybe").count()
    assert 2 <= n <= 200


@pytest.mark.parametrize("most", [0, 16 << 10, 128 << 20])
def test_documents_without_copies_never_move(spark, monkeypatch, most):
    """Whether every task may be handed no filter, one for the repeated digests alone, or one for all rows: the same result; with a filter nothing but its finds is exchanged."""
    from tidemark.llm import exact_dedup as E

    monkeypatch.setattr(E, "FILTER_BYTES", most)
    rows = [(i, f"text {i}") for i in range(20_000)] + [(30_000 + i, f"text {i}") for i in range(50)] + [(40_000 + i, "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = E.exact_dedup(df).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in got} == {True: 20_001, False: 50 + 2999}
    kept = E.drop_exact_copies(df)
    plan = kept._jdf.queryExecution().sparkPlan()
    unions = [p for p in iter_plans(plan) if p.nodeName() == "Union"]
    assert bool(unions) == bool(most)  # without a filter all rows go one way
    for u in unions:
        names = {p.nodeName() for p in iter_plans(u.children().apply(0))}
        assert "BroadcastHashJoin" in names and not any(x in n for n in names for x in ("SortMergeJoin", "ShuffledHash", "Aggregate"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(50, 20_000), *range(30_000, 30_050), 42_999])


def iter_plans(node):
    yield node
    for i in range(node.children().length()):
        yield from iter_plans(node.children().apply(i))


def test_decontamination(spark, none):
    from tidemark.llm import decontaminate as D

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.randint(15, 60)) for i in range(40)} | {90: text(2), 91: text(5), 92: []}
    docs, truth = [], set()
    for n in range(240):
        body = text(rng.randint(0, 400))
        if n % 2 == 0:
            i = rng.choice(list(range(40)))
            planted = list(items[i])
            for _ in range(rng.randint(0, len(planted) // 10)):
                planted[rng.randrange(len(planted))] = word()
            at = rng.randint(0, len(body))
            body[at:at] = planted
            truth.add((n, i))
        docs.append((n, ("\n" if n % 3 else " ").join(body).upper() if n % 5 == 0 else ", ".join(body)))
    docs += [(500, None), (501, ""), (None, " ".join(items[0])), (502, " ".join(items[90])), (502, " ".join(items[90]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(93, None)], "item_id long, text string")
    df = spark.createDataFrame([(i, t, None, "s", None, "z") for i, t in docs], DOC)
    found = D.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    encode = lambda x: np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in D.hashed_words(pa.array([x or ""]), D.ALNUM))])
    brute = set()
    for i, t in docs:
        for k, w in items.items():
            e = int(0.2 * len(w)) if len(w) >= 4 else 0
            if w and min(D.distances(encode(" ".join(w)).tolist(), encode(t).tolist()), default=99) <= e:
                brute.add((i, k))
    assert truth <= brute and got <= brute and len(brute - got) <= 0.02 * len(brute)
    assert all(r["similarity"] >= 0.8 - 1e-9 for r in found)
    clean = D.drop_contaminated(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got} and clean.columns == df.columns
    assert D.contaminated(none, bench).count() == 0 and D.contaminated(df, bench.filter("false")).count() == 0


def test_edit_distance():
    from tidemark.llm.decontaminate import distances, occurrences

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert distances(a, b) == row[1:]
        most = rng.randint(0, len(a) - 1)
        near = [j for j, d in enumerate(row) if j and d <= most]
        got = occurrences(a, b, most)
        assert len(got) == sum(j - 1 not in near for j in near)
        for start, end, d in got:
            assert d == row[end] and edits(a, b[start:end]) == d


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_license_scan(spark, odd, none):
    from tidemark.llm import license_scan as L

    mit = next(t for t, name in L.TEMPLATES.items() if name == "mit-text")
    edited = mit.split()
    edited[5:6] = ["person", "or", "entity"]
    extra = [(30, mit.upper() + "."), (31, " ".join(edited)), (32, " ".join(mit.split()[:12])), (33, "under the CC-BY. Licensed under CC BY-SA 4.0"), (22, "mit license")]
    rows = odd_rows() + extra
    df = odd.unionByName(spark.createDataFrame([(i, t, None, "s", None, "z") for i, t in extra], DOC))
    got = L.scan_licenses(df)[0].collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        base = L.brute_base(t)
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        want[i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base}))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    labels = {r["doc_id"]: r["labels"].split(",") for r in got}
    assert "mit-text" in labels[30] and "mit-text" in labels[31] and "mit-text" not in labels[32] and "cc-by-sa-4.0" in labels[33] and "cc-by-nc-4.0" not in labels[33]
    assert all(0 <= r["score"] <= 1 for r in got) and L.scan_licenses(none)[0].count() == 0


def test_pipeline(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline as P

    assert entry.queries()["pipeline"] is P.run
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from tidemark.llm.decontaminate import contaminated
    from tidemark.llm.toxicity import score_toxicity

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}
    left = {i: t for i, t in rows.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first[left[i]] = i
    left = {i: t for t, i in first.items()}
    comp = {i: c for i, _, c in brute_components(sorted(left.items()), 5, 80)}
    left = {i: t for i, t in left.items() if comp[i] == i}
    kept = spark.createDataFrame(sorted(left.items()), "doc_id long, text string")
    bad = {r["doc_id"] for r in contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    out = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(left) - bad
