"""Links, components and copies: chains, groups, long lists, repeated ids and clashing column names."""

import collections
import random

import numpy as np
import pytest
from test_llm import brute_components

CLASH = "maybe long, at0 long, bucket0 string, bits0 string, sha string, keep string, size long, spread string, hot_size long, wanted long, key string, id string, n long, label string, `a.b` string"


def components_of(rows):
    """Smallest node of every node's component."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def same_partition(got, want):
    assert got.keys() == want.keys()
    pairs = {(got[x], want[x]) for x in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("task_links", [1 << 20, 40])
def test_components(spark, task_links):
    from tidemark.llm.components import components

    rng = random.Random(task_links)
    name = [rng.getrandbits(62) - (1 << 61) for _ in range(1500)]
    chain = [(name[i], name[i + 1]) for i in range(399)]
    star = [(name[500], name[i]) for i in range(501, 700)]
    some = [(name[rng.randrange(700, 1500)], name[rng.randrange(700, 1500)]) for _ in range(500)]
    links = chain + star + some + [(b, a) for a, b in some[:50]]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), task_links).collect()}
    same_partition(got, components_of([x for x in links if x[0] != x[1]]))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain_settles_in_few_rounds(spark):
    from tidemark.llm.components import components

    rng = random.Random(5)
    name = rng.sample(range(1 << 40), 20_000)
    report = []
    labels = components(spark.createDataFrame(list(zip(name, name[1:])), "a long, b long"), 500, report)
    assert labels.count() == 20_000 and labels.select("label").distinct().count() == 1
    assert len(report) <= 12 and all(2 * b <= a + 1 for a, b in zip(report, report[1:]))


def test_local_roots():
    from tidemark.llm.components import local_roots

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    nodes, roots = local_roots(a, b)
    want = components_of(zip(a.tolist(), b.tolist()))
    assert dict(zip(nodes.tolist(), roots.tolist())) == want


def test_chain_of_shifted_texts_through_the_query(spark, tmp_path, monkeypatch):
    from tidemark.llm import components as C
    from tidemark.llm.jaccard_join import op1_jaccard_join

    words = [f"w{i}" for i in range(100 + 4 * 400)]
    rows = [(7 * i + 3, " ".join(words[4 * i : 4 * i + 100])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(C.components, "__defaults__", (64, None))
    got = op1_jaccard_join(spark, str(tmp_path)).collect()
    assert len(got) == 400 and {r["component_id"] for r in got} == {3}


def test_groups_of_copies_at_the_threshold(spark, monkeypatch):
    """Copies of one text with edits of their own: some link, most do not; long lists are refined, not crossed."""
    from tidemark.llm import jaccard_join as J

    rng = random.Random(11)
    rows, n = [], 0
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(140)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
                copy[rng.randrange(140)] = f"e{n}x{rng.randint(0, 99999)}"
            if rng.random() < 0.3:  # a second text in the group
                copy[60:75] = [f"g{group}second{i}" for i in range(15)]
            rows.append((n, " ".join(copy)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    refined, real = [], J.SetJoin.refined

    def spy(self, lists):
        out = real(self, lists)
        refined.append(out.count())
        return out

    monkeypatch.setattr(J.SetJoin, "refined", spy)
    for few in (4, 0):  # 0: every open list is refined as long as that helps
        monkeypatch.setattr(J, "FEW", few)
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, 5, 80).collect())
        assert got == brute_components(rows, 5, 80)
    assert refined


def test_boundary_is_the_cheapest():
    from tidemark.llm.jaccard_join import boundary, prefix, subsets

    rng = random.Random(2)
    for percent in (60, 80, 90):
        for _ in range(20):
            sizes = {a: rng.randint(0, 50) for a in range(1, 30)}
            scan = rng.choice([1.0, 3.0, 40.0])
            cost = lambda x: sum(n * subsets(a, percent) for a, n in sizes.items() if a <= x) + sum(n * int(prefix(a, percent)) * (1 + scan) for a, n in sizes.items() if 100 * a // percent > x)  # noqa: B023, E731
            x, light, heavy = boundary(sizes, scan, percent)
            assert np.isclose(light + heavy, cost(x)) and light + heavy <= min(map(cost, range(30))) * (1 + 1e-9)


def test_near_copies_go_by_row_not_by_id(spark):
    from tidemark.llm.jaccard_join import drop_near_copies

    base = [f"w{i}" for i in range(80)]
    near = " ".join([*base[:-1], "other"])
    rows = [(3, " ".join(base)), (5, near), (5, "an unrelated text"), (None, " ".join(base)), (None, "alone without an id"), (6, None), (6, None), (8, "twice the same row"), (8, "twice the same row"), (9, "")]
    df = spark.createDataFrame([(i, t, *[None] * 15) for i, t in rows], f"doc_id long, text string, {CLASH}")
    got = drop_near_copies(df)
    want = [(3, " ".join(base)), (5, "an unrelated text"), (None, "alone without an id"), (6, None), (6, None), (8, "twice the same row"), (9, "")]
    assert got.columns == df.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter(want)
    nothing = df.limit(0)
    assert drop_near_copies(nothing).count() == 0


def test_sets_of_unlike_sizes_make_no_list_long(spark, monkeypatch):
    """Frequent words stand in sets of all sizes: few of those can link, so nothing has to be refined (its differences from pivots filled the disk)."""
    from tidemark.llm import jaccard_join as J

    rng = random.Random(11)
    words, texts = [f"w{i}" for i in range(300)], []
    for _ in range(500):
        texts.append(rng.sample(words, int(20 * 14 ** rng.random())))
    for t in rng.sample(texts, 60):  # at the limit of similarity and of the size filter
        gone = len(t) // 10 if rng.random() < 0.5 else len(t) // 18
        texts.append(rng.sample(t, len(t) - gone))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(J.SetJoin, "refined", lambda *_: pytest.fail("refined"))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, 1, 90) and len({r["component_id"] for r in got}) < len(rows) - 40


def test_exact_copies_with_clashing_columns_and_hot_groups(spark, monkeypatch):
    from tidemark.llm import exact_dedup as E

    texts = [None, "", "a", "b", "a", "a", "c", "b"] + ["hot"] * 3000
    rows = [(i if i != 4 else None, t, *[None] * 14, f"own {i}") for i, t in enumerate(texts)] + [(3007, "hot", *[None] * 14, "again"), (6, "c", *[None] * 14, "again")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(5)
    for hot in (E.HOT, 1):
        monkeypatch.setattr(E, "HOT", hot)
        got = E.exact_dedup(df).collect()
        assert len(got) == len(rows)
        sizes = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got}
        assert {(0, 1, 2), (1, 1, 2), (2, 5, 3), (None, 5, 3), (3, 7, 2), (6, 6, 2), (8, 3007, 3001)} <= sizes
        kept = E.drop_exact_copies(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, ""), (5, "a"), (6, "c"), (7, "b"), (3007, "hot")]
