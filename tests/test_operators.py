"""Edge cases and numerical references of single operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as C
from tidemark.operators import audit, corpus, panels, regimes, stats, text, topics, unitroot
from tidemark.operators import windows as W


def one(spark, sql):
    return spark.sql(sql)


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([(" 금리 ,금리,a,3일,기자,2022년,0.5%,",), (None,), ("",)], "k string")
    got = [r[0] for r in df.select(C.keyword_tokens(F.col("k"), ["기자"])).collect()]
    assert got == [["금리"], [], []]
    weekly = df.select(C.keyword_tokens(F.col("k"), trim=False, dedup=False)).first()[0]
    assert weekly.count("금리") == 1 and " 금리 " in weekly


def test_iso_week_edges(spark):
    df = spark.createDataFrame([("2020-12-31",), ("2021-01-01",), ("2024-12-30",), ("2025-01-01",)], "d string").select(C.iso_week_key(F.col("d").cast("date")))
    assert [r[0] for r in df.collect()] == ["2020-W53", "2020-W53", "2025-W01", "2025-W01"]


def test_safe_date_and_range(spark):
    df = spark.createDataFrame([("20240229",), ("20230229",), ("x",), (None,)], "d string").select(C.safe_date(F.col("d")).alias("d"))
    kept = df.select(C.in_range(F.col("d"), F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"))).collect()
    assert [r[0] for r in kept] == [True, False, False, False]


def test_full_windows(spark):
    for n in (2, 3, 12, 13):
        df = spark.createDataFrame([(i, float(i * i % 7)) for i in range(n)], "t int, x double")
        got = df.select(W.full_window_std(F.col("x"), W.ordered("t"), 3).alias("s"), W.full_window_std(F.col("x"), W.ordered("t"), 12).alias("l")).toPandas()
        s = pd.Series([float(i * i % 7) for i in range(n)])
        np.testing.assert_allclose(got["s"].astype(float), s.rolling(3).std(), atol=1e-12)
        np.testing.assert_allclose(got["l"].astype(float), s.rolling(12).std(), atol=1e-12)


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r["i"]: r["p_holm"] for r in W.holm(df, tie=["i"]).collect()}
    assert got[4] is None and got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.06) and got[3] == pytest.approx(0.06)


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(False, False), (None, False)], "p boolean, a boolean")
    r = stats.confusion(df, F.col("p"), F.col("a")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (0, 0, 0, 2) and r.precision is None and r.recall is None and r.specificity == 1


def test_activation_ties_and_nulls(spark):
    z = spark.createDataFrame([("m1", "Train", "b", 0.7), ("m1", "Train", "a", 0.7), ("m1", "Train", "c", None), ("m2", "Train", "a", 0.1), ("m2", "Train", "b", 0.2)], "month string, period string, regime string, z double")
    got = {r["month"]: r for r in regimes.activation(z, ["a", "b", "c"]).collect()}
    assert got["m1"]["argmax"] == "a" and got["m1"]["active"] == "a;b" and got["m1"]["omitted"] == "b" and got["m1"]["n_active"] == 2
    assert got["m2"]["argmax"] == "b" and got["m2"]["hurdle"] == "none" and got["m2"]["active"] == "none"


def test_claims_prefer_longest_then_order(spark):
    pairs = regimes.domain_pairs(spark, {"x": {"g": ["rate", "in"]}, "y": {"h": ["interest", "in"]}})
    terms = spark.createDataFrame([("interest rate",), ("inn",), ("zzz",)], "term string")
    got = {r["term"]: (r["keyword"], r["domain"]) for r in regimes.claim_terms(terms, pairs).collect()}
    assert got == {"interest rate": ("interest", "y"), "inn": ("in", "x")}


def test_mapping_boundaries(spark):
    w = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.9), (1, "a", 0.01), (1, "z", 0.99), (2, "z", 0.0), (3, "a", 1.0), (3, "b", 0.5)], "topic int, term string, weight double")
    claims = spark.createDataFrame([("a", "da"), ("b", "db")], "term string, domain string")
    got = {r["topic"]: r["status"] for r in regimes.map_topics(w, claims).collect()}
    assert got == {0: "ambiguous", 1: "residual", 2: "residual", 3: "assigned"}


def test_mapping_doesnt_depend_on_topic_order(spark):
    rng = np.random.default_rng(1)
    w = pd.DataFrame([(t, x, float(rng.random())) for t in range(5) for x in "abcd"], columns=["topic", "term", "weight"])
    claims = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "p")], "term string, domain string")
    base = regimes.map_topics(spark.createDataFrame(w), claims).toPandas().set_index("topic")
    perm = rng.permutation(5)
    moved = regimes.map_topics(spark.createDataFrame(w.assign(topic=perm[w["topic"]])), claims).toPandas().set_index("topic")
    for t in range(5):
        assert base.loc[t, "best"] == moved.loc[perm[t], "best"] and base.loc[t, "status"] == moved.loc[perm[t], "status"]


def test_train_zscore_ignores_the_future(spark):
    rows = [(i, "Train" if i < 8 else "Eval", float(i % 5)) for i in range(12)]
    f = lambda rs: {r["i"]: r["z"] for r in spark.createDataFrame(rs, "i int, p string, x double").withColumn("z", W.train_zscore(F.col("x"), F.col("p") == "Train")).collect()}
    a, b = f(rows), f([(i, p, 1e6 if p == "Eval" else x) for i, p, x in rows])
    assert all(a[i] == b[i] for i in range(8))


def test_forecasts_ignore_the_future(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=30))
    f = lambda v: {r["t"]: r["forecast"] for r in stats.ar1_forecasts(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "t int, y double"), "t", "y", 20).collect()}
    a = f(y)
    b = f(np.where(np.arange(30) >= 25, 1e6, y))
    assert all(a[t] == pytest.approx(b[t]) for t in range(20, 25 + 1))
    x = np.column_stack([np.ones(19), y[:19]])
    want = np.array([1, y[19]]) @ np.linalg.lstsq(x, y[1:20], rcond=None)[0]
    assert a[20] == pytest.approx(want)


def test_hac_against_the_sandwich(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60), rng.normal(size=60)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g string, t int, x double, y double")
    for r in stats.hac_slope(df, ["g"], "t", [2, 4]).collect():
        fit = stats.ols_hac(y, x[:, None], r["maxlags"])
        assert r["beta"] == pytest.approx(fit["beta"][1]) and r["se"] == pytest.approx(fit["se"][1])


def test_distributions():
    assert stats.f_upper(4.683257, 6, 60) == pytest.approx(0.000573, abs=1e-6)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)


def test_spearman_shares_ranks(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 1.0), ("g", 3.0, 5.0), ("g", None, 1.0), ("g", 4.0, 4.0)], "g string, x double, y double")
    want = pd.Series([1.5, 1.5, 3, 4]).corr(pd.Series([2, 1, 4, 3]))
    assert stats.spearman(df, ["g"], "x", "y").first()["rho"] == pytest.approx(want)


def test_hungarian_beats_every_permutation():
    import itertools

    c = np.random.default_rng(4).random((5, 5))
    best = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert sum(c[i, j] for i, j in enumerate(topics.hungarian(c))) == pytest.approx(best)


def test_nnls_conditions():
    rng = np.random.default_rng(5)
    h, x = rng.random((3, 8)), rng.random((6, 8))
    w = topics.nnls_rows(x @ h.T, h @ h.T, np.zeros((6, 3)), 2000)
    g = w @ (h @ h.T) - x @ h.T
    assert (w >= 0).all() and (g[w == 0] > -1e-7).all() and np.abs(g[w > 0]).max() < 1e-6


def test_nmf_recovers_planted_topics(spark):
    rows = [(i, list(range(0, 4)) if i % 2 else list(range(4, 8)), [0.5] * 4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, idx array<int>, w array<double>")
    model = topics.fit_nmf(df, 8, 2, 30)
    assert all(a >= b - 1e-9 for a, b in zip(model.objective, model.objective[1:], strict=False)) and model.objective[-1] < 1e-6
    got = topics.transform(df, model).collect()
    assert all(r["valid"] and max(r["topics"]) > 0.99 and sum(r["topics"]) == pytest.approx(1) for r in got)


def test_month_grid_and_guards(spark):
    assert [r[0] for r in panels.month_grid(spark, "2023-11", "2024-02").collect()] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        panels.one_to_one(twice, twice, "k")


def test_systematic_sample(spark):
    df = spark.range(1003).repartition(7)
    got = sorted(r["id"] for r in text.systematic_sample(df, ["id"], 10).collect())
    assert got == list(range(0, 1003, 10))


def test_corpus_order_of_stages(spark):
    raw = spark.createDataFrame([
        ("b", "f", 0, "20240105", "S", "T1", "k1", "http://x/1", None), ("a", "f", 0, "20240105", "S", "T1", "k1", "HTTP://X/1", "중복"), ("a", "f", 1, "20240106", "S", "T1", "k2", "http://x/1", None),
        ("a", "f", 2, "20240107", "S", "T2", " ", "", None), ("a", "f", 3, "20250107", "S", "T2", "k", "", None), ("a", "f", 4, "bad", "S", "T2", "k", "", None), ("a", "f", 5, "20240108", " S ", "T3", "k", "", None), ("a", "f", 6, "20240108", "S", "T3 ", "k", None, None)],
        "folder string, name string, row long, date string, source string, title string, keywords string, url string, exclude_flag string")
    kept, counters = corpus.build_corpus(raw, "2024-01-01", "2024-12-31")
    assert sorted((r["folder"], r["row"]) for r in kept.collect()) == [("a", 1), ("a", 5)]
    assert tuple(counters.first()) == (8, 6, 5, 4, 2)


def test_verdicts(spark):
    rows = audit.checks(audit.check("a", one(spark, "SELECT true AS ok")), audit.check("b", one(spark, "SELECT cast(null AS boolean) AS ok")))
    assert dict(audit.verdict(rows).collect())["overall"] == audit.NONE
    assert dict(audit.verdict(rows.unionByName(audit.check("c", one(spark, "SELECT false AS ok")))).collect())["overall"] == audit.FAIL


def test_files_stay_inside(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    before = audit.snapshot([tmp_path / "a.txt"])
    audit.export(tmp_path / "a.txt", tmp_path / "out", "b/a.txt")
    with pytest.raises(ValueError):
        audit.export(tmp_path / "a.txt", tmp_path / "out", "../a.txt")
    assert audit.changed(before, audit.snapshot([tmp_path / "a.txt"])) == []


def test_unit_roots():
    rng = np.random.default_rng(6)
    walk, noise = np.cumsum(rng.normal(size=400) + 0.2), rng.normal(size=400)
    assert unitroot.adf(noise, 0)[0] < -8 and unitroot.adf(walk, 0)[0] > -3.4
    assert unitroot.kpss(walk)[0] > 0.463 > unitroot.kpss(noise)[0]


def test_published_regime_metrics(spark):
    """The published counts follow from an activation table: 39 of 67 months, 112 active, 49 omitted."""
    rows = [(f"m{i:02d}", "Train" if i < 48 else "Eval", n, n - 1 if n else 0) for i, n in enumerate([3] * 10 + [2] * 29 + [1] * 24 + [0] * 4)]
    act = spark.createDataFrame(rows, "month string, period string, n_active long, n_omitted long")
    r = {x["split"]: x for x in regimes.single_vs_multi(act).collect()}["Full"]
    assert (r["months"], r["multi"], r["active"], r["omitted"]) == (67, 39, 112, 49) and r["omitted_pct"] == pytest.approx(43.75)


def test_bootstrap_doesnt_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(40)], "t int, x double, y double")
    a = stats.block_bootstrap(df, "t", "x", "y", [4], 50).collect()
    b = stats.block_bootstrap(df.repartition(13), "t", "x", "y", [4], 50).collect()
    assert a[0]["replicates"] == 50 and all(math.isclose(p, q, abs_tol=1e-9) for p, q in zip(a[0], b[0], strict=True))


def test_coefficient_comparison(spark):
    cols = "variable string, beta double, r2 double, p_holm double"
    base = spark.createDataFrame([("a", 1.0, 0.5, 0.01), ("b", -1.0, 0.5, 0.2), ("c", 2.0, 0.5, None)], cols)
    other = spark.createDataFrame([("a", -0.5, 0.4, 0.02), ("b", -2.0, 0.4, 0.04), ("c", 0.0, 0.4, 0.01), ("d", 1.0, 0.4, 0.01)], cols)
    got = {r["variable"]: r for r in stats.compare_coefficients(base, other, ["variable"]).collect()}
    assert (got["a"]["beta_difference"], got["a"]["sign_preserved"], got["a"]["significance_preserved"]) == (-1.5, False, True)
    assert (got["b"]["sign_preserved"], got["b"]["significance_preserved"]) == (True, False)
    assert (got["c"]["sign_preserved"], got["c"]["significance_preserved"]) == (False, True)  # an unknown p counts as unchanged
    assert got["d"]["beta_difference"] is None and got["d"]["significance_preserved"] is None


def test_slopes_are_adjusted_within_their_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = 0.4 * x[:, 0] + rng.normal(size=60)
    df = spark.createDataFrame([("s", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)], "g string, t int, y double, a double, b double")
    got = {r["variable"]: r for r in stats.ols_table(df, ["g"], "t", "y", ["a", "b"]).collect()}
    assert got["const"]["p_holm"] is None and got["const"]["p"] is not None
    low, high = sorted((got["a"], got["b"]), key=lambda r: r["p"])
    assert math.isclose(low["p_holm"], min(1, 2 * low["p"])) and math.isclose(high["p_holm"], max(low["p_holm"], high["p"]))


def test_largest_difference_and_ranks(spark):
    rows = [("g", "a", 1.0, 2.0), ("g", "b", 2.0, 3.0), ("g", "c", 3.0, 3.5), ("g", "d", None, 9.0)]
    r = stats.compare_series(spark.createDataFrame(rows, "k string, month string, x double, y double"), ["k"], "month", "x", "y").first()
    assert (r["n"], r["largest"], r["largest_at"]) == (3, 1.0, "a")  # the first of two equal differences
    assert math.isclose(r["rho"], 1.0) and math.isclose(r["bias"], 2.5 / 3)


def test_rendered_cells(spark):
    shown = spark.createDataFrame([("m1", "1.23", ""), ("m2", "1.24", "0.00"), ("m3", "5.00", "1.00"), ("m4", "x", "1.00")], "month string, a string, b string")
    value = spark.createDataFrame([("m1", 1.2345, None), ("m2", 1.2345, None), ("m4", 5.0, 1.0), ("m5", 1.0, 1.0)], "month string, a double, b double")
    got = {(r["month"], r["column"]): r["ok"] for r in audit.recheck(shown, value, ["month"], ["a", "b"], 2).collect()}
    assert got == {("m1", "a"): True, ("m1", "b"): True, ("m2", "a"): False, ("m2", "b"): False, ("m3", "a"): False, ("m3", "b"): False, ("m4", "a"): False, ("m4", "b"): True, ("m5", "a"): False, ("m5", "b"): False}


def test_diversity(spark):
    t = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 1), ("y", "c", 2)], "topic string, term string, rank int")
    got = {(r["k"], r["topic"]): (r["redundancy"], r["diversity"]) for r in text.diversity(t, "topic", [1, 2]).collect()}
    assert got == {(1, "x"): (1.0, 0.5), (1, "y"): (1.0, 0.5), (2, "x"): (0.5, 0.75), (2, "y"): (0.5, 0.75)}


def test_nmf_ways_agree(spark, monkeypatch):
    """All tasks together and one task by itself run the same iterations; the start is the library's definition by a dense decomposition."""
    rng = np.random.default_rng(3)
    x = rng.random((60, 3)) @ rng.random((3, 12)) * (rng.random((60, 12)) < 0.7)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id int, idx array<int>, w array<double>").repartition(20)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    h = np.zeros((3, 12))
    h[0] = np.sqrt(s[0]) * np.abs(vt[0])
    for i in (1, 2):
        pairs = [(np.maximum(e * u[:, i], 0), np.maximum(e * vt[i], 0)) for e in (1, -1)]
        a, b = max(pairs, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        h[i] = np.sqrt(s[i] * np.linalg.norm(a) * np.linalg.norm(b)) * b / np.linalg.norm(b)
    w = topics.nnls_rows(x @ h.T, h @ h.T, np.zeros((60, 3)), 2000)
    alone = topics.fit_runs(df.withColumn("run", F.lit(0)), 12, 3, [("nndsvd", None)], [1, 20])[0]
    for cells in (25_000, 4):  # one block, and more tasks than are added at once
        monkeypatch.setattr(topics, "LEAST_CELLS", cells)
        monkeypatch.setattr(topics, "BLOCK_ROWS", 7)
        monkeypatch.setattr(topics, "FAN", 2)
        one, more = topics.fit_nmf_steps(df, 12, 3, [1, 20])
        assert one.objective[0] == pytest.approx(((x - w @ h) ** 2).sum(), rel=1e-3)
        assert len(more.objective) > 1 and more.objective[-1] < one.objective[0]
        assert np.allclose(one.h, alone[0].h, atol=1e-6) and more.objective == pytest.approx(alone[1].objective, rel=1e-6)
        assert (topics.fit_nmf(df.limit(0), 12, 3, 2).h == 0).all()


def test_matched_bases():
    a = np.array([[4.0, 3, 0, 0], [0, 0, 2, 1]])
    m = topics.match_bases(a, a[::-1])
    assert [(x["left"], x["right"]) for x in m] == [(0, 1), (1, 0)] and all(x["cosine"] == pytest.approx(1) and x["weighted_jaccard"] == pytest.approx(1) and x["margin"] == pytest.approx(1) for x in m)


def test_stability_and_convergence(spark):
    rows = [(i, list(range(0, 4)) if i % 2 else list(range(4, 8)), [0.5] * 4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, idx array<int>, w array<double>")
    got = topics.stability(df, 8, 2, topics.study_runs(2, 1, 0, 2), max_iter=50).collect()
    assert sorted((r["kind"], r["run_a"], r["run_b"]) for r in got) == [("base-nndsvda", 0, 3), ("base-random", 0, 4), ("base-random", 0, 5), ("base-subsample", 0, 1), ("base-subsample", 0, 2), ("random", 4, 5), ("subsample", 1, 2)]
    assert all(r["least_cosine"] > 0.99 and r["from_90"] == 2 for r in got)
    c = topics.convergence(df, 8, 2, [5, 10], [20]).collect()
    assert [(r["base_iter"], r["max_iter"]) for r in c] == [(5, 5), (5, 10), (10, 10)] and all(r["converged"] and r["same_order"] and r["h_change"] < 1e-6 for r in c)


def test_a_continued_fit_equals_separate_fits(spark):
    rng = np.random.default_rng(8)
    x = rng.random((40, 3)) @ rng.random((3, 9)) * (rng.random((40, 9)) < 0.8)
    df = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)], "doc_id int, idx array<int>, w array<double>").coalesce(2)
    for start in ("nndsvd", "nndsvdar"):
        steps = topics.fit_nmf_steps(df, 9, 3, [1, 2, 4], 0.0, start, 3)
        for m, n in zip(steps, (1, 2, 4), strict=True):
            alone = topics.fit_nmf(df, 9, 3, n, 0.0, start, 3)
            assert np.allclose(m.h, alone.h) and len(m.objective) == n and np.allclose(m.objective, alone.objective)
    assert len(topics.convergence(df, 9, 3, [1, 2], [3], tol=0.0).collect()) == 6


def test_filled_starts_have_no_zeros(spark):
    total = lambda make: make((np.array([0, 0, 1]), np.array([0, 1, 2]), np.array([1.0, 2.0, 3.0])), 2)
    plain, filled, jittered = (topics._first_basis(total, 4, 2, s, 1) for s in topics.STARTS[:3])
    assert (plain == 0).any() and (filled > 0).all() and (filled[plain == 0] == 6 / 8).all() and 0 < jittered[plain == 0].max() < 6 / 800


def test_an_unstable_topic_shows(spark):
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(("rate", "chip", "home"))], "idx int, term string")
    base = np.array([[1.0, 0, 0], [0, 1.0, 0.1]])
    moved = np.array([[0, 1.0, 0.95], [1.0, 0, 0]])  # topics change places, the second becomes ambiguous
    weights, matched = topics.bases_table(spark, [base, base, moved], vocab)
    claims = spark.createDataFrame([("rate", "macro", "m"), ("chip", "tech", "t"), ("home", "estate", "e")], "term string, domain string, grp string")
    mapped = regimes.mapped_runs(weights, claims, matched)
    got = {(r["base_topic"], r["kind"]): (r["runs"], r["status_rate"], r["domain_rate"], r["reproduced_rate"]) for r in regimes.reproduction(mapped, {0: "base", 1: "same", 2: "random"}).collect()}
    assert got == {(0, "same"): (1, 1, 1, 1), (1, "same"): (1, 1, 1, 1), (0, "random"): (1, 1, 1, 1), (1, "random"): (1, 0, 0, 0)}
    formed = {r["run"]: (r["assigned"], r["regimes"], r["reproduced"], r["of_base"]) for r in regimes.regimes_formed(mapped, {0: "base", 1: "same", 2: "random"}).collect()}
    assert formed == {0: (2, "macro;tech", 2, 2), 1: (2, "macro;tech", 2, 2), 2: (1, "macro", 1, 2)}


def test_chains_join_what_the_nearest_pairs_join():
    rng = np.random.default_rng(9)
    for n, k in ((1, 1), (2, 1), (5, 2), (40, 7), (90, 12)):
        x = rng.normal(size=(n, 6))
        d = ((x[:, None] - x[None]) ** 2).sum(2) ** 0.5
        e, size, label, live = d.copy(), np.ones(n), np.arange(n), n
        np.fill_diagonal(e, np.inf)
        while live > k:
            i, j = sorted(np.unravel_index(np.argmin(e), e.shape))
            row = (e[i] * size[i] + e[j] * size[j]) / (size[i] + size[j])
            e[i], e[:, i], e[i, i] = row, row, np.inf
            e[j], e[:, j] = np.inf, np.inf
            size[i] += size[j]
            label[label == j] = i
            live -= 1
        assert topics.average_linkage(d.copy(), k).tolist() == label.tolist()


def test_sparse_counts(spark):
    v = topics.count_vectors(spark.createDataFrame([(1, [0, 3]), (2, [])], "doc_id int, idx array<int>"), 5).orderBy("doc_id").collect()
    assert [(r["features"].size, dict(zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True))) for r in v] == [(5, {0: 1.0, 3: 1.0}), (5, {})]


def test_clusters_follow_movement(spark):
    rows = [(f"t{i}", f"2024-{m:02d}", (m if i % 2 else 13 - m) * (i + 1) / 100) for i in range(6) for m in range(1, 13)]
    got = {r["term"]: (r["cluster"], r["peak_month"]) for r in topics.keyword_clusters(spark.createDataFrame(rows, "term string, month string, share double"), 2).collect()}
    assert {v[1] for k, v in got.items() if int(k[1:]) % 2} == {"2024-12"} and {v[1] for k, v in got.items() if not int(k[1:]) % 2} == {"2024-01"} and len({v[0] for v in got.values()}) == 2


def test_lda_tells_planted_topics_apart(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(i, list(range(0, 6)) if i % 2 else list(range(6, 12))) for i in range(200)], "doc_id int, idx array<int>")
    model = topics.fit_lda(df, 12, 2, 30)
    v = topics.count_vectors(df, 12)
    best = {(r["doc_id"] % 2, int(np.argmax(r["t"]))) for r in model.transform(v).select("doc_id", vector_to_array("topicDistribution").alias("t")).collect()}
    assert len(best) == 2 and len({b for _, b in best}) == 2 and math.exp(model.logPerplexity(v)) < 12


def test_lda_documents_follow_the_library(spark):
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 3 else "b", sorted({int(x) for x in rng.integers(0, 60, n) + 60 * rng.integers(0, 3, n) ** (i % 2)})) for i, n in enumerate(rng.integers(0, 80, 300).tolist())]
    df = spark.createDataFrame(rows, "doc_id int, part string, idx array<int>")
    model = topics.fit_lda(df.select("doc_id", "idx"), 240, 4, 30)
    v = topics.count_vectors(df, 240, ["doc_id", "part"])
    want = {r["doc_id"]: r["t"] for r in model.transform(v).select("doc_id", vector_to_array("topicDistribution").alias("t")).collect()}
    documents = topics.lda_documents(df, model, ["doc_id", "part"])
    got = {r["doc_id"]: r for r in documents.collect()}
    assert got.keys() == want.keys() and all(len(got[i]["topics"]) == 4 and got[i]["n_terms"] == len(t) for i, _, t in rows)
    assert all(sum(got[i]["topics"]) == (pytest.approx(1) if t else 0) for i, _, t in rows)
    assert np.mean([np.abs(np.array(got[i]["topics"]) - want[i]).max() < 0.02 for i in want]) > 0.97  # the library's starts are random
    for part, b in topics.lda_log_perplexity(documents, model, "part").items():
        assert b == pytest.approx(model.logPerplexity(v.filter(F.col("part") == part)), rel=1e-4)


def test_lda_queries_infer_in_blocks(spark, monkeypatch):
    """Not by the library, whose bound makes the exponentials of all terms anew for each document."""
    from pyspark.ml.clustering import LDAModel

    from tidemark.plans import topics as plans

    for name in ("logPerplexity", "transform"):
        monkeypatch.setattr(LDAModel, name, lambda *_: pytest.fail("by the library"))
    got = plans.Q["lda_perplexity"](spark, "/root/testdata/sf0.001").collect()
    assert [r["period"] for r in got] == ["Train", "Eval"] and all(0 < r["log_perplexity"] < 20 for r in got)
    shares = plans.Q["lda_topics"](spark, "/root/testdata/sf0.001").collect()
    assert len(shares) > 100 and all(len(r["topics"]) == 14 and sum(r["topics"]) == pytest.approx(1) for r in shares)


def test_cases_are_distinct_months(spark):
    act = spark.createDataFrame([("m1", "a", "a;b", 3.0), ("m2", "a", "a;b", 2.0), ("m3", "b", "b;c", 1.0)], "month string, hurdle string, active string, z double")
    order = [F.desc("z")]
    got = regimes.select_cases(act, [("one", F.col("z") > 0, order), ("none", F.col("z") > 9, order), ("two", F.col("z") > 0, order, "one"), ("three", F.col("z") > 0, order, "none")]).collect()
    assert [(r["rule"], r["month"]) for r in got] == [("one", "m1"), ("two", "m3"), ("three", "m2")]


def test_manifest_counts_rows_without_part(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "source string, n int")
    got = {r["part"]: (r["rows"], r["most"], r["total_ok"]) for r in audit.manifest(df, "source", [F.max("n").alias("most")]).collect()}
    assert got == {"a": (2, 2, False), "all": (3, 3, False)}


def test_running_grid_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    n, first = 60, 35
    y, x = np.cumsum(rng.normal(size=n)), rng.normal(size=n)
    y[7] = np.nan
    rows = [(i, None if np.isnan(y[i]) else float(y[i]), float(x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "t int, y double, x double").repartition(7)
    models = [("ar1", "y", [("y", 1)], True), ("ar2x", "y", [("y", 1), ("y", 2), ("x", 1), ("x", 2)], True), ("ar2x fixed", "y", [("y", 1), ("y", 2), ("x", 1), ("x", 2)], False), ("x", "x", [("y", 3)], False)]
    got = {(r["model"], r["t"]): r["forecast"] for r in stats.forecast_grid(df, "t", models, first).collect()}
    col = {"y": y, "x": x}
    for name, target, lags, expanding in models:
        a = np.column_stack([np.ones(n), *[np.concatenate([[np.nan] * k, col[c][: n - k]]) for c, k in lags]])
        for t in range(first, n):
            use = np.arange(t if expanding else first)
            use = use[np.isfinite(a[use]).all(1) & np.isfinite(col[target][use])]
            assert math.isclose(got[name, t], a[t] @ np.linalg.lstsq(a[use], col[target][use], rcond=None)[0], rel_tol=1e-7, abs_tol=1e-9)
    old = {r["t"]: r["forecast"] for r in stats.ar1_forecasts(df.filter("y IS NOT NULL"), "t", "y", first).collect()}
    new = {r["t"]: r["forecast"] for r in stats.forecast_grid(df.filter("y IS NOT NULL"), "t", models[:1], first).collect()}
    assert old.keys() == new.keys() and all(math.isclose(old[t], new[t], rel_tol=1e-8) for t in old)


def test_no_model_of_the_grid_sees_the_future(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(50, 2))
    later = base.copy()
    later[40:] = 1e6
    models = [(f"{p} {e}", "a", [("a", k) for k in range(1, p + 1)] + [("b", 1)], e) for p in (1, 2) for e in (True, False)]
    f = lambda v: {(r["model"], r["t"]): r["forecast"] for r in stats.forecast_grid(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)], "t int, a double, b double"), "t", models, 30).filter("t <= 40").collect()}
    assert f(base) == f(later)


def test_grid_without_a_solution_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, None) for i in range(10)], "t int, y double, x double")
    assert {r["forecast"] for r in stats.forecast_grid(df, "t", [("flat", "y", [("y", 1)], True), ("none", "y", [("x", 1)], True)], 6).collect()} == {None}


def test_unit_root_probabilities():
    from tidemark.operators import unitroot

    for t, p in zip(unitroot.ADF_CRITICAL, (0.01, 0.05, 0.10), strict=True):
        assert abs(unitroot.adf_p(t) - p) < 0.0015
    assert [unitroot.kpss_p(t) for t in unitroot.KPSS_CRITICAL] == [0.01, 0.05, 0.10] and unitroot.kpss_p(9) == 0.01 and unitroot.kpss_p(0) == 0.10
    assert unitroot.adf_p(-20) == 0 and unitroot.adf_p(3) == 1
    p = [unitroot.adf_p(t / 10) for t in range(-60, 20)]
    assert p == sorted(p)


def test_bootstrap_by_prefix_moments(spark):
    import hashlib

    rng = np.random.default_rng(7)
    x, y = rng.normal(size=23) + 100, rng.normal(size=23) * 1e3
    got = stats.block_bootstrap(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double"), "t", "x", "y", [5], 40).collect()[0]
    r = []
    for rep in range(40):
        take = [int(hashlib.md5(f"42-5-{rep}-{slot}".encode()).hexdigest()[:8], 16) % 19 + k for slot in range(5) for k in range(5)][:23]
        r.append(np.corrcoef(x[take], y[take])[0, 1])
    assert math.isclose(got["low95"], np.quantile(r, 0.025), rel_tol=1e-9) and math.isclose(got["high99"], np.quantile(r, 0.995), rel_tol=1e-9)
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(8)], "t int, x double, y double")
    assert stats.block_bootstrap(flat, "t", "x", "y", [2], 5).collect()[0]["high95"] == 0


def test_references_as_the_standard_library_resolves_them(spark):
    import html
    import html.entities
    import random

    rng = random.Random(4)
    some = rng.sample(sorted(html.entities.html5), 150)
    texts = ["", "no reference", "&", "&;", "&#;", "&#x;", "&amp", "&ampx", "&notit;", "&notin;", "&copy&reg;x", "&unknown;", "&#65;&#x41;&#X41", "&#0;", "&#128;&#x9f;&#x81;", "&#xD800;", "&#x110000;", "&#99999999999999;", "&#13;&#11;&#1;", "&#x1F600;", "&#xFFFE;&#xfdd0;", "&#xFEFF;a", "&#0000065;", "a &lt;b&gt; &quot;c&quot;", "&&amp;&", "&CounterClockwiseContourIntegral;", "&a" * 3]
    texts += ["".join(rng.choice([f"&{rng.choice(some)}", f"&{rng.choice(some)[:-1]}", " ", "x", ";", f"&#{rng.randint(0, 70000)};", f"&#x{rng.randint(0, 70000):x}"]) for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, t string")
    got = dict(df.select("id", text.unescape(F.col("t"))).collect())
    assert got.pop(-1) is None
    bad = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not bad
    tags = text.unescape_html(spark.createDataFrame([(1, "<p class='x'>a&nbsp;b</p>&lt;i&gt;")], "id int, h string"), "id", "h").head()
    assert tags["text"] == " a b <i>"


def test_keyword_sets_merge_in_order_and_are_capped(spark):
    rows = [("r", 1, 1, "b"), ("r", 1, 2, "a"), ("r", 2, 1, "a"), ("r", 2, 2, "c"), ("s", 1, 1, "a")]
    df = spark.createDataFrame(rows, "regime string, g int, k int, word string")
    got = sorted((r["regime"], r["position"], r["word"]) for r in regimes.merge_keyword_sets(df, "regime", "g", "k", "word", 3).collect())
    assert got == [("r", 0, "b"), ("r", 1, "a"), ("r", 2, "c"), ("s", 0, "a")]
    with pytest.raises(Exception, match="r: 3 keywords; the cap is 2"):
        regimes.merge_keyword_sets(df, "regime", "g", "k", "word", 2).collect()


def test_texts_of_a_report(spark):
    from tidemark.functions import scalar as C

    df = spark.createDataFrame([(1.23456, 2, 5), (-0.5, 0, 0), (None, 1, 3), (0.0, 3, 3)], "x double, a int, b int")
    got = [tuple(r) for r in df.select(C.signed(F.col("x")), C.number_text(F.col("x")), C.percent_text(F.col("x")), C.change_word(F.col("x")), C.ratio_text(F.col("a"), F.col("b"))).collect()]
    assert got == [("+1.23", "1.2346", "+1.23%", "less error", "40.0% (2/5)"), ("-0.50", "-0.5000", "-0.50%", "more error", "undefined"), ("N/A", "N/A", "N/A", "N/A", "33.3% (1/3)"), ("+0.00", "0.0000", "+0.00%", "equal", "100.0% (3/3)")]


def test_a_stored_sample_is_replayed(spark):
    from tidemark.operators.corpus import replay

    rows = spark.createDataFrame([(i, f"m{i % 3}") for i in range(30)], "id int, month string").repartition(6)
    sample = spark.createDataFrame([(0, 5), (1, 3), (2, 99)], "place long, id int")
    order = sorted(range(30), key=lambda i: (f"m{i % 3}", i))
    assert sorted(tuple(r) for r in replay(rows, sample, "id", ["month", "id"]).collect()) == [(0, 5, order.index(5)), (1, 3, order.index(3)), (2, 99, None)]


def test_sparse_rows_without_shuffle_of_cells(spark):
    """Rows looked up in tasks are what the joined and windowed form gives, also for ids in two rows; the plan moves no cells."""
    vocab = spark.createDataFrame([("ab", 0, 3), ("cd", 1, 2), ("ef", 2, 1)], "term string, idx int, df long")
    once = [(1, ["cd", "ab", "no"]), (2, ["ef"]), (3, ["no"]), (4, []), (None, ["ab", "ef"])]
    for given in (once, [*once, (2, ["ab", "ef"]), (None, ["cd"])]):
        docs = spark.createDataFrame(given, "doc_id long, terms array<string>")
        rows = text.tfidf_rows(docs, vocab, 7)
        said = topics.rows_of(text.tfidf(docs.select("doc_id", F.explode("terms").alias("term")), vocab, 7))
        got, want = ({r[0]: (list(r[1]), [round(x, 12) for x in r[2]]) for r in x.collect()} for x in (rows, said))
        assert got == want
        if given is once:
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_words_are_found_not_split(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ab abc\n\nABCÐ÷é 😀Œuvre no",)], "text string").select(C.words(F.col("text"), 3).alias("w"))
    assert [r["w"] for r in rows.collect()] == [[], [], ["abc", "abcð", "œuvre"]]
    assert "split(" not in rows._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_laid_out_once_for_both_products():
    """Rectangles of rows of like length give what the dense matrix gives, empty rows and columns and very long rows included; the published sample fits a study's task."""
    rng = np.random.default_rng(5)
    x = (rng.random((300, 50)) < rng.random((300, 1)) ** 4) * rng.random((300, 50))
    x[7], x[:, 3], x[11] = 0, 0, 1
    rows, idx = np.nonzero(x)
    block = topics.Cells((rows, idx, x[rows, idx]), 300, 50)
    h, w = rng.random((50, 4)), rng.random((300, 4))
    assert np.allclose(block.times(h), x @ h) and np.allclose(block.transposed_times(w), x.T @ w)
    assert block.squares == pytest.approx((x**2).sum()) and block.sum == pytest.approx(x.sum())
    assert 48 * 3000 * 200 <= topics.TASK_CELLS


def test_each_run_of_a_study_has_a_task_of_its_own(spark):
    df = spark.createDataFrame([(i, r, [i % 4], [1.0]) for i in range(8) for r in range(6)], "doc_id int, run int, idx array<int>, w array<double>")
    runs = topics.fit_runs(df, 4, 2, [("random", r) for r in range(6)], [3])
    assert sorted(runs) == list(range(6)) and all(len(m) == 1 and m[0].h.shape == (2, 4) for m in runs.values())
    dealt = df.repartitionById(6, "run").select("run", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r["run"], r["p"]) for r in dealt) == [(r, r) for r in range(6)]
