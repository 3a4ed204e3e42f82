"""Statistical queries: correlations, Holm, HAC, bootstrap, forecasts, warnings, model comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import change_word, improvement, number_text, percent_text
from tidemark.operators import panels as P
from tidemark.operators import stats as S
from tidemark.operators import windows as W
from tidemark.operators.text import cosine_matrix
from tidemark.plans.base import months, shares, ship_months, sql, table, weeks
from tidemark.plans.panels import DER, derivatives
from tidemark.operators.regimes import overlapping_splits, regime_zscores

Q, O = {}, {}


def query(oracle=None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


SPLITS = ", sp AS (SELECT unnest(['Full', period]) AS split, * FROM weeks), df AS (SELECT split, week, n - lag(n) OVER w AS dn, level - lag(level) OVER w AS dl FROM sp WINDOW w AS (PARTITION BY split ORDER BY week))"


def _weekly_diffs(spark, d):
    """Differences within each split: no pair spans a boundary."""
    w = W.ordered("week", ["split"])
    return weeks(spark, d).withColumn("split", overlapping_splits(F.col("period"))).select("split", "week", W.diff(F.col("n"), w).alias("dn"), W.diff(F.col("level"), w).alias("dl"))


LEADLAG = SPLITS + ", ll AS (SELECT split, h, dn AS x, CASE h WHEN -1 THEN lag(dl) OVER w WHEN 0 THEN dl ELSE lead(dl) OVER w END AS y FROM df, (SELECT unnest([-1, 0, 1]) AS h) WINDOW w AS (PARTITION BY split, h ORDER BY week)), cr AS (SELECT split, h, count(*) AS n, corr(x, y) AS r FROM ll WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)"


@query(sql("weeks", LEADLAG + " SELECT split, h, n, round(r, 6) AS r FROM cr"))
def lead_lag_corr(spark, d):
    ll = S.lead_lag(_weekly_diffs(spark, d), "week", ["split"], "dn", "dl", [-1, 0, 1])
    return S.correlation(ll, ["split", "h"]).select("split", "h", "n", F.round("r", 6).alias("r"))


@query()
def corr_p_values(spark, d):
    """Correlations of regimes' z with the price level at five lags, their p values, Holm within each split."""
    z = regime_zscores(shares(spark, d)).select("month", "regime", "z", "period").join(months(spark, d).select("month", "level"), "month").withColumn("split", overlapping_splits(F.col("period")))
    ll = S.lead_lag(z, "month", ["split", "regime"], "z", "level", [-2, -1, 0, 1, 2])
    c = S.correlation(ll, ["split", "regime", "h"]).withColumn("p", S.pearson_p("r", F.col("n").cast("double")))
    return W.holm(c, "p", ["split"], tie=["regime", "h"])


@query(sql("months", ", sp AS (SELECT unnest(['Full', period]) AS split, month, n, level FROM months), rk AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY n) + (count(*) OVER (PARTITION BY split, n) - 1) / 2 AS x, rank() OVER (PARTITION BY split ORDER BY level) + (count(*) OVER (PARTITION BY split, level) - 1) / 2 AS y FROM sp) SELECT split, count(*) AS n, round(corr(x, y), 6) AS rho FROM rk GROUP BY 1"))
def spearman_corr(spark, d):
    m = months(spark, d).withColumn("split", overlapping_splits(F.col("period")))
    return S.spearman(m, ["split"], "n", "level").select("split", "n", F.round("rho", 6).alias("rho"))


PS = ", ps AS (SELECT regime AS family, month, CASE WHEN share < 0.15 THEN NULL ELSE round(share * share, 6) END AS p FROM shares), rk AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY family, p IS NULL) AS m FROM ps WINDOW w AS (PARTITION BY family, p IS NULL ORDER BY p, month))"


@query(sql("shares", PS + " SELECT family, month, p, CASE WHEN p IS NOT NULL THEN round(max(least(1.0, p * (m - r + 1))) OVER (PARTITION BY family, p IS NULL ORDER BY r ROWS UNBOUNDED PRECEDING), 6) END AS p_holm FROM rk"))
def holm_adjust(spark, d):
    p = shares(spark, d).select(F.col("regime").alias("family"), "month", F.when(F.col("share") >= 0.15, F.round(F.col("share") * F.col("share"), 6)).alias("p"))
    return W.holm(p, "p", ["family"], tie=["month"]).withColumn("p_holm", F.round("p_holm", 6))


ZS = SPLITS + ", zs AS (SELECT split, week, (dn - avg(dn) OVER w) / stddev_samp(dn) OVER w AS x, (dl - avg(dl) OVER w) / stddev_samp(dl) OVER w AS y FROM df WHERE dn IS NOT NULL WINDOW w AS (PARTITION BY split))"
HAC = ", c AS (SELECT split, week, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM zs WINDOW w AS (PARTITION BY split)), b AS (SELECT split, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, count(*) AS n FROM c GROUP BY 1), u AS (SELECT c.split, week, x * (y - beta * x) AS u, row_number() OVER (PARTITION BY c.split ORDER BY week) AS pos FROM c JOIN b USING (split)), gm AS (SELECT a.split, a.pos - l.pos AS h, sum(a.u * l.u) AS g FROM u a JOIN u l ON a.split = l.split AND a.pos - l.pos BETWEEN 0 AND 8 GROUP BY 1, 2), hac AS (SELECT b.split, mx AS maxlags, any_value(n) AS n, any_value(beta) AS beta, sqrt(sum(CASE WHEN h = 0 THEN g WHEN h <= mx THEN 2 * (1 - h / (mx + 1)) * g ELSE 0 END)) / any_value(sxx) AS se FROM gm JOIN b USING (split), (SELECT unnest([2, 4, 8]) AS mx) GROUP BY 1, 2)"


@query(sql("weeks", ZS + HAC + " SELECT split, maxlags, n, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS z FROM hac"))
def hac_bivariate(spark, d):
    """Standardised slopes (equal to r) with Newey-West errors at three bandwidths, per split."""
    z = S.standardized(_weekly_diffs(spark, d).filter("dn IS NOT NULL").select("split", "week", F.col("dn").alias("x"), F.col("dl").alias("y")), ["split"], ["x", "y"])
    return S.hac_slope(z, ["split"], "week", [2, 4, 8]).select("split", "maxlags", "n", *[F.round(c, 6).alias(c) for c in ("beta", "se", "z")])


@query()
def hac_p_values(spark, d):
    """Normal p values of the slopes (the library's convention), Holm within split."""
    return W.holm(hac_bivariate(spark, d).withColumn("p", S.normal_p("z")), "p", ["split"], tie=["maxlags"])


PARTIAL = ", j AS (SELECT m.month, n, level, revenue FROM months m JOIN ship_months USING (month)), zz AS (SELECT (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS y, (level - avg(level) OVER ()) / stddev_samp(level) OVER () AS x, (revenue - avg(revenue) OVER ()) / stddev_samp(revenue) OVER () AS c FROM j), r AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, c) AS xc, corr(c, y) AS cy FROM zz)"


@query(sql("months ship_months", PARTIAL + " SELECT spec, n, round(CASE spec WHEN 'raw' THEN xy WHEN 'partial' THEN (xy - xc * cy) / (1 - xc * xc) ELSE cy END, 6) AS slope FROM r, (SELECT unnest(['raw', 'partial', 'anchor']) AS spec)"))
def hac_partial_control(spark, d):
    """Standardised slopes: raw, with one control, of the control alone; from correlations in one pass."""
    j = months(spark, d).select("month", F.col("n").cast("double").alias("y"), F.col("level").alias("x")).join(ship_months(spark, d).select("month", F.col("revenue").alias("c")), "month")
    r = j.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("xy"), F.corr("x", "c").alias("xc"), F.corr("c", "y").alias("cy"))
    partial = (F.col("xy") - F.col("xc") * F.col("cy")) / (1 - F.col("xc") * F.col("xc"))
    specs = F.array(*[F.struct(F.lit(s).alias("spec"), F.round(v, 6).alias("slope")) for s, v in (("raw", F.col("xy")), ("partial", partial), ("anchor", F.col("cy")))])
    return r.select("n", F.explode(specs).alias("s")).select("s.spec", "n", "s.slope")


@query()
def ols_multivariate(spark, d):
    """Scaled returns on regime z scores: HAC errors, normal p, R2, robust F, Wald, intervals, VIF."""
    wide = regime_zscores(shares(spark, d)).groupBy("month").pivot("regime", ["urgent", "high", "medium", "low"]).agg(F.first("z"))
    return S.ols_table(derivatives(spark, d).select("month", "ret", "period").withColumn("split", overlapping_splits(F.col("period"))).join(wide, "month"), ["split"], "month", "ret", ["urgent", "high", "medium", "low"], 3)


BOOT = ", s AS (SELECT row_number() OVER (ORDER BY month) - 1 AS pos, n AS x, level AS y, count(*) OVER () AS total FROM months), g AS (SELECT block, rep, slot, CAST('0x' || substr(md5('42-' || block || '-' || rep || '-' || slot), 1, 8) AS BIGINT) % ((SELECT max(total) FROM s) - block + 1) AS start FROM (SELECT unnest([2, 4, 8]) AS block), (SELECT unnest(range(2000)) AS rep), (SELECT unnest(range(200)) AS slot) WHERE slot * block < (SELECT max(total) FROM s)), k AS (SELECT block, rep, start + k AS pos FROM g, (SELECT unnest(range(8)) AS k) WHERE k < block AND slot * block + k < (SELECT max(total) FROM s)), r AS (SELECT block, rep, corr(x, y) AS r FROM k JOIN s USING (pos) GROUP BY 1, 2)"


@query(sql("months", BOOT + " SELECT block, count(*) AS replicates, round(quantile_cont(r, 0.025), 6) AS low95, round(quantile_cont(r, 0.975), 6) AS high95, round(quantile_cont(r, 0.005), 6) AS low99, round(quantile_cont(r, 0.995), 6) AS high99, round(least(1.0, 2 * least(avg(CAST(r <= 0 AS DOUBLE)), avg(CAST(r >= 0 AS DOUBLE)))), 6) AS p FROM r GROUP BY 1"))
def block_bootstrap_ci(spark, d):
    m = months(spark, d).withColumn("nn", F.col("n").cast("double"))
    b = S.block_bootstrap(m, "month", "nn", "level", [2, 4, 8], 2000)
    return b.select("block", "replicates", *[F.round(c, 6).alias(c) for c in ("low95", "high95", "low99", "high99", "p")])


AR = ", s AS (SELECT month, ret AS y, row_number() OVER (ORDER BY month) AS pos, lag(ret) OVER (ORDER BY month) AS prev FROM der WHERE ret IS NOT NULL)"
FC = ", {name} AS (SELECT t.month, any_value(t.y) AS actual, regr_intercept(p.y, p.prev) + regr_slope(p.y, p.prev) * any_value(t.prev) AS forecast FROM s t JOIN s p ON p.prev IS NOT NULL AND p.pos < {end} WHERE t.pos > 47 GROUP BY 1)"
FORECASTS = DER + AR + FC.format(name="fe", end="t.pos") + FC.format(name="ff", end="48")


def _returns(spark, d):
    return derivatives(spark, d).filter("ret IS NOT NULL").select("month", "ret", "vol3")


@query(sql("months", FORECASTS + " SELECT month, round(actual, 6) AS actual, round(forecast, 6) AS forecast FROM fe"))
def ar_forecast_expanding(spark, d):
    return S.ar1_forecasts(_returns(spark, d), "month", "ret", 47).select("month", F.round("actual", 6).alias("actual"), F.round("forecast", 6).alias("forecast"))


@query(sql("months", FORECASTS + " SELECT month, round(actual, 6) AS actual, round(forecast, 6) AS forecast FROM ff"))
def ar_forecast_fixed(spark, d):
    return S.ar1_forecasts(_returns(spark, d), "month", "ret", 47, expanding=False).select("month", F.round("actual", 6).alias("actual"), F.round("forecast", 6).alias("forecast"))


@query()
def ar2_exogenous_forecast(spark, d):
    """AR(2) with a lagged exogenous column, expanding."""
    return S.ar_forecasts(_returns(spark, d), "month", "ret", 2, ["vol3"], 47)


#: name, target, lagged columns, expanding: returns on their two and steps on their one last values, each with and without the shares of a regime, each with both windows.
GRID_MODELS = [(f"{target} {kind} {'expanding' if e else 'fixed'}", target, [(target, k) for k in range(1, p + 1)] + [(x, k) for k in range(1, p + 1)] * (kind == "news"), e)
    for target, p, x in (("ret", 2, "urgent"), ("step", 1, "high")) for kind in (f"ar{p}", "news") for e in (True, False)]


def _grid_series(spark, d):
    z = regime_zscores(shares(spark, d)).groupBy("month").pivot("regime", ["urgent", "high"]).agg(F.first("z"))
    return derivatives(spark, d).filter("ret IS NOT NULL").select("month", "ret", "step").join(z, "month")


def _grid(spark, d):
    s = _grid_series(spark, d)
    g = S.forecast_grid(s, "month", GRID_MODELS, 47)
    zero = g.filter(F.col("model").isin([f"{t} ar{p} expanding" for t, p in (("ret", 2), ("step", 1))])).select(F.concat(F.split("model", " ")[0], F.lit(" zero")).alias("model"), "month", "actual", F.lit(0.0).alias("forecast"))
    return g.unionByName(zero)


def _grid_sql():
    """The same grid: designs as lists, all earlier pairs joined, elimination as recursion."""
    designs = " UNION ALL ".join(f"SELECT '{n}' AS model, {e} AS expanding, month, pos, CAST({t} AS DOUBLE) AS y, [1.0::DOUBLE, {', '.join(f'CAST(lag({c}, {k}) OVER w AS DOUBLE)' for c, k in lags)}] AS a FROM gs WINDOW w AS (ORDER BY month)" for n, t, lags, e in GRID_MODELS)
    return DER + f""", gs AS (SELECT *, row_number() OVER (ORDER BY month) AS pos FROM (SELECT month, ret, step, max(z) FILTER (regime = 'urgent') AS urgent, max(z) FILTER (regime = 'high') AS high FROM der JOIN z USING (month) WHERE ret IS NOT NULL GROUP BY 1, 2, 3)),
 ds AS MATERIALIZED ({designs}), ok AS MATERIALIZED (SELECT * FROM ds WHERE y IS NOT NULL AND len(list_filter(a, lambda v: v IS NULL)) = 0),
 ce AS (SELECT t.model, t.month, i, j, sum(p.a[i] * CASE WHEN j > len(p.a) THEN p.y ELSE p.a[j] END) AS s FROM ok t JOIN ok p ON p.model = t.model AND p.pos < CASE WHEN t.expanding THEN t.pos ELSE 48 END, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 7)) AS j) WHERE t.pos > 47 AND i <= len(t.a) AND j <= len(t.a) + 1 GROUP BY 1, 2, 3, 4),
 mx AS (SELECT model, month, list(r ORDER BY i) AS m FROM (SELECT model, month, i, list(s ORDER BY j) AS r FROM ce GROUP BY 1, 2, 3) GROUP BY 1, 2),
 el(model, month, p, m) AS (SELECT model, month, CAST(1 AS BIGINT), m FROM mx UNION ALL SELECT model, month, p + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 2), lambda j: CASE WHEN i = p THEN m[i][j] / m[p][p] ELSE m[i][j] - m[i][p] / m[p][p] * m[p][j] END)) FROM el WHERE p <= len(m)),
 gr AS (SELECT ds.model, ds.month, y AS actual, list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][len(m) + 1] * a[i])) AS forecast FROM ds LEFT JOIN el ON el.model = ds.model AND el.month = ds.month AND p = len(m) + 1 WHERE pos > 47),
 gz AS (SELECT * FROM gr UNION ALL SELECT split_part(model, ' ', 1) || ' zero', month, actual, 0.0 FROM gr WHERE model IN ('ret ar2 expanding', 'step ar1 expanding'))"""


@query(sql("months z", _grid_sql() + " SELECT model, month, round(actual, 6) AS actual, round(forecast, 6) AS forecast FROM gz").replace("WITH ", "WITH RECURSIVE ", 1))
def forecast_grid(spark, d):
    """Eight models over two targets and every evaluated month, and the zero forecasts: one pass of running sums."""
    return _grid(spark, d).select("model", "month", F.round("actual", 6).alias("actual"), F.round("forecast", 6).alias("forecast"))


@query(sql("months z", _grid_sql() + """, gm AS (SELECT model, split_part(model, ' ', 1) AS target, count(*) AS n, CASE WHEN count(forecast) = count(*) THEN sqrt(avg((forecast - actual) ** 2)) END AS rmse, CASE WHEN count(forecast) = count(*) THEN avg(abs(forecast - actual)) END AS mae, CASE WHEN count(forecast) = count(*) THEN avg(forecast - actual) END AS bias FROM gz GROUP BY 1, 2)
 SELECT m.model, m.n, round(m.rmse, 6) AS rmse, round(m.mae, 6) AS mae, round(m.bias, 6) AS bias, round(100 * (b.rmse - m.rmse) / b.rmse, 6) AS improvement FROM gm m JOIN gm b ON b.model = m.target || ' zero'""").replace("WITH ", "WITH RECURSIVE ", 1))
def forecast_grid_errors(spark, d):
    """Errors of each model of the grid and its improvement on the zero forecast of its target."""
    m = S.errors(_grid(spark, d).withColumn("error", F.col("forecast") - F.col("actual")).withColumn("target", F.split("model", " ")[0]), "error", ["target", "model"])
    base = m.filter("model LIKE '% zero'").select("target", F.col("rmse").alias("base"))
    return m.join(F.broadcast(base), "target").select("model", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")], F.round(improvement(F.col("base"), F.col("rmse")), 6).alias("improvement"))


@query(sql("months z", _grid_sql() + """, fl AS (SELECT model, coalesce(forecast < 0, false) AS p, actual < 0 AS a FROM gr WHERE model LIKE 'ret %' UNION ALL SELECT 'always up', false, actual < 0 FROM gr WHERE model = 'ret ar2 expanding' UNION ALL SELECT 'always down', true, actual < 0 FROM gr WHERE model = 'ret ar2 expanding'),
 fc AS (SELECT model, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM fl GROUP BY 1)
 SELECT model, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM fc""").replace("WITH ", "WITH RECURSIVE ", 1))
def forecast_grid_falls(spark, d):
    """How the grid's returns and the two constant guesses call falls."""
    g = _grid(spark, d).filter("model LIKE 'ret %' AND model <> 'ret zero'")
    guess = g.filter("model = 'ret ar2 expanding'")
    p = g.select("model", (F.col("forecast") < 0).alias("p"), (F.col("actual") < 0).alias("a"))
    for name, down in (("always up", False), ("always down", True)):
        p = p.unionByName(guess.select(F.lit(name).alias("model"), F.lit(down).alias("p"), (F.col("actual") < 0).alias("a")))
    return S.confusion(p, F.col("p"), F.col("a"), ["model"]).select("model", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "balanced_accuracy")])


@query(sql("months z", _grid_sql() + """, gm AS (SELECT model, split_part(model, ' ', 1) AS target, sqrt(avg((forecast - actual) ** 2)) AS rmse, count(forecast) = count(*) AS whole FROM gz GROUP BY 1, 2), ge AS (SELECT m.model, CASE WHEN m.whole THEN m.rmse END AS rmse, CASE WHEN m.whole AND b.rmse <> 0 THEN 100 * (b.rmse - m.rmse) / b.rmse END AS i FROM gm m JOIN gm b ON b.model = m.target || ' zero')
 SELECT model, CASE WHEN rmse IS NULL THEN 'N/A' ELSE printf('%.4f', rmse) END AS rmse, CASE WHEN model LIKE '% zero' THEN 'base' WHEN i IS NULL THEN 'N/A (N/A)' ELSE printf('%+.2f', i) || '% (' || CASE WHEN i > 0 THEN 'less error' WHEN i < 0 THEN 'more error' ELSE 'equal' END || ')' END AS against_zero FROM ge""").replace("WITH ", "WITH RECURSIVE ", 1))
def forecast_report_cells(spark, d):
    """The grid's errors as a report writes them: four digits, N/A where a forecast is missing, and what each model gains on the zero forecast in words."""
    m = S.errors(_grid(spark, d).withColumn("error", F.col("forecast") - F.col("actual")).withColumn("target", F.split("model", " ")[0]), "error", ["target", "model"])
    base = m.filter("model LIKE '% zero'").select("target", F.col("rmse").alias("base"))
    gain = improvement(F.col("base"), F.col("rmse"))
    words = F.when(F.col("model").endswith(" zero"), "base").otherwise(F.concat(percent_text(gain), F.lit(" ("), change_word(gain), F.lit(")")))
    return m.join(F.broadcast(base), "target").select("model", number_text(F.col("rmse")).alias("rmse"), words.alias("against_zero"))


def _models(spark, d):
    e, f = (S.ar1_forecasts(_returns(spark, d), "month", "ret", 47, x) for x in (True, False))
    zero = e.select("month", "actual", F.lit(0.0).alias("forecast"))
    return e.select(F.lit("ar1 expanding").alias("model"), "*").unionByName(f.select(F.lit("ar1 fixed").alias("model"), "*")).unionByName(zero.select(F.lit("zero").alias("model"), "*"))


MODELS = FORECASTS + ", mo AS (SELECT 'ar1 expanding' AS model, * FROM fe UNION ALL SELECT 'ar1 fixed', * FROM ff UNION ALL SELECT 'zero', month, actual, 0.0 FROM fe)"


@query(sql("months", MODELS + ", em AS (SELECT model, count(*) AS n, sqrt(avg((actual - forecast) ** 2)) AS rmse, avg(abs(actual - forecast)) AS mae, avg(actual - forecast) AS bias FROM mo GROUP BY 1) SELECT model, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(bias, 6) AS bias, round(100 * ((SELECT rmse FROM em WHERE model = 'zero') - rmse) / (SELECT rmse FROM em WHERE model = 'zero'), 6) AS improvement FROM em"))
def forecast_metrics(spark, d):
    m = S.errors(_models(spark, d).withColumn("error", F.col("actual") - F.col("forecast")), "error", ["model"])
    base = m.filter("model = 'zero'").select(F.col("rmse").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("model", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")], F.round(improvement(F.col("base"), F.col("rmse")), 6).alias("improvement"))


@query(sql("months", MODELS + ", b AS (SELECT model, forecast > 0 AS p, actual > 0 AS a FROM mo WHERE model <> 'zero' UNION ALL SELECT 'always up', true, actual > 0 FROM fe UNION ALL SELECT 'always down', false, actual > 0 FROM fe), c AS (SELECT model, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM b GROUP BY 1) SELECT model, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c"))
def direction_confusion(spark, d):
    m = _models(spark, d)
    e = m.filter("model = 'ar1 expanding'")
    p = m.filter("model <> 'zero'").select("model", (F.col("forecast") > 0).alias("p"), (F.col("actual") > 0).alias("a"))
    for name, up in (("always up", True), ("always down", False)):
        p = p.unionByName(e.select(F.lit(name).alias("model"), F.lit(up).alias("p"), (F.col("actual") > 0).alias("a")))
    return S.confusion(p, F.col("p"), F.col("a"), ["model"]).select("model", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "balanced_accuracy")])


WARN = DER + ", wz AS (SELECT shares.month, (share - avg(share) FILTER (shares.period = 'Train') OVER ()) / stddev_samp(share) FILTER (shares.period = 'Train') OVER () AS z FROM shares WHERE regime = 'urgent'), ev AS (SELECT der.month, z, ret <= -3 AS event, CASE WHEN der.month <= '1998-12' THEN 'Train' ELSE 'Eval' END AS period FROM der JOIN wz USING (month) WHERE ret IS NOT NULL), th AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold), fw AS (SELECT threshold, month, period, z >= threshold AS warning, event, lead(event) OVER w AS e1, lead(event, 2) OVER w AS e2, lag(z >= threshold) OVER w AS w1, lag(z >= threshold, 2) OVER w AS w2 FROM ev, th WINDOW w AS (PARTITION BY threshold ORDER BY month))"


def _warnings(spark, d):
    z = regime_zscores(shares(spark, d)).filter("regime = 'urgent'").select("month", "z")
    return derivatives(spark, d).filter("ret IS NOT NULL").select("month", "period", (F.col("ret") <= -3).alias("event")).join(z, "month")


CONF = "SELECT {keys}, count(*) FILTER (warning AND (e1 OR e2)) AS tp, count(*) FILTER (warning AND NOT (e1 OR e2)) AS fp, count(*) FILTER (NOT warning AND (e1 OR e2)) AS fn, count(*) FILTER (NOT warning AND NOT (e1 OR e2)) AS tn FROM fw WHERE e2 IS NOT NULL {more} GROUP BY ALL"


@query(sql("months shares", WARN + " " + CONF.format(keys="period", more="AND threshold = 0.5")))
def early_warning_confusion(spark, d):
    """Warnings at z 0.5 against a fall in the next two months; the last two months aren't evaluable."""
    e = P.forward_events(_warnings(spark, d), "month", "event", F.col("z") >= 0.5).filter("evaluable")
    return S.confusion(e, F.col("warning"), F.col("hit"), ["period"]).select("period", "tp", "fp", "fn", "tn")


@query(sql("months shares", WARN + " " + CONF.format(keys="threshold", more="")))
def warning_threshold_sweep(spark, d):
    """All thresholds in one job: a parameter frame, windows per threshold, one aggregation."""
    th = spark.createDataFrame([(x,) for x in (0.3, 0.4, 0.5, 0.6, 0.7)], "threshold double")
    e = P.forward_events(_warnings(spark, d).crossJoin(F.broadcast(th)), "month", "event", F.col("z") >= F.col("threshold"), ["threshold"]).filter("evaluable")
    return S.confusion(e, F.col("warning"), F.col("hit"), ["threshold"]).select("threshold", "tp", "fp", "fn", "tn")


@query(sql("months shares", WARN + " SELECT month, coalesce(w1, false) OR coalesce(w2, false) AS warned, CASE WHEN coalesce(w1, false) THEN 1 WHEN coalesce(w2, false) THEN 2 END AS lead FROM fw WHERE threshold = 0.5 AND event"))
def event_recall_leadtime(spark, d):
    return P.event_recall(_warnings(spark, d), "month", "event", F.col("z") >= 0.5).select("month", "warned", "lead")


@query(sql("months ship_months", ", a AS (SELECT month, level AS x, discount * 1000000 AS y FROM months JOIN ship_months USING (month)), z AS (SELECT month, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM a) SELECT count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) ** 2)), 6) AS rmse, round(max(abs(x - y)), 6) AS largest, round(avg(x - y), 6) AS mean_difference, round(100.0 * count(*) FILTER ((x >= 0.5) = (y >= 0.5)) / count(*), 6) AS agreement FROM z"))
def model_comparison_deltas(spark, d):
    """Two series of z scores: distance, bias and how often both are active or both not."""
    j = months(spark, d).select("month", F.col("level").alias("x")).join(ship_months(spark, d).select("month", (F.col("discount") * 1000000).alias("y")), "month")
    z = j.select("month", W.zscore(F.col("x")).alias("x"), W.zscore(F.col("y")).alias("y")).withColumn("e", F.col("x") - F.col("y"))
    return z.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.max(F.abs("e")), 6).alias("largest"), F.round(F.avg("e"), 6).alias("mean_difference"), F.round(P.split_pct(F.count_if((F.col("x") >= 0.5) == (F.col("y") >= 0.5)), F.count(F.lit(1))), 6).alias("agreement"))


@query(sql("months ship_months", ", a AS (SELECT month, n - lag(n) OVER w AS dn, level - lag(level) OVER w AS dl, revenue - lag(revenue) OVER w AS dr, discount - lag(discount) OVER w AS dd FROM months JOIN ship_months USING (month) WINDOW w AS (ORDER BY month)) SELECT x, y, round(r, 6) AS r FROM (SELECT 'dn' AS x, 'dr' AS y, corr(dn, dr) AS r FROM a UNION ALL SELECT 'dn', 'dd', corr(dn, dd) FROM a UNION ALL SELECT 'dl', 'dr', corr(dl, dr) FROM a UNION ALL SELECT 'dl', 'dd', corr(dl, dd) FROM a)"))
def indicator_corr_table(spark, d):
    w = W.ordered("month")
    j = months(spark, d).join(ship_months(spark, d), "month")
    a = j.select("month", *[W.diff(F.col(c), w).alias(n) for c, n in (("n", "dn"), ("level", "dl"), ("revenue", "dr"), ("discount", "dd"))])
    x = P.stack(a, ["month"], ["dn", "dl"], "x", "u").join(P.stack(a, ["month"], ["dr", "dd"], "y", "v"), "month")
    return S.correlation(x, ["x", "y"], "u", "v").select("x", "y", F.round("r", 6).alias("r"))


CENT = "cen AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2)"


def _centroids(spark, d, rows=None):
    e = table(spark, d, "embeddings") if rows is None else rows
    v = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    return v.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))


COS = f"WITH {CENT}, cos AS (SELECT a.label AS a, b.label AS b, greatest(0, least(1, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))))) AS cosine FROM cen a JOIN cen b USING (i) GROUP BY 1, 2)"


@query(COS + " SELECT a, max(b) FILTER (r = 1) AS best, round(max(cosine) FILTER (r = 1), 6) AS best_value, max(b) FILTER (r = 2) AS second, round(max(cosine) FILTER (r = 1) - max(cosine) FILTER (r = 2), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS r FROM cos WHERE a <> b) WHERE r <= 2 GROUP BY 1")
def topic_cosine_matrix(spark, d):
    c = cosine_matrix(_centroids(spark, d), "label", "v").filter("a <> b")
    return W.best_two(c, ["a"], "cosine", "b", [F.desc(F.round("cosine", 9)), F.col("b")]).select("a", "best", F.round("best_value", 6).alias("best_value"), "second", F.round("margin", 6).alias("margin"))


@query(COS + " SELECT count(*) AS pairs, round(avg(cosine), 6) AS mean, round(stddev_samp(cosine), 6) AS sd, round(min(cosine), 6) AS low, round(max(cosine), 6) AS high, count(*) FILTER (cosine >= 0.2) AS similar FROM cos WHERE a < b")
def run_pair_enumeration(spark, d):
    """All pairs i < j of a few runs, summarised."""
    c = cosine_matrix(_centroids(spark, d), "label", "v").filter("a < b")
    return c.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("cosine"), 6).alias("mean"), F.round(F.stddev_samp("cosine"), 6).alias("sd"), F.round(F.min("cosine"), 6).alias("low"), F.round(F.max("cosine"), 6).alias("high"), F.count_if(F.col("cosine") >= 0.2).alias("similar"))


@query()
def topic_alignment_hungarian(spark, d):
    """Centroids of even and odd vectors matched one to one with the largest total cosine."""
    from tidemark.operators.topics import align

    e = table(spark, d, "embeddings")
    return align(_centroids(spark, d, e.filter("vec_id % 2 = 0")), _centroids(spark, d, e.filter("vec_id % 2 = 1")), "label", "v")


def _unit_roots(spark, d):
    from tidemark.operators.unitroot import unit_roots

    s = P.stack(derivatives(spark, d).select("month", "level", "ret", "step", "yoy"), ["month"], ["level", "ret", "step", "yoy"], "series", "v").filter("v IS NOT NULL")
    return unit_roots(s, "series", "month", "v")


@query()
def unit_root_tests(spark, d):
    """ADF and KPSS statistics and p values of the price level, returns, steps and yearly changes."""
    return _unit_roots(spark, d)


@query()
def stationarity_verdicts(spark, d):
    """Which of the series are stationary by both ADF tests, by the one without lags alone, or by none."""
    from tidemark.operators.unitroot import stationarity

    return stationarity(_unit_roots(spark, d), "series")
