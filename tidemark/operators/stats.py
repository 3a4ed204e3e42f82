"""Statistical operators on panels: correlation grids, HAC regressions, bootstrap, forecasts, warnings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.scalar import ratio
from tidemark.operators.panels import forward_events
from tidemark.operators.windows import average_rank, holm


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, k: float, df: float) -> float:
    return betainc(df / 2, k / 2, df / (df + k * f)) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation under the t distribution; null below three pairs."""
    def one(r, n):
        if r is None or pd.isna(r) or pd.isna(n) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")


def correlation(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n and Pearson r of the complete pairs of each group: a grid of splits, pairs and lags is one job."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))


def lead_lag(series: DataFrame, order: str, keys: list[str], x: str, y: str, lags: list[int]) -> DataFrame:
    """Rows (keys, h, x, y at h steps later); shifts never cross the keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    shifted = [F.struct(F.lit(h).alias("h"), (F.lead(y, h).over(w) if h >= 0 else F.lag(y, -h).over(w)).alias("y")) for h in lags]
    return series.select(*keys, order, F.col(x).alias("x"), F.array(*shifted).alias("s")).select(*keys, order, "x", F.explode("s").alias("s")).select(*keys, order, "x", "s.h", "s.y")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, average_rank(F.col(x), keys).alias("x"), average_rank(F.col(y), keys).alias("y"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("rho"))


def standardized(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Columns as z scores within each group (sample deviation)."""
    w = Window.partitionBy(*keys)
    return df.select(*[c for c in df.columns if c not in cols], *[ratio(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)).alias(c) for c in cols])


def hac_slope(df: DataFrame, keys: list[str], order: str, maxlags: list[int], x: str = "x", y: str = "y") -> DataFrame:
    """Slope of y on x with intercept and its Newey-West error (Bartlett weights, no small-sample correction), for each bandwidth.

    With centred x the slope's score at t is x_t * e_t, so its variance is a weighted sum of their
    lagged products over (sum x^2)^2: moments and lags only, in SQL."""
    w, o = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    c = both.withColumn("__x", F.col(x) - F.avg(x).over(w)).withColumn("__y", F.col(y) - F.avg(y).over(w))
    c = c.withColumn("__b", ratio(F.sum(F.col("__x") * F.col("__y")).over(w), F.sum(F.col("__x") * F.col("__x")).over(w)))
    c = c.withColumn("__u", F.col("__x") * (F.col("__y") - F.col("__b") * F.col("__x")))
    top = max(maxlags)
    for h in range(1, top + 1):
        c = c.withColumn(f"__u{h}", F.col("__u") * F.lag("__u", h).over(o))
    g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("__b").alias("beta"), F.sum(F.col("__x") * F.col("__x")).alias("__sxx"), F.sum(F.col("__u") * F.col("__u")).alias("__g0"), *[F.coalesce(F.sum(f"__u{h}"), F.lit(0.0)).alias(f"__g{h}") for h in range(1, top + 1)])
    rows = []
    for m in maxlags:
        s = F.col("__g0")
        for h in range(1, m + 1):
            s = s + 2 * (1 - h / (m + 1)) * F.col(f"__g{h}")
        rows.append(F.struct(F.lit(m).alias("maxlags"), ratio(F.sqrt(F.greatest(s, F.lit(0.0))), F.col("__sxx")).alias("se")))
    return g.select(*keys, "n", "beta", F.explode(F.array(*rows)).alias("e")).select(*keys, "n", "beta", "e.maxlags", "e.se").withColumn("z", ratio(F.col("beta"), F.col("se")))


def ols_hac(y: np.ndarray, x: np.ndarray, maxlags: int) -> dict:
    """Multivariate OLS with intercept: Newey-West errors, normal p values, R2, robust F, VIF."""
    n, k = x.shape
    a = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ (a.T @ y)
    e = y - a @ beta
    u = a * e[:, None]
    s = u.T @ u
    for h in range(1, maxlags + 1):
        g = u[h:].T @ u[:-h]
        s += (1 - h / (maxlags + 1)) * (g + g.T)
    cov = inv @ s @ inv
    se = np.sqrt(np.diag(cov))
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - (e @ e) / total
    wald = beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:])
    vif = np.diag(np.linalg.inv(np.corrcoef(x, rowvar=False).reshape(k, k))) if k > 1 else np.ones(1)
    return {"n": n, "beta": beta, "se": se, "p": [normal_two_sided(z) for z in beta / se], "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1), "f": wald / k, "wald": wald, "f_p": f_upper(wald / k, k, n - k - 1), "vif": vif, "low": beta - 1.959963984540054 * se, "high": beta + 1.959963984540054 * se}


def ols_table(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], maxlags: int = 3) -> DataFrame:
    """One row per coefficient of each group's regression; groups are series, not corpora.

    ``p_holm`` adjusts the slopes of one regression among themselves; the constant's is null."""

    def run(key, pdf):
        pdf = pdf.dropna(subset=[y, *xs]).sort_values(order)
        fit = ols_hac(pdf[y].to_numpy(float), pdf[xs].to_numpy(float), maxlags)
        head = {k: [v] * (len(xs) + 1) for k, v in zip(keys, key, strict=True)}
        same = {c: [float(fit[c])] * (len(xs) + 1) for c in ("r2", "adj_r2", "f", "wald", "f_p")}
        return pd.DataFrame(head | {"variable": ["const", *xs], "n": fit["n"], "beta": fit["beta"], "se": fit["se"], "p": fit["p"], "low": fit["low"], "high": fit["high"], "vif": [None, *fit["vif"]]} | same)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    table = df.select(*keys, order, y, *xs).groupBy(*keys).applyInPandas(run, f"{kinds}, variable string, n long, beta double, se double, p double, low double, high double, vif double, r2 double, adj_r2 double, f double, wald double, f_p double")
    return holm(table.withColumn("__slope_p", F.when(F.col("variable") != "const", F.col("p"))), "__slope_p", keys, tie=["variable"]).drop("__slope_p")


def compare_coefficients(base: DataFrame, other: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Coefficients of ``other`` against those of ``base`` with the same keys: differences of slope and R2, whether the
    sign stays, whether significance after Holm stays (a null p on either side counts as unchanged). Coefficients that
    ``base`` lacks have nulls."""
    b = base.select(*keys, F.col("beta").alias("__beta"), F.col("r2").alias("__r2"), F.col("p_holm").alias("__p"))
    known = F.col("__beta").isNotNull()
    stays = F.coalesce((F.col("p_holm") < alpha) == (F.col("__p") < alpha), F.lit(True))
    return other.join(b, keys, "left").select(*keys, (F.col("beta") - F.col("__beta")).alias("beta_difference"), (F.col("r2") - F.col("__r2")).alias("r2_difference"), (F.signum("beta") == F.signum("__beta")).alias("sign_preserved"), F.when(known, stays).alias("significance_preserved"))


def compare_series(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Two series of each group: means, bias, distances, where the largest difference is (first on a tie), both correlations. Incomplete pairs don't count."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, order, F.col(x).alias("x"), F.col(y).alias("y"), (F.col(y) - F.col(x)).alias("e"))
    both = both.withColumns({"rx": average_rank(F.col("x"), keys), "ry": average_rank(F.col("y"), keys)})
    largest = F.min(F.struct((-F.abs("e")).alias("low"), F.col(order).alias("at")))
    g = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), largest.alias("__l"), F.corr("x", "y").alias("r"), F.corr("rx", "ry").alias("rho"))
    return g.select(*keys, "n", "mean_x", "mean_y", "bias", "mae", "rmse", (-F.col("__l.low")).alias("largest"), F.col("__l.at").alias("largest_at"), "r", "rho")


def block_bootstrap(series: DataFrame, order: str, x: str, y: str, blocks: list[int], replicates: int, seed: int = 42) -> DataFrame:
    """Moving-block bootstrap of a correlation: block, r, percentile intervals, two-sided p.

    Starts are hashes of (seed, block, replicate, slot), so any engine draws the same; a replicate
    without variance counts as 0. The series' running moments are one row for each position, so a block,
    however long, is the difference of two of them, and a replicate the sum of its blocks."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    mean = series.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    s = series.select(order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).crossJoin(F.broadcast(mean)).select(order, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    moments = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}
    upto = s.select(F.row_number().over(w).alias("pos"), *[F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, m in moments.items()])
    n = series.count()
    spark = series.sparkSession
    upto = upto.unionByName(spark.range(1).select(F.lit(0).alias("pos"), *[F.lit(0.0).alias(k) for k in moments]))
    grid = None
    for b in blocks:
        slots = -(-n // b)
        one = spark.range(replicates * slots).select(F.lit(b).alias("block"), F.floor(F.col("id") / slots).alias("rep"), (F.col("id") % slots).alias("slot"))
        grid = one if grid is None else grid.unionByName(one)
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "block", "rep", "slot").cast("binary")), 1, 8), 16, 10).cast("long")
    start = F.pmod(digest, F.lit(n) - F.col("block") + 1).cast("int")
    drawn = grid.withColumn("from", start).withColumn("to", (F.col("from") + F.least(F.col("block"), F.lit(n) - F.col("slot") * F.col("block"))).cast("int"))
    at = lambda end: upto.select(F.col("pos").alias(end), *[F.col(k).alias(f"{end}_{k}") for k in moments])
    sums = drawn.join(at("from"), "from").join(at("to"), "to").groupBy("block", "rep").agg(F.sum(F.col("to") - F.col("from")).alias("n"), *[F.sum(F.col(f"to_{k}") - F.col(f"from_{k}")).alias(k) for k in moments])
    vx, vy, c = (F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") for a, b in ("xx", "yy", "xy"))
    flat = (vx <= 1e-12 * F.col("n") * F.col("sxx")) | (vy <= 1e-12 * F.col("n") * F.col("syy"))
    reps = sums.select("block", "rep", F.when(flat, 0.0).otherwise(F.coalesce(ratio(c, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))), F.lit(0.0))).alias("r"))
    q = lambda p: F.percentile("r", F.lit(p))
    two = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("r") <= 0).cast("double")), F.avg((F.col("r") >= 0).cast("double"))))
    return reps.groupBy("block").agg(F.count(F.lit(1)).alias("replicates"), q(0.025).alias("low95"), q(0.975).alias("high95"), q(0.005).alias("low99"), q(0.995).alias("high99"), two.alias("p"))


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and rates; undefined rates are null."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    c = df.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp)})
    return c.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def warning_table(series: DataFrame, order: str, event: str, warn: Column, keys: list[str]) -> DataFrame:
    """Warnings against events in the next two rows of each group: months, counts, rates, the events' own rate and the gain of precision over it."""
    c = confusion(forward_events(series, order, event, warn, keys).filter("evaluable"), F.col("warning"), F.col("hit"), keys)
    months = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    base = ratio(F.col("tp") + F.col("fn"), months)
    return c.select(*keys, months.alias("months"), "tp", "fp", "fn", "tn", "precision", "recall", "specificity", base.alias("base_rate"), (F.col("precision") - base).alias("gain"))


def errors(df: DataFrame, error: str, keys: list[str]) -> DataFrame:
    """rmse, mae and bias of each group; null if any prediction is missing."""
    whole = F.count(error) == F.count(F.lit(1))
    e = F.col(error)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(whole, F.sqrt(F.avg(e * e))).alias("rmse"), F.when(whole, F.avg(F.abs(e))).alias("mae"), F.when(whole, F.avg(e)).alias("bias"))


def ar1_forecasts(series: DataFrame, order: str, value: str, first: int, expanding: bool = True) -> DataFrame:
    """One-step AR(1) forecasts from position ``first`` on: estimated on all earlier rows, or on those before ``first``. One window, running moments."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    s = series.select(order, F.col(value).alias("actual"), F.row_number().over(w).alias("pos"), F.lag(value).over(w).alias("last"))
    y = F.col("actual") if expanding else F.when(F.col("pos") <= first, F.col("actual"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    fit = s.withColumns({"b": F.regr_slope(y, F.col("last")).over(past), "a": F.regr_intercept(y, F.col("last")).over(past)}).filter(F.col("pos") > first)
    return fit.select(order, "actual", (F.col("a") + F.col("b") * F.col("last")).alias("forecast"))


def solved(matrix: Column, size: int) -> Column:
    """The solution of symmetric equations, rows of ``size`` coefficients and a right side, by elimination in expressions; null where a pivot vanishes."""

    def eliminate(m, p):
        pivot = F.get(m, p)
        unit = F.transform(pivot, lambda v: F.try_divide(v, F.get(pivot, p)))
        return F.transform(m, lambda row, i: F.when(i == p, unit).otherwise(F.zip_with(row, unit, lambda v, u: v - F.get(row, p) * u)))

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, eliminate)
    return F.transform(whole, lambda row: F.get(row, F.lit(size)))


def forecast_grid(series: DataFrame, order: str, models: list[tuple[str, str, list[tuple[str, int]], bool]], first: int, keys: list[str] = ()) -> DataFrame:
    """One-step least-squares forecasts of many models over one or many series: keys, model, order, actual, forecast.

    A model is (name, target column, lagged columns as (column, lag), expanding): estimated with a constant on
    all rows before the forecast's, or on the first ``first`` rows for all forecasts. The outer products of each
    row's regressors and target are summed as they run, once for all models, lags and targets, and solved at each
    row; incomplete rows don't count, and a forecast without more complete rows than coefficients, without
    all its lags or with dependent regressors is null."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)
    size = 1 + max(len(lags) for _, _, lags, _ in models)
    offered = []
    for name, target, lags, expanding in models:
        x = [F.lit(1.0), *[F.lag(c, k).over(w).cast("double") for c, k in lags]]
        offered.append(F.struct(F.lit(name).alias("model"), F.lit(expanding).alias("expanding"), F.lit(len(x)).alias("k"), F.array(*x, *[F.lit(0.0)] * (size - len(x))).alias("x"), F.col(target).cast("double").alias("y")))
    rows = series.select(*keys, order, F.row_number().over(w).alias("pos"), F.array(*offered).alias("m")).select(*keys, order, "pos", F.explode("m").alias("m")).select(*keys, order, "pos", "m.*")
    rows = rows.withColumn("whole", F.forall("x", lambda v: v.isNotNull())).withColumn("used", F.col("whole") & F.col("y").isNotNull() & (F.col("expanding") | (F.col("pos") <= first)))
    past = Window.partitionBy(*keys, "model").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cell = lambda i: F.col("y") if i == size else F.get("x", F.lit(i))
    sums = {f"s{i}_{j}": F.coalesce(F.sum(F.when(F.col("used"), cell(i) * cell(j))).over(past), F.lit(0.0)) for i in range(size) for j in range(i, size + 1)}
    run = rows.withColumns(sums | {"n": F.count_if(F.col("used")).over(past)}).filter(F.col("pos") > first)
    own = lambda i: F.when(F.col("k") <= i, 1.0).otherwise(F.col(f"s{i}_{i}"))  # noqa: E731  a place without a regressor has coefficient 0
    matrix = F.array(*[F.array(*[own(i) if i == j else F.col(f"s{min(i, j)}_{max(i, j)}") for j in range(size + 1)]) for i in range(size)])
    value = F.aggregate(F.zip_with("b", "x", lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)
    known = F.col("whole") & (F.col("n") > F.col("k"))
    return run.withColumn("b", solved(matrix, size)).select(*keys, "model", order, F.col("y").alias("actual"), F.when(known, value).alias("forecast"))


def ar_forecasts(series: DataFrame, order: str, value: str, lags: int, exog: list[str], first: int, expanding: bool = True) -> DataFrame:
    """One-step AR(p) forecasts with exogenous columns of one row before."""
    return forecast_grid(series, order, [("ar", value, [*[(value, k) for k in range(1, lags + 1)], *[(c, 1) for c in exog]], expanding)], first).drop("model")
