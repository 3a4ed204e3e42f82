"""Queries that hold two results against each other: series, activations, regressions, warning rules, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import TRAIN_END
from tidemark.functions.scalar import month_key, ratio
from tidemark.operators import audit as A
from tidemark.operators import panels as P
from tidemark.operators import regimes as R
from tidemark.operators import stats as S
from tidemark.operators import text as T
from tidemark.plans.base import REGIMES, corpus, docs, exploded, months, shares, ship_months, slug, sql, table, weeks
from tidemark.plans.corpus import TOPS, VOCAB, stratified_sample, tops, vocabulary
from tidemark.operators.windows import ordered
from tidemark.plans.panels import DER, derivatives
from tidemark.plans.regimes import DICTIONARY
from tidemark.plans.statistics import SPLITS, _weekly_diffs
from tidemark.tables import stored

Q, O = {}, {}
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def query(oracle=None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


#: The same panel from sums of prices instead of counts: shares of a month and z scores by training moments.
PRICED = """, ps AS (SELECT month, period, regime, total / sum(total) OVER (PARTITION BY month) AS share FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN strftime(o_orderdate, '%Y-%m') <= '1998-12' THEN 'Train' ELSE 'Eval' END AS period, replace(lower(regexp_replace(o_orderpriority, '^[0-9]+-', '')), ' ', '_') AS regime, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2, 3)),
 pz AS (SELECT *, (share - avg(share) FILTER (period = 'Train') OVER (PARTITION BY regime)) / stddev_samp(share) FILTER (period = 'Train') OVER (PARTITION BY regime) AS z FROM ps)"""


def priced_shares(spark, d):
    sums = table(spark, d, "orders").groupBy(month_key(F.col("o_orderdate")).alias("month"), slug(F.col("o_orderpriority")).alias("regime")).agg(F.sum("o_totalprice").alias("v"))
    total = sums.groupBy("month").agg(F.sum("v").alias("total"))
    return sums.join(total, "month").select("month", F.when(F.col("month") <= "1998-12", "Train").otherwise("Eval").alias("period"), "regime", (F.col("v") / F.col("total")).alias("share"))


@query(sql("shares", PRICED + """, j AS (SELECT unnest(['Full', s.period]) AS split, s.regime, s.month, s.share AS x, p.share AS y FROM shares s JOIN ps p ON p.month = s.month AND p.regime = s.regime),
 k AS (SELECT *, rank() OVER (PARTITION BY split, regime ORDER BY x) + (count(*) OVER (PARTITION BY split, regime, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY split, regime ORDER BY y) + (count(*) OVER (PARTITION BY split, regime, y) - 1) / 2 AS ry FROM j)
 SELECT split, regime, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(y - x), 6) AS bias, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(max(abs(y - x)), 6) AS largest,
 arg_max(month, (abs(y - x), -CAST(replace(month, '-', '') AS BIGINT))) AS largest_at, round(corr(x, y), 6) AS r, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1, 2"""))
def series_comparison(spark, d):
    """Each regime's share by counts against its share by prices, in all splits, with the month of the largest difference."""
    j = shares(spark, d).withColumnRenamed("share", "x").join(priced_shares(spark, d).select("month", "regime", F.col("share").alias("y")), ["month", "regime"]).withColumn("split", R.overlapping_splits(F.col("period")))
    return S.compare_series(j, ["split", "regime"], "month", "x", "y").select("split", "regime", "n", *r6("mean_x", "mean_y", "bias", "mae", "rmse", "largest"), "largest_at", *r6("r", "rho"))


@query()
def series_comparison_p_values(spark, d):
    """p values of both correlations of ``series_comparison`` under the t distribution, Spearman's included."""
    n = F.col("n").cast("double")
    return series_comparison(spark, d).select("split", "regime", "n", "r", S.pearson_p("r", n).alias("r_p"), "rho", S.pearson_p("rho", n).alias("rho_p"))


@query(sql("z", PRICED + """, c AS (SELECT unnest(['Full', z.period]) AS split, z.month, z.z AS a, pz.z AS b, z.regime FROM z JOIN pz ON pz.month = z.month AND pz.regime = z.regime),
 m AS (SELECT split, month, count(*) AS cells, count(*) FILTER ((a >= 0.5) = (b >= 0.5)) AS same, arg_max(regime, a) = arg_max(regime, b) AS top, (count(*) FILTER (a >= 0.5) >= 2) = (count(*) FILTER (b >= 0.5) >= 2) AS multi FROM c GROUP BY 1, 2)
 SELECT split, count(*) AS months, CAST(sum(cells) AS BIGINT) AS cells, round(100.0 * sum(same) / sum(cells), 6) AS cell_pct, round(100.0 * count(*) FILTER (top) / count(*), 6) AS argmax_pct, round(100.0 * count(*) FILTER (multi) / count(*), 6) AS multi_pct FROM m GROUP BY 1"""))
def activation_agreement(spark, d):
    """Activations by counts against those by prices: every cell of the regimes by months, the strongest regime, several at once."""
    a, b = R.regime_zscores(shares(spark, d)), R.regime_zscores(priced_shares(spark, d))
    return R.agreement(a, b, list(REGIMES)).select("split", "months", "cells", *r6("cell_pct", "argmax_pct", "multi_pct"))


REG = """, j AS (SELECT unnest(['Full', period]) AS split, month, n AS y, level, revenue FROM months JOIN ship_months USING (month)),
 e AS (SELECT 'base' AS spec, split, month, y, level AS x FROM j UNION ALL SELECT 'other', split, month, y, revenue FROM j),
 c AS (SELECT spec, split, month, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS y FROM e WINDOW w AS (PARTITION BY spec, split)),
 b AS (SELECT spec, split, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, corr(x, y) ** 2 AS r2 FROM c GROUP BY 1, 2),
 u AS (SELECT spec, split, x * (y - beta * x) AS u, row_number() OVER (PARTITION BY spec, split ORDER BY month) AS pos FROM c JOIN b USING (spec, split)),
 s AS (SELECT a.spec, a.split, sum(a.u * l.u * CASE WHEN a.pos = l.pos THEN 1 ELSE 2 * (1 - (a.pos - l.pos) / 4) END) AS s FROM u a JOIN u l ON a.spec = l.spec AND a.split = l.split AND a.pos - l.pos BETWEEN 0 AND 3 GROUP BY 1, 2),
 f AS (SELECT spec, split, beta, r2, abs(beta) / (sqrt(s) / sxx) > 1.959963984540054 AS significant FROM s JOIN b USING (spec, split))"""


@query(sql("months ship_months", REG + " SELECT o.split, 'x' AS variable, round(o.beta - a.beta, 6) AS beta_difference, round(o.r2 - a.r2, 6) AS r2_difference, sign(o.beta) = sign(a.beta) AS sign_preserved, o.significant = a.significant AS significance_preserved FROM f o JOIN f a ON a.split = o.split AND a.spec = 'base' AND o.spec = 'other'"))
def regression_comparison(spark, d):
    """Two regressions of the number of orders, on the price level and on revenue: what changes in slope, R2, sign and significance."""
    j = months(spark, d).select("month", "period", F.col("n").cast("double").alias("y"), "level").join(ship_months(spark, d).select("month", "revenue"), "month").withColumn("split", R.overlapping_splits(F.col("period")))
    fit = lambda x: S.ols_table(S.standardized(j.select("split", "month", "y", F.col(x).alias("x")), ["split"], ["x", "y"]), ["split"], "month", "y", ["x"], 3).filter("variable <> 'const'")
    return S.compare_coefficients(fit("level"), fit("revenue"), ["split", "variable"]).select("split", "variable", *r6("beta_difference", "r2_difference"), "sign_preserved", "significance_preserved")


TWO = DER + """, dz AS (SELECT month, max(z) FILTER (regime = 'urgent') AS z1, max(z) FILTER (regime = 'high') AS z2 FROM z GROUP BY 1), th AS (SELECT CAST(unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS DOUBLE) AS threshold)"""


def _z_pair(spark, d):
    z = R.regime_zscores(shares(spark, d))
    return z.groupBy("month").agg(F.max(F.when(F.col("regime") == "urgent", F.col("z"))).alias("z1"), F.max(F.when(F.col("regime") == "high", F.col("z"))).alias("z2"))


def _thresholds(spark):
    return F.broadcast(spark.createDataFrame([(x,) for x in (0.3, 0.4, 0.5, 0.6, 0.7)], "threshold double"))


@query(sql("months z", TWO + """, ev AS (SELECT month, ret, z1, z2 FROM der JOIN dz USING (month) WHERE ret IS NOT NULL), smp AS (SELECT 'all' AS sample, * FROM ev UNION ALL SELECT 'first 60', * FROM ev WHERE month <= '1999-12'),
 k AS (SELECT sample, 'fall' AS kind, month, z1, z2, ret < 0 AS event FROM smp UNION ALL SELECT sample, 'crash', month, z1, z2, ret <= -3 FROM smp),
 fw AS (SELECT sample, kind, threshold, coalesce(z1 >= threshold, false) OR coalesce(z2 >= threshold, false) AS warning, lead(event) OVER w OR lead(event, 2) OVER w AS hit, lead(event, 2) OVER w IS NOT NULL AS evaluable FROM k, th WINDOW w AS (PARTITION BY sample, kind, threshold ORDER BY month)),
 c AS (SELECT sample, kind, threshold, count(*) AS months, count(*) FILTER (warning AND hit) AS tp, count(*) FILTER (warning AND NOT hit) AS fp, count(*) FILTER (NOT warning AND hit) AS fn, count(*) FILTER (NOT warning AND NOT hit) AS tn FROM fw WHERE evaluable GROUP BY 1, 2, 3)
 SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + fn) / months, 6) AS base_rate, round(tp / nullif(tp + fp, 0) - (tp + fn) / months, 6) AS gain FROM c"""))
def dual_warning(spark, d):
    """Warnings when either of two regimes is active, for falls and crashes, at five thresholds, on all months and on the first 60."""
    ev = derivatives(spark, d).filter("ret IS NOT NULL").select("month", "ret").join(_z_pair(spark, d), "month")
    ev = ev.withColumn("sample", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("month") <= "1999-12", "first 60")), lambda s: s.isNotNull())))
    kinds = F.explode(F.array(F.struct(F.lit("fall").alias("kind"), (F.col("ret") < 0).alias("event")), F.struct(F.lit("crash").alias("kind"), (F.col("ret") <= -3).alias("event"))))
    k = ev.select("sample", "month", "z1", "z2", kinds.alias("k")).select("sample", "month", "z1", "z2", "k.*").crossJoin(_thresholds(spark))
    warn = F.coalesce(F.col("z1") >= F.col("threshold"), F.lit(False)) | F.coalesce(F.col("z2") >= F.col("threshold"), F.lit(False))
    w = S.warning_table(k, "month", "event", warn, ["sample", "kind", "threshold"])
    return w.select("sample", "kind", "threshold", "months", "tp", "fp", "fn", "tn", *r6("precision", "recall", "specificity", "base_rate", "gain"))


@query(sql("months z", TWO + """, fw AS (SELECT threshold, month, step > 0 AS event, coalesce(lag(z1 >= threshold) OVER w, false) OR coalesce(lag(z1 >= threshold, 2) OVER w, false) AS warned FROM der JOIN dz USING (month), th WINDOW w AS (PARTITION BY threshold ORDER BY month)),
 s AS (SELECT 'all' AS sample, * FROM fw UNION ALL SELECT 'core', * FROM fw WHERE month BETWEEN '1997-07' AND '1999-12')
 SELECT sample, threshold, count(*) AS events, count(*) FILTER (warned) AS hits, round(count(*) FILTER (warned) / count(*), 6) AS recall FROM s WHERE event GROUP BY 1, 2"""))
def rise_recall(spark, d):
    """Rises of the level with a warning one or two months before, in all months and in a core period."""
    s = derivatives(spark, d).select("month", (F.col("step") > 0).alias("event")).join(_z_pair(spark, d), "month").crossJoin(_thresholds(spark))
    e = P.event_recall(s, "month", "event", F.col("z1") >= F.col("threshold"), ["threshold"])
    e = e.withColumn("sample", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("month").between("1997-07", "1999-12"), "core")), lambda x: x.isNotNull())))
    g = e.groupBy("sample", "threshold").agg(F.count(F.lit(1)).alias("events"), F.count_if("warned").alias("hits"))
    return g.withColumn("recall", F.round(ratio(F.col("hits"), F.col("events")), 6))


TOPS20 = TOPS.replace("rank <= 10", "rank <= 20")


@query(sql("tokens", f", v AS ({VOCAB}), t AS ({TOPS20}), h AS (SELECT k, lang, count(*) OVER (PARTITION BY k, term) AS held, row_number() OVER (PARTITION BY k, term) AS nth FROM t, (SELECT unnest([10, 20]) AS k) WHERE rank <= k), a AS (SELECT k, count(*) FILTER (nth = 1) / count(*) AS diversity FROM h GROUP BY 1) SELECT h.k, lang, round(avg(CAST(held > 1 AS DOUBLE)), 6) AS redundancy, round(any_value(diversity), 6) AS diversity, round(1 - any_value(diversity), 6) AS overall_redundancy FROM h JOIN a ON a.k = h.k GROUP BY 1, 2"))
def topic_diversity(spark, d):
    """Diversity and redundancy of the 10 and 20 first terms; languages play topics."""
    return T.diversity(tops(corpus(spark, d), 20), "lang", [10, 20]).select("k", "lang", *r6("redundancy", "diversity", "overall_redundancy"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, strftime(min(o_orderdate), '%Y-%m') AS first_month FROM orders GROUP BY 1, 2")
def request_combinations(spark, d):
    """Distinct combinations of what was asked for, with their rows and first month."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return o.agg(F.count(F.lit(1)).alias("n"), month_key(F.min("o_orderdate")).alias("first_month"))


@query(sql("months ship_months", " SELECT c.column, count(*) AS cells, CAST(0 AS BIGINT) AS wrong FROM months JOIN ship_months USING (month), (SELECT unnest(['level', 'revenue']) AS column) c GROUP BY 1"))
def report_recheck(spark, d):
    """Every cell of a rendered monthly report recomputed from the orders and lines."""
    report = months(spark, d).join(ship_months(spark, d), "month").select("month", F.format_string("%.2f", "level").alias("level"), F.format_string("%.2f", "revenue").alias("revenue"))
    o = table(spark, d, "orders").groupBy(month_key(F.col("o_orderdate")).alias("month")).agg((F.sum("o_totalprice") / F.count("o_totalprice")).alias("level"))
    computed = ship_months(spark, d).select("month", "revenue").join(o, "month")
    return A.recheck(report, computed, ["month"], ["level", "revenue"], 2).groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("ok")).alias("wrong"))


@query(sql("tokens z months weeks", SPLITS + f""", v AS ({VOCAB}), f AS (SELECT doc_id, period FROM (SELECT doc_id, period, row_number() OVER (PARTITION BY month ORDER BY md5('42-' || doc_id), doc_id) AS r FROM docs WHERE period = 'Train') WHERE r <= 5),
 c AS (SELECT term, count(*) AS n FROM tokens WHERE period = 'Train' GROUP BY 1), m AS (SELECT regime, avg(share) AS mean, stddev_samp(share) AS sd FROM z WHERE period = 'Train' GROUP BY 1),
 wk AS (SELECT week, period, lag(period) OVER (ORDER BY week) AS before FROM weeks)
 SELECT 'split' AS audit, count(*) AS checked, count(*) FILTER ((period = 'Train') <> (month <= '2024-12')) AS leaks FROM docs UNION ALL SELECT 'vocabulary', count(*), count(*) FILTER (v.df <> coalesce(c.n, 0)) FROM v LEFT JOIN c ON c.term = v.term
 UNION ALL SELECT 'fit sample', count(*), count(*) FILTER (period <> 'Train') FROM f UNION ALL SELECT 'basis cells', count(*), count(*) FILTER (f.period <> 'Train') FROM tokens JOIN f USING (doc_id) JOIN v USING (term)
 UNION ALL SELECT 'mapping', count(DISTINCT source), 0 FROM tokens JOIN v USING (term) WHERE period = 'Train' UNION ALL SELECT 'z scores', count(*), count(*) FILTER (abs(z - (share - mean) / sd) > 1e-9) FROM z JOIN m USING (regime)
 UNION ALL SELECT 'regression window', count(*), count(*) FILTER (month > '1998-12') FROM months WHERE period = 'Train' UNION ALL SELECT 'weekly differences', count(*), count(*) FILTER (before <> period) FROM df JOIN wk USING (week) WHERE split <> 'Full' AND dn IS NOT NULL"""))
def leakage_audit(spark, d):
    """What was learned, checked against the training period at eight stages: rows looked at and rows that leak, recomputed another way."""
    all_docs = corpus(spark, d)
    t = exploded(all_docs)
    leaks = lambda c: [F.count(F.lit(1)).alias("checked"), F.count_if(F.coalesce(c, F.lit(False))).alias("leaks")]
    split = all_docs.agg(*leaks((F.col("period") == "Train") != (F.col("month") <= TRAIN_END)))
    again = T.document_frequency(t.filter("period = 'Train'")).select("term", F.col("df").alias("again"))
    v = vocabulary(all_docs)
    vocab = v.join(again, "term", "left").agg(*leaks(F.col("df") != F.coalesce("again", F.lit(0))))
    chosen = stored(stratified_sample(spark, d).select("doc_id"), "sample")
    sample = chosen.join(all_docs.select("doc_id", "period"), "doc_id").agg(*leaks(F.col("period") != "Train"))
    cells = t.join(chosen, "doc_id", "left_semi").join(v.select("term"), "term", "left_semi").agg(*leaks(F.col("period") != "Train"))
    with_all, alone = (_train_mapping(spark, c) for c in (all_docs, stored(all_docs.filter("period = 'Train'"), "train")))
    moved = with_all.join(alone.select("topic", F.col("status").alias("s"), F.col("best").alias("b")), "topic", "full").agg(*leaks(~(F.col("status").eqNullSafe(F.col("s")) & F.col("best").eqNullSafe(F.col("b")))))
    s = shares(spark, d)
    moments = s.filter("period = 'Train'").groupBy("regime").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"))
    z = R.regime_zscores(s).join(F.broadcast(moments), "regime").agg(*leaks(F.abs(F.col("z") - (F.col("share") - F.col("mean")) / F.col("sd")) > 1e-9))
    window = months(spark, d).filter("period = 'Train'").agg(*leaks(F.col("month") > "1998-12"))
    before = weeks(spark, d).select("week", "period", F.lag("period").over(ordered("week")).alias("before"))
    differences = _weekly_diffs(spark, d).filter("split <> 'Full' AND dn IS NOT NULL").join(before, "week").agg(*leaks(F.col("before") != F.col("period")))
    stages = {"split": split, "vocabulary": vocab, "fit sample": sample, "basis cells": cells, "mapping": moved, "z scores": z, "regression window": window, "weekly differences": differences}
    return A.checks(*[f.select(F.lit(n).alias("audit"), "checked", "leaks") for n, f in stages.items()])


def _train_mapping(spark, c):
    """Sources as topics, mapped by what a stored corpus says of its training documents."""
    vocab = vocabulary(c).select("term")
    w = exploded(c.filter("period = 'Train'")).join(vocab, "term").groupBy(F.col("source").alias("topic"), "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return R.map_topics(stored(w, "weights"), stored(R.claim_terms(vocab, R.domain_pairs(spark, DICTIONARY)), "claims"))


@query("SELECT coalesce(source, 'all') AS part, count(*) AS rows, count(DISTINCT lang) AS langs, min(doc_id) AS first, max(doc_id) AS last, true AS total_ok FROM documents GROUP BY ROLLUP (source) HAVING source IS NOT NULL OR grouping(source) = 1")
def source_manifest(spark, d):
    """Every source's rows and range, and the total, which must be the sum of the parts."""
    return A.manifest(table(spark, d, "documents"), "source", [F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")])
