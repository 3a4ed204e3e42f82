"""Panel queries: grids, derivatives, pivots, joins, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import iso_week_key, month_key, ratio
from tidemark.operators import panels as P
from tidemark.operators import windows as W
from tidemark.plans.base import REGIMES, months, shares, ship_months, sql, table, weeks

Q, O = {}, {}
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def query(oracle=None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


GRID = "g AS (SELECT strftime(unnest(generate_series(DATE '1994-11-01', DATE '2002-02-01', INTERVAL 1 MONTH)), '%Y-%m') AS month)"


@query(sql("months ship_months", f", {GRID} SELECT month, n, round(level, 8) AS level, lines, round(revenue, 2) AS revenue, n IS NOT NULL AS in_study FROM g LEFT JOIN months USING (month) LEFT JOIN ship_months USING (month)"))
def panel_grid_left_join(spark, d):
    p = P.on_grid(P.month_grid(spark, "1994-11", "2002-02"), months(spark, d), ship_months(spark, d))
    return p.select("month", "n", F.round("level", 8).alias("level"), "lines", F.round("revenue", 2).alias("revenue"), F.col("n").isNotNull().alias("in_study"))


DER = """, x AS (SELECT month, total, level, 100 * (ln(total) - lag(ln(total)) OVER w) AS ret, level - lag(level) OVER w AS step, 100 * (level / lag(level, 12) OVER w - 1) AS yoy FROM months WINDOW w AS (ORDER BY month)),
 y AS (SELECT *, CASE WHEN count(ret) OVER f3 = 3 THEN stddev_samp(ret) OVER f3 END AS vol3, CASE WHEN count(ret) OVER f12 = 12 THEN stddev_samp(ret) OVER f12 END AS vol12 FROM x WINDOW f3 AS (ORDER BY month ROWS 2 PRECEDING), f12 AS (ORDER BY month ROWS 11 PRECEDING)),
 der AS (SELECT *, ret / nullif(lag(vol12) OVER (ORDER BY month), 0) AS ret_std FROM y)"""


def derivatives(spark, d):
    w = W.ordered("month")
    p = months(spark, d).withColumns({"ret": W.log_diff(F.col("total"), w), "step": W.diff(F.col("level"), w), "yoy": W.ratio_change(F.col("level"), w)})
    p = p.withColumns({"vol3": W.full_window_std(F.col("ret"), w, 3), "vol12": W.full_window_std(F.col("ret"), w, 12)})
    return p.withColumn("ret_std", W.scaled_by_lagged(F.col("ret"), F.col("vol12"), w))


@query(sql("months", DER + " SELECT month, round(ret, 6) AS ret, round(step, 6) AS step, round(yoy, 6) AS yoy, round(vol3, 6) AS vol3, round(vol12, 6) AS vol12, round(ret_std, 6) AS ret_std FROM der"))
def panel_derivatives(spark, d):
    return derivatives(spark, d).select("month", *r6("ret", "step", "yoy", "vol3", "vol12", "ret_std"))


@query(sql("months", DER + " SELECT month, round(step, 6) AS step, round(yoy, 6) AS yoy, round((level - avg(level) OVER ()) / stddev_samp(level) OVER (), 6) AS z FROM der"))
def diff_yoy_fullz(spark, d):
    return derivatives(spark, d).withColumn("z", W.zscore(F.col("level"))).select("month", *r6("step", "yoy", "z"))


@query(sql("months", DER + " SELECT month, round(vol3, 6) AS vol3, round(vol12, 6) AS vol12 FROM der"))
def rolling_std_full_window(spark, d):
    return derivatives(spark, d).select("month", *r6("vol3", "vol12"))


@query(sql("months ship_months", ", l AS (SELECT month, unnest(['total', 'level', 'revenue']) AS series, unnest([total, level, revenue]) AS v FROM months JOIN ship_months USING (month)), z AS (SELECT *, (v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series) AS z FROM l) SELECT month, series, round(z, 6) AS z FROM z WHERE abs(z) >= 2"))
def panel_outliers(spark, d):
    p = P.stack(months(spark, d).join(ship_months(spark, d), "month"), ["month"], ["total", "level", "revenue"], "series", "v")
    return p.withColumn("z", W.zscore(F.col("v"), ["series"])).filter(F.abs("z") >= 2).orderBy(F.desc(F.abs("z")), "month").select("month", "series", F.round("z", 6).alias("z"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type = before")
def panel_repeats(spark, d):
    w = W.ordered(["ts", "event_id"], ["user_id"])
    return table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).filter("event_type = before").select("user_id", "event_id", "event_type")


@query("SELECT day, event_type FROM (SELECT strftime(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)), '%Y-%m-%d') AS day), (SELECT DISTINCT event_type FROM events) EXCEPT SELECT strftime(ts, '%Y-%m-%d'), event_type FROM events")
def coverage_gap_months(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date"))).alias("at")).select(F.date_format("at", "yyyy-MM-dd").alias("day"))
    return P.coverage_gaps(days.crossJoin(F.broadcast(e.select("event_type").distinct())), e, ["day", "event_type"])


WEEK = "isoyear({0}) || '-W' || lpad(CAST(weekofyear({0}) AS VARCHAR), 2, '0')"


def _event_types(spark, d):
    return [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a fixed handful


@query(f"SELECT week, event_type, n, round(m, 6) AS mean FROM (SELECT {WEEK.format('ts')} AS week, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2)")
def daily_to_iso_week_pivot(spark, d):
    """Weekly means by type, pivoted and stacked back: one row per filled cell."""
    types = _event_types(spark, d)
    e = table(spark, d, "events").withColumn("week", iso_week_key(F.col("ts")))
    wide = e.groupBy("week").pivot("event_type", types).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    cells = F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(f"{t}_n").alias("n"), F.round(F.col(f"{t}_mean"), 6).alias("mean")) for t in types])
    return wide.select("week", F.explode(cells).alias("c")).select("week", "c.*").filter("n IS NOT NULL")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1, 2")
def monthly_pivot_std(spark, d):
    types = _event_types(spark, d)
    wide = table(spark, d, "events").groupBy(month_key(F.col("ts")).alias("month")).pivot("event_type", types).agg(F.stddev_samp("value"))
    return P.stack(wide, ["month"], types, "event_type", "sd").filter("sd IS NOT NULL").withColumn("sd", F.round("sd", 6))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def pivot_duplicate_guard(spark, d):
    types = _event_types(spark, d)
    long = table(spark, d, "events").groupBy(month_key(F.col("ts")).alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    wide = P.pivot_once(long, "month", "event_type", types, "n")
    return wide.select("month", F.explode(F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(t).alias("n")) for t in types])).alias("c")).select("month", "c.*").filter("n IS NOT NULL")


SHIPWEEK = f", sw AS (SELECT {WEEK.format('l_shipdate')} AS week, count(*) AS lines, avg(l_discount) AS discount FROM lineitem GROUP BY 1), cust AS (SELECT {WEEK.format('o_orderdate')} AS week, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


@query(sql("weeks", SHIPWEEK + " SELECT week, period, n, round(level, 8) AS level, lines, round(discount, 6) AS discount, customers FROM weeks JOIN sw USING (week) LEFT JOIN cust USING (week)"))
def weekly_news_search_panel(spark, d):
    lines = table(spark, d, "lineitem").groupBy(iso_week_key(F.col("l_shipdate")).alias("week")).agg(F.count(F.lit(1)).alias("lines"), F.avg("l_discount").alias("discount"))
    cust = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(iso_week_key(F.col("o_orderdate")).alias("week")).agg(F.countDistinct("o_custkey").alias("customers"))
    return weeks(spark, d).join(lines, "week").join(cust, "week", "left").select("week", "period", "n", F.round("level", 8).alias("level"), "lines", F.round("discount", 6).alias("discount"), "customers")


@query(sql("months z", " SELECT z.month, z.regime, round(z.z, 6) AS z, round(months.level, 8) AS level, round(lead(months.level) OVER (PARTITION BY regime ORDER BY z.month), 8) AS next_level FROM z JOIN months ON months.month = z.month"))
def panel_inner_join_regimes(spark, d):
    from tidemark.operators.regimes import regime_zscores

    j = regime_zscores(shares(spark, d)).drop("period").join(months(spark, d), "month")
    return j.select("month", "regime", F.round("z", 6).alias("z"), F.round("level", 8).alias("level"), F.round(F.lead("level").over(W.ordered("month", ["regime"])), 8).alias("next_level"))


@query("SELECT n_name AS nation, r_name AS region, customers, round(balance, 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, count(*) AS customers, sum(c_acctbal) AS balance FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def validated_one_to_one_join(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return P.one_to_one(n, c, "key").select("nation", "region", "customers", "balance")


@query("SELECT c_mktsegment AS segment, count(*) FILTER (has) AS with_orders, count(*) FILTER (NOT has) AS without_orders FROM (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS has FROM customer) GROUP BY 1")
def anti_semi_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    one = c.join(o, "c_custkey", "left_semi").select("c_mktsegment", F.lit(1).alias("has"))
    two = c.join(o, "c_custkey", "left_anti").select("c_mktsegment", F.lit(0).alias("has"))
    return one.unionByName(two).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("has") == 1).alias("with_orders"), F.count_if(F.col("has") == 0).alias("without_orders"))


@query("SELECT label, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' END AS label FROM orders) GROUP BY 1")
def map_lookup_labels(spark, d):
    o = P.map_lookup(table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": "now", "2-HIGH": "soon"}, "label")
    return o.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(sql("months", " SELECT month, lag(month) OVER (ORDER BY month) AS prev, coalesce(strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') = lag(month) OVER (ORDER BY month), false) AS consecutive FROM months"))
def prev_month_check(spark, d):
    prev = F.lag("month").over(W.ordered("month"))
    before = month_key(F.add_months(F.concat("month", F.lit("-01")).cast("date"), -1))
    return months(spark, d).select("month", prev.alias("prev"), F.coalesce(before == prev, F.lit(False)).alias("consecutive"))


@query(sql("shares", " SELECT regime, arg_max(month, (share, -CAST(replace(month, '-', '') AS BIGINT))) AS peak, round(max(share), 6) AS high, arg_min(month, (share, CAST(replace(month, '-', '') AS BIGINT))) AS trough, round(min(share), 6) AS low FROM shares GROUP BY 1"))
def series_peak_trough(spark, d):
    """First month of the largest and of the smallest share."""
    g = shares(spark, d).groupBy("regime").agg(F.min(F.struct((-F.col("share")).alias("v"), "month")).alias("hi"), F.min(F.struct(F.col("share").alias("v"), "month")).alias("lo"))
    return g.select("regime", F.col("hi.month").alias("peak"), F.round(-F.col("hi.v"), 6).alias("high"), F.col("lo.month").alias("trough"), F.round("lo.v", 6).alias("low"))


@query(sql("months ship_months", " SELECT 'orders' AS chunk, count(*) AS rows, array_to_string(list_sort(list(month) FILTER (n < 100)), ';') AS thin, round_even(avg(n), 2) AS mean FROM months UNION ALL SELECT 'lines', count(*), coalesce(nullif(array_to_string(list_sort(list(month) FILTER (lines < 100)), ';'), ''), 'none'), round_even(avg(lines), 2) FROM ship_months").replace("array_to_string(list_sort(list(month) FILTER (n < 100)), ';') AS thin", "coalesce(nullif(array_to_string(list_sort(list(month) FILTER (n < 100)), ';'), ''), 'none') AS thin"))
def union_metric_chunks(spark, d):
    from tidemark.functions.scalar import joined_or_none

    def chunk(p, name, col):
        return p.agg(F.count(F.lit(1)).alias("rows"), joined_or_none(F.array_sort(F.collect_list(F.when(F.col(col) < 100, F.col("month"))))).alias("thin"), F.bround(F.avg(col), 2).alias("mean")).select(F.lit(name).alias("chunk"), "*")

    return chunk(months(spark, d), "orders", "n").unionByName(chunk(ship_months(spark, d), "lines", "lines"))


@query(sql("months", DER + ", win(name, lo, hi) AS (VALUES ('calm', '1996-01', '1997-06'), ('rise', '1997-07', '1999-12'), ('late', '2000-01', '2001-12')) SELECT name, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd FROM win JOIN der ON month BETWEEN lo AND hi GROUP BY 1"))
def volatility_regime_windows(spark, d):
    win = spark.createDataFrame([("calm", "1996-01", "1997-06"), ("rise", "1997-07", "1999-12"), ("late", "2000-01", "2001-12")], "name string, lo string, hi string")
    j = derivatives(spark, d).join(F.broadcast(win), F.col("month").between(F.col("lo"), F.col("hi")))
    return j.groupBy("name").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.stddev_samp("ret"), 6).alias("sd"))


@query(sql("shares", ", w AS (SELECT month, coalesce(max(share) FILTER (regime = 'urgent'), 0) AS urgent, coalesce(max(share) FILTER (regime = 'high'), 0) AS high, coalesce(max(share) FILTER (regime = 'low'), 0) AS low FROM shares GROUP BY 1) SELECT month, round(urgent, 6) AS urgent, round(high, 6) AS high, round(low, 6) AS low, round(urgent + high + low, 6) AS three FROM w"))
def horizontal_sums(spark, d):
    """A wide panel whose row sums skip missing cells."""
    wide = shares(spark, d).groupBy("month").pivot("regime", list(REGIMES)).agg(F.first("share"))
    cells = {c: F.coalesce(c, F.lit(0.0)) for c in ("urgent", "high", "low")}
    return wide.select("month", *[F.round(v, 6).alias(c) for c, v in cells.items()], F.round(cells["urgent"] + cells["high"] + cells["low"], 6).alias("three"))


AUD = ", chk AS (SELECT 'months' AS name, (SELECT count(*) FROM months) = 80 AS ok, true AS evidence UNION ALL SELECT 'shares sum to 1', (SELECT max(abs(s - 1)) < 1e-9 FROM (SELECT sum(share) AS s FROM shares GROUP BY month)), true UNION ALL SELECT 'orders unique', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders), true UNION ALL SELECT 'returns before 1990', NULL, false)"


@query(sql("months shares", AUD + ", a AS (SELECT name, CASE WHEN NOT evidence THEN 'INSUFFICIENT EVIDENCE' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM chk) SELECT name, status FROM a UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status <> 'PASS') THEN 'INSUFFICIENT EVIDENCE' ELSE 'PASS' END FROM a"))
def audit_verdict(spark, d):
    from tidemark.operators import audit as A

    s = shares(spark, d).groupBy("month").agg(F.sum("share").alias("s"))
    o = table(spark, d, "orders")
    return A.verdict(A.checks(
        A.check("months", months(spark, d).agg((F.count(F.lit(1)) == 80).alias("ok"))), A.check("shares sum to 1", s.agg((F.max(F.abs(F.col("s") - 1)) < 1e-9).alias("ok"))),
        A.check("orders unique", o.agg((F.count("o_orderkey") == F.countDistinct("o_orderkey")).alias("ok"))), A.no_evidence(spark, "returns before 1990")))
