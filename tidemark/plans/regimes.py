"""Regime queries: dictionary mapping, shares, z scores, activation and case selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regimes as R
from tidemark.operators.windows import first_by_rank
from tidemark.plans.base import REGIMES, corpus, exploded, shares, sql
from tidemark.plans.corpus import VOCAB, vocabulary
from tidemark.tables import stored

Q, O = {}, {}

#: A dictionary over the driver's invented vocabulary: domains, groups, keywords.
DICTIONARY = {
    "thermal": {"heat": ["the", "ther"], "hand": ["hand", "han"]},
    "motion": {"going": ["tion", "ation"], "ring": ["ing", "ring"]},
    "place": {"land": ["land", "lich"], "house": ["haus", "eaux"]},
    "other": {"end": ["end", "ent"], "and": ["and", "ent"]},
}
PAIRS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{dom}', '{g}', {r})" for r, (dom, gs) in enumerate(DICTIONARY.items()) for i, (g, ks) in enumerate(gs.items()) for k in ks if not any(k in x for x in list(gs.values())[:i])) + ") AS t(keyword, domain, grp, domain_rank)"
CLAIMS = f"v AS ({VOCAB}), pairs AS ({PAIRS_SQL}), claims AS (SELECT term, keyword, domain, grp FROM (SELECT term, keyword, domain, grp, row_number() OVER (PARTITION BY term ORDER BY length(keyword) DESC, domain_rank, keyword) AS r FROM v JOIN pairs ON keyword = term OR (length(keyword) >= 2 AND contains(term, keyword))) WHERE r = 1)"
WEIGHTS = ", w AS (SELECT source AS topic, term, CAST(count(*) AS DOUBLE) AS weight FROM tokens JOIN v USING (term) GROUP BY 1, 2)"
MAPPING = ", mass AS (SELECT topic, domain, sum(weight) AS mass FROM w JOIN claims USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mass DESC, domain) AS rank FROM mass), m AS (SELECT t.topic, any_value(total) AS total, max(domain) FILTER (rank = 1) AS best, coalesce(max(mass) FILTER (rank = 1), 0) AS best_mass, max(domain) FILTER (rank = 2) AS second, coalesce(max(mass) FILTER (rank = 2), 0) AS second_mass FROM (SELECT topic, sum(weight) AS total FROM w GROUP BY 1) t LEFT JOIN r ON r.topic = t.topic AND rank <= 2 GROUP BY 1), mapping AS (SELECT *, best_mass / CASE WHEN total > 0 THEN total ELSE 1 END AS best_share, CASE WHEN best_mass > 0 THEN second_mass / best_mass ELSE 1 END AS mass_ratio, CASE WHEN best_mass <= 0 OR best_mass / CASE WHEN total > 0 THEN total ELSE 1 END <= 0.01 THEN 'residual' WHEN CASE WHEN best_mass > 0 THEN second_mass / best_mass ELSE 1 END >= 0.9 THEN 'ambiguous' ELSE 'assigned' END AS status FROM m)"
GROUPS = ", g AS (SELECT topic, grp AS dominant_group, mass AS group_mass FROM (SELECT topic, grp, sum(weight) AS mass, row_number() OVER (PARTITION BY topic ORDER BY sum(weight) DESC, grp) AS rank FROM w JOIN claims USING (term) GROUP BY 1, 2) WHERE rank = 1)"
ACT = """, best AS (SELECT month, period, max(z) AS max_z, arg_min(regime, {'a': -z, 'b': pos}) AS argmax, coalesce(list(regime ORDER BY pos) FILTER (z >= 0.5), []) AS act FROM z WHERE z IS NOT NULL GROUP BY 1, 2),
 a AS (SELECT month, period, argmax, max_z, CASE WHEN max_z >= 0.5 THEN argmax ELSE 'none' END AS hurdle, act, list_filter(act, lambda x: x <> CASE WHEN max_z >= 0.5 THEN argmax ELSE '' END) AS om FROM best),
 acts AS (SELECT month, period, argmax, max_z, hurdle, len(act) AS n_active, CASE WHEN len(act) = 0 THEN 'none' ELSE array_to_string(act, ';') END AS active, len(om) AS n_omitted, CASE WHEN len(om) = 0 THEN 'none' ELSE array_to_string(om, ';') END AS omitted FROM a)"""


def query(oracle=None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


def _claims(spark, c):
    """Which keyword claims each vocabulary term of a stored corpus; stored."""
    return stored(R.claim_terms(vocabulary(c).select("term"), R.domain_pairs(spark, DICTIONARY)), "claims")


def weights_and_claims(spark, d):
    """Sources play topics: a term's documents are its weight; and the claims. Words are cut once, the vocabulary is built once."""
    c = corpus(spark, d)
    vocab = vocabulary(c).select("term")
    w = exploded(c).join(vocab, "term").groupBy(F.col("source").alias("topic"), "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return stored(w, "weights"), stored(R.claim_terms(vocab, R.domain_pairs(spark, DICTIONARY)), "claims")


@query(sql("tokens", ", " + CLAIMS + " SELECT term, keyword, domain, grp FROM claims"))
def term_claim_domain(spark, d):
    return _claims(spark, corpus(spark, d))


@query(sql("tokens", ", " + CLAIMS + WEIGHTS + MAPPING + GROUPS + " SELECT topic, best, round(best_mass, 6) AS best_mass, round(best_share, 6) AS best_share, second, round(mass_ratio, 6) AS mass_ratio, round(1 - mass_ratio, 6) AS confidence, status, dominant_group FROM mapping LEFT JOIN g USING (topic)"))
def topic_mapping_status(spark, d):
    w, c = weights_and_claims(spark, d)
    m = R.map_topics(w, c).join(R.dominant_group(w, c), "topic", "left")
    return m.select("topic", "best", *[F.round(x, 6).alias(x) for x in ("best_mass", "best_share", "mass_ratio", "confidence")], "second", "status", "dominant_group")


@query(sql("tokens", ", " + CLAIMS + WEIGHTS + MAPPING + GROUPS + ", s AS (SELECT best AS domain, count(*) AS topics, array_to_string(list_sort(list(DISTINCT dominant_group)), ';') AS groups FROM mapping LEFT JOIN g USING (topic) WHERE status = 'assigned' GROUP BY 1) SELECT domain, coalesce(topics, 0) AS topics, coalesce(groups, '') AS groups, CASE WHEN topics IS NULL THEN 'unsupported' WHEN domain = 'motion' AND groups = 'ring' THEN 'ring only' ELSE 'supported' END AS support FROM (SELECT DISTINCT domain FROM pairs) LEFT JOIN s USING (domain)"))
def domain_support(spark, d):
    w, c = weights_and_claims(spark, d)
    domains = R.domain_pairs(spark, DICTIONARY).select("domain").distinct()
    return R.domain_support(R.map_topics(w, c), R.dominant_group(w, c), domains, {"motion": "ring"})


@query(sql("tokens", f""", v AS ({VOCAB}), c AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN v USING (term) GROUP BY 1, 2, 3), g AS (SELECT lang, source, term, row_number() OVER (PARTITION BY lang, source ORDER BY n DESC, term) AS rank FROM c), t AS (SELECT * FROM g WHERE rank <= 2 AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8')),
 f AS (SELECT lang, term, min({{'s': source, 'r': rank}}) AS place FROM t GROUP BY 1, 2) SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY place, term) - 1 AS position FROM f"""))
def keyword_set_merge(spark, d):
    """Languages play regimes and nine sources their groups: two keywords of each, merged in order and at most twenty a regime."""
    c = corpus(spark, d)
    n = exploded(c).join(vocabulary(c).select("term"), "term").groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"))
    best = first_by_rank(n, ["lang", "source"], [F.desc("n"), F.col("term")], 2).filter(F.col("source").isin([f"src{i}" for i in range(9)]))
    return R.merge_keyword_sets(best, "lang", "source", "rank", "term")


@query(sql("shares", ", mp(topic, regime) AS (VALUES ('urgent', 'fast'), ('high', 'fast'), ('medium', 'slow'), ('low', 'slow'), ('not_specified', 'residual')) SELECT month, period, mp.regime, round(sum(share), 6) AS share FROM shares JOIN mp ON mp.topic = shares.regime GROUP BY 1, 2, 3"))
def regime_share_monthly(spark, d):
    m = spark.createDataFrame([("urgent", "fast", "assigned"), ("high", "fast", "assigned"), ("medium", "slow", "assigned"), ("low", "slow", "assigned"), ("not_specified", "slow", "ambiguous")], "topic string, best string, status string")
    return R.regime_panel(shares(spark, d).withColumnRenamed("regime", "topic"), m).withColumn("share", F.round("share", 6))


@query(sql("z", "SELECT month, period, regime, round(share, 6) AS share, round(z, 6) AS z FROM z"))
def regime_zscore_train_only(spark, d):
    return R.regime_zscores(shares(spark, d)).select("month", "period", "regime", F.round("share", 6).alias("share"), F.round("z", 6).alias("z"))


def _act(spark, d):
    return R.activation(R.regime_zscores(shares(spark, d)), list(REGIMES))


@query(sql("z", ACT + " SELECT month, period, argmax, round(max_z, 6) AS max_z, hurdle, n_active, active, n_omitted, omitted FROM acts"))
def regime_activation(spark, d):
    return _act(spark, d).withColumn("max_z", F.round("max_z", 6))


@query(sql("z", ACT + """, l AS (SELECT month, regime, pos, z, regime || '(z=' || printf('%+.2f', z) || ')' AS t FROM z WHERE z >= 0.5)
 SELECT a.month, argmax || '(z=' || printf('%+.2f', max_z) || ')' AS top, coalesce(string_agg(t, ', ' ORDER BY l.pos), 'none') AS active, coalesce(string_agg(t, ', ' ORDER BY l.pos) FILTER (l.regime <> a.hurdle), 'none') AS omitted FROM acts a LEFT JOIN l ON l.month = a.month GROUP BY 1, 2"""))
def activation_labels(spark, d):
    """Each month's strongest, active and omitted regimes as a report writes them."""
    z = R.regime_zscores(shares(spark, d))
    return R.active_labels(z, R.activation(z, list(REGIMES)), list(REGIMES))


@query(sql("z", ACT + ", s AS (SELECT unnest(['Full', period]) AS split, * FROM acts) SELECT split, count(*) AS months, count(*) FILTER (n_active >= 2) AS multi, count(*) FILTER (n_active = 0) AS inactive, CAST(sum(n_active) AS BIGINT) AS active, CAST(sum(n_omitted) AS BIGINT) AS omitted, round(100.0 * count(*) FILTER (n_active >= 2) / count(*), 6) AS multi_pct, round(100.0 * sum(n_omitted) / nullif(sum(n_active), 0), 6) AS omitted_pct FROM s GROUP BY 1"))
def single_vs_multi_metrics(spark, d):
    return R.single_vs_multi(_act(spark, d)).withColumns({c: F.round(c, 6) for c in ("multi_pct", "omitted_pct")})


@query(sql("z", ACT + " SELECT period, active AS combination, count(*) AS months FROM acts GROUP BY 1, 2"))
def regime_combinations(spark, d):
    return R.combinations(_act(spark, d))


@query(sql("z", ACT + """, c1 AS (SELECT 'most active' AS rule, * FROM acts WHERE n_active >= 2 ORDER BY n_active DESC, month LIMIT 1), c2 AS (SELECT 'strongest' AS rule, * FROM acts WHERE month NOT IN (SELECT month FROM c1) ORDER BY max_z DESC, month LIMIT 1),
 c3 AS (SELECT 'omitted' AS rule, * FROM acts WHERE n_omitted > 0 AND month NOT IN (SELECT month FROM c1 UNION SELECT month FROM c2) ORDER BY n_omitted DESC, max_z, month LIMIT 1), c4 AS (SELECT 'quiet' AS rule, * FROM acts WHERE n_active = 0 AND month NOT IN (SELECT month FROM c1 UNION SELECT month FROM c2 UNION SELECT month FROM c3) ORDER BY max_z, month LIMIT 1)
 SELECT rule, month, hurdle, active FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3 UNION ALL FROM c4)"""))
def case_selection_rules(spark, d):
    """Four months by four rules in turn: a row for each rule is the operator."""
    one = F.lit(True)
    return R.select_cases(_act(spark, d), [("most active", F.col("n_active") >= 2, [F.desc("n_active")]), ("strongest", one, [F.desc("max_z")]), ("omitted", F.col("n_omitted") > 0, [F.desc("n_omitted"), F.col("max_z")]), ("quiet", F.col("n_active") == 0, [F.col("max_z")])])


NOT = " AND month NOT IN (SELECT month FROM c{0})"
BEST = "ORDER BY second_z DESC, sum_active_z DESC, month LIMIT 1)"


@query(sql("z", ACT + ", runner AS (SELECT month, max(z) FILTER (r = 2) AS second_z, sum(z) FILTER (z >= 0.5) AS sum_active_z FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY z DESC, regime) AS r FROM z WHERE z IS NOT NULL) GROUP BY 1), several AS (SELECT * FROM acts LEFT JOIN runner USING (month) WHERE n_active >= 2), common_pair AS (SELECT active FROM several WHERE n_active = 2 GROUP BY 1 ORDER BY count(*) DESC, active LIMIT 1)"
    + ", c1 AS (SELECT 'three' AS rule, * FROM several WHERE n_active = 3 " + BEST + ", c2 AS (SELECT 'pair' AS rule, * FROM several WHERE active = 'urgent;high'" + NOT.format(1) + " " + BEST + ", c3 AS (SELECT 'frequent pair' AS rule, * FROM several WHERE period = 'Train' AND active IN (SELECT active FROM common_pair)" + NOT.format(1) + NOT.format(2) + " " + BEST
    + ", c4 AS (SELECT 'evaluation' AS rule, * FROM several WHERE period = 'Eval'" + "".join(map(NOT.format, (1, 2, 3))) + " " + BEST + ", c5 AS (SELECT 'other combination' AS rule, * FROM several WHERE period = 'Eval' AND active NOT IN (SELECT active FROM c4)" + "".join(map(NOT.format, (1, 2, 3, 4))) + " " + BEST
    + " SELECT rule, month, hurdle, active FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3 UNION ALL FROM c4 UNION ALL FROM c5)"))
def case_months(spark, d):
    """Five months by the published kinds of rule: three regimes at once, a given pair, the most frequent pair in training, evaluation, evaluation with another combination; the largest second z first."""
    a = R.with_runner_up(_act(spark, d), R.regime_zscores(shares(spark, d))).filter("n_active >= 2")
    order = [F.desc("second_z"), F.desc("sum_active_z")]
    late = F.col("period") == "Eval"
    return R.select_cases(a, [("three", F.col("n_active") == 3, order), ("pair", F.col("active") == "urgent;high", order), ("frequent pair", (F.col("period") == "Train") & F.col("frequent"), order), ("evaluation", late, order), ("other combination", late, order, "evaluation")])


EVID = ", " + CLAIMS + ", e AS (SELECT doc_id, month, domain, count(*) AS n FROM tokens JOIN claims USING (term) GROUP BY 1, 2, 3), s AS (SELECT doc_id, month, sum(n) FILTER (domain = 'thermal') / sum(n) AS a, sum(n) FILTER (domain = 'motion') / sum(n) AS b FROM e GROUP BY 1, 2)"


@query(sql("tokens", EVID + " SELECT month, doc_id, round(least(a, b), 6) AS both_share, rank FROM (SELECT month, doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, row_number() OVER (PARTITION BY month ORDER BY round(least(coalesce(a, 0), coalesce(b, 0)), 12) DESC, doc_id) AS rank FROM s) WHERE rank <= 2"))
def compound_top_articles(spark, d):
    """Each month's two documents that carry two domains most evenly: min of both shares."""
    c = corpus(spark, d)
    e = exploded(c).join(_claims(spark, c), "term").groupBy("doc_id", "month").pivot("domain", ["thermal", "motion", "place", "other"]).agg(F.count(F.lit(1)))
    total = F.coalesce("thermal", F.lit(0)) + F.coalesce("motion", F.lit(0)) + F.coalesce("place", F.lit(0)) + F.coalesce("other", F.lit(0))
    s = e.withColumn("both", F.least(F.coalesce("thermal", F.lit(0)) / total, F.coalesce("motion", F.lit(0)) / total))
    return first_by_rank(s, ["month"], [F.desc(F.round("both", 12)), F.col("doc_id")], 2).select("month", "doc_id", F.round("both", 6).alias("both_share"), "rank")


@query(sql("tokens", EVID + " SELECT doc_id, domain AS top_domain, round(n / total, 6) AS share FROM (SELECT doc_id, domain, n, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, domain) AS r FROM e) WHERE r = 1"))
def article_top_domain(spark, d):
    """Each document's domain with most claimed terms."""
    c = corpus(spark, d)
    e = exploded(c).join(_claims(spark, c), "term").groupBy("doc_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    g = e.groupBy("doc_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("low"), "domain")).alias("best"))
    return g.select("doc_id", F.col("best.domain").alias("top_domain"), F.round(-F.col("best.low") / F.col("total"), 6).alias("share"))
