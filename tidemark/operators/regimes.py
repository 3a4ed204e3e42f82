"""Dictionary mapping of topics to regimes, and regimes over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import joined_or_none, labelled, ratio, signed
from tidemark.operators.windows import first_by_rank, train_zscore


def domain_pairs(spark: SparkSession, dictionary: dict[str, dict[str, list[str]]]) -> DataFrame:
    """keyword, domain, grp, domain_rank: each keyword once per domain (its first group); domains in the dictionary's order."""
    rows, seen = [], set()
    for rank, (domain, groups) in enumerate(dictionary.items()):
        for group, keywords in groups.items():
            for k in keywords:
                if (domain, k) not in seen:
                    seen.add((domain, k))
                    rows.append((k, domain, group, rank))
    return spark.createDataFrame(rows, "keyword string, domain string, grp string, domain_rank int")


def merge_keyword_sets(keywords: DataFrame, regime: str, group: str, rank: str, keyword: str, cap: int = 20) -> DataFrame:
    """regime, keyword, position: the keywords of a regime's groups, each once, in the order of groups and ranks; a regime with more than ``cap`` raises."""
    first = keywords.groupBy(regime, keyword).agg(F.min(F.struct(group, rank)).alias("at"))
    sets = first.groupBy(regime).agg(F.array_sort(F.collect_list(F.struct("at", keyword))).alias("k"))  # bounded by the cap, or an error
    too_many = F.raise_error(F.concat(F.col(regime).cast("string"), F.lit(": "), F.size("k").cast("string"), F.lit(f" keywords; the cap is {cap}")))
    kept = sets.select(regime, F.when(F.size("k") <= cap, F.col("k")).otherwise(too_many.cast(sets.schema["k"].dataType)).alias("k"))
    return kept.select(regime, F.posexplode("k").alias("position", "one")).select(regime, F.col(f"one.{keyword}").alias(keyword), F.col("position").cast("long").alias("position"))


def claim_terms(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """term, keyword, domain, grp: the keyword that claims each term.

    A keyword claims a term it equals or, from two letters on, stands in; the longest wins, then
    the domain's order, then the keyword. Terms are cut into their parts of the keywords' lengths, so keywords
    are looked up, not tried one by one; the dictionary is small by construction and broadcast."""
    lengths = [r[0] for r in pairs.select(F.length("keyword")).distinct().collect()]  # a few
    cut = lambda n: F.when(F.length("term") >= n, F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring(F.col("term"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.flatten(F.array(F.array("term"), *[cut(n) for n in lengths if n >= 2])))
    found = terms.select("term", F.explode(parts).alias("keyword")).join(F.broadcast(pairs), "keyword")
    best = F.min(F.struct((-F.length("keyword")).alias("len"), "domain_rank", "keyword", "domain", "grp")).alias("b")
    return found.groupBy("term").agg(best).select("term", "b.keyword", "b.domain", "b.grp")


def map_topics(weights: DataFrame, claims: DataFrame, min_share: float = 0.01, tie: float = 0.90) -> DataFrame:
    """One row per topic: masses of best and second domain, share, ratio, confidence, status.

    residual: no mass, or the best share not above ``min_share``; ambiguous: second/best from
    ``tie`` on; else assigned. A topic without weight has divisor 1."""
    total = weights.groupBy("topic").agg(F.sum("weight").alias("total"))
    mass = weights.join(claims.select("term", "domain"), "term").groupBy("topic", "domain").agg(F.sum("weight").alias("mass"))
    top = first_by_rank(mass, ["topic"], [F.desc("mass"), F.col("domain")], 2)
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = top.groupBy("topic").agg(pick("domain", 1).alias("best"), pick("mass", 1).alias("best_mass"), pick("domain", 2).alias("second"), pick("mass", 2).alias("second_mass"))
    out = total.join(two, "topic", "left").withColumns({"best_mass": F.coalesce("best_mass", F.lit(0.0)), "second_mass": F.coalesce("second_mass", F.lit(0.0))})
    share = F.col("best_mass") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    mass_ratio = F.when(F.col("best_mass") > 0, F.col("second_mass") / F.col("best_mass")).otherwise(F.lit(1.0))
    status = F.when((F.col("best_mass") <= 0) | (share <= min_share), "residual").when(mass_ratio >= tie, "ambiguous").otherwise("assigned")
    return out.select("topic", "best", "best_mass", share.alias("best_share"), "second", "second_mass", mass_ratio.alias("mass_ratio"), (1 - mass_ratio).alias("confidence"), status.alias("status"))


def map_topics_again(weights: DataFrame, pairs: DataFrame, min_share: float = 0.01, tie: float = 0.90) -> DataFrame:
    """topic, status, domain, best_mass by a second rule of its own, in SQL: to hold ``map_topics`` against.

    The dictionary becomes one list in the order of precedence; each term looks for the first entry that stands in it,
    and a topic's masses are sorted as a list, where equal masses go by the domain's name."""
    ordered = pairs.agg(F.sort_array(F.collect_list(F.struct((-F.length("keyword")).alias("n"), "domain_rank", "keyword", "domain"))).alias("dictionary"))
    return weights.sparkSession.sql(
        """WITH owned AS (SELECT topic, weight, get(filter(dictionary, k -> k.keyword = term OR (length(k.keyword) >= 2 AND contains(term, k.keyword))), 0).domain AS domain FROM {w} CROSS JOIN {d}),
        sums AS (SELECT topic, domain, sum(weight) AS mass FROM owned GROUP BY topic, domain),
        lists AS (SELECT topic, sum(mass) AS total, array_sort(collect_list(CASE WHEN domain IS NOT NULL THEN named_struct('low', -mass, 'domain', domain) END)) AS m FROM sums GROUP BY topic),
        two AS (SELECT topic, total, coalesce(-get(m, 0).low, 0D) AS best_mass, coalesce(-get(m, 1).low, 0D) AS next_mass, get(m, 0).domain AS best FROM lists),
        said AS (SELECT topic, best, best_mass, CASE WHEN best_mass <= 0 OR best_mass <= {least} * total THEN 'residual' WHEN next_mass >= {tie} * best_mass THEN 'ambiguous' ELSE 'assigned' END AS status FROM two)
        SELECT topic, status, CASE WHEN status = 'assigned' THEN best END AS domain, best_mass FROM said""",
        w=weights, d=ordered, least=min_share, tie=tie)


def permuted(weights: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Copies of a basis with its topics renumbered at random, as (struct of copy and number as topic, term, weight), and which topic each number stands for."""
    topics = weights.select(F.col("topic").alias("own")).distinct()
    each = topics.select("own", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    order = Window.partitionBy("copy").orderBy(F.md5(F.concat_ws("-", F.col("copy"), F.col("own").cast("string"))), "own")  # a few topics
    names = each.withColumn("number", F.row_number().over(order))
    moved = weights.withColumnRenamed("topic", "own").join(F.broadcast(names), "own").select(F.struct("copy", "number").alias("topic"), "term", "weight")
    return moved, names


def equivariance(weights: DataFrame, claims: DataFrame, copies: int = 5) -> DataFrame:
    """copy, topics, changed: how many topics have another status or domain after a renumbering, all copies mapped at once and brought back."""
    moved, names = permuted(weights, copies)
    said = F.when(F.col("status") == "assigned", F.col("best"))
    base = map_topics(weights, claims).select(F.col("topic").alias("own"), F.col("status").alias("own_status"), said.alias("own_domain"))
    back = map_topics(moved, claims).select("topic.*", "status", said.alias("domain")).join(F.broadcast(names), ["copy", "number"]).join(F.broadcast(base), "own")
    changed = ~(F.col("status").eqNullSafe(F.col("own_status")) & F.col("domain").eqNullSafe(F.col("own_domain")))
    return back.groupBy("copy").agg(F.count(F.lit(1)).alias("topics"), F.count_if(changed).alias("changed"))


def dominant_group(weights: DataFrame, claims: DataFrame) -> DataFrame:
    """The dictionary group with most mass in each topic; ties by name."""
    g = weights.join(claims.select("term", "grp"), "term").groupBy("topic", "grp").agg(F.sum("weight").alias("mass"))
    return first_by_rank(g, ["topic"], [F.desc("mass"), F.col("grp")]).select("topic", F.col("grp").alias("dominant_group"), F.col("mass").alias("group_mass"))


def domain_support(mapping: DataFrame, groups: DataFrame, domains: DataFrame, special: dict[str, str] | None = None) -> DataFrame:
    """Per domain: assigned topics, their dominant groups, and its status; ``special`` names a domain's group that alone is only partial support."""
    a = mapping.filter("status = 'assigned'").join(groups, "topic", "left").groupBy(F.col("best").alias("domain")).agg(F.count(F.lit(1)).alias("topics"), F.array_sort(F.collect_set("dominant_group")).alias("groups"))
    out = domains.join(a, "domain", "left").withColumn("topics", F.coalesce("topics", F.lit(0).cast("long")))
    status = F.when(F.col("topics") == 0, "unsupported")
    for domain, group in (special or {}).items():
        status = status.when((F.col("domain") == domain) & (F.col("groups") == F.array(F.lit(group))), f"{group} only")
    return out.select("domain", "topics", F.coalesce(F.array_join("groups", ";"), F.lit("")).alias("groups"), status.otherwise("supported").alias("support"))


def mapped_runs(weights: DataFrame, claims: DataFrame, matched: DataFrame) -> DataFrame:
    """All runs' topics mapped in one table, with the base topic each matches: run, topic, base_topic, cosine, status, domain (null unless assigned), best_share.

    A topic without any weight is residual."""
    both = weights.select(F.struct("run", "topic").alias("topic"), "term", "weight")
    m = map_topics(both, claims).select("topic.*", "status", F.when(F.col("status") == "assigned", F.col("best")).alias("domain"), "best_share")
    return matched.join(m, ["run", "topic"], "left").withColumn("status", F.coalesce("status", F.lit("residual")))


def _kinds(kinds: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("run"))


def reproduction(mapped: DataFrame, kinds: dict[int, str], base: int = 0) -> DataFrame:
    """For each base topic and kind of run: runs, the shares in which its match has its status, its domain and both, and the mean cosine of the matches."""
    b = mapped.filter(F.col("run") == base).select("base_topic", F.col("status").alias("base_status"), F.col("domain").alias("base_domain"))
    j = mapped.filter(F.col("run") != base).withColumn("kind", _kinds(kinds)).join(F.broadcast(b), "base_topic")  # a few topics
    status, domain = F.col("status") == F.col("base_status"), F.col("domain").eqNullSafe(F.col("base_domain"))
    rate = lambda c: F.avg(c.cast("double"))
    return j.groupBy("base_topic", "base_status", "base_domain", "kind").agg(F.count(F.lit(1)).alias("runs"), rate(status).alias("status_rate"), rate(domain).alias("domain_rate"), rate(status & domain).alias("reproduced_rate"), F.avg("cosine").alias("mean_cosine"))


def regimes_formed(mapped: DataFrame, kinds: dict[int, str], base: int = 0) -> DataFrame:
    """For each run: assigned topics, the regimes they form, and how many of the base's are among them."""
    g = mapped.groupBy("run").agg(F.count_if(F.col("status") == "assigned").alias("assigned"), F.array_sort(F.collect_set("domain")).alias("domains"))
    own = g.filter(F.col("run") == base).select(F.col("domains").alias("base_domains"))
    j = g.crossJoin(F.broadcast(own))
    return j.select("run", _kinds(kinds).alias("kind"), "assigned", F.size("domains").cast("long").alias("formed"), joined_or_none(F.col("domains")).alias("regimes"), F.size(F.array_intersect("domains", "base_domains")).cast("long").alias("reproduced"), F.size("base_domains").cast("long").alias("of_base"))


def regime_panel(topic_shares: DataFrame, mapping: DataFrame) -> DataFrame:
    """month, period, regime, share: assigned topics summed by regime, all others as ``residual``; shares of a month sum to 1."""
    m = mapping.select("topic", F.when(F.col("status") == "assigned", F.col("best")).otherwise("residual").alias("regime"))
    return topic_shares.join(F.broadcast(m), "topic").groupBy("month", "period", "regime").agg(F.sum("share").alias("share"))


def regime_zscores(shares: DataFrame) -> DataFrame:
    """z of each regime's share with the training months' mean and deviation."""
    return shares.withColumn("z", train_zscore(F.col("share"), F.col("period") == "Train", ["regime"]))


def activation(z: DataFrame, regimes: list[str], threshold: float = 0.5) -> DataFrame:
    """Per month: the plain argmax, the argmax over the hurdle (else none), all active regimes and those the hurdle argmax omits.

    Ties go to the first regime in the given order; a null z is never active."""
    order = F.array_position(F.array(*map(F.lit, regimes)), F.col("regime"))
    rows = z.withColumn("pos", order).filter(F.col("z").isNotNull() & (F.col("pos") > 0))
    best = F.min(F.struct((-F.col("z")).alias("low"), "pos", "regime")).alias("best")
    active = F.array_sort(F.collect_list(F.when(F.col("z") >= threshold, F.struct("pos", "regime")))).getField("regime").alias("active")
    g = rows.groupBy("month", "period").agg(best, active)
    hurdle = F.when(-F.col("best.low") >= threshold, F.col("best.regime"))
    omitted = F.filter("active", lambda r: ~r.eqNullSafe(F.coalesce(hurdle, F.lit(""))))
    return g.select("month", "period", F.col("best.regime").alias("argmax"), (-F.col("best.low")).alias("max_z"), F.coalesce(hurdle, F.lit("none")).alias("hurdle"), F.size("active").cast("long").alias("n_active"), joined_or_none(F.col("active")).alias("active"), F.size(omitted).cast("long").alias("n_omitted"), joined_or_none(omitted).alias("omitted"))


def active_labels(z: DataFrame, act: DataFrame, regimes: list[str], threshold: float = 0.5) -> DataFrame:
    """month, argmax, active and omitted regimes with their z as text, in the given order."""
    order = F.array_position(F.array(*map(F.lit, regimes)), F.col("regime"))
    on = F.when(F.col("z") >= threshold, F.struct(order.alias("pos"), F.col("regime").alias("name"), "z"))
    g = z.groupBy("month").agg(F.array_sort(F.collect_list(on)).alias("on")).join(act.select("month", "argmax", "max_z", "hurdle"), "month")
    others = F.filter("on", lambda p: p["name"] != F.col("hurdle"))
    return g.select("month", F.concat("argmax", F.lit("(z="), signed(F.col("max_z")), F.lit(")")).alias("top"), labelled(F.col("on")).alias("active"), labelled(others).alias("omitted"))


def overlapping_splits(period: Column) -> Column:
    """Rows count for the whole and for their own period."""
    return F.explode(F.array(F.lit("Full"), period))


def single_vs_multi(act: DataFrame) -> DataFrame:
    """Per split: months, months with several active regimes, active and omitted regimes and their shares in percent."""
    g = act.withColumn("split", overlapping_splits(F.col("period"))).groupBy("split").agg(
        F.count(F.lit(1)).alias("months"), F.count_if(F.col("n_active") >= 2).alias("multi"), F.count_if(F.col("n_active") == 0).alias("inactive"), F.sum("n_active").alias("active"), F.sum("n_omitted").alias("omitted"))
    return g.select("*", (100 * ratio(F.col("multi"), F.col("months"))).alias("multi_pct"), (100 * ratio(F.col("omitted"), F.col("active"))).alias("omitted_pct"))


def agreement(base: DataFrame, other: DataFrame, regimes: list[str], threshold: float = 0.5) -> DataFrame:
    """How far two panels of z scores activate alike, per split, in percent: single cells, the strongest regime, several at once."""
    on = lambda z: F.coalesce(F.col(z) >= threshold, F.lit(False))
    known = F.col("regime").isin(list(regimes))
    cells = base.filter(known).select("month", "period", "regime", F.col("z").alias("__a")).join(other.select("month", "regime", F.col("z").alias("__b")), ["month", "regime"])
    cells = cells.groupBy("month", "period").agg(F.count(F.lit(1)).alias("cells"), F.count_if(on("__a") == on("__b")).alias("same"))
    a, b = (activation(z, regimes, threshold).select("month", F.col("argmax").alias(f"top_{n}"), (F.col("n_active") >= 2).alias(f"multi_{n}")) for n, z in (("a", base), ("b", other)))
    j = cells.join(a, "month").join(b, "month").withColumn("split", overlapping_splits(F.col("period")))
    g = j.groupBy("split").agg(F.count(F.lit(1)).alias("months"), F.sum("cells").alias("cells"), F.sum("same").alias("same"), F.count_if(F.col("top_a") == F.col("top_b")).alias("top"), F.count_if(F.col("multi_a") == F.col("multi_b")).alias("multi"))
    return g.select("split", "months", "cells", (100 * ratio(F.col("same"), F.col("cells"))).alias("cell_pct"), (100 * ratio(F.col("top"), F.col("months"))).alias("argmax_pct"), (100 * ratio(F.col("multi"), F.col("months"))).alias("multi_pct"))


def combinations(act: DataFrame) -> DataFrame:
    return act.groupBy("period", F.col("active").alias("combination")).agg(F.count(F.lit(1)).alias("months"))


def with_runner_up(act: DataFrame, z: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Activations with the second largest z of the month, the sum of the active ones, and whether the month's combination is the most frequent pair (ties by name)."""
    ranked = first_by_rank(z.filter(F.col("z").isNotNull()), ["month"], [F.desc("z"), F.col("regime")], 2).groupBy("month").agg(F.max(F.when(F.col("rank") == 2, F.col("z"))).alias("second_z"))
    total = z.groupBy("month").agg(F.sum(F.when(F.col("z") >= threshold, F.col("z"))).alias("sum_active_z"))
    top = act.filter("n_active = 2").groupBy("active").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "active").limit(1).select("active", F.lit(True).alias("frequent"))
    out = act.join(ranked, "month", "left").join(total, "month", "left").join(F.broadcast(top), "active", "left")
    return out.withColumn("frequent", F.coalesce("frequent", F.lit(False)))


def select_cases(act: DataFrame, rules: list[tuple]) -> DataFrame:
    """One month for each rule in turn, by the rule's filter and order, never one already chosen. At most one row per rule.

    A rule is (name, filter, order) or (name, filter, order, earlier rule whose combination it may not repeat). Each
    choice, a single row, is taken to the driver, so later rules don't compute it again."""
    picked: list = []
    for name, keep, order, *other in rules:
        rest = act.filter(keep & ~F.col("month").isin([r["month"] for r in picked]))
        if other:
            rest = rest.filter(~F.col("active").isin([r["active"] for r in picked if r["rule"] == other[0]]))
        picked += rest.orderBy(*order, "month").limit(1).select(F.lit(name).alias("rule"), "month", "hurdle", "active").collect()
    return act.sparkSession.createDataFrame(picked, "rule string, month string, hurdle string, active string")
