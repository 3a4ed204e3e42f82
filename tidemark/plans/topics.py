"""Topic model queries; results depend on numerical optimisation, so tests hold invariants instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import MAX_DF_RATIO, N_TOPICS, NMF_MAX_ITER, PER_MONTH_SAMPLE, TOP_N_VOCAB
from tidemark.functions.scalar import hash_order
from tidemark.operators import regimes as R
from tidemark.operators import text as T
from tidemark.operators import topics as M
from tidemark.operators.windows import first_by_rank
from tidemark.plans.base import corpus, docs, exploded
from tidemark.plans.corpus import varying_terms
from tidemark.plans.regimes import DICTIONARY
from tidemark.tables import stored

Q, O = {}, {}
#: Least document frequency: the driver's corpora are smaller than the published one's 200.
LEAST_DF = 5


def query(f):
    Q[f.__name__] = f
    return f


def _fitted(spark, d, chosen):
    """The corpus, the vocabulary of all training documents, and a function from a part of the corpus to its rows of weights, inverse document frequencies from ``chosen`` alone (a sample's ids, at most PER_MONTH_SAMPLE a month, so they are broadcast and the corpus isn't shuffled)."""
    c = corpus(spark, d)
    train = c.filter("period = 'Train'")
    vocab = stored(T.vocabulary(exploded(train), train.count(), LEAST_DF, MAX_DF_RATIO, TOP_N_VOCAB), "vocabulary")
    df = T.document_frequency(exploded(c.join(F.broadcast(chosen), "doc_id", "left_semi")))
    fit = stored(vocab.select("term", "idx").join(df, "term", "left").select("term", "idx", F.coalesce("df", F.lit(0)).alias("df")), "frequencies")
    n_fit = chosen.count()
    return c, vocab, lambda part, keep=(): T.tfidf_rows(part, fit, n_fit, keep)


def _sample(spark, d):
    """The published number of training documents a month, by hash."""
    chosen = first_by_rank(docs(spark, d).filter("period = 'Train'").select("doc_id", "month"), ["month"], [hash_order(F.col("doc_id")), F.col("doc_id")], PER_MONTH_SAMPLE)
    return stored(chosen.select("doc_id"), "sample")


def _prepared(spark, d):
    """Corpus, vocabulary and its size, the function that makes rows of weights, and the sample's rows, stored: of other documents no row is made before it is asked for."""
    chosen = _sample(spark, d)
    c, vocab, rows = _fitted(spark, d, chosen)
    return c, vocab, vocab.count(), rows, stored(rows(c.join(F.broadcast(chosen), "doc_id", "left_semi")), "rows")


@query
def nmf_topics(spark, d):
    """Monthly topic shares of all documents under a basis fitted on the training sample."""
    c, _, terms, rows, sample = _prepared(spark, d)
    shares = M.transform(rows(c), M.fit_nmf(sample, terms, N_TOPICS, NMF_MAX_ITER))
    return M.mean_shares(docs(spark, d).select("doc_id", "month").join(shares, "doc_id", "left"), "month", N_TOPICS)


@query
def nmf_top_terms(spark, d):
    """The 25 heaviest terms of each topic, ties by index: a report of fixed length."""
    _, vocab, terms, _, sample = _prepared(spark, d)
    model = M.fit_nmf(sample, terms, N_TOPICS, NMF_MAX_ITER)
    return first_by_rank(model.table(spark, vocab), ["topic"], [F.desc("weight"), F.col("idx")], 25)


def _lda(spark, d):
    """The model, and all documents' topics and bounds under it with their period."""
    c, _, terms, rows, sample = _prepared(spark, d)
    model = M.fit_lda(sample, terms, N_TOPICS, 10)
    return model, M.lda_documents(rows(c, ["period"]), model, ["doc_id", "period"])


@query
def lda_topics(spark, d):
    """Topic shares by online LDA on binary counts."""
    return _lda(spark, d)[1].select("doc_id", "topics")


@query
def lda_perplexity(spark, d):
    """Bound on the perplexity of a word, for training and evaluation documents apart."""
    import math

    model, documents = _lda(spark, d)
    bounds = M.lda_log_perplexity(documents, model, "period")
    bounds = [(p, bounds.get(p, math.inf)) for p in ("Train", "Eval")]
    return spark.createDataFrame([(p, float(b), math.exp(min(b, 700.0))) for p, b in bounds], "period string, log_perplexity double, perplexity double")


@query
def topic_stability(spark, d):
    """Ten subsamples and eleven other starts (one with filled zeros, five with random fillings, five random) at the published size, matched with the base and within their kind."""
    _, _, terms, _, sample = _prepared(spark, d)
    return M.stability(sample, terms, N_TOPICS, M.study_runs(), max_iter=NMF_MAX_ITER)


def _mapped_study(spark, d):
    """Runs of the study with every topic's mapping and the base topic it matches; and the base's mapping."""
    _, vocab, terms, _, sample = _prepared(spark, d)
    runs = M.study_runs()
    weights, matched = M.bases_table(spark, M.fit_study(sample, terms, N_TOPICS, runs, max_iter=NMF_MAX_ITER), vocab)
    weights = stored(weights, "bases")
    claims = stored(R.claim_terms(vocab.select("term"), R.domain_pairs(spark, DICTIONARY)), "claims")
    return runs, R.mapped_runs(weights, claims, matched)


@query
def mapping_reproduction(spark, d):
    """How often each base topic's status and domain come back, by kind of run."""
    runs, mapped = _mapped_study(spark, d)
    return R.reproduction(mapped, {r: kind for r, (kind, _, _) in enumerate(runs)})


@query
def regimes_reproduced(spark, d):
    """How many of the base's regimes each run forms, and which."""
    runs, mapped = _mapped_study(spark, d)
    return R.regimes_formed(mapped, {r: kind for r, (kind, _, _) in enumerate(runs)})


@query
def nmf_convergence(spark, d):
    """One fit at 400, 800 and 1200 iterations, and at 1600 and 2400 where it hasn't converged by then; every two against each other."""
    _, _, terms, _, sample = _prepared(spark, d)
    return M.convergence(sample, terms, N_TOPICS, [400, 800, 1200], [1600, 2400])


@query
def exploratory_topics(spark, d):
    """First documents of each month instead of a random sample; raw weights are averaged before they are normalised."""
    first = stored(first_by_rank(docs(spark, d).select("doc_id", "month"), ["month"], [F.col("doc_id")], PER_MONTH_SAMPLE).select("doc_id", "month"), "sample")
    c, vocab, rows = _fitted(spark, d, first.select("doc_id"))
    part = stored(rows(c.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi")), "rows")
    weights = M.transform(part, M.fit_nmf(part, vocab.count(), N_TOPICS, NMF_MAX_ITER), raw=True)
    return M.mean_shares(first.join(weights, "doc_id", "left"), "month", N_TOPICS)


@query
def keyword_clusters(spark, d):
    """Twelve clusters of the terms whose monthly share varies, by their movement; at most the capped vocabulary's terms."""
    varying, n, matrix = varying_terms(corpus(spark, d))
    grid = varying.select("term").crossJoin(F.broadcast(n)).join(matrix, ["term", "month"], "left")  # capped terms by calendar months
    return M.keyword_clusters(grid.select("term", "month", (F.coalesce("df", F.lit(0)) / F.col("n")).alias("share")), 12)
