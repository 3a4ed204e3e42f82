"""Corpus queries: cleaning, deduplication, counts, vocabulary, TF-IDF, samples, coherence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import STOP_WORDS, category_root, clip, hash_order, month_key, ratio, strip_all, typed_kind, words
from tidemark.operators import text as T
from tidemark.operators.windows import first_by_rank
from tidemark.config import KEYWORD_TERMS, TOP_N_VOCAB
from tidemark.plans.base import corpus, docs, exploded, sql, table
from tidemark.tables import stored

Q, O = {}, {}


def query(oracle=None):
    """Register a query under its function's name."""

    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


@query(sql("docs", "SELECT month, count(*) AS n, count(DISTINCT source) AS sources FROM docs GROUP BY 1"))
def corpus_month_counts(spark, d):
    return docs(spark, d).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query(sql("docs", "SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM docs WHERE length(trim(text)) > 0 GROUP BY 1"))
def corpus_dedup_first(spark, d):
    """First seen of equal texts; one aggregation, so a group of copies is summed before the shuffle."""
    kept = docs(spark, d).filter(F.length(F.trim("text")) > 0)
    return kept.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.min(F.struct("doc_id", "source")).alias("first"), F.count(F.lit(1)).alias("copies")).select("key", "first.*", "copies")


@query(sql("docs", """SELECT count(*) AS raw, count(*) FILTER (in_range) AS in_range, count(*) FILTER (in_range AND NOT excluded) AS not_excluded,
 count(*) FILTER (in_range AND NOT excluded AND filled) AS filled, count(DISTINCT CASE WHEN in_range AND NOT excluded AND filled THEN md5(text) END) AS unique_texts
 FROM (SELECT *, coalesce(month BETWEEN '2021-03' AND '2026-03', false) AS in_range, contains(text, '@') OR contains(text, '###') AS excluded, length(trim(text)) > 0 AS filled FROM docs)"""))
def corpus_stage_counters(spark, d):
    """Rows left after each stage, in the order that matters: range, exclusion, empty, duplicates."""
    return T.stage_counters(docs(spark, d), [("in_range", F.coalesce(F.col("month").between("2021-03", "2026-03"), F.lit(False))), ("not_excluded", ~(F.col("text").contains("@") | F.col("text").contains("###"))), ("filled", F.length(F.trim("text")) > 0)], F.md5(F.col("text").cast("binary")), "unique_texts")


@query("""SELECT split_part(p_type, ' ', 1) AS root, count(*) AS n, count(*) FILTER (contains(p_type, 'BRASS')) AS brass, count(*) FILTER (length(p_name) >= 12) AS long_names, count(*) = 20000 AS capped FROM part GROUP BY 1""")
def category_root_flags(spark, d):
    part = table(spark, d, "part").withColumn("root", category_root(F.col("p_type"), " "))
    return part.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_type").contains("BRASS")).alias("brass"), F.count_if(F.length("p_name") >= 12).alias("long_names"), (F.count(F.lit(1)) == 20000).alias("capped"))


@query(sql("tokens", "SELECT term, count(*) AS df, round(count(*) / (SELECT count(*) FROM docs), 6) AS ratio FROM tokens GROUP BY 1"))
def token_df_ratio(spark, d):
    c = corpus(spark, d)
    return T.document_frequency(exploded(c)).select("term", "df", F.round(F.col("df") / c.count(), 6).alias("ratio"))


#: The model's vocabulary and, in the same order, the keyword study's.
VOCAB = f"SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS idx FROM (SELECT term, count(*) AS df FROM tokens WHERE period = 'Train' GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.15 * (SELECT count(*) FROM docs WHERE period = 'Train')) QUALIFY idx < {TOP_N_VOCAB}"
KEYWORDS = VOCAB.replace(f"idx < {TOP_N_VOCAB}", f"idx < {KEYWORD_TERMS}")


def vocabulary(c, top=TOP_N_VOCAB):
    """The training vocabulary of a stored corpus, stored too: at most ``top`` terms."""
    train = c.filter("period = 'Train'")
    return stored(T.vocabulary(exploded(train), train.count(), 5, 0.15, top), "vocabulary")


@query(sql("tokens", VOCAB))
def vocab_train_top(spark, d):
    return vocabulary(corpus(spark, d))


def _by_month(c):
    """In how many documents of a month each term of the keyword study stands."""
    return exploded(c).join(vocabulary(c, KEYWORD_TERMS).select("term"), "term").groupBy("month", "term").agg(F.count(F.lit(1)).alias("df"))


@query(sql("tokens", f", v AS ({KEYWORDS}) SELECT month, term, count(*) AS df FROM tokens JOIN v USING (term) GROUP BY 1, 2"))
def term_month_matrix(spark, d):
    return _by_month(corpus(spark, d))


def varying_terms(c):
    """(term, mean, cv) of the terms whose monthly share varies enough, and the month counts and document frequencies they come from."""
    n = c.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    matrix = stored(_by_month(c), "month-terms")
    return T.variation_filter(matrix, n, 0.35), n, matrix


@query(sql("tokens", f""", v AS ({KEYWORDS}), m AS (SELECT month, count(*) AS n FROM docs GROUP BY 1), c AS (SELECT month, term, count(*) AS df FROM tokens JOIN v USING (term) GROUP BY 1, 2),
 g AS (SELECT v.term, coalesce(c.df, 0) / m.n AS share FROM v CROSS JOIN m LEFT JOIN c ON c.term = v.term AND c.month = m.month)
 SELECT term, round(avg(share), 6) AS mean, round(stddev_samp(share) / avg(share), 6) AS cv FROM g GROUP BY 1 HAVING stddev_samp(share) / avg(share) >= 0.35"""))
def term_cv_filter(spark, d):
    """Terms whose monthly share varies enough; absent months count as zero."""
    return varying_terms(corpus(spark, d))[0]


@query(sql("docs", "SELECT month, doc_id, rank FROM (SELECT month, doc_id, row_number() OVER (PARTITION BY month ORDER BY md5('42-' || doc_id), doc_id) AS rank FROM docs WHERE period = 'Train') WHERE rank <= 5"))
def stratified_sample(spark, d):
    """Five documents a month: taking so many is the operator."""
    return first_by_rank(docs(spark, d).filter("period = 'Train'"), ["month"], [hash_order(F.col("doc_id")), F.col("doc_id")], 5).select("month", "doc_id", "rank")


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders) WHERE pos % 10 = 0")
def systematic_subsample(spark, d):
    """Every tenth row of the total order, by range partitions and their offsets."""
    return T.systematic_sample(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 10).select("o_orderkey", "pos")


def _long(rows):
    """A row for each cell of sparse rows."""
    return rows.select("doc_id", F.explode(F.arrays_zip("idx", "w")).alias("x")).select("doc_id", F.col("x.idx").alias("idx"), F.round("x.w", 6).alias("weight"))


@query(sql("tokens", f""", v AS ({VOCAB}), n AS (SELECT count(*) AS n FROM docs WHERE period = 'Train'), w AS (SELECT doc_id, idx, ln((1 + n.n) / (1 + df)) + 1 AS idf FROM tokens JOIN v USING (term), n)
 SELECT doc_id, idx, round(idf / sqrt(sum(idf * idf) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""))
def tfidf_long(spark, d):
    c = corpus(spark, d)
    return _long(T.tfidf_rows(c, vocabulary(c), c.filter("period = 'Train'").count()))


FIT = "f AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY month ORDER BY md5('42-' || doc_id), doc_id) AS rank FROM docs WHERE period = 'Train') WHERE rank <= 5)"


@query(sql("tokens", f""", v AS ({VOCAB}), {FIT}, n AS (SELECT count(*) AS n FROM f), c AS (SELECT term, count(*) AS fit_df FROM tokens JOIN f USING (doc_id) GROUP BY 1),
 w AS (SELECT doc_id, idx, ln((1 + n.n) / (1 + coalesce(fit_df, 0))) + 1 AS idf FROM tokens JOIN v USING (term) LEFT JOIN c USING (term), n)
 SELECT doc_id, idx, round(idf / sqrt(sum(idf * idf) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""))
def tfidf_sample_idf(spark, d):
    """TF-IDF as the topic model takes it: the vocabulary from all training documents, inverse document frequencies from the fit sample alone."""
    fit = stored(stratified_sample(spark, d).select("doc_id"), "sample")
    n = fit.count()
    c = corpus(spark, d)
    df = T.document_frequency(exploded(c).join(fit, "doc_id", "left_semi"))
    vocab = vocabulary(c).select("term", "idx").join(df, "term", "left").select("term", "idx", F.coalesce("df", F.lit(0)).alias("df"))
    return _long(T.tfidf_rows(c, vocab, n))


TOPS = "SELECT lang, term, rank FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank FROM tokens JOIN v USING (term) GROUP BY lang, term) WHERE rank <= 10"


def counts_by_lang(c):
    """In how many documents of each language each vocabulary term stands."""
    return exploded(c).join(vocabulary(c).select("term"), "term").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


def tops(c, k=10):
    """Languages play topics: their k most frequent vocabulary terms, stored."""
    return stored(first_by_rank(counts_by_lang(c), ["lang"], [F.desc("n"), F.col("term")], k).select("lang", "term", "rank", "n"), "tops")


def _pairs(c, topics):
    """How often the topics' terms stand together, counted once and stored: at most the square of their number."""
    return stored(T.cooccurrence(exploded(c), topics.select("term").distinct()), "pairs")


CO = f", v AS ({VOCAB}), t AS ({TOPS}), x AS (SELECT DISTINCT doc_id, term FROM tokens JOIN (SELECT DISTINCT term FROM t) USING (term)), co AS (SELECT a.term AS t1, b.term AS t2, count(*) AS shared FROM x a JOIN x b ON a.doc_id = b.doc_id GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM docs)"


@query(sql("tokens", CO + " SELECT t1, t2, shared FROM co WHERE t1 <= t2"))
def term_cooccurrence_top(spark, d):
    c = corpus(spark, d)
    return T.cooccurrence(exploded(c), tops(c).select("term").distinct())


PAIRS = """, p AS (SELECT a.lang, a.term AS t1, b.term AS t2, a.rank AS r1, b.rank AS r2, coalesce(co.shared, 0) AS shared, ca.shared AS n1, cb.shared AS n2, n.n FROM t a JOIN t b ON a.lang = b.lang CROSS JOIN n LEFT JOIN co ON co.t1 = a.term AND co.t2 = b.term
 JOIN co ca ON ca.t1 = a.term AND ca.t2 = a.term JOIN co cb ON cb.t1 = b.term AND cb.t2 = b.term),
 q AS (SELECT *, CASE WHEN t1 = t2 THEN 1.0 WHEN shared = 0 THEN -1.0 WHEN shared = n THEN 1.0 ELSE ln((shared / n) / ((n1 / n) * (n2 / n))) / -ln(shared / n) END AS npmi FROM p)"""


@query(sql("tokens", CO + PAIRS + " SELECT lang, round(avg(npmi) FILTER (r1 < r2), 6) AS npmi, round(avg(ln((shared + 1) / n1)) FILTER (r1 < r2), 6) AS umass FROM q GROUP BY 1"))
def coherence_npmi_umass(spark, d):
    c = corpus(spark, d)
    t = tops(c)
    return T.coherence(t, _pairs(c, t), c.count(), "lang").groupBy("lang").agg(
        F.round(F.avg(F.when(F.col("r1") < F.col("r2"), F.col("npmi"))), 6).alias("npmi"), F.round(F.avg(F.when(F.col("r1") < F.col("r2"), F.ln((F.col("shared") + 1) / F.col("n1")))), 6).alias("umass"))


@query(sql("tokens", CO + PAIRS + """, s AS (SELECT lang, t2, sum(npmi) AS total FROM q GROUP BY 1, 2), c AS (SELECT q.lang, q.t1, sum(npmi * total) / nullif(sqrt(sum(npmi * npmi)) * sqrt(sum(total * total)), 0) AS cos FROM q JOIN s ON s.lang = q.lang AND s.t2 = q.t2 GROUP BY 1, 2)
 SELECT lang, round(avg(cos), 6) AS c_v FROM c GROUP BY 1"""))
def coherence_cv(spark, d):
    """Mean cosine of each word's NPMI vector with the sum of all of them."""
    c = corpus(spark, d)
    t = tops(c)
    return T.coherence_cv(stored(T.coherence(t, _pairs(c, t), c.count(), "lang"), "npmi"), "lang").select("lang", F.round("c_v", 6).alias("c_v"))


@query(sql("tokens", f", v AS ({VOCAB}), c AS (SELECT lang, term, count(*) AS n FROM tokens JOIN v USING (term) GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, round(exp(-sum(p * ln(p))), 6) AS effective_vocab, count(*) AS terms FROM p WHERE p > 1e-15 GROUP BY 1"))
def effective_vocab_entropy(spark, d):
    counts = counts_by_lang(corpus(spark, d))
    p = counts.select("lang", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("p")).filter("p > 1e-15")
    return p.groupBy("lang").agg(F.round(F.exp(-F.sum(F.col("p") * F.ln("p"))), 6).alias("effective_vocab"), F.count(F.lit(1)).alias("terms"))


@query("""SELECT 'document' AS kind, count(*) AS n, count(*) FILTER (length(trim(text)) = 0) AS empty, count(*) FILTER (length(text) >= 200) AS cut, count(*) FILTER (contains(text, '@')) AS flagged FROM documents
 UNION ALL SELECT 'turn', count(*), count(*) FILTER (length(trim(text)) = 0), count(*) FILTER (length(text) >= 200), count(*) FILTER (contains(text, '@')) FROM conversations
 UNION ALL SELECT 'page', count(*), count(*) FILTER (length(trim(html)) = 0), count(*) FILTER (length(html) >= 200), count(*) FILTER (contains(html, '@')) FROM pages""")
def clean_strip_fill_flags(spark, d):
    """Rename, fill, strip and flag three tables alike."""
    out = None
    for kind, name, col in (("document", "documents", "text"), ("turn", "conversations", "text"), ("page", "pages", "html")):
        t = table(spark, d, name).withColumnsRenamed({col: "body"}).select(strip_all(F.col("body")).alias("clean"), F.coalesce("body", F.lit("")).alias("body"))
        one = t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("clean") == 0).alias("empty"), F.count_if(F.length("body") >= 200).alias("cut"), F.count_if(F.col("body").contains("@")).alias("flagged")).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT kind, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM (SELECT unnest(list_filter(list_transform(string_split(p_name || ',' || p_type || ',' || p_size || '%', ','), lambda x: trim(x)), lambda x: length(x) >= 2)) AS token, 'kept' AS kind FROM part) WHERE NOT regexp_full_match(token, '[0-9]+([.][0-9]+)?\\s*(일|월|년|분기|주|차|%|명|건|원|억|조)?') GROUP BY 1""")
def numeric_token_filter(spark, d):
    from tidemark.functions.scalar import keyword_tokens

    part = table(spark, d, "part").select(F.concat_ws(",", "p_name", "p_type", F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("keywords"))
    return part.select(F.explode(keyword_tokens(F.col("keywords"), dedup=False)).alias("token")).groupBy(F.lit("kept").alias("kind")).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("token").alias("distinct_tokens"))


@query(sql("docs", "SELECT period, count(*) AS n, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS without_terms FROM (SELECT period, len(list_filter(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿœß]+'), lambda x: length(x) >= 3)) > 0 AS valid FROM docs) GROUP BY 1"))
def valid_doc_counts(spark, d):
    valid = F.size(words(F.col("text"), 3)) > 0
    return docs(spark, d).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("without_terms"))


@query("SELECT conv_id, turn, role, n FROM (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS rank FROM conversations) WHERE rank = 1")
def stable_dedup_sorted(spark, d):
    """First turn of each role: one aggregation instead of a window, so long conversations are summed early."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", "role").agg(F.min(F.struct("turn", "text")).alias("first"), F.count(F.lit(1)).alias("n")).select("conv_id", "first.turn", "role", "n")


def _hash_level(inner: str, key: str, order: str) -> str:
    return f"SELECT source, {key} AS k, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY {order})) AS h FROM ({inner}) GROUP BY 1, 2"


IDS = "SELECT source, doc_id AS k, 1 AS n, CAST(doc_id AS VARCHAR) AS h FROM documents"


@query("SELECT source, CAST(n AS BIGINT) AS n, h AS ids_sha256 FROM (" + _hash_level(_hash_level(_hash_level(IDS, "k // 4096", "k"), "k // 4096", "k"), "0", "k") + ")")
def text_hash(spark, d):
    """A digest of each source's sorted ids: hashes of ranges of 4096 ids, of 4096 ranges, and of those, so no task holds all ids."""
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("k"), F.lit(1).cast("long").alias("n"), F.col("doc_id").cast("string").alias("h"))
    for key in (F.floor(F.col("k") / 4096), F.floor(F.col("k") / 4096), F.lit(0).cast("long")):
        parts = rows.groupBy("source", key.alias("range")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "h"))).alias("parts"))
        rows = parts.select("source", F.col("range").alias("k"), "n", F.sha2(F.array_join(F.col("parts.h"), "\n").cast("binary"), 256).alias("h"))
    return rows.select("source", "n", F.col("h").alias("ids_sha256"))


@query(sql("docs", ", s AS (SELECT month, doc_id, row_number() OVER (PARTITION BY month ORDER BY md5('42-' || doc_id), doc_id) AS rank FROM docs WHERE period = 'Train'), f AS (SELECT * FROM s WHERE rank <= 5), v AS (SELECT month, doc_id, row_number() OVER (PARTITION BY month ORDER BY md5('1042-' || doc_id), doc_id) AS rank FROM docs WHERE period = 'Train' AND doc_id NOT IN (SELECT doc_id FROM f)) SELECT month, doc_id, rank FROM v WHERE rank <= 2"))
def replay_sample_positions(spark, d):
    """A validation sample disjoint from the fit sample."""
    train = docs(spark, d).filter("period = 'Train'")
    rest = train.join(stratified_sample(spark, d).select("doc_id"), "doc_id", "left_anti")
    return first_by_rank(rest, ["month"], [hash_order(F.col("doc_id"), 1042), F.col("doc_id")], 2).select("month", "doc_id", "rank")


@query(sql("docs", ", t AS (SELECT doc_id, row_number() OVER (ORDER BY month, doc_id) - 1 AS position FROM docs WHERE period = 'Train'), s AS (SELECT doc_id, row_number() OVER (ORDER BY month, rank) - 1 AS place FROM (SELECT month, doc_id, row_number() OVER (PARTITION BY month ORDER BY md5('42-' || doc_id), doc_id) AS rank FROM docs WHERE period = 'Train') WHERE rank <= 5) SELECT place, doc_id, position FROM s LEFT JOIN t USING (doc_id)"))
def replay_stored_sample(spark, d):
    """The stored fit sample replayed: each of its ids, in its order, with its row position among the training documents."""
    from tidemark.operators.corpus import replay

    train = docs(spark, d).filter("period = 'Train'").select("doc_id", "month")
    chosen = stratified_sample(spark, d).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month", "rank")) - 1)  # five a month
    return replay(stored(train, "train"), stored(chosen.select("place", "doc_id"), "sample"), "doc_id", ["month", "doc_id"])


@query("SELECT event_type, user_id % 5 AS bucket, count(*) AS n, min(value) AS low, round(quantile_cont(value, 0.5), 6) AS middle, max(value) AS high FROM events GROUP BY 1, 2")
def value_counts_summary(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", (F.col("user_id") % 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("middle"), F.max("value").alias("high"))


@query("SELECT event_id, path, json_extract_string(props, '$.' || path) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events)")
def json_flatten(spark, d):
    """Every path and value of a JSON column."""
    from tidemark.sources.readers import flatten_json

    return flatten_json(table(spark, d, "events"), "event_id", "props")


@query("SELECT count(*) AS docs, count(*) FILTER (n_chars > 200) AS predicted, count(*) FILTER (n_chars > 200 AND quality = 1) AS tp, count(*) FILTER (n_chars > 200 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 200 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 200 AND quality = 0) AS tn, round(count(*) FILTER (n_chars > 200 AND quality = 1) / nullif(count(*) FILTER (n_chars > 200), 0), 6) AS precision, round(count(*) FILTER (n_chars > 200 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall FROM documents JOIN labels USING (doc_id)")
def label_confusion(spark, d):
    from tidemark.operators.stats import confusion

    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    c = confusion(j, F.col("n_chars") > 200, F.col("quality") == 1)
    return c.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("docs"), (F.col("tp") + F.col("fp")).alias("predicted"), "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


TOPS25 = TOPS.replace("rank <= 10", "rank <= 25").replace("SELECT lang, term, rank FROM (SELECT lang, term,", "SELECT lang, term, rank, n FROM (SELECT lang, term, count(*) AS n,")


@query(sql("tokens", f", v AS ({VOCAB}), t AS ({TOPS25}) SELECT a.lang AS a, b.lang AS b, count(*) FILTER (a.term = b.term) AS common, round(count(*) FILTER (a.term = b.term) / (50 - count(*) FILTER (a.term = b.term)), 6) AS jaccard FROM t a JOIN t b ON a.lang < b.lang GROUP BY 1, 2"))
def topk_jaccard(spark, d):
    """Jaccard of the top 25 terms of each pair of languages."""
    return T.topk_jaccard(tops(corpus(spark, d), 25).groupBy("lang").agg(F.collect_set("term").alias("terms")), "lang", "terms")


@query(sql("tokens", f""", v AS ({VOCAB}), c AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM tokens JOIN v USING (term) GROUP BY 1, 2), t AS (SELECT lang, term FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 25),
 l AS (SELECT a.lang AS a, b.lang AS b FROM (SELECT DISTINCT lang FROM t) a JOIN (SELECT DISTINCT lang FROM t) b ON a.lang < b.lang), u AS (SELECT DISTINCT a, b, term FROM l JOIN t ON t.lang IN (a, b)),
 g AS (SELECT u.a, u.b, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM u LEFT JOIN c x ON x.lang = u.a AND x.term = u.term LEFT JOIN c y ON y.lang = u.b AND y.term = u.term), s AS (SELECT a, b, x / sum(x) OVER w AS x, y / sum(y) OVER w AS y FROM g WINDOW w AS (PARTITION BY a, b))
 SELECT a, b, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS weighted_jaccard, count(*) AS terms FROM s GROUP BY 1, 2"""))
def weighted_jaccard(spark, d):
    """Ruzicka similarity of every two languages over the union of their top terms, weights from their full counts."""
    return T.weighted_jaccard(stored(counts_by_lang(corpus(spark, d)), "counts"), "lang", 25).withColumn("weighted_jaccard", F.round("weighted_jaccard", 6))


@query(sql("tokens", f", v AS ({VOCAB}), t AS MATERIALIZED ({TOPS25}) SELECT lang, term, 'added' AS change FROM t WHERE lang <> 'de' AND term NOT IN (SELECT term FROM t WHERE lang = 'de') UNION ALL SELECT l.lang, b.term, 'removed' FROM (SELECT DISTINCT lang FROM t WHERE lang <> 'de') l JOIN t b ON b.lang = 'de' WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.lang = l.lang AND x.term = b.term)"))
def topk_terms_diff(spark, d):
    """What each language's top terms have beyond the baseline's (German) and lack of them."""
    return T.terms_diff(tops(corpus(spark, d), 25), "lang", "de")


@query()
def html_unescape_text(spark, d):
    """Entities of pages resolved, tags dropped."""
    return T.unescape_html(table(spark, d, "pages"), "page_id", "html")


CELLS = " UNION ALL ".join(f"SELECT '{f}' AS field, {v} AS v FROM part" for f, v in (
    ("size", "CAST(p_size AS VARCHAR)"), ("part_id", "CAST(p_partkey AS VARCHAR)"), ("padded", "lpad(CAST(p_partkey AS VARCHAR), 8, '0')"), ("long", "'12345678901' || CAST(p_partkey + 10000 AS VARCHAR)"), ("brand", "p_brand"), ("price", "printf('%.2f', p_retailprice)"),
    ("signed", "'+' || CAST(p_size AS VARCHAR)"), ("power", "CAST(p_size AS VARCHAR) || 'e5'"), ("huge", "CAST(p_size AS VARCHAR) || 'e999'"), ("bare", "'.' || CAST(p_size AS VARCHAR)"), ("flag", "CASE WHEN p_size > 25 THEN 'true' ELSE '' END")))


@query(f"""SELECT field, CASE WHEN v = '' THEN 'empty' WHEN lower(field) = 'id' OR regexp_matches(lower(field), '(_id|_ids|_code|_hash|_sha256)$') THEN 'text'
 WHEN NOT regexp_full_match(v, '[+-]?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN 'text' WHEN regexp_matches(v, '[.eE]') THEN CASE WHEN isfinite(TRY_CAST(v AS DOUBLE)) THEN 'number' ELSE 'text' END
 WHEN length(ltrim(v, '+-')) <= 15 THEN 'integer' ELSE 'text' END AS kind, count(*) AS n FROM ({CELLS}) GROUP BY 1, 2""")
def typed_cells(spark, d):
    """How cells of a report are typed: padded numbers, long digits, identifiers and infinite numbers stay text."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    cells = {"size": size, "part_id": key, "padded": F.lpad(key, 8, "0"), "long": F.concat(F.lit("12345678901"), (F.col("p_partkey") + 10000).cast("string")), "brand": F.col("p_brand"), "price": F.format_string("%.2f", "p_retailprice"),
        "signed": F.concat(F.lit("+"), size), "power": F.concat(size, F.lit("e5")), "huge": F.concat(size, F.lit("e999")), "bare": F.concat(F.lit("."), size), "flag": F.when(F.col("p_size") > 25, "true").otherwise("")}
    rows = table(spark, d, "part").select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("v")) for f, v in cells.items()])).alias("c"))
    return rows.groupBy(F.col("c.field").alias("field"), typed_kind(F.col("c.v"), F.col("c.field")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


WIDE = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


@query(f"""SELECT doc_id, title, url, keywords, length(content) AS content_length, month FROM (SELECT doc_id, trim(lang) AS title, '' AS url, lang || ', x' AS keywords,
 regexp_replace(regexp_replace(coalesce(text, ''), '^{WIDE}+', ''), '{WIDE}+$', '') AS content, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE strftime(DATE '2021-01-01' + to_months(CAST(doc_id % 24 AS INTEGER)), '%Y-%m') END AS month FROM documents)""")
def clean_articles(spark, d):
    """Articles filled and stripped (ideographic and unbreakable spaces too), dates parsed or null."""
    from tidemark.operators.corpus import clean_articles as clean

    day = F.date_format(F.add_months(F.lit("2021-01-01").cast("date"), (F.col("doc_id") % 24).cast("int")), "yyyyMMdd")
    raw = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "unreadable").otherwise(day).alias("date"), "source", F.concat(F.lit("\u3000\t"), "lang", F.lit("\u00a0")).alias("title"),
        F.lit(None).cast("string").alias("url"), F.concat(F.lit(" "), "lang", F.lit(", x\u2003")).alias("keywords"), F.col("text").alias("content"), F.lit(None).cast("string").alias("features"), F.lit(None).cast("string").alias("exclude_flag"))
    return clean(raw).select("doc_id", "title", "url", "keywords", F.length("content").alias("content_length"), "month")


def _words(names):
    return ", ".join(f"'{w}'" for w in names)


@query(f"""SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_transform(string_split(k, ','), lambda x: trim(x, ' ' || chr(12288))), lambda x: length(x) >= 2 AND x NOT IN ({_words(STOP_WORDS)})
 AND NOT regexp_full_match(x, '[0-9]+([.][0-9]+)?\\s*(일|월|년|분기|주|차|%|명|건|원|억|조)?')))) AS token
 FROM (SELECT p_name || ',기자,' || p_brand || ',상반기, 금리' || chr(12288) || ',' || p_size || '일,금리,' || p_size || ' %,주주총회,' || p_size AS k FROM part)) GROUP BY 1""")
def tokens_with_stop_lists(spark, d):
    """Keyword lists to tokens: stripped, each once, without idiom, calendar words and numbers with units."""
    from tidemark.functions.scalar import keyword_tokens

    size = F.col("p_size").cast("string")
    k = F.concat(F.col("p_name"), F.lit(",기자,"), F.col("p_brand"), F.lit(",상반기, 금리\u3000,"), size, F.lit("일,금리,"), size, F.lit(" %,주주총회,"), size)
    return table(spark, d, "part").select(F.explode(keyword_tokens(k)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
