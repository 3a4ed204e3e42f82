"""Corpus operators: vocabulary, TF-IDF, co-occurrence, coherence, samples, similarity of term sets."""

from __future__ import annotations

import html.entities

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio
from tidemark.operators.windows import first_by_rank


def stage_counters(rows: DataFrame, stages: list[tuple[str, Column]], key: Column, unique: str) -> DataFrame:
    """Rows left after each filter in turn, and distinct keys among the last: one pass."""
    left, counts = F.lit(True), [F.count(F.lit(1)).alias("raw")]
    for name, keep in stages:
        left = left & keep
        counts.append(F.count_if(left).alias(name))
    return rows.agg(*counts, F.countDistinct(F.when(left, key)).alias(unique))


def document_frequency(tokens: DataFrame, by: list[str] = ()) -> DataFrame:
    """In how many documents each term stands; tokens are distinct within documents."""
    return tokens.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(train_tokens: DataFrame, n_docs: int, min_df: int, max_ratio: float, top: int) -> DataFrame:
    """term, df, idx: training terms neither rare nor common, ranked by (-df, term), capped.

    The cap bounds the frame, so the ranking window runs over at most ``top`` rows."""
    kept = document_frequency(train_tokens).filter((F.col("df") >= min_df) & (F.col("df") <= max_ratio * n_docs)).orderBy(F.desc("df"), "term").limit(top)
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "term")) - 1)


def tfidf(tokens: DataFrame, vocab: DataFrame, n_fit: int) -> DataFrame:
    """doc_id, idx, weight: binary term frequency, idf ln((1+n)/(1+df))+1, unit rows."""
    w = tokens.join(vocab, "term").select("doc_id", "idx", (F.ln(F.lit(1.0 + n_fit) / (1 + F.col("df"))) + 1).alias("idf"))
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "idx", (F.col("idf") / norm).alias("weight"))


def tfidf_rows(docs: DataFrame, vocab: DataFrame, n_fit: int, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, idx array, w array: what ``tfidf`` gives, as one sparse row for each document that has any term of the vocabulary.

    ``docs`` has (doc_id, terms array). The vocabulary is capped, so every task looks its own documents' terms up and nothing
    but ids is shuffled, to see whether any stands in two rows: those are merged first."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), *[F.min(c).alias(c) for c in keep])
    v = vocab.select("term", "idx", "df").toArrow()  # capped
    idf = np.log((1.0 + n_fit) / (1 + v["df"].to_numpy().astype(float))) + 1
    held = docs.sparkSession.sparkContext.broadcast((v["term"].combine_chunks(), v["idx"].to_numpy().astype(np.int32), idf))
    head = ["doc_id", *keep]

    def run(batches):
        terms, idx, weight = held.value
        for b in batches:
            lists, n = b.column(b.num_columns - 1), b.num_rows
            at = pc.index_in(lists.flatten(), value_set=terms)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            at = at.drop_null().to_numpy()
            row = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy())[known]
            order = np.lexsort((idx[at], row))
            row, x, i = row[order], weight[at][order], idx[at][order]
            w = x / np.sqrt(np.bincount(row, x * x, n))[row]
            size = np.bincount(row, minlength=n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            out = [*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(i)), pa.ListArray.from_arrays(offsets, pa.array(w))]
            yield pa.RecordBatch.from_arrays(out, names=[*head, "idx", "w"]).filter(pa.array(size > 0))

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*head).dtypes)
    return docs.select(*head, "terms").mapInArrow(run, f"{kinds}, idx array<int>, w array<double>")


def variation_filter(matrix: DataFrame, docs_per_month: DataFrame, least: float) -> DataFrame:
    """Terms whose monthly document shares have a coefficient of variation from ``least`` on.

    Absent months count as zero without a grid: their squares come from the month count."""
    m = docs_per_month.count()
    s = matrix.join(F.broadcast(docs_per_month), "month").select("term", (F.col("df") / F.col("n")).alias("share"))
    sums = s.groupBy("term").agg((F.sum("share") / m).alias("mean"), F.sum(F.col("share") * F.col("share")).alias("sq"))
    cv = F.sqrt(F.greatest(F.col("sq") - m * F.col("mean") * F.col("mean"), F.lit(0.0)) / (m - 1)) / F.col("mean")
    return sums.withColumn("cv", cv).filter(F.col("cv") >= least).select("term", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


def systematic_sample(rows: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every step-th row of a total order, with its position ``pos``: numbered within range partitions, offset by their sizes."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).alias("__part")
    numbered = placed.withColumn("__part", part).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    pos = numbered.join(F.broadcast(before.drop("__n")), "__part").withColumn("pos", F.col("__before") + F.col("__row"))
    return pos.filter(F.col("pos") % step == 0).drop("__at", "__part", "__row", "__before")


def cooccurrence(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """t1 <= t2 and in how many documents both stand, for a bounded set of terms: terms first, then pairs within documents."""
    kept = tokens.join(F.broadcast(terms), "term", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pairs = F.flatten(F.transform("terms", lambda a: F.transform(F.filter("terms", lambda b: b >= a), lambda b: F.struct(a.alias("t1"), b.alias("t2")))))
    return kept.select(F.explode(pairs).alias("p")).groupBy("p.t1", "p.t2").agg(F.count(F.lit(1)).alias("shared"))


def coherence(topics: DataFrame, pairs: DataFrame, n_docs: int, topic: str) -> DataFrame:
    """All ordered pairs of each topic's terms with counts and NPMI: 1 with itself, -1 without common document."""
    alone = pairs.filter("t1 = t2").select(F.col("t1").alias("term"), F.col("shared").alias("df"))
    both = pairs.unionByName(pairs.filter("t1 < t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "shared"))
    t = topics.join(F.broadcast(alone), "term")
    a, b = (t.select(topic, F.col("term").alias(f"t{i}"), F.col("rank").alias(f"r{i}"), F.col("df").alias(f"n{i}")) for i in (1, 2))
    j = a.join(b, topic).join(F.broadcast(both), ["t1", "t2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    p, p1, p2 = (F.col(c) / n_docs for c in ("shared", "n1", "n2"))
    npmi = F.when(F.col("t1") == F.col("t2"), 1.0).when(F.col("shared") == 0, -1.0).when(F.col("shared") == n_docs, 1.0).otherwise(F.ln(p / (p1 * p2)) / -F.ln(p))
    return j.withColumn("npmi", npmi)


def coherence_cv(pairs: DataFrame, topic: str) -> DataFrame:
    total = pairs.groupBy(topic, "t2").agg(F.sum("npmi").alias("total"))
    j = pairs.join(total, [topic, "t2"])
    cos = j.groupBy(topic, "t1").agg(ratio(F.sum(F.col("npmi") * F.col("total")), F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("total") * F.col("total")))).alias("cos"))
    return cos.groupBy(topic).agg(F.avg("cos").alias("c_v"))


def diversity(topics: DataFrame, topic: str, ks: list[int]) -> DataFrame:
    """k, topic, the share of its k first terms that other topics' have too, and the share of distinct terms among all topics' k first."""
    sizes = F.explode(F.array(*map(F.lit, ks))).alias("k")
    t = topics.select(topic, "term", "rank", sizes).filter(F.col("rank") <= F.col("k"))
    held = t.groupBy("k", "term").agg(F.count(F.lit(1)).alias("held"))
    all_k = held.groupBy("k").agg(ratio(F.count(F.lit(1)), F.sum("held")).alias("diversity"))
    g = t.join(F.broadcast(held), ["k", "term"]).groupBy("k", topic).agg(F.avg((F.col("held") > 1).cast("double")).alias("redundancy"))
    return g.join(F.broadcast(all_k), "k").select("k", topic, "redundancy", "diversity", (1 - F.col("diversity")).alias("overall_redundancy"))


def topk_jaccard(sets: DataFrame, key: str, items: str) -> DataFrame:
    """a < b, common items and Jaccard of each pair of a few sets."""
    a, b = (sets.select(F.col(key).alias(k), F.col(items).alias(f"{k}_items")) for k in "ab")
    common = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", common.alias("common"), F.round(ratio(common, F.size(F.array_union("a_items", "b_items"))), 6).alias("jaccard"))


def weighted_jaccard(weights: DataFrame, key: str, k: int, value: str = "n") -> DataFrame:
    """a < b, sum(min)/sum(max) over the union of both top-k lists, weights renormalised there: for every two of a few sets."""
    best = first_by_rank(weights, [key], [F.desc(value), F.col("term")], k).select(key, "term")
    names = best.select(key).distinct()
    a, b = (names.select(F.col(key).alias(c)) for c in "ab")
    two = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    union = two.join(best, F.col("a") == F.col(key)).select("a", "b", "term").unionByName(two.join(best, F.col("b") == F.col(key)).select("a", "b", "term")).distinct()
    w = lambda c, v: weights.select(F.col(key).alias(c), "term", F.col(value).alias(v))
    g = union.join(w("a", "x"), ["a", "term"], "left").join(w("b", "y"), ["b", "term"], "left").select("a", "b", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    pair = Window.partitionBy("a", "b")  # at most 2k rows
    s = g.select("a", "b", ratio(F.col("x"), F.sum("x").over(pair)).alias("x"), ratio(F.col("y"), F.sum("y").over(pair)).alias("y"))
    return s.groupBy("a", "b").agg(ratio(F.sum(F.least("x", "y")), F.sum(F.greatest("x", "y"))).alias("weighted_jaccard"), F.count(F.lit(1)).alias("terms"))


def terms_diff(tops: DataFrame, key: str, base: str) -> DataFrame:
    """key, term, change: terms that each other set has beyond the base's (added) and those of the base's that it lacks (removed)."""
    own = tops.filter(F.col(key) == base).select("term")
    others = tops.filter(F.col(key) != base).select(key, "term")
    added = others.join(F.broadcast(own), "term", "left_anti").withColumn("change", F.lit("added"))
    lists = others.groupBy(key).agg(F.collect_set("term").alias("has")).crossJoin(F.broadcast(own.agg(F.collect_set("term").alias("base"))))
    removed = lists.select(key, F.explode(F.array_except("base", "has")).alias("term"), F.lit("removed").alias("change"))
    return added.select(key, "term", "change").unionByName(removed)


def cosine_matrix(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """a, b and the cosine of each pair of a few vectors, clipped to [0, 1]."""
    v = vectors.select(key, F.col(values).alias("v"))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    x, y = (v.select(F.col(key).alias(k), F.col("v").alias(f"{k}_v")) for k in "ab")
    dot = F.aggregate(F.zip_with("a_v", "b_v", lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    return x.crossJoin(F.broadcast(y)).select("a", "b", clip(ratio(dot, norm(F.col("a_v")) * norm(F.col("b_v"))), 0.0, 1.0).alias("cosine"))


#: Fixed value: what a character reference looks like.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _character(code: Column) -> Column:
    """The character of a number, with the standard's replacements: code page 1252 between 128 and 159, a sign for what is no character, nothing for control signs and the like."""
    known = F.create_map(*[F.lit(x) for n in range(0x80, 0xA0) for x in (n, bytes([n]).decode("cp1252", "ignore") or chr(n))], F.lit(13), F.lit("\r"), F.lit(0xFEFF), F.lit("\ufeff"))
    dropped = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 11) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    special = F.try_element_at(known, code.cast("int"))
    return F.when(special.isNotNull(), special).when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(dropped, "").otherwise(wide)


def unescape(c: Column) -> Column:
    """Character references resolved as HTML 5 says: numbers, names with and without semicolon, the longest known beginning of a name; others stay. In expressions alone."""
    named = F.create_map(*[F.lit(x) for pair in html.entities.html5.items() for x in pair])
    short = F.create_map(*[F.lit(x) for k, v in html.entities.html5.items() if not k.endswith(";") for x in (k, v)])  # known without semicolon: the only beginnings there are

    def one(ref):
        name = F.substr(ref, F.lit(2))
        digits = F.regexp_replace(F.lower(name), "[#x;]", "")
        sized = F.greatest(F.length(F.regexp_replace(digits, "^0+", "")), F.lit(1))
        hexed = F.conv(F.right(F.lpad(digits, 8, "0"), F.lit(8)), 16, 10).cast("long")
        plain = F.right(F.lpad(digits, 10, "0"), F.lit(10)).cast("long")
        code = F.when(F.lower(name).startswith("#x"), F.when(sized > 8, 0x110000).otherwise(hexed)).otherwise(F.when(sized > 10, 0x110000).otherwise(plain))
        begins = F.transform(F.sequence(F.greatest(F.length(name), F.lit(2)), F.lit(2), F.lit(-1)), lambda n: F.substr(name, F.lit(1), n))
        begin = F.get(F.filter(begins, lambda b: F.map_contains_key(short, b)), 0)
        whole = F.try_element_at(named, name)
        other = F.when(whole.isNotNull(), whole).when((F.length(name) > 1) & begin.isNotNull(), F.concat(F.try_element_at(short, begin), F.substr(name, F.length(begin) + 1))).otherwise(ref)
        return F.when(name.startswith("#"), _character(code)).otherwise(other)

    refs = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    between = F.split(c, REFERENCE, -1)
    return F.array_join(F.zip_with(between, F.transform(refs, one), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def unescape_html(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Text of pages: each tag becomes a blank, character references are resolved; null stays null."""
    return pages.select(key, unescape(F.regexp_replace(column, "<[^>]*>", " ")).alias("text"))
