"""Term statistics and BM25+ over document tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from ..functions.hashing import fnv1a_word
from ..functions.text import bind, each_word, stem_word, tokenize

K1, B, DELTA, FIELD_BOOST, COVERAGE = 1.5, 0.75, 0.5, 4, 0.1


def term_frequencies(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf); tokens may repeat. Outer, or a filter on the list's size would make the tokens twice."""
    return docs.select(F.col(id_col), F.explode_outer(tokens).alias("term")).where("term IS NOT NULL").groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df): in how many rows each term is."""
    return docs.select(F.explode_outer(F.array_distinct(tokens)).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row (n, avgdl); rows without tokens count."""
    return docs.select(F.size(tokens).alias("l")).agg(F.count("*").alias("n"), F.coalesce(F.avg("l"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column, delta: float = DELTA) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5))) + delta


def term_score(tf: Column, idf_: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B, sublinear: bool = True) -> Column:
    t = F.log(1 + tf) if sublinear else tf.cast("double")
    return idf_ * t * (k1 + 1) / (t + k1 * (1 - b + b * length / avgdl))


def _count(array: Column, value: Column) -> Column:
    return F.size(F.filter(array, lambda t: t == value))


def bm25(docs: DataFrame, query: list[str], id_col: str, tokens: Column, title: Column | None = None, tags: Column | None = None, stats: DataFrame | None = None, k1: float = K1, b: float = B, coverage: bool = True) -> DataFrame:
    """(id, bm25_score, matched) of the rows that have a query term.

    query: its tokens, made as the documents' are. tokens: content tokens, distinct by default, so a content term has
    tf 1; title and tag tokens add FIELD_BOOST each to tf and nothing to length. stats: (n, avgdl, df map<term, df>) of a whole
    corpus; without it, of docs.

    Terms that aren't asked for are dropped within the row, before anything is exploded: what is shuffled is one row a document, and the
    statistics are one aggregate of as many counts as the query has terms.
    """
    if not query:
        return docs.select(F.col(id_col), F.lit(0.0).alias("bm25_score"), F.lit(0).alias("matched")).limit(0)
    ask = F.array(*map(F.lit, query))
    boosted = [x for x in (title, tags) if x is not None]
    boost = F.array().cast("array<string>")
    for x in boosted:
        boost = F.concat(boost, F.flatten(F.array_repeat(x, FIELD_BOOST)))

    def measured(t: Column) -> Column:
        hits = F.filter(F.concat(t, boost) if boosted else t, lambda x: F.array_contains(ask, x))
        counted = bind(hits, lambda h: F.transform(F.array_distinct(h), lambda q: F.struct(q.alias("term"), _count(h, q).alias("tf"))))
        return F.struct(F.size(t).alias("l"), counted.alias("hits"))

    # bound in one expression: a filter that moves below a projection would have it tokenize again for every use
    d = docs.select(F.col(id_col), bind(tokens, measured).alias("_m")).select(id_col, F.col("_m.l").alias("_l"), F.col("_m.hits").alias("_h"))
    if stats is None:
        # one aggregate: a count for each query term beside the number of rows and their mean length
        has = [F.count_if(F.array_contains("_h.term", q)) for q in query]
        n, avgdl, *counts = d.agg(F.count("*"), F.avg("_l"), *has).first()
        df = dict(zip(query, counts))
    else:
        one = stats.select("n", "avgdl", *(F.element_at("df", F.lit(q)).alias(f"t{i}") for i, q in enumerate(query))).first()
        n, avgdl, df = one.n, one.avgdl, {q: one[f"t{i}"] or 0 for i, q in enumerate(query)}
    if not n or not avgdl:
        return docs.select(F.col(id_col), F.lit(0.0).alias("bm25_score"), F.lit(0).alias("matched")).limit(0)
    weights = F.create_map(*(F.lit(x) for q in query for x in (q, max(0.0, math.log((n - df.get(q, 0) + 0.5) / (df.get(q, 0) + 0.5))) + DELTA)))
    part = lambda h: term_score(h["tf"].cast("double"), F.element_at(weights, h["term"]), F.col("_l"), F.lit(float(avgdl)), k1, b)
    total = F.aggregate("_h", F.lit(0.0), lambda s, h: s + part(h))
    if coverage:
        total = total * (1 + COVERAGE * F.size("_h") / len(query))
    row = F.struct(total.alias("bm25_score"), F.size("_h").alias("matched"))
    # outer, as what an inner one drops is made a filter below it that makes all tokens again
    return d.select(id_col, F.inline_outer(F.when(F.size("_h") > 0, F.array(row)))).where("matched IS NOT NULL")


def query_tokens(text: str, **options) -> list[str]:
    """A query's tokens by the same expression as the documents'."""
    from pyspark.sql import SparkSession

    return list(SparkSession.active().range(1).select(tokenize(F.lit(text), **options).alias("t")).first().t)


def stem_index(word: str) -> int:
    """Hash of a word's stem; words of up to three letters and numbers are not stemmed."""
    return fnv1a_word(word if len(word) <= 3 or re.fullmatch("[0-9]+", word) else stem_word(word))


def sparse_vectors(docs: DataFrame, id_col: str, tokens: Column, stemmed: bool = False) -> DataFrame:
    """(id, index, tf): hashed terms with real term frequencies; stemmed: the terms are the stems of tokens.

    Tokens are hashed where they are, each distinct one of a batch once, so the counts of (id, index) are all that is shuffled.
    """
    index = each_word(stem_index if stemmed else fnv1a_word, LongType())
    rows = docs.select(F.col(id_col), F.explode_outer(tokens).alias("term")).where("term IS NOT NULL")
    return rows.select(id_col, index(F.col("term")).alias("index")).groupBy(id_col, "index").agg(F.count("*").alias("tf"))


def bm25_many(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str, tokens: Column, query_col: str, query_tokens: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score, rank): the best documents of each of many queries, which share one pass over the documents.

    Postings of terms that a query has meet the queries by term; a term's queries come as one array, so a term's postings are not repeated
    before they are scored. Each document has a content term once, however often it is in it.
    """
    d = docs.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("t"))
    n, avgdl = d.agg(F.count("*"), F.avg(F.size("t"))).first()
    ask = queries.select(F.col(query_col).alias("q"), F.array_distinct(query_tokens).alias("t"))
    size = ask.select("q", F.size("t").alias("m"))
    asked = ask.select("q", F.explode("t").alias("term")).groupBy("term").agg(F.collect_list("q").alias("qs"))
    postings = d.select("id", F.size("t").alias("l"), F.explode("t").alias("term")).join(asked, "term")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    part = term_score(F.lit(1.0), idf(F.lit(float(n or 0)), F.col("df")), F.col("l"), F.lit(float(avgdl or 1)), k1, b)
    scored = postings.join(df, "term").select("id", part.alias("s"), F.explode("qs").alias("q"))
    total = scored.groupBy("q", "id").agg(F.sum("s").alias("s"), F.count("*").alias("c")).join(size, "q")
    total = total.select("q", "id", F.round(F.col("s") * (1 + COVERAGE * F.col("c") / F.col("m")), 9).alias("score"))
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")
