"""Queries by name over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning, hashing, scoring, text as tx, vectors
from ..operators import bm25, catalog, chunking, context, entities, events, fusion, joins, keywords, rules, wiki
from ..operators.text_index import TextIndex
from ..sources.work import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in as many partitions as there are cores at least: a small file is one row group, which one task reads."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def r6(c):
    return F.round(c, 6)


# vectors


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    return vectors.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), k, "vec_id", "embedding").select(F.col("vec_id").alias("id"), "score")


_DENSE = f"SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM embeddings ORDER BY score DESC, id LIMIT 100"


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def knn_cosine(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id", "embedding").select("vec_id", r6("score").alias("score"))


@query(f"""WITH q AS (SELECT {_Q} AS q), p AS (SELECT vec_id, unnest(embedding) > 0 AS x, unnest(q) > 0 AS y FROM embeddings, q)
SELECT vec_id, round(count(*) FILTER (x AND y) / greatest(count(*) FILTER (x OR y), 1), 6) AS score FROM p GROUP BY vec_id ORDER BY 2 DESC, 1 LIMIT 10""")
def knn_jaccard(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id", "embedding", "jaccard").select("vec_id", r6("score").alias("score"))


@query(f"""WITH q AS (SELECT {_Q} AS q), p AS (SELECT vec_id, unnest(embedding) > 0 AS x, unnest(q) > 0 AS y FROM embeddings, q)
SELECT vec_id, round(1 - count(*) FILTER (x <> y) / count(*), 6) AS score FROM p GROUP BY vec_id ORDER BY 2 DESC, 1 LIMIT 10""")
def knn_hamming(spark, d):
    signs = lambda v: [1.0 if x > 0 else 0.0 for x in v]
    e = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    return vectors.nearest(e, signs(_query_vector(spark, d)), 10, "vec_id", "embedding", "hamming").select("vec_id", r6("score").alias("score"))


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 3")
def knn_per_collection(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _query_vector(spark, d)))
    rows = table(spark, d, "embeddings").select("vec_id", "label", vectors.cosine(F.col("embedding"), q).alias("score"))
    return joins.top_per(rows, ["label"], 3, "score", "vec_id").select("vec_id", "label", r6("score").alias("score"), "rank")


@query("""SELECT a.label, count(*) AS pairs, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_similarity, round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS max_similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def pairwise_cosine_by_label(spark, d):
    """All pairs of each collection, as the matrix functions give, block by block."""
    out = vectors.pairwise(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "pairs", r6("mean_similarity").alias("mean_similarity"), r6("max_similarity").alias("max_similarity"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_component, len(embedding) AS dims, list_min(embedding) < 0 AS has_negative FROM embeddings")
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", r6(vectors.norm(F.col("embedding"))).alias("norm"), r6(vectors.normalize(F.col("embedding"))[0]).alias("first_component"), F.size("embedding").cast("long").alias("dims"), (F.array_min("embedding") < 0).alias("has_negative"))


# terms

_TOK = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\w\s]', ' ', 'g'), '[\s\x0B]+'), lambda t: t <> '')"


def _simple(c="text"):
    return tx.tokenize_simple(F.col(c))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def term_statistics(spark, d):
    tf = bm25.term_frequencies(table(spark, d, "documents"), "doc_id", _simple())
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("max_tf"))


@query(f"SELECT term, df, round(greatest(0, ln((n - df + 0.5) / (df + 0.5))) + 0.5, 6) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term), (SELECT count(*) AS n FROM documents)")
def inverse_document_frequency(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    return bm25.document_frequencies(docs, _simple()).select("term", "df", r6(bm25.idf(F.lit(float(n)), F.col("df"))).alias("idf"))


@query(f"SELECT count(*) AS n, round(avg(len(list_distinct({_TOK}))), 6) AS avgdl FROM documents")
def corpus_statistics(spark, d):
    return bm25.corpus_stats(table(spark, d, "documents"), F.array_distinct(_simple())).select("n", r6("avgdl").alias("avgdl"))


def _item_terms(spark, d) -> list[str]:
    return sorted(table(spark, d, "benchmark").where("item_id = 0").select(F.array_distinct(_simple()).alias("t")).first().t)


def _bm25_sql(boost: bool) -> str:
    tf = f"1 + {bm25.FIELD_BOOST} * (CASE WHEN list_contains(title, term) THEN 1 ELSE 0 END)" if boost else "1"
    hit = "list_contains(toks, term) OR list_contains(title, term)" if boost else "list_contains(toks, term)"
    content = "(CASE WHEN list_contains(toks, term) THEN 1 ELSE 0 END)"
    tf = tf.replace("1 +", f"{content} +", 1) if boost else "1"
    return f"""WITH q AS (SELECT unnest(list_distinct({_TOK})) AS term FROM benchmark WHERE item_id = 0), m AS (SELECT count(*) AS m FROM q),
d AS (SELECT doc_id, list_distinct({_TOK}) AS toks, list_distinct({_TOK.replace('text', 'source')}) AS title FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
h AS (SELECT doc_id, len(toks) AS l, term, ln(1 + {tf}) AS t FROM d, q WHERE {hit}),
i AS (SELECT term, greatest(0, ln((n - count(*) + 0.5) / (count(*) + 0.5))) + 0.5 AS idf FROM h, s GROUP BY term, n)
SELECT doc_id, round(sum(idf * t * 2.5 / (t + 1.5 * (0.25 + 0.75 * l / avgdl))) * (1 + 0.1 * count(*) / m), 9) AS score FROM h JOIN i USING (term), s, m GROUP BY doc_id, m"""


_indices: dict[tuple[str, str], TextIndex] = {}


def _index(spark, d) -> TextIndex:
    """The documents' text index, made at its first use by an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indices:
        index = TextIndex(spark, f"{work_folder(spark)}/engram/index-{uuid.uuid4().hex}")
        _indices[key] = index.upsert(table(spark, d, "documents"), "doc_id", F.array_distinct(_simple()), F.array_distinct(_simple("source")))
    return _indices[key]


def _text_scores(spark, d, boost=False) -> DataFrame:
    q = _item_terms(spark, d)
    title = F.array_distinct(_simple("source")) if boost else None
    return bm25.bm25(table(spark, d, "documents"), q, "doc_id", F.array_distinct(_simple()), title).select(F.col("doc_id"), F.round("bm25_score", 9).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(False)}) ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return _text_scores(spark, d).orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", r6("score").alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(True)})")
def bm25_field_boost(spark, d):
    return _text_scores(spark, d, True).select("doc_id", r6("score").alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(True)}) ORDER BY score DESC, doc_id LIMIT 20")
def indexed_topk(spark, d):
    """The same scores from the index of all documents, whose blocks of low bounds are not read."""
    out = _index(spark, d).search(_item_terms(spark, d), 20, boosted=True, digits=6)
    return out.select(F.col("id").alias("doc_id"), F.col("bm25_score").alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(False).replace('FROM documents)', 'FROM (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0))')})")
def indexed_changes(spark, d):
    """All scores after a seventh of the documents is deleted and a fifth has its text replaced: as if the index were made anew."""
    docs = table(spark, d, "documents")
    index = TextIndex(spark, f"{work_folder(spark)}/engram/index-{uuid.uuid4().hex}")
    index.upsert(docs, "doc_id", F.array_distinct(_simple()))
    index.upsert(docs.where("doc_id % 5 = 0"), "doc_id", F.array_distinct(_simple("lang")))
    index.delete(docs.where("doc_id % 7 = 0").select("doc_id"), "doc_id")
    return index.search(_item_terms(spark, d)).select(F.col("id").alias("doc_id"), r6("bm25_score").alias("score"))


_TEXT = f"SELECT doc_id AS id, score FROM ({_bm25_sql(False)}) ORDER BY score DESC, id LIMIT 100"


def _text(spark, d, k=100):
    return _text_scores(spark, d).orderBy(F.col("score").desc(), "doc_id").limit(k).select(F.col("doc_id").alias("id"), "score")


@query(f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_DENSE})), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_TEXT})),
j AS (SELECT coalesce(v.id, t.id) AS id, coalesce(v.score, 0) AS vs, coalesce(t.score / (t.score + 3), 0) AS ts, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS rrf FROM v FULL JOIN t ON v.id = t.id),
k AS (SELECT *, rrf / max(rrf) OVER () AS f FROM j)
SELECT id, round(rrf, 6) AS rrf, round(least(1, CASE WHEN vs > 0.01 AND ts > 0.01 THEN (0.55 * vs + 0.45 * ts) * (1 + 0.08 * least(vs, ts)) * (0.95 + 0.05 * f) WHEN vs > 0.01 THEN vs * 0.55 * (0.9 + 0.1 * f) WHEN ts > 0.01 THEN ts * 0.6 * (0.9 + 0.1 * f) ELSE 0.25 * f END), 6) AS score FROM k""")
def fuse_rrf(spark, d):
    return fusion.reciprocal_rank(_dense(spark, d, 100), _text(spark, d)).select("id", r6("rrf").alias("rrf"), r6("score").alias("score"))


@query(f"""WITH v AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS n FROM ({_DENSE})), t AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS n FROM ({_TEXT}))
SELECT coalesce(v.id, t.id) AS id, round(0.5 * coalesce(v.n, 0) + 0.5 * coalesce(t.n, 0), 6) AS score FROM v FULL JOIN t ON v.id = t.id""")
def fuse_weighted(spark, d):
    return fusion.weighted(_dense(spark, d, 100), _text(spark, d)).select("id", r6("score").alias("score"))


@query(f"""WITH v AS ({_DENSE}), t AS (SELECT doc_id AS id, score AS b FROM ({_bm25_sql(False)})), j AS (SELECT v.id, score, coalesce(b, 0) AS b FROM v LEFT JOIN t ON v.id = t.id)
SELECT id, round(0.5 * score + 0.5 * b / greatest(max(b) OVER (), 0.0001), 6) AS score FROM j""")
def fuse_rescored(spark, d):
    text = _text_scores(spark, d).select(F.col("doc_id").alias("id"), "score")
    return fusion.rescored(_dense(spark, d, 100), text).select("id", r6("score").alias("score"))


@query(f"""WITH v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_DENSE.replace('LIMIT 100', 'LIMIT 40')})), t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_TEXT.replace('LIMIT 100', 'LIMIT 40')}))
SELECT id, round(score, 6) AS score FROM (SELECT coalesce(v.id, t.id) AS id, coalesce(1.0::DOUBLE / (1 + v.rank), 0) + coalesce(1.0::DOUBLE / (1 + t.rank), 0) AS score FROM v FULL JOIN t ON v.id = t.id) ORDER BY score DESC, id LIMIT 10""")
def dense_sparse_hybrid(spark, d):
    return fusion.dense_sparse(_dense(spark, d, 100), _text(spark, d), "id", 10).select("id", r6("score").alias("score"))


@query(f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_DENSE})), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_TEXT})),
j AS (SELECT a.r AS ra, b.r AS rb FROM a FULL JOIN b ON a.id = b.id), n AS (SELECT count(ra) AS na, count(rb) AS nb FROM j),
f AS (SELECT ra, rb, coalesce(ra, na + 1) - coalesce(rb, nb + 1) AS x FROM j, n)
SELECT count(*) FILTER (ra <= 20 AND rb <= 20) AS overlap, count(*) FILTER (rb IS NULL) AS only_a, count(*) FILTER (ra IS NULL) AS only_b, round(1 - 6 * sum(x * x) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM f""")
def compare_rankings(spark, d):
    rank = lambda x: fusion.ranked(x, "id", F.col("score"))
    out = fusion.spearman(rank(_dense(spark, d, 100)), rank(_text(spark, d)))
    return out.select("overlap", "only_a", "only_b", r6("rho").alias("rho"))


@query(None)
def sparse_vectors(spark, d):
    return bm25.sparse_vectors(table(spark, d, "documents"), "doc_id", tx.tokenize(F.col("text"), stemmed=False, dedupe=False), stemmed=True)


@query(None)
def stemmed_tokens(spark, d):
    """Stems of distinct words, made once for each."""
    words = table(spark, d, "documents").select(F.explode(tx.latin_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


# events


def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", "event_type", (F.col("value") / 100).alias("score"), (F.col("event_id") % 10 + 1).cast("int").alias("importance"), (F.col("event_type") == "purchase").alias("should_persist"),
        F.col("event_id").cast("int").alias("source_window_end"), F.array(F.concat(F.lit("u"), F.col("user_id"))).alias("characters"), F.array(F.get_json_object("props", "$.k")).alias("keywords"),
        F.lit(False).alias("rerank_applied"), "user_id",
    )


_EVENTS = "SELECT event_id, event_type, user_id, value / 100 AS score, event_id % 10 + 1 AS importance, event_type = 'purchase' AS persist, event_id AS wend, json_extract_string(props, '$.k') AS kw FROM events"


@query(f"""WITH n AS (SELECT count(*) AS n FROM events), e AS ({_EVENTS})
SELECT event_id, round(0.55 * score + 0.2 * importance / 10 + 0.15 * persist::INT + 0.1 * pow(0.5, greatest(0, n - wend) / greatest(40, 0.2 * n)) + CASE WHEN length(kw) >= 2 AND contains('about 42 and 17', kw) THEN 0.2 ELSE 0 END, 6) AS final_score
FROM e, n WHERE importance >= 3 AND wend < n - 50""")
def event_rerank(spark, d):
    e = _events(spark, d)
    n = e.count()
    out = events.reranked(e, n, scoring.WEIGHTS, "about 42 and 17", None, 3)
    return events.beyond_context(out, n, 50).select("event_id", r6("final_score").alias("final_score"))


@query(f"""SELECT user_id, arg_max(event_id, (score, -event_id)) AS event_id, round(max(score), 6) AS score FROM ({_EVENTS}) GROUP BY user_id""")
def merge_by_max(spark, d):
    return events.best_by(_events(spark, d).select("user_id", "event_id", "score"), ["user_id"], "score", "event_id").select("user_id", "event_id", r6("score").alias("score"))


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM events), e AS ({_EVENTS}),
f AS (SELECT *, 0.55 * score + 0.2 * importance / 10 + 0.15 * persist::INT + 0.1 * pow(0.5, greatest(0, n - wend) / greatest(40, 0.2 * n)) AS final FROM e, n),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY final DESC, event_id) AS r FROM f),
w AS (SELECT event_type, user_id, 0::BIGINT AS r, []::BIGINT[] AS kept, []::BIGINT[] AS ends FROM (SELECT DISTINCT event_type, user_id FROM e)
    UNION ALL SELECT o.event_type, o.user_id, o.r, CASE WHEN o.score < 0.75 AND len(list_filter(w.ends, lambda x: abs(x - o.wend) < 10)) > 0 THEN w.kept ELSE list_append(w.kept, o.event_id) END,
        CASE WHEN o.score < 0.75 AND len(list_filter(w.ends, lambda x: abs(x - o.wend) < 10)) > 0 THEN w.ends ELSE list_append(w.ends, o.wend) END
    FROM w JOIN o ON o.event_type = w.event_type AND o.user_id = w.user_id AND o.r = w.r + 1),
k AS (SELECT unnest(arg_max(kept, r)) AS event_id FROM w GROUP BY event_type, user_id)
SELECT event_id, event_type, round(final, 6) AS final_score FROM f WHERE event_id IN (SELECT event_id FROM k)""")
def near_copies_dropped(spark, d):
    e = _events(spark, d)
    return events.near_copies_dropped(events.reranked(e, e.count())).select("event_id", "event_type", r6("final_score").alias("final_score"))


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM events), e AS ({_EVENTS}), b AS (SELECT * FROM e ORDER BY score DESC, event_id LIMIT 20),
f AS (SELECT *, 0.55 * score + 0.2 * importance / 10 + 0.15 * persist::INT + 0.1 * pow(0.5, greatest(0, n - wend) / greatest(40, 0.2 * n)) + CASE WHEN length(kw) >= 2 AND contains('about 42', kw) THEN 0.2 ELSE 0 END AS final FROM b, n),
o AS (SELECT *, row_number() OVER (ORDER BY final DESC, event_id) AS r FROM f),
w AS (SELECT 0::BIGINT AS r, []::STRUCT(id BIGINT, t VARCHAR, u BIGINT, w BIGINT)[] AS kept UNION ALL
    SELECT o.r, CASE WHEN o.score < 0.75 AND len(list_filter(w.kept, lambda k: k.t = o.event_type AND k.u = o.user_id AND abs(k.w - o.wend) < 10)) > 0 THEN w.kept ELSE list_append(w.kept, {{'id': o.event_id, 't': o.event_type, 'u': o.user_id, 'w': o.wend}}) END FROM w JOIN o ON o.r = w.r + 1)
SELECT event_id, round(final, 6) AS final_score FROM o WHERE event_id IN (SELECT unnest(kept).id FROM w WHERE r = (SELECT max(r) FROM w)) AND wend < n - 20 ORDER BY final DESC, event_id LIMIT 10""")
def event_retrieval(spark, d):
    e = _events(spark, d)
    return events.retrieved(e, None, e.count(), 10, "about 42", 20).select("event_id", r6("final_score").alias("final_score"))


@query(f"SELECT event_type, count(*) AS n FROM ({_EVENTS}) WHERE event_type IN ('click', 'purchase') AND importance >= 4 GROUP BY 1")
def planner_filters(spark, d):
    out = events.filtered(_events(spark, d), {"event_type_any": ["click", " purchase ", ""], "importance_gte": 4})
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT max(event_id)::INT + 1 AS tip FROM events")
def vectorization_tip(spark, d):
    return _events(spark, d).agg(events.vectorization_tip(None).alias("tip"))


@query(f"SELECT event_type, string_agg('- ' || event_type || ' ' || event_id, chr(10) ORDER BY score DESC, event_id) AS context FROM ({_EVENTS}) GROUP BY event_type")
def event_format(spark, d):
    """All events of each type as text."""
    e = _events(spark, d).withColumns({"summary": F.concat("event_type", F.lit(" "), "event_id"), "final_score": F.col("score")})
    return events.formatted(e, ["event_type"], "summary")


# conversations

_IDX = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"""WITH m AS ({_IDX}), w AS (SELECT conv_id, idx AS s FROM m WHERE idx % 2 = 0 AND idx + 3 <= n)
SELECT w.conv_id, s::INT AS window_start, (s + 2)::INT AS window_end, string_agg(coalesce(text, ''), chr(10) ORDER BY idx) AS text FROM w JOIN m ON m.conv_id = w.conv_id AND idx BETWEEN s AND s + 2 GROUP BY w.conv_id, s""")
def count_windows(spark, d):
    return chunking.count_windows(table(spark, d, "conversations"), size=3, overlap=1)


def _batch_sql(n: int) -> str:
    return f"SELECT conv_id, (idx // {n})::INT AS batch, string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY idx) AS text, count(*)::INT AS messages, min(idx)::INT AS start_index, max(idx)::INT AS end_index FROM ({_IDX}) GROUP BY 1, 2"


@query(_batch_sql(4))
def message_batches(spark, d):
    return chunking.message_batches(table(spark, d, "conversations"))


@query(_batch_sql(2))
def conversation_turns(spark, d):
    return chunking.chunk(table(spark, d, "conversations"), "conversation_turns")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn DESC) AS query_text FROM (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id")
def query_text(spark, d):
    return context.query_text(table(spark, d, "conversations"), 3)


_CTX = "SELECT conv_id, list(text ORDER BY turn) AS msgs, list(role ORDER BY turn) AS roles, max(n) AS n, arg_max(role, turn) AS last FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) GROUP BY conv_id"


@query(f"""SELECT conv_id, regexp_matches(array_to_string(msgs[1:2], chr(10)), '(?i)\\bth\\w+') AND n >= 3 AS pattern_and_count, last = 'user' AS speaker, list_contains(roles, 'system') AS present, NOT (n BETWEEN 2 AND 3) AS not_between, contains(lower(array_to_string(msgs, ' ')), 'ing') AS emotion FROM ({_CTX})""")
def rule_conditions(spark, d):
    ctx = rules.chunk_context(table(spark, d, "conversations"))
    one = rules.compile_rule
    return ctx.select(
        "conv_id",
        rules.compile_conditions({"enabled": True, "logic": "AND", "rules": [{"type": "pattern", "settings": {"patterns": ["/\\bth\\w+/i"], "scanDepth": 2}}, {"type": "messageCount", "settings": {"count": 3}}]}).alias("pattern_and_count"),
        one({"type": "speaker", "settings": {"values": ["user"]}}).alias("speaker"),
        one({"type": "characterPresent", "settings": {"values": ["SYSTEM"]}}).alias("present"),
        one({"type": "messageCount", "negate": True, "settings": {"count": 2, "operator": "between", "upperBound": 3}}).alias("not_between"),
        one({"type": "emotion", "settings": {"values": ["test"], "detectionMethod": "patterns"}}, lexicon={"test": ["ing"]}).alias("emotion"),
    )


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) <= 120 AS at_night, (SELECT count(*) FROM events) - event_id <= 100 AS recent, value / 100 >= 0.5 AS strong FROM events")
def rule_events(spark, d):
    e = table(spark, d, "events")
    cols = {"now": F.col("ts"), "message_count": F.lit(e.count()), "message_index": F.col("event_id"), "score": F.col("value") / 100}
    one = lambda kind, **s: rules.compile_rule({"type": kind, "settings": s}, cols)
    return e.select("event_id", one("timeOfDay", startTime="22:00", endTime="02:00").alias("at_night"), one("recency", messagesAgo=100, operator="lte").alias("recent"), one("scoreThreshold", threshold=0.5).alias("strong"))


@query("""WITH h AS (SELECT user_id, count(*) AS c, max(event_id) AS last FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT e.user_id, coalesce(c, 0) < 5 AND (last IS NULL OR (SELECT count(*) FROM events) - last >= 50) AS allowed FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN h USING (user_id)""")
def rule_cooldown(spark, d):
    e = table(spark, d, "events")
    h = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("activations"), F.max("event_id").alias("last_activation"))
    rows = e.select("user_id").distinct().join(h, "user_id", "left").withColumn("message_count", F.lit(e.count()))
    return rows.select("user_id", rules.compile_rule({"type": "frequency", "settings": {"maxActivations": 5, "cooldownMessages": 50}}).alias("allowed"))


@query(f"""SELECT conv_id, contains(lower(array_to_string(msgs[1:5], chr(10))), 'the') OR n % 2 = 0 AS active FROM (SELECT *, conv_id FROM ({_CTX}))""")
def collection_activation(spark, d):
    ctx = rules.chunk_context(table(spark, d, "conversations")).withColumn("even", F.col("message_count") % 2)
    meta = {"enabled": True, "triggers": ["THE"]}
    return ctx.select("conv_id", (rules.activation(meta, None, None) | (F.col("even") == 0)).alias("active"))


# chunks

_TRIM = r"regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


def _parts_sql(split: str) -> str:
    return f"SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS chunk_index, unnest(p) AS text, len(p)::INT AS total_chunks FROM (SELECT doc_id, list_filter(list_transform({split}, lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS p FROM documents)"


@query(_parts_sql(r"string_split_regex(text, '\n\n+')"))
def chunk_paragraph(spark, d):
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), "paragraph").drop("strategy")


@query(_parts_sql(r"string_split(regexp_replace(text, '(?m)^(#{1,6}\s+.+)$', chr(1) || '\1', 'g'), chr(1))"))
def chunk_section(spark, d):
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), "section").drop("strategy")


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS s FROM documents),
p AS (SELECT doc_id, string_split(list_reduce(s, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) <= 500 THEN a || ' ' || x ELSE a || chr(1) || x END), chr(1)) AS p FROM s WHERE len(s) > 0)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS chunk_index, unnest(p) AS text, len(p)::INT AS total_chunks FROM p""")
def chunk_sentence(spark, d):
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), "sentence").drop("strategy")


@query(None)
def chunk_adaptive(spark, d):
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), "adaptive").drop("strategy")


@query(None)
def chunk_dialogue(spark, d):
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), "dialogue").drop("strategy")


# cleaning and strings


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x0B\x{00A0}]+', ' ', 'g')) AS text FROM pages")
def clean_html(spark, d):
    no_script = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>", "")
    return table(spark, d, "pages").select("page_id", tx.strip_html(no_script).alias("text"))


@query(r"SELECT doc_id, regexp_extract_all(text, 'https?://[^\s\x0B]+') AS urls, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b') AS emails FROM documents")
def extract_links(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.extract_urls(F.col("text")).alias("urls"), tx.extract_emails(F.col("text")).alias("emails"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)</?(?:b|i|u|em|strong)>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text FROM (SELECT page_id, regexp_replace(html, '(?i)<font[^>]*>(.*?)</font>', '\1', 'g') AS html FROM pages)")
def clean_preset(spark, d):
    rules_ = [cleaning.BUILT_IN["strip_font_tags"], cleaning.BUILT_IN["strip_bold_italic"]]
    return table(spark, d, "pages").select("page_id", cleaning.clean(F.col("html"), rules_).alias("text"))


@query("SELECT p_partkey, levenshtein(lower(p_name), lower(p_type)) AS distance, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def string_similarity(spark, d):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", tx.edit_distance(a, b).cast("long").alias("distance"), r6(tx.similarity(a, b)).alias("similarity"))


@query(r"""SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS capital, reverse(p_name) AS backwards, lower(regexp_replace(regexp_replace(regexp_replace(p_name, '([A-Z])', '_\1', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS snake,
replace(replace(replace(p_brand, '&', '&amp;'), '<', '&lt;'), '#', '#') AS escaped, regexp_matches(p_name, '^[a-zA-Z0-9]+$') AS alphanumeric, rpad(p_brand, 12, '.') AS padded, CASE WHEN length(p_type) <= 10 THEN p_type ELSE substr(p_type, 1, 7) || '...' END AS short FROM part""")
def string_functions(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", tx.capitalize(c("p_name")).alias("capital"), F.reverse("p_name").alias("backwards"), tx.snake_case(c("p_name")).alias("snake"), tx.escape_html(c("p_brand")).alias("escaped"),
        tx.is_alphanumeric(c("p_name")).alias("alphanumeric"), tx.pad(c("p_brand"), 12, ".").alias("padded"), tx.truncate(c("p_type"), 10, break_words=True).alias("short"),
    )


_CODES = "list_prepend({0}::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT))"
_A = f"list_reduce({_CODES.format(5381)}, lambda h, c: xor(h * 33, c) & 4294967295)"
_B = f"list_reduce({_CODES.format(0xABCDEF)}, lambda h, c: xor(xor(h * 33, c), c * 65536) & 4294967295)"


@query(f"SELECT p_partkey, list_reduce({_CODES.format(0x811C9DC5)}, lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv1a, {_A} AS djb2, ({_B} >> 11) * 4294967296 + {_A} AS event_hash FROM part")
def hash_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", hashing.fnv1a(n).alias("fnv1a"), hashing.djb2(n).alias("djb2"), hashing.event_hash(n).alias("event_hash"))


# keywords


@query(None)
def tfidf_keywords(spark, d):
    out = keywords.tfidf_keywords(table(spark, d, "documents"), "doc_id", F.col("text"), level="aggressive")
    return out.select("doc_id", "rank", "keyword", r6("score").alias("score"), r6("weight").alias("weight"))


@query(None)
def frequency_keywords(spark, d):
    return keywords.frequency_keywords(table(spark, d, "documents"), "doc_id", F.col("text"), level="aggressive")


@query("""WITH w AS (SELECT item_id, w, sum(n) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{2,}')) AS w, 1 AS n FROM benchmark UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(substr(text, 1, 240)), '[a-z][a-z0-9''-]{2,}')), 1 FROM benchmark)
WHERE w NOT IN (""" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.stop_words("en")) + """) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, w) AS rank, w AS keyword FROM w QUALIFY rank <= 50""")
def query_keywords(spark, d):
    return keywords.query_keywords(table(spark, d, "benchmark"), "item_id", F.col("text"))


@query("SELECT lower(role) AS keyword, count(*) AS n FROM conversations GROUP BY 1 UNION ALL SELECT 'turn' || (turn % 3), count(*) FROM conversations GROUP BY 1")
def keyword_counts(spark, d):
    c = table(spark, d, "conversations").select(F.array(F.upper("role"), F.concat(F.lit("Turn"), (F.col("turn") % 3).cast("string"))).alias("keywords"))
    return keywords.keyword_counts(c)


@query("SELECT source, count(*) AS chunks, max(length(text))::INT AS max_chars, round(avg(length(text)), 6) AS avg_chars, sum(length(text))::BIGINT AS total_chars, substr(arg_max(text, (length(text), text)), 1, 80) AS preview FROM documents GROUP BY source")
def size_summary(spark, d):
    return keywords.size_summary(table(spark, d, "documents"), "source").withColumn("avg_chars", r6("avg_chars"))


@query("SELECT source, md5(text) AS hash, count(*) AS n, count(*) - 1 AS extra FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_hashes(spark, d):
    return keywords.duplicate_hashes(table(spark, d, "documents").withColumn("hash", F.md5(F.col("text").cast("binary"))), ["source"])


@query(None)
def glossary(spark, d):
    g = table(spark, d, "documents").select("doc_id", F.explode(entities.glossary_of("text")).alias("g"))
    return g.select("doc_id", "g.acronym", "g.full_name")


# links, parents, context


def _chunks(spark, d) -> DataFrame:
    """Documents as chunks of their sources, scored by their vectors, or 0 without one; every third is a summary of another."""
    q = F.array(*(F.lit(float(x)) for x in _query_vector(spark, d)))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), ((1 + vectors.cosine(F.col("embedding"), q)) / 2).alias("score"))
    e = table(spark, d, "documents").join(v, "doc_id", "left")
    return e.select(
        F.col("source").alias("collection_id"), F.col("doc_id").alias("hash"), "text", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("doc_id") % 3 == 0).alias("is_summary"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 20).alias("parent_hash"),
    )


_CHUNKS = f"SELECT source AS collection_id, doc_id AS hash, text, CASE WHEN vec_id IS NULL THEN 0::DOUBLE ELSE (1 + list_cosine_similarity(embedding::DOUBLE[], {_Q})) / 2 END AS score, doc_id % 3 = 0 AS is_summary, CASE WHEN doc_id % 3 = 0 THEN doc_id + 20 END AS parent_hash FROM documents LEFT JOIN embeddings ON vec_id = doc_id"
_HITS = f"SELECT * FROM ({_CHUNKS}) WHERE score >= 0.1"


@query(f"SELECT collection_id, hash, round(score, 6) AS score FROM ({_CHUNKS}) WHERE score >= 0.25")
def score_threshold(spark, d):
    return joins.above(_chunks(spark, d)).select("collection_id", "hash", r6("score").alias("score"))


@query(f"""WITH h AS ({_HITS}), c AS ({_CHUNKS}), j AS (SELECT h.collection_id, coalesce(c.hash, h.hash) AS hash, coalesce(c.text, h.text) AS text, h.score, c.hash IS NOT NULL AS from_summary FROM h LEFT JOIN c ON c.collection_id = h.collection_id AND h.is_summary AND c.hash = h.parent_hash)
SELECT collection_id, hash, text, round(score, 6) AS score, from_summary FROM j QUALIFY row_number() OVER (PARTITION BY collection_id, hash ORDER BY score DESC, from_summary DESC) = 1""")
def parent_expansion(spark, d):
    c = _chunks(spark, d)
    return joins.expanded_parents(joins.above(c, 0.1), c).select("collection_id", "hash", "text", r6("score").alias("score"), "from_summary")


def _links(spark, d) -> DataFrame:
    c = _chunks(spark, d)
    return c.select("hash", (F.col("hash") * 7 % 500).alias("target_hash"), F.when(F.col("hash") % 2 == 0, "soft").otherwise("force").alias("mode"))


_LINKS = "SELECT doc_id AS hash, doc_id * 7 % 500 AS target_hash, CASE WHEN doc_id % 2 = 0 THEN 'soft' ELSE 'force' END AS mode FROM documents"


@query(f"""WITH h AS ({_HITS}), l AS ({_LINKS}), v AS (SELECT target_hash, count(*) * 0.15::DOUBLE AS b FROM l WHERE mode = 'soft' AND hash IN (SELECT hash FROM h) GROUP BY 1)
SELECT hash, round(CASE WHEN b IS NULL THEN score ELSE least(1, score + b) END, 6) AS score, round(coalesce(b, 0), 6) AS link_boost FROM h LEFT JOIN v ON v.target_hash = h.hash""")
def soft_links(spark, d):
    out = joins.soft_linked(joins.above(_chunks(spark, d), 0.1), _links(spark, d))
    return out.select("hash", r6("score").alias("score"), r6("link_boost").alias("link_boost"))


@query(f"WITH h AS ({_HITS}), l AS ({_LINKS}) SELECT hash, text, 1.0::DOUBLE AS score FROM ({_CHUNKS}) WHERE hash IN (SELECT target_hash FROM l WHERE mode = 'force' AND hash IN (SELECT hash FROM h)) AND hash NOT IN (SELECT hash FROM h)")
def force_links(spark, d):
    c = _chunks(spark, d)
    return joins.force_linked(joins.above(c, 0.1), _links(spark, d), c).select("hash", "text", "score")


@query("SELECT d.doc_id FROM documents d WHERE md5(d.text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') AND source <> 'src0'")
def context_anti_join(spark, d):
    docs = table(spark, d, "documents").withColumn("hash", F.md5(F.col("text").cast("binary")))
    return joins.not_in_context(docs.where("source <> 'src0'"), docs.where("source = 'src0'")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0' AND doc_id > (SELECT max(doc_id) FROM documents WHERE source = 'src0') - 500 AND text IS NOT NULL) AND source <> 'src0'")
def context_depth(spark, d):
    """As context_anti_join, against the places of the last 500 only."""
    docs = table(spark, d, "documents").withColumn("hash", F.md5(F.col("text").cast("binary")))
    return joins.not_in_context(docs.where("source <> 'src0' AND text IS NOT NULL"), docs.where("source = 'src0'"), depth=500, order="doc_id").select("doc_id")


@query(f"SELECT hash, round(CASE WHEN collection_id IN ('src3', 'src5') THEN 1 ELSE score END, 6) AS score, round(score, 6) AS original_score FROM ({_HITS})")
def keyword_boost(spark, d):
    c = joins.above(_chunks(spark, d), 0.1).withColumn("keywords", F.array(F.upper("collection_id")))
    return joins.keyword_boosted(c, ["src3", "SRC5"]).select("hash", r6("score").alias("score"), r6("original_score").alias("original_score"))


@query(f"""WITH h AS (SELECT * FROM ({_CHUNKS}) WHERE score >= 0.5), c AS (SELECT collection_id, '<col>' || chr(10) || string_agg('note' || chr(10) || text, chr(10) || chr(10) ORDER BY score DESC, hash) || chr(10) || '</col>' AS t, max(score) AS best FROM h GROUP BY 1)
SELECT '<mem>' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY best DESC, collection_id) || chr(10) || '</mem>' AS context FROM c""")
def context_text(spark, d):
    c = joins.above(_chunks(spark, d), 0.5).withColumns({"context": F.lit("note"), "xml_tag": F.lit(None).cast("string"), "collection_context": F.lit(""), "collection_tag": F.lit("col")})
    return context.assembled(c, global_tag="mem")


@query("SELECT hash, CASE WHEN score < 0.25 THEN 'Below threshold' WHEN hash % 2 = 1 THEN 'Failed conditions' WHEN hash % 4 = 2 THEN 'Not injected' END AS reason FROM (" + _CHUNKS + ")")
def exclusion_reasons(spark, d):
    c = _chunks(spark, d)
    a = joins.above(c)
    p = a.where("hash % 2 = 0")
    return joins.exclusion_reason(c, a, p, p.where("hash % 4 = 0"))


@query("SELECT doc_id AS hash, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def store_sync(spark, d):
    h = lambda t: table(spark, d, t).select(F.col("doc_id").alias("hash"))
    return joins.out_of_step(h("documents"), h("labels"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def paged_scan(spark, d):
    return joins.pages_of(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], 50, 25)


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'both' AS kind, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def set_operations(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.union(b).distinct(), "either")).unionByName(n(a.subtract(b), "only_a")).unionByName(n(a.unionByName(b), "all"))


# wiki and catalog


def _pages(spark, d) -> DataFrame:
    p = table(spark, d, "pages")
    host = F.parse_url("url", F.lit("HOST"))
    return p.select(
        F.col("page_id").cast("string").alias("key"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("library_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), "url",
        F.array(F.regexp_extract("html", 'lang="([a-z]+)"', 1)).alias("categories"), F.length("html").cast("long").alias("size_bytes"), (F.col("page_id") % 2).cast("int").alias("content_fetched"),
        F.col("html").alias("content"), F.col("html").alias("plaintext"), F.col("page_id").alias("fetched_at"),
    )


_PAGES = r"""SELECT page_id::VARCHAR AS key, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '([^.]+\.[^.]+)$', 1) AS library_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS cat, length(html) AS size,
CASE WHEN length(html) >= 20480 THEN 'gt20k' WHEN length(html) >= 5120 THEN '5to20k' WHEN length(html) >= 1024 THEN '1to5k' ELSE 'lt1k' END AS bucket, page_id % 2 AS fetched FROM pages"""


@query(f"""WITH p AS ({_PAGES}), x AS (SELECT *, cat IN ('en', 'fr') AS c, bucket IN ('1to5k', '5to20k') AS b, fetched = 1 AS f FROM p)
SELECT 'categories' AS facet, cat AS value, count(*) AS n FROM x WHERE b AND f GROUP BY ALL UNION ALL SELECT 'size', bucket, count(*) FROM x WHERE c AND f GROUP BY ALL
UNION ALL SELECT 'fetched', CASE WHEN f THEN 'fetched' ELSE 'unfetched' END, count(*) FROM x WHERE c AND b GROUP BY ALL UNION ALL SELECT 'libraries', library_id, count(*) FROM x WHERE c AND b AND f GROUP BY ALL""")
def wiki_facets(spark, d):
    return wiki.facets(_pages(spark, d), ["en", "fr"], ["1to5k", "5to20k"], True)


@query(rf"""SELECT key, title FROM ({_PAGES}) WHERE len(list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda t: starts_with(t, 'th'))) > 0 AND len(list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda t: starts_with(t, 'er'))) > 0""")
def wiki_search(spark, d):
    return wiki.searched(_pages(spark, d), "Th er")[0].select("key", "title")


@query(f"""WITH p AS ({_PAGES}), n AS (SELECT key, 'new ' || key AS title, CASE WHEN key::INT % 3 = 0 THEN 1 ELSE 0 END AS fetched FROM p WHERE key::INT % 5 = 0 UNION ALL SELECT 'x' || key, 'new', 0 FROM p WHERE key::INT % 50 = 0)
SELECT coalesce(n.key, p.key) AS key, CASE WHEN n.key IS NULL THEN p.title ELSE n.title END AS title, (CASE WHEN n.key IS NULL OR (n.fetched = 0 AND p.fetched = 1) THEN p.fetched ELSE n.fetched END)::INT AS content_fetched, CASE WHEN p.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'kept' ELSE 'updated' END AS status FROM p FULL JOIN n ON n.key = p.key""")
def page_upsert(spark, d):
    p = _pages(spark, d).select("key", "title", "content_fetched", "content")
    k = F.col("key").cast("int")
    some = p.where(k % 5 == 0).select("key", F.concat(F.lit("new "), "key").alias("title"), F.when(k % 3 == 0, 1).otherwise(0).alias("content_fetched"), F.lit("c").alias("content"))
    more = p.where(k % 50 == 0).select(F.concat(F.lit("x"), "key").alias("key"), F.lit("new").alias("title"), F.lit(0).alias("content_fetched"), F.lit("c").alias("content"))
    return wiki.upserted(p, some.unionByName(more)).drop("content")


@query(f"SELECT library_id, count(*) AS pages, sum(size)::BIGINT AS chars FROM ({_PAGES}) GROUP BY 1")
def library_usage(spark, d):
    return _pages(spark, d).groupBy("library_id").agg(F.count("*").alias("pages"), F.sum("size_bytes").alias("chars"))


@query("SELECT s_suppkey, 'mem_document_standard_h_' || substr(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]+', '_', 'g'), 1, 50) || '_' || s_suppkey AS collection_id, 'document' AS type, 'character' AS scope, 'standard' AS backend FROM supplier")
def collection_ids(spark, d):
    s = table(spark, d, "supplier")
    cid = catalog.collection_id("document", "standard", F.lit("h"), F.col("s_name"), F.col("s_suppkey"))
    p = catalog.parsed_id(F.col("collection_id"))
    return s.select("s_suppkey", cid.alias("collection_id")).select("s_suppkey", "collection_id", p["type"].alias("type"), p["scope"].alias("scope"), p["backend"].alias("backend"))


@query("SELECT 'src' || k AS collection_id, coalesce(n, 0)::BIGINT AS chunk_count FROM (SELECT unnest(range(0, 25)) AS k) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) ON source = 'src' || k")
def collection_counts(spark, d):
    reg = spark.range(25).select(F.concat(F.lit("src"), "id").alias("collection_id"))
    return catalog.with_counts(reg, table(spark, d, "documents").withColumnRenamed("source", "collection_id"))


@query("SELECT r_name AS chat, list(n_name ORDER BY n_name) AS collections FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def lock_index(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return catalog.locks_index(n.select(F.col("n_name").alias("collection_id"), F.array("r_name").alias("chat_locks")))


@query("SELECT event_id, user_id, round(sum(value) OVER w, 2) AS sum_value, min(value) OVER w AS min_value, max(value) OVER w AS max_value, count(*) OVER w AS in_window FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def query_metrics(spark, d):
    out = catalog.query_metrics(table(spark, d, "events"), "user_id", "event_id", "value")
    return out.select("event_id", "user_id", F.round(F.col("avg_value") * F.col("in_window"), 2).alias("sum_value"), "min_value", "max_value", "in_window")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_per_group(spark, d):
    return joins.top_per(table(spark, d, "orders"), ["o_custkey"], 2, "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


