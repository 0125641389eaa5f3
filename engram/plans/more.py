"""More queries: composites, browsing, ingest helpers, catalog, joins of the live sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bloom, hashing, scoring, text as tx, vectors
from ..operators import reformat, bm25, browse, catalog, chunking, context, events, joins, keywords, retrieval, rules, wiki
from .registry import _CHUNKS, _EVENTS, _HITS, _LINKS, _PAGES, _Q, _TOK, _bm25_sql, _chunks, _events, _item_terms, _links, _pages, _query_vector, _simple, query, r6, table

# searches with many queries


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10""")
def knn_many(spark, d):
    """Every vector whose id is divisible by 20 against all vectors."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest_many(e, asked, 10, "vec_id", "embedding").withColumn("score", r6("score"))


@query(f"""WITH q AS (SELECT item_id, unnest(t) AS term, len(t) AS m FROM (SELECT item_id, list_distinct({_TOK}) AS t FROM benchmark)),
d AS (SELECT doc_id, list_distinct({_TOK}) AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d),
i AS (SELECT term, greatest(0, ln((n - count(*) + 0.5) / (count(*) + 0.5))) + 0.5 AS idf FROM p, n GROUP BY term, n),
s AS (SELECT item_id, doc_id, round(sum(idf * ln(2) * 2.5 / (ln(2) + 1.5 * (0.25 + 0.75 * l / avgdl))) * (1 + 0.1 * count(*) / m), 9) AS score FROM q JOIN p USING (term) JOIN i USING (term), n GROUP BY item_id, doc_id, m)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def bm25_many(spark, d):
    """Every benchmark item as a query against all documents."""
    out = bm25.bm25_many(table(spark, d, "documents"), table(spark, d, "benchmark"), 10, "doc_id", _simple(), "item_id", _simple())
    return out.withColumn("score", r6("score"))


# one collection, all collections


def _scored_chunks(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return table(spark, d, "documents").join(e, "doc_id").select(F.col("doc_id").alias("hash"), "text", "source", "vector", F.array_distinct(_simple()).alias("tokens"))


_VECTORS = f"SELECT doc_id AS id, text, source, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM documents JOIN embeddings ON vec_id = doc_id"
_RRF = """j AS (SELECT coalesce(v.id, t.id) AS id, coalesce(v.score, 0) AS vs, coalesce(t.score / (t.score + 3), 0) AS ts, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS rrf FROM v FULL JOIN t ON v.id = t.id),
k AS (SELECT *, rrf / max(rrf) OVER () AS f FROM j),
o AS (SELECT id, least(1, CASE WHEN vs > 0.01 AND ts > 0.01 THEN (0.55 * vs + 0.45 * ts) * (1 + 0.08 * least(vs, ts)) * (0.95 + 0.05 * f) WHEN vs > 0.01 THEN vs * 0.55 * (0.9 + 0.1 * f) WHEN ts > 0.01 THEN ts * 0.6 * (0.9 + 0.1 * f) ELSE 0.25 * f END) AS score FROM k)"""
_RANK = "row_number() OVER (ORDER BY score DESC, id) AS rank"


def _local(sql: str) -> str:
    """The text scores among the candidates c instead of all documents."""
    return sql.replace("FROM documents", "FROM (SELECT id AS doc_id, text, source FROM c)")


@query(f"""WITH c AS (SELECT * FROM ({_VECTORS}) ORDER BY score DESC, id LIMIT 20), t AS (SELECT doc_id AS id, score AS b FROM ({_local(_bm25_sql(False))})),
j AS (SELECT c.id, score, coalesce(b, 0) AS b FROM c LEFT JOIN t ON c.id = t.id)
SELECT id AS hash, round(0.5 * score + 0.5 * b / greatest(max(b) OVER (), 0.0001), 6) AS score FROM j ORDER BY 0.5 * score + 0.5 * b / greatest(max(b) OVER (), 0.0001) DESC, id LIMIT 10""")
def query_collection_rescored(spark, d):
    return retrieval.query_collection(_scored_chunks(spark, d), _query_vector(spark, d), _item_terms(spark, d), 10).select("hash", r6("score").alias("score"))


@query(f"""WITH c AS (SELECT * FROM ({_VECTORS}) ORDER BY score DESC, id LIMIT 30), v AS (SELECT id, score, {_RANK} FROM c), t0 AS (SELECT doc_id AS id, score FROM ({_local(_bm25_sql(False))})),
t AS (SELECT *, {_RANK} FROM t0), {_RRF} SELECT id AS hash, round(score, 6) AS score FROM o ORDER BY o.score DESC, id LIMIT 10""")
def query_collection_hybrid(spark, d):
    return retrieval.query_collection(_scored_chunks(spark, d), _query_vector(spark, d), _item_terms(spark, d), 10, "hybrid").select("hash", r6("score").alias("score"))


@query(f"""WITH c AS (SELECT * FROM ({_VECTORS})), v AS (SELECT id, score, {_RANK} FROM (SELECT * FROM c ORDER BY score DESC, id LIMIT 30)), t0 AS (SELECT doc_id AS id, score FROM ({_local(_bm25_sql(False))}) ORDER BY score DESC, id LIMIT 30),
t AS (SELECT *, {_RANK} FROM t0), {_RRF} SELECT id AS hash, round(score, 6) AS score FROM o ORDER BY o.score DESC, id LIMIT 10""")
def query_collection_native(spark, d):
    return retrieval.query_collection(_scored_chunks(spark, d), _query_vector(spark, d), _item_terms(spark, d), 10, native=True).select("hash", r6("score").alias("score"))


@query(f"SELECT source, id AS hash, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM ({_VECTORS}) QUALIFY rank <= 5")
def query_collections(spark, d):
    return retrieval.query_collections(_scored_chunks(spark, d), "source", _query_vector(spark, d), 5).select("source", "hash", r6("score").alias("score"), "rank")


_CANDIDATES = f"SELECT * FROM ({_CHUNKS}) QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY score DESC, hash) <= 10"


def _candidates(spark, d) -> DataFrame:
    return joins.top_per(_chunks(spark, d), ["collection_id"], 10).drop("rank").withColumn("keywords", F.array(F.upper("collection_id")))


@query(f"""WITH c AS ({_CHUNKS}), a AS (SELECT * REPLACE (CASE WHEN collection_id = 'src3' THEN 1 ELSE score END AS score) FROM ({_CANDIDATES})),
e AS (SELECT a.collection_id, coalesce(c.hash, a.hash) AS hash, coalesce(c.text, a.text) AS text, a.score, c.hash IS NOT NULL AS f FROM a LEFT JOIN c ON c.collection_id = a.collection_id AND a.is_summary AND c.hash = a.parent_hash),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY collection_id, hash ORDER BY score DESC, f DESC) = 1),
h AS (SELECT * FROM b WHERE score >= 0.5 AND length(text) > 200), l AS ({_LINKS}),
v AS (SELECT target_hash, count(*) * 0.15::DOUBLE AS x FROM l WHERE mode = 'soft' AND hash IN (SELECT hash FROM h) GROUP BY 1),
o AS (SELECT hash, text, CASE WHEN x IS NULL THEN score ELSE least(1, score + x) END AS score FROM h LEFT JOIN v ON v.target_hash = h.hash
    UNION ALL SELECT hash, text, 1 FROM c WHERE hash IN (SELECT target_hash FROM l WHERE mode = 'force' AND hash IN (SELECT hash FROM h)) AND hash NOT IN (SELECT hash FROM h))
SELECT hash, text, round(score, 6) AS score FROM o WHERE hash NOT IN (SELECT doc_id FROM labels)""")
def chunk_retrieval(spark, d):
    """All stages from candidates of every collection to what goes into context; the labelled documents are in view already."""
    c = _chunks(spark, d).withColumn("keywords", F.array(F.upper("collection_id")))
    recent = table(spark, d, "labels").select(F.col("doc_id").alias("hash"))
    out = retrieval.chunk_retrieval(_candidates(spark, d), c, _links(spark, d), recent, ["src3"], 0.5, F.length("text") > 200)
    return out.select("hash", "text", r6("score").alias("score"))


@query(f"SELECT collection_id, hash, round(score, 6) AS score, row_number() OVER (PARTITION BY collection_id ORDER BY score DESC, hash) AS rank FROM ({_CHUNKS}) WHERE score >= 0.5 AND collection_id IN ('src3', 'src5') QUALIFY rank <= 4")
def search_collections(spark, d):
    c = _chunks(spark, d).withColumn("keywords", F.array(F.upper("collection_id")))
    return retrieval.search_collections(c, "src3, SRC5", 0.5, top_k=4).select("collection_id", "hash", r6("score").alias("score"), "rank")


@query(f"""WITH h AS (SELECT 'a' AS lookup, collection_id AS book, hash AS uid, text, score FROM ({_CHUNKS}) UNION ALL SELECT 'b', collection_id, hash, text, 1 - score FROM ({_CHUNKS})),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lookup, book ORDER BY score DESC, uid) <= 3), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY book, uid ORDER BY score DESC, lookup) = 1),
s AS (SELECT * FROM b WHERE score >= 0.3 * 0.8 AND uid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) NOT IN (SELECT lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)),
e AS (SELECT source AS book, d.doc_id AS uid, 'now ' || lang AS content, quality IS NOT DISTINCT FROM 0 AS disabled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT s.book, s.uid, round(s.score, 6) AS score, coalesce(CASE WHEN trim(content) <> '' THEN content END, s.text) AS text FROM s LEFT JOIN e ON e.book = s.book AND e.uid = s.uid WHERE s.book = 'src1' OR (e.uid IS NOT NULL AND NOT disabled)""")
def lorebook_retrieval(spark, d):
    """Two lookups of every source as a book, of which src1 can't be read; toxic entries are active already, bad ones are disabled."""
    c = _chunks(spark, d).select(F.col("collection_id").alias("book"), F.col("hash").alias("uid"), "text", "score")
    hits = c.withColumn("lookup", F.lit("a")).unionByName(c.withColumns({"score": 1 - F.col("score"), "lookup": F.lit("b")}))
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    active = docs.join(labels.where("toxic = 1"), "doc_id").select(F.col("doc_id").alias("uid"), "text")
    entries = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(F.col("source").alias("book"), F.col("doc_id").alias("uid"), F.concat(F.lit("now "), "lang").alias("content"), F.col("quality").eqNullSafe(F.lit(0)).alias("disabled"))
    books = docs.where("source <> 'src1'").select(F.col("source").alias("book"))
    return retrieval.lorebook_retrieval(hits, active, entries, books, fused=True).select("book", "uid", r6("score").alias("score"), "text")


@query(f"""WITH n AS (SELECT count(*) AS n FROM events), e AS ({_EVENTS}), a AS (SELECT event_id, row_number() OVER (ORDER BY score DESC, event_id) AS r FROM e ORDER BY score DESC, event_id LIMIT 160),
b AS (SELECT event_id, row_number() OVER (ORDER BY s DESC, event_id) AS r FROM (SELECT event_id, 1 / (1 + abs(score - 0.5)) AS s FROM e) ORDER BY s DESC, event_id LIMIT 160),
f AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(1.0::DOUBLE / (1 + a.r), 0) + coalesce(1.0::DOUBLE / (1 + b.r), 0) AS sim FROM a FULL JOIN b ON a.event_id = b.event_id ORDER BY sim DESC, 1 LIMIT 40)
SELECT event_id, round(0.55 * sim + 0.2 * importance / 10 + 0.15 * persist::INT + 0.1 * pow(0.5, greatest(0, n - wend) / greatest(40, 0.2 * n)), 6) AS score FROM f JOIN e USING (event_id), n WHERE importance >= 3 AND wend < n - 50
ORDER BY 0.55 * sim + 0.2 * importance / 10 + 0.15 * persist::INT + 0.1 * pow(0.5, greatest(0, n - wend) / greatest(40, 0.2 * n)) DESC, event_id LIMIT 10""")
def formula_rerank(spark, d):
    e = _events(spark, d)
    n = e.count()
    other = e.select("event_id", (1 / (1 + F.abs(F.col("score") - 0.5))).alias("score"))
    return retrieval.formula_reranked(e.select("event_id", "score"), other, e, n, 10, depth=50, least_importance=3).select("event_id", r6("score").alias("score"))


@query(r"""SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS chunk_index, unnest(p) AS text, title AS entry_name, 'document' AS content_type, 'corpus' AS source_name, 0 AS n_keywords
FROM (SELECT doc_id, source || ' ' || doc_id AS title, [regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')] AS p FROM documents WHERE regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') <> '')
QUALIFY row_number() OVER (PARTITION BY p[1] ORDER BY doc_id) = 1 AND p[1] NOT IN (SELECT regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') FROM documents WHERE source = 'src0' AND text IS NOT NULL)""")
def content_ingest(spark, d):
    """Whole documents as chunks of which those of src0 are stored; of equal texts the first in order is taken."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "doc_id").alias("page_title"), "source")
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    stored = docs.where("source = 'src0'").select(hashing.content_hash(trimmed).alias("hash"))
    firsts = docs.withColumn("_h", trimmed).where("_h <> ''").groupBy("_h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    out = retrieval.ingested(docs.join(firsts, "doc_id").drop("source"), stored, "doc_id", "per_message", "document", "corpus", level="off")
    return out.select("doc_id", "chunk_index", "text", "entry_name", "content_type", "source_name", F.size("keywords").alias("n_keywords"))


# browsing and gathers


@query("SELECT doc_id AS hash, length(text)::INT AS n_chars FROM documents WHERE (contains(lower(text), 'that') OR contains(lower(source), 'that')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY n_chars DESC, hash LIMIT 100")
def chunk_list(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    c = c.select(F.col("doc_id").alias("hash"), "text", F.col("source").alias("entry_name"), F.array("source").alias("keywords"), (F.col("quality") == 0).alias("disabled"))
    return browse.chunk_list(c, " That ", "enabled", "length").select("hash", "n_chars").limit(100)


_REGISTRY = "SELECT 'mem_' || CASE n_nationkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'lorebook' ELSE 'eventbase' END || '_' || lower(n_name) AS collection_id, n_name AS book, n_nationkey % 4 <> 0 AS enabled, CASE WHEN n_regionkey < 3 THEN [r_name] ELSE [] END AS chat_locks, CASE WHEN n_nationkey % 5 = 0 THEN ['ann'] ELSE [] END AS character_locks FROM nation JOIN region ON r_regionkey = n_regionkey"


def _registry(spark, d) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    kind = F.element_at(F.array(F.lit("document"), F.lit("lorebook"), F.lit("eventbase")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    return n.select(
        F.concat(F.lit("mem_"), kind, F.lit("_"), F.lower("n_name")).alias("collection_id"), F.col("n_name").alias("book"), (F.col("n_nationkey") % 4 != 0).alias("enabled"),
        F.when(F.col("n_regionkey") < 3, F.array("r_name")).otherwise(none).alias("chat_locks"), F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("ann"))).otherwise(none).alias("character_locks"),
    )


@query(f"""WITH r AS ({_REGISTRY}) SELECT 'global' AS list, collection_id FROM r WHERE len(chat_locks) = 0 AND len(character_locks) = 0 UNION ALL SELECT 'chat', collection_id FROM r WHERE len(chat_locks) > 0
UNION ALL SELECT 'active', collection_id FROM r WHERE enabled AND ((len(chat_locks) = 0 AND len(character_locks) = 0) OR list_contains(chat_locks, 'ASIA') OR list_contains(character_locks, 'ann'))""")
def collection_list(spark, d):
    r = _registry(spark, d)
    out = [("global", browse.collection_list(r, "global")), ("chat", browse.collection_list(r, "chat")), ("active", browse.collection_list(r, active_only=True, chat_id="ASIA", character_id="ann"))]
    parts = [df.select(F.lit(n).alias("list"), "collection_id") for n, df in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH r AS ({_REGISTRY}) SELECT 'events' AS list, collection_id FROM r WHERE starts_with(collection_id, 'mem_eventbase_') AND enabled AND list_contains(chat_locks, 'ASIA')
UNION ALL SELECT 'lorebooks', collection_id FROM r WHERE starts_with(collection_id, 'mem_lorebook_') AND enabled AND ((len(chat_locks) = 0 AND len(character_locks) = 0) OR list_contains(chat_locks, 'AMERICA')) AND NOT starts_with(lower(book), 'ca')""")
def collection_gathers(spark, d):
    r = _registry(spark, d)
    e, b = browse.gathered(r, "mem_eventbase_", "ASIA"), browse.lorebook_gather(r, "mem_lorebook_", ["CA"], "AMERICA")
    return e.select(F.lit("events").alias("list"), "collection_id").unionByName(b.select(F.lit("lorebooks").alias("list"), "collection_id"))


@query(f"WITH r AS ({_REGISTRY}) SELECT collection_id FROM r WHERE enabled AND starts_with(collection_id, 'mem_document_')")
def queried_collections(spark, d):
    return catalog.queried(_registry(spark, d).where(~F.startswith("collection_id", F.lit("mem_eventbase_")))).select("collection_id")


@query(f"""WITH r AS ({_REGISTRY}) SELECT 'locked' AS op, collection_id, CASE WHEN collection_id = 'mem_document_algeria' AND NOT list_contains(chat_locks, 'x') THEN list_append(chat_locks, 'x') ELSE chat_locks END AS locks, enabled FROM r
UNION ALL SELECT 'unlocked', collection_id, CASE WHEN collection_id = 'mem_document_algeria' THEN list_filter(chat_locks, lambda x: x <> 'AFRICA') ELSE chat_locks END, enabled FROM r
UNION ALL SELECT 'set', collection_id, chat_locks, CASE WHEN collection_id = 'mem_document_algeria' THEN true ELSE enabled END FROM r""")
def lock_changes(spark, d):
    r, one = _registry(spark, d), "mem_document_algeria"
    out = [("locked", catalog.locked(r, one, "x")), ("unlocked", catalog.locked(r, one, "AFRICA", on=False)), ("set", catalog.set_metadata(r, one, enabled=True))]
    parts = [df.select(F.lit(n).alias("op"), "collection_id", F.col("chat_locks").alias("locks"), "enabled") for n, df in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH r AS ({_REGISTRY}), m AS (SELECT * FROM r WHERE length(collection_id) % 2 = 0) SELECT 'orphan' AS op, collection_id FROM r WHERE collection_id NOT IN (SELECT collection_id FROM m)
UNION ALL SELECT 'renamed', collection_id FROM r WHERE book NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 2) UNION ALL SELECT 'registered', collection_id FROM r UNION ALL SELECT 'left', collection_id FROM r WHERE collection_id NOT IN (SELECT collection_id FROM m)""")
def registry_changes(spark, d):
    r = _registry(spark, d)
    m = r.where(F.length("collection_id") % 2 == 0)
    keyed = lambda x: x.select(F.col("collection_id").alias("registry_key"), "collection_id")
    books = table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("name"))
    blank = spark.createDataFrame([(None, "a"), (" ", "b")], "registry_key string, collection_id string")
    added = catalog.cleaned_registry(catalog.registered(keyed(m), keyed(r).unionByName(keyed(r))).unionByName(blank))
    out = [("orphan", catalog.orphans(r, m)), ("renamed", catalog.renamed_books(r, books)), ("registered", added), ("left", catalog.unregistered(keyed(r), keyed(m)))]
    parts = [df.select(F.lit(n).alias("op"), "collection_id") for n, df in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH r AS ({_REGISTRY}) SELECT collection_id, CASE WHEN n % 7 = 0 THEN 'chat' ELSE CASE WHEN contains(collection_id, 'eventbase') THEN 'chat' ELSE 'character' END END AS scope,
coalesce(enabled, true) AND CASE WHEN n % 7 = 0 OR contains(collection_id, 'eventbase') THEN list_contains(chat_locks, 'ASIA') ELSE list_contains(character_locks, 'ann') OR list_contains(chat_locks, 'ASIA') END AS is_active FROM (SELECT *, length(collection_id) AS n FROM r)""")
def collection_metadata(spark, d):
    r = _registry(spark, d)
    meta = r.select("collection_id", "enabled", "chat_locks", "character_locks", F.when(F.length("collection_id") % 7 == 0, "chat").otherwise("nonsense").alias("scope"))
    return catalog.with_metadata(r.select("collection_id"), meta, "ASIA", "ann").select("collection_id", "scope", "is_active")


@query("""SELECT s_name AS cid, CASE WHEN s_suppkey % 4 = 0 THEN 'malformed' WHEN s_suppkey % 4 = 1 THEN 'foreign' WHEN s_suppkey % 4 = 2 THEN 'internal' END AS reason, replace('mem_document_standard_h_' || s_suppkey, 'standard', 'qdrant') AS moved FROM supplier""")
def collection_id_checks(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 4
    cid = F.when(k == 0, F.concat("s_name", F.lit(" x"))).when(k == 1, F.lit("other_1")).when(k == 2, F.lit("mem_internal_a")).otherwise(F.lit("mem_document_a"))
    own = catalog.collection_id("document", "standard", F.lit("h"), F.lit(None).cast("string"), F.col("s_suppkey"))
    return s.select(F.col("s_name").alias("cid"), catalog.rejection(cid).alias("reason"), F.regexp_replace(catalog.remapped(own, "qdrant"), "_h__", "_h_").alias("moved"))


# events, windows, archives


@query(f"SELECT event_id FROM (SELECT * FROM ({_EVENTS}) WHERE importance >= 3) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, event_id) <= 5")
def stored_events(spark, d):
    return browse.most_important(browse.worth_storing(_events(spark, d)), ["user_id"], 5).select("event_id")


@query("WITH w AS (SELECT user_id, event_id, event_type = 'click' AS done FROM events) SELECT user_id, event_id FROM w WHERE event_id >= (SELECT min(event_id) FROM w o WHERE o.user_id = w.user_id AND NOT done)")
def fast_forward(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    done = e.where("event_type = 'click'").select("event_id")
    return browse.fast_forwarded(e, done, "event_id", "user_id", "event_id").select("user_id", "event_id")


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role <> 'user') AS character_messages FROM conversations GROUP BY 1")
def archive_statistics(spark, d):
    return browse.archive_statistics(table(spark, d, "conversations"), ["conv_id"], F.col("role") == "user")


@query("SELECT event_type, count(*) AS query_count, max(event_id) AS last_used FROM events GROUP BY 1")
def usage_counters(spark, d):
    return browse.usage(table(spark, d, "events"), "event_type", "event_id")


@query(f"WITH c AS ({_CHUNKS}) SELECT count(*) AS candidates, count(*) FILTER (score >= 0.55) AS above, count(*) FILTER (score < 0.55 AND score >= 0.55 - 0.1) AS just_missed, count(*) FILTER (hash IN (SELECT doc_id FROM labels)) AS injected FROM c")
def stage_statistics(spark, d):
    return browse.stage_statistics(_chunks(spark, d), 0.55, table(spark, d, "labels").select(F.col("doc_id").alias("hash")))


@query("SELECT doc_id, sha1(text) AS archive_id FROM documents")
def archive_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", browse.archive_id(F.col("text")).alias("archive_id"))


@query("SELECT conv_id, CASE WHEN count(*) >= 3 THEN ((count(*) - 3) // 2) * 2 END AS start FROM conversations GROUP BY 1")
def last_window(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", chunking.last_window_start(F.col("n"), 3, 1).alias("start"))


@query("SELECT user_id, string_agg(h, ',' ORDER BY h) AS fingerprint FROM (SELECT user_id, event_id::VARCHAR AS h FROM events) GROUP BY user_id")
def window_fingerprints(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("h")).select("user_id", hashing.window_fingerprint(F.col("h")).alias("fingerprint"))


@query("""SELECT event_id, CASE WHEN event_type IN ('combat', 'travel') THEN event_type ELSE 'other' END AS event_type, CASE WHEN event_id % 5 = 0 THEN 5 ELSE greatest(1, least(10, round(value / 10)))::INT END AS importance, 'saw ' || event_type AS summary,
CASE WHEN event_id % 3 = 0 THEN ['k', 'x'] ELSE ['k'] END AS keywords, event_type = 'purchase' AS should_persist FROM events WHERE event_type <> 'view'""")
def validated_events(spark, d):
    e = table(spark, d, "events")
    none = F.array().cast("array<string>")
    raw = e.select(
        "event_id", F.concat(F.lit(" "), "event_type").alias("event_type"), F.when(F.col("event_id") % 5 == 0, "much").otherwise((F.col("value") / 10).cast("string")).alias("importance"),
        F.when(F.col("event_type") != "view", F.concat(F.lit(" saw "), "event_type", F.lit(" "))).alias("summary"), F.lit("no date").alias("date_time"), F.lit(None).cast("string").alias("cause"), F.lit("r").alias("result"),
        F.when(F.col("event_type") == "purchase", True).alias("should_persist"), none.alias("characters"), none.alias("locations"), none.alias("factions"), none.alias("items"), none.alias("open_threads"),
        F.array(F.lit("k "), F.lit(""), F.lit("k"), F.lit(None)).alias("keywords"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("K"), F.lit("x"))).otherwise(none).alias("concepts"),
    )
    return events.validated(raw).select("event_id", "event_type", "importance", "summary", "keywords", "should_persist")


@query(f"SELECT event_id, round((2 + (event_id % 10)) * 0.2 / 3, 6) AS weight, round(CASE WHEN kw = '1' THEN 1.0 ELSE 1.0::DOUBLE / 3 END, 6) AS overlap FROM ({_EVENTS})")
def score_functions(spark, d):
    e = _events(spark, d)
    kw = F.col("keywords")[0]
    a, b = F.array(kw, F.lit("Ann")), F.array(F.lit("1"), F.lit("aNN"))
    weight = (scoring.keyword_weight(F.col("importance")) - 1.7) / 0.6 * 9 * 0.2 / 3 + 0.2 / 3 * 2
    return e.select("event_id", r6(weight).alias("weight"), r6(scoring.name_overlap(a, b)).alias("overlap"))


# rules


@query("""SELECT event_id, event_id % 100 <= 30 AS chance, event_type IN ('click', 'view') AS generation, event_id % 4 >= 2 AS swipes, user_id % 2 = 0 AS grouped, NOT (user_id % 2 = 0) AS not_grouped, contains(lower(event_type), 'ick') OR user_id::VARCHAR = '7' AS entry, event_id % 10 BETWEEN 3 AND 5 AS between_ FROM events""")
def rule_kinds(spark, d):
    e = table(spark, d, "events")
    cols = {
        "chance": (F.col("event_id") % 100).cast("double"), "generation_type": F.upper("event_type"), "swipe_count": F.col("event_id") % 4, "is_group_chat": F.col("user_id") % 2 == 0,
        "active_entries": F.array(F.struct(F.col("event_type").alias("key"), F.col("user_id").alias("uid"))), "message_count": F.col("event_id") % 10,
    }
    one = lambda kind, **s: rules.compile_rule({"type": kind, "settings": s}, cols)
    return e.select(
        "event_id", one("randomChance", probability=30).alias("chance"), one("generationType", values=["click", "View"]).alias("generation"), one("swipeCount", count=2).alias("swipes"), one("isGroupChat").alias("grouped"),
        one("isGroupChat", isGroup=False).alias("not_grouped"), one("lorebookActive", values=["ICK", "7"]).alias("entry"), one("messageCount", count=3, operator="between", upperBound=5).alias("between_"),
    )


@query("SELECT event_type AS type, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS negated FROM events GROUP BY 1")
def rule_counts(spark, d):
    e = table(spark, d, "events").select(F.array(F.struct(F.col("event_type").alias("type"), (F.col("event_id") % 2 == 0).alias("negate"))).alias("rules"))
    return rules.rule_counts(e)


# joins of the live sources


@query("SELECT d.doc_id AS hash, CASE WHEN d.lang = 'en' THEN d.text ELSE b.text END AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def backfilled_texts(spark, d):
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("hash"), F.when(F.col("lang") == "en", F.col("text")).otherwise(" ").alias("text"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("hash"), "text", F.lit(0).alias("idx"))
    return joins.backfilled(hits, b.unionByName(b.withColumns({"idx": F.lit(1), "text": F.lit("later")}))).select("hash", "text")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text HAVING text NOT IN (SELECT text FROM documents WHERE source = 'src2')")
def new_documents(spark, d):
    docs = table(spark, d, "documents").withColumn("hash", F.sha2("text", 256))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    return joins.new_only(first, docs.where("source = 'src2'").select("hash").distinct()).select("doc_id")


@query("""SELECT doc_id AS hash, CASE WHEN lang = 'en' THEN source ELSE 'local' END AS title, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 9 END AS depth FROM documents""")
def chunk_overrides(spark, d):
    docs = table(spark, d, "documents")
    c = docs.select(F.col("doc_id").alias("hash"), F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("title"), F.when(F.col("doc_id") % 2 == 0, 0).alias("depth"))
    o = docs.select(F.col("doc_id").alias("hash"), F.lit("local").alias("title"), F.lit(9).alias("depth"))
    return joins.overridden(c, o, ["title", "depth"])


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])I([^A-Za-z0-9_]|$)') AND NOT contains(text, 'the speaker') THEN '[Glossary: I = the speaker]' || chr(10) || text ELSE text END AS text FROM conversations""")
def glossary_lines(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    g = c.select("conv_id").distinct().select("conv_id", F.lit("I").alias("acronym"), F.lit("the speaker").alias("full_name"))
    return joins.glossary_injected(c, g, "conv_id").select("conv_id", "turn", "text")


@query(f"""WITH h AS ({_HITS}) SELECT CASE WHEN hash % 2 = 0 THEN 1 ELSE 0 END AS position, CASE WHEN hash % 2 = 0 THEN 4 ELSE 2 END AS depth, count(*) AS n FROM h GROUP BY 1, 2""")
def chunk_positions(spark, d):
    c = joins.above(_chunks(spark, d), 0.1).withColumns({"override_position": F.when(F.col("hash") % 2 == 0, 1), "collection_depth": F.when(F.col("hash") % 2 == 0, 4)})
    return context.position(c).groupBy("position", "depth").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def paged_with_total(spark, d):
    return joins.paged(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 40, 20)


# keywords and strings


@query(None)
def chat_keywords(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", keywords.chat_keywords(F.col("text")).alias("keywords"))


@query("SELECT p_partkey, [lower(p_brand), lower(p_type), lower(p_name)] AS keywords FROM part")
def lorebook_keywords(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", keywords.lorebook_keywords(F.array(F.concat(F.lit(" "), F.upper(c("p_brand"))), F.lit("the"), F.lit("x")), F.array("p_type", "p_brand", "p_name")).alias("keywords"))


@query("SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#12', 'brand#23')")
def keyword_filter(spark, d):
    return table(spark, d, "part").where(keywords.has_keyword(F.array("p_brand"), "BRAND#12, , brand#23")).select("p_partkey")


@query("SELECT vec_id, len(embedding)::INT AS dims, round(list_min(embedding), 6) AS least, round(list_max(embedding), 6) AS most, list_bool_and(list_transform(embedding, lambda x: x IN (0, 1))) AS is_binary, list_bool_and(list_transform(embedding, lambda x: x = floor(x))) AS is_quantized FROM embeddings")
def vector_profiles(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", vectors.profile(F.col("embedding")).alias("p"))
    return p.select("vec_id", "p.dims", F.round("p.least", 6).alias("least"), F.round("p.most", 6).alias("most"), "p.is_binary", "p.is_quantized")


@query(r"""SELECT doc_id, CASE WHEN lang IS NULL THEN NULL ELSE 'latin' END AS script FROM documents WHERE regexp_matches(text, '\p{L}') AND lang IS NOT NULL""")
def scripts(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    return docs.select("doc_id", tx.script_of(F.col("text")).alias("script"))


# wiki


@query(f"SELECT key AS page_id, min(title) AS title, list_sort(list_distinct([any_value(cat), any_value(library_id)])) AS categories FROM ({_PAGES}) WHERE regexp_matches(title, '[aeiou]') GROUP BY key")
def wiki_enumeration(spark, d):
    p = _pages(spark, d)
    w = p.select(F.col("key").alias("page_id"), "title", "categories").unionByName(p.select(F.col("key").alias("page_id"), "title", F.array("library_id").alias("categories"))).unionByName(p.select(F.col("key").alias("page_id"), "title", F.lit(None).cast("array<string>").alias("categories")))
    return browse.enumerated(w, "[aeiou]")


@query(f"SELECT lower(key) || '_x' AS asked, key AS title, size FROM ({_PAGES}) WHERE key::INT % 2 = 0")
def wiki_fetch(spark, d):
    p = _pages(spark, d)
    asked = p.select(F.concat("key", F.lit("_x")).alias("asked"))
    normalized = p.where(F.col("key").cast("int") % 2 == 0).select(F.concat("key", F.lit("_x")).alias("asked"), F.col("key").alias("title"))
    out = browse.fetched(asked, normalized, p.select(F.col("key").alias("title"), "content"))
    return out.select("asked", "title", F.length("content").alias("size"))


@query(f"SELECT library_id, key FROM ({_PAGES}) WHERE library_id = 'example.com' AND fetched = 1")
def library_pages(spark, d):
    return browse.library_pages(_pages(spark, d), "example.com", True).select("library_id", "key")


@query(f"SELECT key, title FROM ({_PAGES}) WHERE lower(replace(trim(title), '_', ' ')) = (SELECT min(lower(replace(trim(title), '_', ' '))) FROM ({_PAGES}))")
def title_lookup(spark, d):
    """Asked with a title as it is written: changing the case of its normal form would not always lead back to it."""
    p = _pages(spark, d)
    return browse.by_title(p, p.agg(F.min_by("title", browse.plain_title(F.col("title")))).first()[0]).select("key", "title")


@query(r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/?#]+') THEN list_transform(['/api.php', '/w/api.php', '/wiki/api.php'], lambda p: lower(regexp_extract(trim(url), '(?i)^(https?://[^/?#]+)', 1)) || p) ELSE [] END AS candidates FROM pages")
def api_candidates(spark, d):
    return table(spark, d, "pages").select("page_id", browse.api_candidates(F.col("url")).alias("candidates"))


@query(f"SELECT key, CASE WHEN key::INT % 3 = 0 THEN 'new' ELSE title END AS title FROM ({_PAGES})")
def page_contents(spark, d):
    p = _pages(spark, d).select("key", "title")
    changes = p.where(F.col("key").cast("int") % 3 == 0).select("key", F.lit("new").alias("title")).unionByName(spark.createDataFrame([("unknown", "x")], "key string, title string"))
    return wiki.updated(p, changes, ["title"])


@query(f"""WITH p AS ({_PAGES}), b AS (SELECT key AS page_key, library_id, title FROM p WHERE fetched = 1) SELECT 'basket' AS op, page_key, library_id, title FROM b UNION ALL SELECT 'left', page_key, library_id, title FROM b WHERE library_id <> 'example.com'""")
def wiki_basket(spark, d):
    p = _pages(spark, d)
    row = lambda at: p.where("content_fetched = 1").select(F.col("key").alias("page_key"), "library_id", (F.lit("later ") if at else F.lit("")).alias("_p"), "title", F.lit(at).alias("added_at")).select("page_key", "library_id", F.concat("_p", "title").alias("title"), "added_at")
    gone = spark.createDataFrame([("gone", "l", "t", 0)], "page_key string, library_id string, title string, added_at int")
    basket = wiki.basket_list(wiki.basket_added(row(0).unionByName(gone), row(1)), p)
    left = wiki.without_library(p, basket, "example.com")[1]
    cols = ["page_key", "library_id", "title"]
    return basket.select(F.lit("basket").alias("op"), *cols).unionByName(left.select(F.lit("left").alias("op"), *cols))


@query(f"""WITH p AS (SELECT key, library_id, title, html FROM ({_PAGES}) JOIN pages ON page_id::VARCHAR = key WHERE fetched = 1 AND library_id = 'example.com') SELECT md5(string_agg('# ' || title || chr(10) || chr(10) || html, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY title, html)) AS text, count(*) AS n FROM p""")
def basket_material(spark, d):
    p = _pages(spark, d).where("library_id = 'example.com'")
    basket = p.select(F.col("key").alias("page_key"), "library_id", "title", F.lit(0).alias("added_at"))
    return wiki.basket_text(basket, p).select(F.md5("text").alias("text"), F.size("fingerprints").cast("long").alias("n"))


@query(f"WITH p AS ({_PAGES}) SELECT key AS page_id, list_sort(list_distinct([cat, library_id])) AS categories FROM p")
def continued_categories(spark, d):
    p = _pages(spark, d).select(F.col("key").alias("page_id"), "title", "categories", "library_id")
    return wiki.continued(p.drop("library_id").unionByName(p.select("page_id", "title", F.array("library_id").alias("categories")))).select("page_id", "categories")


@query("SELECT doc_id, length(text)::INT AS chars, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '[\\s\\x0B]+'), lambda x: x <> '')) END::INT AS words FROM documents")
def text_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.char_count(F.col("text")).alias("chars"), tx.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def bloom_semi_join(spark, d):
    """A Bloom filter of the smaller side thins the larger one before the join."""
    wanted = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    bits, hashes = bloom.shape(wanted.count())
    thin = bloom.maybe_in(table(spark, d, "documents").select("doc_id"), "doc_id", bloom.build(wanted, "doc_id", bits, hashes), bits, hashes)
    return thin.join(wanted, "doc_id", "left_semi")


# reformat

_HEADED = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<[^>]*>', chr(2), 'g'), '\s+', ' ', 'g'), chr(2) || '[ ' || chr(2) || ']*', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


def _page_texts(spark, d) -> DataFrame:
    """Pages as Markdown of one section: their title as its header, and a paragraph for what stands between two tags."""
    html = F.regexp_replace("html", r"(?s)<script>.*?</script>|<style>.*?</style>|<[^>]*>", chr(2))
    text = F.regexp_replace(F.regexp_replace(html, r"[ \t\n\f\r]+", " "), f"{chr(2)}[ {chr(2)}]*", "\n\n")
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.concat(F.lit("# "), F.btrim(text, F.lit(" \n"))).alias("text"))


def _numbered_outline(text: str, title: str | None, names: list[str], missing: list) -> list[dict]:
    """A record a batch, that counts those before it in its chain."""
    return [{"entry_type": "concept", "name": f"{title or ''}#{len(names) + 1}", "body": text}]


_BATCHES = f"""WITH t AS (SELECT page_id, '# ' || {_HEADED} AS text FROM pages WHERE html IS NOT NULL),
l AS (SELECT page_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM t),
p AS (SELECT page_id, regexp_extract(text, '^[^' || chr(10) || ']*') AS title, CASE WHEN length(text) <= 1500 THEN [text] ELSE
    string_split(list_reduce(s, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 2 + length(x) <= 1500 THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1)) END AS p FROM l),
b AS (SELECT page_id, title, (generate_subscripts(p, 1) - 1)::INT AS batch, unnest(p) AS text FROM p)"""


@query(f"{_BATCHES} SELECT page_id, batch, 0 AS chain, batch AS part, CASE WHEN batch > 0 THEN trim(title) END AS section_title, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM b")
def reformat_batches(spark, d):
    out = reformat.batched(_page_texts(spark, d), "page_id", "text", 1500)
    return out.select("page_id", "batch", "chain", "part", "section_title", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"{_BATCHES} SELECT page_id, batch, batch AS pos, CASE WHEN batch > 0 THEN trim(title) ELSE '' END || '#' || (batch + 1) AS name, md5(text) AS body_md5, 'concept' AS entry_type FROM b")
def reformatted_pages(spark, d):
    """Each batch's record counts those that its chain has given before: the fold's order."""
    batches = reformat.batched(_page_texts(spark, d), "page_id", "text", 1500)
    out = reformat.extracted(batches, _numbered_outline, "page_id", None)
    return out.select("page_id", "batch", "pos", "record.name", F.md5(F.col("record.body").cast("binary")).alias("body_md5"), "record.entry_type")
