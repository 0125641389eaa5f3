"""Whole queries: one collection, all collections, chunks into context, lorebooks, events with a formula, ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing, scoring, vectors
from . import bm25, chunking, context, fusion, joins, keywords

#: Least score of a lorebook entry, less where lists are fused, as fusion scores lower.
LOREBOOK_THRESHOLD, FUSED_SHARE = 0.3, 0.8


def expanded_query(text: Column, concepts: list[str]) -> Column:
    """The query with a planner's concepts behind it, which the text score then finds and nothing filters."""
    return F.concat_ws(" ", text, *map(F.lit, concepts))


def query_collection(chunks: DataFrame, vector: list[float], terms: list[str], top_k: int, method: str = "bm25", native: bool = False, id_col: str = "hash", vector_col: str = "vector", tokens: Column | None = None) -> DataFrame:
    """(id, score) of one collection's best top_k chunks.

    method bm25: dense candidates, more than asked for, scored again with the text score among them. method hybrid: dense and text
    ranks of the candidates fused. native: dense and text ranks of the whole collection fused. Candidates are at
    most 100, so what follows the dense search is small.
    """
    tokens = F.col("tokens") if tokens is None else tokens
    fused = native or method == "hybrid"
    n = scoring.hybrid_overfetch(top_k) if fused else scoring.overfetch(top_k)
    dense = vectors.nearest(chunks, vector, n, id_col, vector_col).select(F.col(id_col).alias("id"), "score")
    base = chunks if native else chunks.join(F.broadcast(dense.select(F.col("id").alias(id_col))), id_col, "left_semi")
    text = bm25.bm25(base, terms, id_col, tokens).select(F.col(id_col).alias("id"), F.col("bm25_score").alias("score"))
    if not fused:
        out = fusion.rescored(dense, text)
    else:
        out = fusion.reciprocal_rank(dense, text.orderBy(F.col("score").desc(), "id").limit(n))
    return out.orderBy(F.col("score").desc(), "id").limit(top_k).select(F.col("id").alias(id_col), "score")


def query_collections(chunks: DataFrame, per: str, vector: list[float], top_k: int, id_col: str = "hash", vector_col: str = "vector") -> DataFrame:
    """chunks with score and rank: the top_k of each collection by cosine, all together; one scan for all collections."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    scored = chunks.withColumn("score", vectors.cosine(F.col(vector_col), q))
    return joins.top_per(scored, [per], top_k, "score", id_col)


def chunk_retrieval(candidates: DataFrame, chunks: DataFrame, links: DataFrame, recent: DataFrame, query_keywords: list[str], threshold: float = 0.25, condition: Column | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The chunks that go into context, in the order of the stages: keyword hits have score 1, summaries become their parents, a reranker
    may score again, then threshold, conditions, links, and nothing that the recent messages show already.

    candidates, chunks(collection_id, hash, text, score, is_summary, parent_hash, keywords); links(hash, target_hash, mode); recent(hash).
    """
    out = joins.keyword_boosted(candidates, query_keywords)
    out = joins.expanded_parents(out, chunks)
    if rerank is not None:
        out = rerank(out)
    out = joins.above(out, threshold)
    if condition is not None:
        out = out.where(condition)
    forced = joins.force_linked(out, links, chunks)
    out = joins.soft_linked(out, links).unionByName(forced, allowMissingColumns=True)
    return joins.not_in_context(out, recent)


def lorebook_retrieval(hits: DataFrame, active: DataFrame, entries: DataFrame, books: DataFrame, fused: bool = False, top_k: int = 3, threshold: float = LOREBOOK_THRESHOLD) -> DataFrame:
    """Entries that lookups found: the best hit of each entry, top_k of each book and lookup, those that score enough, not active, and alive.

    hits(lookup, book, uid, text, score): rows of all lookups of a dual query.
    """
    best = joins.top_per(hits, ["lookup", "book"], top_k, "score", "uid").drop("rank")
    best = joins.top_per(best, ["book", "uid"], 1, "score", "lookup").drop("rank", "lookup")
    out = joins.above(best, threshold * (FUSED_SHARE if fused else 1.0))
    return joins.live_entries(joins.not_active(out, active), entries, books)


def formula_reranked(dense: DataFrame, text: DataFrame, stored: DataFrame, chat_length: int, top_k: int, weights: dict[str, float] = scoring.WEIGHTS, depth: int = 0, least_importance: int = 1, id_col: str = "event_id") -> DataFrame:
    """Events as a server with formulas ranks them: fused ranks stand for the similarity, filters come first, the result counts as ranked.

    dense, text: result lists (id, score) of at most 4 * top_k rows that matter.
    """
    fused = fusion.dense_sparse(dense, text, id_col, 4 * top_k).select(id_col, F.col("score").alias("similarity"))
    rows = stored.drop("score").join(F.broadcast(fused), id_col).where(F.col("importance") >= least_importance)
    if depth > 0:
        rows = rows.where(F.coalesce("source_window_end", F.lit(-1)) < chat_length - depth)
    score = scoring.event_score(F.col("similarity"), F.col("importance"), F.col("should_persist"), F.col("source_window_end"), chat_length, weights)
    return rows.withColumns({"score": score, "rerank_applied": F.lit(True)}).drop("similarity").orderBy(F.col("score").desc(), id_col).limit(top_k)


def enriched(chunks: DataFrame, id_col: str, content_type: str, source_name: str, level: str = "balanced", base: float = keywords.BASE_WEIGHT) -> DataFrame:
    """chunks with keywords (array of struct text, weight, best first, one for each stem), entry_name, content_type and source_name.

    Chats take the words that tell their sentences apart, other content frequent words; a speaker is a keyword of a chat. A record's name and
    aliases, its scored keywords and a character's name count more. entry_name is the record's name or else the page's title. Columns
    speaker, name, aliases, record_keywords (array of struct text, importance) and page_title are used where there are any.
    """
    have = set(chunks.columns)
    none = F.array().cast("array<struct<text:string,weight:double>>")
    word = lambda c, w: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.array(F.struct(F.lower(c).alias("text"), F.lit(w).cast("double").alias("weight")))).otherwise(none)
    own = [none]
    if content_type == "chat" and "speaker" in have:
        own.append(word(F.col("speaker"), base))
    if "name" in have:
        own.append(word(F.col("name"), base + 0.5))
    if "aliases" in have:
        own.append(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("text"), F.lit(base + 0.5).alias("weight"))))
    if "record_keywords" in have:
        amount = lambda k: base + 0.2 + (F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(k["importance"], F.lit(5)))) - 1) / 9 * 0.6
        own.append(F.transform(F.filter("record_keywords", lambda k: k["text"] != ""), lambda k: F.struct(F.lower(k["text"]).alias("text"), amount(k).alias("weight"))))
    find = keywords.tfidf_keywords if content_type == "chat" else keywords.frequency_keywords
    parts = [chunks.select(id_col, F.explode(F.concat(*(F.coalesce(x, none) for x in own))).alias("k")).select(id_col, F.col("k.text").alias("keyword"), F.col("k.weight").alias("weight"))]
    if level != "off":
        parts.append(find(chunks, id_col, F.col("text"), level, base).select(id_col, "keyword", "weight"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = keywords.by_stem(rows, [id_col]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), F.col("keyword").alias("text")))).alias("k"))
    best = best.select(id_col, F.transform("k", lambda x: F.struct(x["text"].alias("text"), (-x["o"]).alias("weight"))).alias("keywords"))
    entry = F.coalesce(*(F.col(c) for c in ("name", "page_title") if c in have), F.lit(None).cast("string"))
    out = chunks.withColumns({"entry_name": entry, "content_type": F.lit(content_type), "source_name": F.lit(source_name)}).join(best, id_col, "left")
    return out.withColumn("keywords", F.coalesce("keywords", none))


def ingested(documents: DataFrame, stored: DataFrame, id_col: str, strategy: str, content_type: str, source_name: str, glossary: DataFrame | None = None, level: str = "balanced") -> DataFrame:
    """The chunks of documents that the store has not: cut, acronyms explained, hashed, without the stored ones, enriched.

    What is stored already is left out before keywords are sought, which is the dear part.
    """
    chunks = chunking.chunk(documents, strategy)
    if glossary is not None:
        chunks = joins.glossary_injected(chunks, glossary, id_col)
    chunks = joins.new_only(chunks.withColumn("hash", hashing.content_hash(F.col("text"))), stored)
    return enriched(chunks, "hash", content_type, source_name, level)


def search_collections(hits: DataFrame, wanted: str = "", threshold: float = 0.0, per: str = "collection_id", top_k: int = 10) -> DataFrame:
    """The browser's search: hits that score enough and have one of the keywords of a comma list, top_k of each collection."""
    out = joins.above(hits, threshold)
    if wanted.strip():
        out = out.where(keywords.has_keyword(F.col("keywords"), wanted))
    return joins.top_per(out, [per], top_k)


def into_context(chunks: DataFrame, global_context: str = "", global_tag: str = "") -> DataFrame:
    """One text for each place of the prompt."""
    return context.injected(context.position(chunks), global_context, global_tag)
