"""Joins of the query path: links, parents, context, live sources, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SOFT_BOOST = 0.15


def above(rows: DataFrame, threshold: float = 0.25, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) >= threshold)


def keyword_boosted(chunks: DataFrame, query_keywords: list[str], keywords: str = "keywords") -> DataFrame:
    """Score 1 for chunks that have a query keyword, whatever the case; original_score keeps what it was."""
    own = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower)
    hit = F.arrays_overlap(own, F.array(*(F.lit(k.lower()) for k in query_keywords))) if query_keywords else F.lit(False)
    return chunks.withColumns({"original_score": F.col("score"), "score": F.when(hit, 1.0).otherwise(F.col("score"))})


def expanded_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Summaries replaced by their parents within the collection, with the summary's score; of several of one parent the best stays.

    hits(collection_id, hash, text, score, is_summary, parent_hash); a summary without its parent stays as it is.
    """
    parent = chunks.select(F.col("collection_id").alias("p_coll"), F.col("hash").alias("p_hash"), F.col("text").alias("p_text"))
    j = hits.join(parent, (F.col("collection_id") == F.col("p_coll")) & F.col("is_summary") & (F.col("parent_hash") == F.col("p_hash")), "left").drop("p_coll")
    j = j.withColumns({"from_summary": F.col("p_hash").isNotNull(), "hash": F.coalesce("p_hash", "hash"), "text": F.coalesce("p_text", "text")}).drop("p_hash", "p_text")
    w = Window.partitionBy("collection_id", "hash").orderBy(F.col("score").desc(), F.col("from_summary").desc())
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def soft_linked(hits: DataFrame, links: DataFrame, boost: float = SOFT_BOOST) -> DataFrame:
    """hits(hash, score) with the score raised by boost for each soft link from another hit, up to 1, and link_boost.

    links(hash, target_hash, mode).
    """
    votes = links.where("mode = 'soft'").join(hits.select("hash"), "hash", "left_semi").groupBy(F.col("target_hash").alias("t")).agg((F.count("*") * boost).alias("link_boost"))
    out = hits.join(votes, F.col("hash") == F.col("t"), "left").drop("t").fillna(0.0, ["link_boost"])
    return out.withColumn("score", F.when(F.col("link_boost") > 0, F.least(F.lit(1.0), F.col("score") + F.col("link_boost"))).otherwise(F.col("score")))


def force_linked(hits: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that a hit links by force and that are no hits themselves, with score 1."""
    wanted = links.where("mode = 'force'").join(hits.select("hash"), "hash", "left_semi").select(F.col("target_hash").alias("hash")).distinct()
    missing = wanted.join(hits.select("hash"), "hash", "left_anti")
    return chunks.join(missing, "hash", "left_semi").withColumn("score", F.lit(1.0))


def not_in_context(hits: DataFrame, recent: DataFrame, key: str = "hash", depth: int = 0, order: str = "idx") -> DataFrame:
    """hits that the last `depth` messages do not show, by their place in the chat; depth 0 takes the whole chat."""
    if depth > 0:
        recent = recent.join(F.broadcast(recent.agg((F.max(order) - depth).alias("_low"))), F.col(order) > F.col("_low"))
    return hits.join(recent.select(key), key, "left_anti")


def backfilled(hits: DataFrame, messages: DataFrame, key: str = "hash") -> DataFrame:
    """Missing texts from the first message with the hash."""
    w = Window.partitionBy(key).orderBy("idx")
    first = messages.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col("text").alias("_m"))
    return hits.join(first, key, "left").withColumn("text", F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.col("_m"))).drop("_m")


def live_entries(hits: DataFrame, entries: DataFrame, books: DataFrame) -> DataFrame:
    """Stored entries (book, uid, text) as their source has them now: deleted and disabled ones go, a text that isn't blank replaces; of books
    that can't be read everything stays."""
    now = entries.select("book", "uid", F.col("content").alias("_c"), F.coalesce("disabled", F.lit(False)).alias("_d"), F.lit(True).alias("_e"))
    out = hits.join(now, ["book", "uid"], "left").join(books.select("book").distinct().withColumn("_b", F.lit(True)), "book", "left")
    keep = F.col("_b").isNull() | (F.coalesce("_e", F.lit(False)) & ~F.coalesce("_d", F.lit(False)))
    return out.where(keep).withColumn("text", F.coalesce(F.when(F.trim("_c") != "", F.col("_c")), F.col("text"))).drop("_c", "_d", "_e", "_b")


def not_active(hits: DataFrame, active: DataFrame) -> DataFrame:
    """Without entries that are active already, by uid or by the same text."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    texts = active.select(norm(F.col("text")).alias("_t")).where("_t <> ''").distinct()
    return hits.join(active.select("uid"), "uid", "left_anti").withColumn("_t", norm(F.col("text"))).join(texts, "_t", "left_anti").drop("_t")


def new_only(rows: DataFrame, stored: DataFrame, key: str = "hash") -> DataFrame:
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def top_per(rows: DataFrame, per: list[str], k: int, score: str = "score", tie: str = "hash") -> DataFrame:
    w = Window.partitionBy(*per).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def out_of_step(a: DataFrame, b: DataFrame, key: str = "hash") -> DataFrame:
    """Keys that only one side has, with its name."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("only_in", F.lit("right")))


def glossary_injected(chunks: DataFrame, glossary: DataFrame, per: str) -> DataFrame:
    """[Glossary: ACR = full name] lines before texts that use an acronym without its full name.

    glossary(per, acronym, full_name): a document's definitions meet its own chunks only, as one short array a document.
    """
    terms = glossary.groupBy(per).agg(F.array_sort(F.collect_list(F.struct("acronym", "full_name"))).alias("_g"))
    j = chunks.join(terms, per, "left")
    none = F.array().cast("array<struct<acronym:string,full_name:string>>")
    words = F.split("text", r"[^\w]+")
    used = F.filter(F.coalesce("_g", none), lambda g: F.array_contains(words, g["acronym"]) & ~F.contains(F.col("text"), g["full_name"]))
    lines = F.transform(used, lambda g: F.concat(F.lit("[Glossary: "), g["acronym"], F.lit(" = "), g["full_name"], F.lit("]")))
    return j.withColumn("text", F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))).drop("_g")


def overridden(chunks: DataFrame, overrides: DataFrame, columns: list[str], key: str = "hash") -> DataFrame:
    """Stored values win over local overrides; empty strings and arrays fall through, 0 and false don't."""
    o = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    types = dict(chunks.dtypes)

    def value(c: str) -> Column:
        empty = F.size(c) <= 0 if types[c].startswith("array") else F.col(c) == "" if types[c] == "string" else F.lit(False)
        return F.coalesce(F.when(F.coalesce(empty, F.lit(False)), None).otherwise(F.col(c)), F.col(f"_{c}"))

    return chunks.join(o, key, "left").withColumns({c: value(c) for c in columns}).drop(*(f"_{c}" for c in columns))


def pages_of(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def paged(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows, each with the total of all of them."""
    return pages_of(rows, order, offset, limit).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def exclusion_reason(candidates: DataFrame, above_threshold: DataFrame, passed: DataFrame, injected: DataFrame, key: str = "hash") -> DataFrame:
    """The first stage that lost each candidate."""
    out = candidates.select(key).distinct()
    for name, stage in (("_a", above_threshold), ("_p", passed), ("_i", injected)):
        out = out.join(stage.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    reason = F.when(F.col("_a").isNull(), "Below threshold").when(F.col("_p").isNull(), "Failed conditions").when(F.col("_i").isNull(), "Not injected")
    return out.select(key, reason.alias("reason"))
