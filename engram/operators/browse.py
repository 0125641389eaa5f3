"""Lists as a person browses them, gathers of collections, ingest helpers and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a stored event's importance is at least, and windows a batch takes.
LEAST_STORED, JUST_MISSED = 3, 0.1
#: Order of a chunk list -> columns, descending where marked.
SORTS = {"index": ("index",), "length": ("-n_chars",), "shortest": ("n_chars",), "keywords": ("-n_keywords",), "modified": ("-modified",), "name": ("entry_name",)}


def chunk_list(chunks: DataFrame, search: str = "", show: str = "all", sort: str = "index", tie: str = "hash") -> DataFrame:
    """Chunks whose text, name or a keyword contains the search without case, of one kind (all, enabled, disabled, conditions, keywords), sorted."""
    s = search.strip().lower()
    none = F.array().cast("array<string>")
    out = chunks.withColumns({"n_chars": F.length(F.coalesce("text", F.lit(""))), "n_keywords": F.size(F.coalesce("keywords", none))})
    if s:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(s))
        out = out.where(has(F.col("text")) | has(F.col("entry_name")) | F.exists(F.coalesce("keywords", none), has))
    enabled = ~F.coalesce("disabled", F.lit(False))
    kinds = {"enabled": enabled, "disabled": ~enabled, "conditions": F.coalesce("has_conditions", F.lit(False)), "keywords": F.col("n_keywords") > 0}
    if show in kinds:
        out = out.where(kinds[show])
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in SORTS[sort]]
    return out.orderBy(*order, tie)


def collection_list(registry: DataFrame, scope: str = "all", active_only: bool = False, chat_id: str | None = None, character_id: str | None = None) -> DataFrame:
    """Collections of a scope: global (without locks), character, chat, or all; active ones are enabled and locked to what is open, or global."""
    none = F.array().cast("array<string>")
    chats, people = F.coalesce("chat_locks", none), F.coalesce("character_locks", none)
    free = (F.size(chats) == 0) & (F.size(people) == 0)
    wanted = {"global": free, "character": F.size(people) > 0, "chat": F.size(chats) > 0}.get(scope, F.lit(True))
    out = registry.where(wanted)
    if active_only:
        here = F.coalesce(F.array_contains(chats, F.lit(chat_id).cast("string")), F.lit(False)) | F.coalesce(F.array_contains(people, F.lit(character_id).cast("string")), F.lit(False))
        out = out.where(F.coalesce("enabled", F.lit(True)) & (free | here))
    return out


def gathered(registry: DataFrame, prefix: str, chat_id: str | None = None) -> DataFrame:
    """Enabled collections whose id begins with the prefix, locked to the chat where one is given; one row for each id."""
    out = registry.where(F.startswith("collection_id", F.lit(prefix)) & F.coalesce("enabled", F.lit(True)))
    if chat_id is not None:
        out = out.where(F.array_contains(F.coalesce("chat_locks", F.array().cast("array<string>")), F.lit(chat_id)))
    return out.dropDuplicates(["collection_id"])


def not_foreign(books: DataFrame, prefixes: list[str], name: str = "book") -> DataFrame:
    """Books that no other tool owns: their names begin with none of its prefixes, without case."""
    out = books
    for p in prefixes:
        out = out.where(~F.startswith(F.lower(F.trim(name)), F.lit(p.lower())))
    return out


def lorebook_gather(registry: DataFrame, prefix: str, foreign: list[str], chat_id: str | None = None, character_id: str | None = None) -> DataFrame:
    """Enabled, active lorebook collections whose book is not another tool's."""
    return not_foreign(collection_list(gathered(registry, prefix), "all", True, chat_id, character_id), foreign)


def worth_storing(events: DataFrame, least: int = LEAST_STORED) -> DataFrame:
    return events.where(F.col("importance") >= least)


def most_important(events: DataFrame, per: list[str], most: int, tie: str = "event_id") -> DataFrame:
    """The `most` events of a window by importance."""
    w = Window.partitionBy(*per).orderBy(F.col("importance").desc(), tie)
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def fast_forwarded(windows: DataFrame, done: DataFrame, key: str = "fingerprint", per: str = "conv_id", order: str = "window_start") -> DataFrame:
    """Windows from the first one on that isn't done; what is done behind it stays, for the ledger to skip."""
    open_ = windows.join(done.select(key).distinct(), key, "left_anti").groupBy(per).agg(F.min(order).alias("_from"))
    return windows.join(open_, per).where(F.col(order) >= F.col("_from")).drop("_from")


def archive_statistics(messages: DataFrame, per: list[str], is_user: Column) -> DataFrame:
    return messages.groupBy(*per).agg(F.count("*").alias("messages"), F.count_if(is_user).alias("user_messages"), F.count_if(~is_user).alias("character_messages"))


def archive_id(text: Column) -> Column:
    """SHA-1 of a chat file's text, which names its archive."""
    return F.sha1(F.coalesce(text, F.lit("")))


def usage(queries: DataFrame, per: str = "collection_id", at: str = "at") -> DataFrame:
    return queries.groupBy(per).agg(F.count("*").alias("query_count"), F.max(at).alias("last_used"))


def stage_statistics(candidates: DataFrame, threshold: float, injected: DataFrame, key: str = "hash") -> DataFrame:
    """One row: candidates, those above the threshold, those just below it, and those that went into context."""
    j = candidates.join(injected.select(key).distinct().withColumn("_i", F.lit(True)), key, "left")
    near = (F.col("score") < threshold) & (F.col("score") >= threshold - JUST_MISSED)
    return j.agg(F.count("*").alias("candidates"), F.count_if(F.col("score") >= threshold).alias("above"), F.count_if(near).alias("just_missed"), F.count_if(F.col("_i")).alias("injected"))


def enumerated(windows: DataFrame, title_pattern: str | None = None) -> DataFrame:
    """Pages of a paged title listing (page_id, title, categories): categories that came in several windows are one list."""
    out = windows.groupBy("page_id").agg(F.min("title").alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("categories", F.array().cast("array<string>")))))).alias("categories"))
    return out.where(F.col("title").rlike(title_pattern)) if title_pattern else out


def fetched(titles: DataFrame, normalized: DataFrame, pages: DataFrame) -> DataFrame:
    """(asked, title, content) of the titles asked for, found under their normal form; missing ones go. normalized(asked, title)."""
    n = normalized.select(F.col("asked"), F.col("title").alias("_n"))
    t = titles.join(n, "asked", "left").select("asked", F.coalesce("_n", "asked").alias("title"))
    return t.join(pages.select("title", "content"), "title").select("asked", "title", "content")


def fetch_batches(titles: DataFrame, per_batch: int = 50, order: str = "title") -> DataFrame:
    """titles with the number of the request that asks for them."""
    return titles.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / per_batch).cast("int"))


def plain_title(title: Column) -> Column:
    """A title without outer spaces, in lower case, its underscores spaces."""
    return F.lower(F.replace(F.trim(title), F.lit("_"), F.lit(" ")))


def by_title(pages: DataFrame, wanted: str | None) -> DataFrame:
    """Pages with the title, whatever its case and whether it has spaces or underscores; none has a null one."""
    return pages.where(plain_title(F.col("title")) == plain_title(F.lit(wanted).cast("string")))


def library_pages(pages: DataFrame, library_id: str, fetched_only: bool = False) -> DataFrame:
    out = pages.where(F.col("library_id") == library_id)
    return out.where("content_fetched = 1") if fetched_only else out


def pages_by_key(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The pages of a list of keys, once each."""
    return pages.join(keys.select("key").distinct(), "key", "left_semi")


def api_candidates(url: Column) -> Column:
    """Addresses where a wiki's API may answer, the likeliest first; none for what is no http address."""
    base = F.regexp_extract(F.trim(url), r"(?i)^(https?://[^/?#]+)", 1)
    paths = F.transform(F.array(F.lit("/api.php"), F.lit("/w/api.php"), F.lit("/wiki/api.php")), lambda p: F.concat(F.lower(base), p))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(paths)
