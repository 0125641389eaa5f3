"""Collections: ids, registry, metadata, locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Types and scopes by the second part of a collection id.
KINDS = {"lorebook": ("lorebook", "character"), "character": ("character", "character"), "document": ("document", "character"), "eventbase": ("chat", "chat"), "archiveevent": ("archive_event", "chat")}
BACKENDS = ("standard", "qdrant")
DEFAULTS = {"enabled": True, "auto_sync": False, "trigger_match_mode": "any", "trigger_case_sensitive": False, "trigger_scan_depth": 5, "query_count": 0}


def name_segment(name: Column, most: int = 50) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), 1, most)


def collection_id(kind: str, backend: str | None, handle: Column, name: Column, stamp: Column, prefix: str = "mem") -> Column:
    parts = [F.lit(prefix), F.lit(kind), *([F.lit(backend)] if backend else []), handle, name_segment(name), stamp.cast("string")]
    return F.concat_ws("_", *parts)


def parsed_id(cid: Column, prefix: str = "mem") -> Column:
    """struct(type, scope, raw_id, format, backend)."""
    kind = F.regexp_extract(cid, rf"^{prefix}_([a-z]+)_", 1)
    pick = lambda i: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[i]))), kind), F.lit("unknown"))
    known = kind.isin(*KINDS)
    raw = F.when(known, F.regexp_replace(cid, rf"^{prefix}_[a-z]+_", "")).otherwise(F.coalesce(cid, F.lit("unknown")))
    backend = F.regexp_extract(raw, f"^({'|'.join(BACKENDS)})_", 1)
    form = F.when(known, "own").when(F.coalesce(cid, F.lit("")) == "", "invalid").otherwise("unknown")
    return F.struct(F.when(known, pick(0)).otherwise("unknown").alias("type"), F.when(known, pick(1)).otherwise("unknown").alias("scope"), raw.alias("raw_id"), form.alias("format"), F.nullif(backend, F.lit("")).alias("backend"))


def remapped(cid: Column, backend: str, prefix: str = "mem") -> Column:
    """The id of the same collection on another backend."""
    return F.regexp_replace(cid, rf"^({prefix}_[a-z]+_)(?:{'|'.join(BACKENDS)})_", f"$1{backend}_")


def effective_scope(stored: Column, parsed: Column) -> Column:
    valid = lambda s: F.when(s.isin("chat", "character"), s)
    return F.coalesce(valid(stored), valid(parsed), F.lit("character"))


def registered(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with rows of unknown keys added; known ones stay as they are."""
    add = new.dropDuplicates(["registry_key"]).join(registry.select("registry_key"), "registry_key", "left_anti")
    return registry.unionByName(add, allowMissingColumns=True)


def unregistered(registry: DataFrame, keys: DataFrame) -> DataFrame:
    return registry.join(keys.select("registry_key"), "registry_key", "left_anti")


def cleaned_registry(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("registry_key").isNotNull() & (F.trim("registry_key") != "")).dropDuplicates(["registry_key"])


def with_metadata(registry: DataFrame, meta: DataFrame, chat_id: str | None = None, character_id: str | None = None) -> DataFrame:
    """The listing: stored metadata over defaults, effective scope, whether it is active here."""
    out = registry.join(meta, "collection_id", "left")
    for c, v in DEFAULTS.items():
        if c in meta.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    none = F.array().cast("array<string>")
    chat = F.array_contains(F.coalesce("chat_locks", none), F.lit(chat_id or ""))
    character = F.array_contains(F.coalesce("character_locks", none), F.lit(character_id or ""))
    scope = effective_scope(F.col("scope"), parsed_id(F.col("collection_id"))["scope"])
    return out.withColumn("scope", scope).withColumn("is_active", F.coalesce("enabled", F.lit(True)) & F.when(F.col("scope") == "chat", chat).otherwise(character | chat))


def with_counts(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    return registry.join(chunks.groupBy("collection_id").agg(F.count("*").alias("chunk_count")), "collection_id", "left").fillna(0, ["chunk_count"])


def locks_index(meta: DataFrame) -> DataFrame:
    """(chat, collections): the reverse of the lock arrays."""
    return meta.select("collection_id", F.explode("chat_locks").alias("chat")).groupBy("chat").agg(F.array_sort(F.collect_set("collection_id")).alias("collections"))


def locked(meta: DataFrame, cid: str, lock: str, column: str = "chat_locks", on: bool = True) -> DataFrame:
    now = F.coalesce(column, F.array().cast("array<string>"))
    new = F.array_union(now, F.array(F.lit(lock))) if on else F.array_remove(now, lock)
    return meta.withColumn(column, F.when(F.col("collection_id") == cid, new).otherwise(F.col(column)))


def set_metadata(meta: DataFrame, cid: str, **values) -> DataFrame:
    here = F.col("collection_id") == cid
    return meta.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def orphans(meta: DataFrame, registry: DataFrame) -> DataFrame:
    return meta.join(registry.select("collection_id"), "collection_id", "left_anti")


def renamed_books(collections: DataFrame, books: DataFrame) -> DataFrame:
    return collections.join(books.select(F.col("name").alias("book")).distinct(), "book", "left_anti")


def queried(registry: DataFrame, prefix: str = "mem") -> DataFrame:
    """Collections of a chunk query: enabled, neither events nor lorebooks."""
    kind = parsed_id(F.col("collection_id"), prefix)["type"]
    return registry.where(F.coalesce("enabled", F.lit(True)) & ~kind.isin("chat", "archive_event", "lorebook"))


def rejection(cid: Column, prefix: str = "mem") -> Column:
    return F.when(F.coalesce(cid, F.lit("")) == "", "empty").when(cid.rlike(r"[\s/\\]"), "malformed").when(~cid.startswith(f"{prefix}_"), "foreign").when(cid.startswith(f"{prefix}_internal_"), "internal")


def assert_tokenizer(meta: DataFrame, cid: str, mode: str) -> None:
    """An error if a collection was built with another tokenizer mode."""
    row = meta.where(F.col("collection_id") == cid).select("tokenizer_mode").first()
    if row and row[0] and row[0] != mode:
        raise ValueError(f"{cid} was built with tokenizer mode {row[0]}, not {mode}")


def tidied_cache(cache: DataFrame, gone: list[str]) -> DataFrame:
    """Cache entries without some collections; entries that have none left go."""
    left = F.array_except("collections", F.array(*map(F.lit, gone)).cast("array<string>"))
    return cache.withColumn("collections", left).where(F.size("collections") > 0)


def query_metrics(log: DataFrame, per: str, order: str, value: str, last: int = 100) -> DataFrame:
    """Rolling mean, least and greatest of the last so many queries."""
    from pyspark.sql import Window

    w = Window.partitionBy(per).orderBy(order).rowsBetween(1 - last, 0)
    return log.withColumns({"avg_value": F.avg(value).over(w), "min_value": F.min(value).over(w), "max_value": F.max(value).over(w), "in_window": F.count("*").over(w)})
