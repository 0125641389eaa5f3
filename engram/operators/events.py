"""Structured events: validation, rerank, suppression of near copies, retrieval, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import WEIGHTS, anchor, anchor_amount, event_score
from .context import falling, joined
from .suppression import GAP, few_kept, near_copies_dropped  # noqa: F401

#: The vocabulary of event types; any other is "other".
EVENT_TYPES = (
    "main_quest_update", "side_quest_update", "combat", "travel", "discovery", "dialogue_significant", "relationship_change", "character_introduction", "character_state_change",
    "item_acquired", "item_lost", "faction_change", "location_change", "revelation", "promise_or_oath", "betrayal", "death", "other",
)
ARRAYS = ("characters", "locations", "factions", "items", "concepts", "keywords", "open_threads")
#: Fixed values of the embedding text: a field's label; factions are a filter, not text.
LABELS = {"date_time": "TIME", "cause": "CAUSE", "result": "RESULT", "characters": "CHARS", "locations": "LOCS", "items": "ITEMS", "keywords": "KEYS", "open_threads": "THREADS"}


def clean_array(a: Column) -> Column:
    """Trimmed, without empties and repetitions; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))


def validated(raw: DataFrame, types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Events of fixed form from loose ones, without those that have no summary.

    raw: event_type, importance (any text), summary, date_time, cause, result, should_persist, and the arrays. Unknown types are
    other, importance is 1 to 10 or 5 if it is no number, a date that isn't one is null, concepts are keywords too.
    """
    number = F.col("importance").cast("string").try_cast("double")
    kind = F.trim(F.coalesce("event_type", F.lit("")))
    summary = F.trim(F.coalesce("summary", F.lit("")))
    out = raw.withColumns({c: clean_array(F.col(c)) for c in ARRAYS})
    low = F.transform("keywords", F.lower)
    more = F.filter("concepts", lambda c: ~F.array_contains(low, F.lower(c)))
    return out.withColumns({
        "event_type": F.when(kind.isin(*types), kind).otherwise("other"),
        "importance": F.when(number.isNull() | F.isnan(number), 5).otherwise(F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), number)))).cast("int"),
        "summary": summary, "cause": F.trim(F.coalesce("cause", F.lit(""))), "result": F.trim(F.coalesce("result", F.lit(""))),
        "date_time": F.try_to_timestamp("date_time"), "keywords": F.concat("keywords", more), "should_persist": F.coalesce("should_persist", F.lit(False)),
    }).where(summary != "")


def embed_text(fields: dict[str, Column] | None = None) -> Column:
    """[type] summary, then a line for each field that isn't empty."""
    get = lambda c: (fields or {}).get(c, F.col(c))
    lines = [F.concat(F.lit("["), get("event_type"), F.lit("] "), get("summary"))]
    for c, label in LABELS.items():
        value = get(c).cast("string") if c in ("date_time", "cause", "result") else F.array_join(get(c), ", ")
        lines.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value)))
    return F.concat_ws("\n", *lines)


def parse_embed_text(text: Column) -> Column:
    """The fields of an embedding text as a struct."""
    line = lambda label: F.regexp_extract(text, rf"(?m)^{label}: *(.*)$", 1)
    many = lambda label: F.filter(F.split(line(label), ", "), lambda x: x != "")
    head = F.substring_index(text, "\n", 1)
    return F.struct(
        F.trim(F.regexp_extract(head, r"^\[([^\]]+)\]", 1)).alias("event_type"), F.trim(F.regexp_extract(head, r"^\[[^\]]+\]\s*(.*)$", 1)).alias("summary"),
        *((line(v) if c in ("date_time", "cause", "result") else many(v)).alias(c) for c, v in LABELS.items()),
    )


def best_by(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of highest score for each key, the least tie first: one aggregate of a struct."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie)))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def reranked(events: DataFrame, chat_length: int, weights: dict[str, float] = WEIGHTS, anchor_text: str = "", boost: float | None = None, least_importance: int = 1) -> DataFrame:
    """events with final_score; those below the least importance go, unless the server has ranked them already."""
    ranked = F.coalesce("rerank_applied", F.lit(False))
    similarity = F.coalesce(*(c for c in ("vector_score", "score") if c in events.columns), F.lit(0.0))
    own = event_score(similarity, F.col("importance"), F.col("should_persist"), F.col("source_window_end"), chat_length, weights)
    extra = anchor(F.col("keywords"), anchor_text, anchor_amount(boost))
    keep = ranked | F.col("importance").isNull() | (F.col("importance") >= least_importance)
    return events.where(keep).withColumn("final_score", F.when(ranked, F.coalesce("score", F.lit(0.0))).otherwise(own) + extra)


def beyond_context(events: DataFrame, chat_length: int, depth: int) -> DataFrame:
    """Without events of the last `depth` messages, which the reader sees anyway; depth 0 keeps all."""
    if depth <= 0:
        return events
    return events.where(F.coalesce("rerank_applied", F.lit(False)) | (F.coalesce("source_window_end", F.lit(-1)) < chat_length - depth))


def retrieved(live: DataFrame, archive: DataFrame | None, chat_length: int, top_k: int = 8, anchor_text: str = "", depth: int = 0, gap: int = GAP, least_importance: int = 1, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The event query: candidates of all lookups, best row of each event, rerank, near copies, context, top k.

    Of each lookup (column lookup, where there is one) the 2 * top_k best are candidates, and archive holds candidates of other lookups, so
    near copies are a walk over few rows.
    """
    per = [F.col("lookup")] if "lookup" in live.columns else []
    w = Window.partitionBy(*per).orderBy(F.col("score").desc_nulls_last(), "event_id")
    best = live.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * top_k).drop("_r") if per else live.orderBy(F.col("score").desc_nulls_last(), "event_id").limit(2 * top_k)
    merged = _merged(best)
    if archive is not None:
        merged = merged.unionByName(archive, allowMissingColumns=True)
    scored = reranked(merged, chat_length, weights, anchor_text, None, least_importance)
    out = beyond_context(few_kept(scored, gap), chat_length, depth)
    return out.orderBy(F.col("final_score").desc(), "event_id").limit(top_k)


def _merged(live: DataFrame) -> DataFrame:
    """Highest score of each event over all lookups."""
    return live.withColumn("_r", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("score").desc_nulls_last()))).where("_r = 1").drop("_r")


def filtered(events: DataFrame, filters: dict) -> DataFrame:
    """A planner's filters: any of up to 8 trimmed values for each *_any, event types, least importance within 1 to 10."""
    out = events
    for key, value in filters.items():
        if key == "importance_gte":
            out = out.where(F.col("importance") >= max(1, min(10, int(value))))
        elif key.endswith("_any"):
            values = list(dict.fromkeys(v.strip() for v in value if v and v.strip()))[:8]
            column = key.removesuffix("_any")
            if values:
                out = out.where(F.col("event_type").isin(values) if column == "event_type" else F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))))
    return out


def planned(events: DataFrame, plan: list[dict], lookup) -> DataFrame:
    """Fan-out of up to four planned queries: lookup(events, text) on each one's filtered events, all together, best score of each."""
    texts: dict[str, dict] = {}
    for q in plan:
        if (q.get("text") or "").strip():
            texts.setdefault(q["text"].strip(), q.get("filters") or {})
    parts = [lookup(filtered(events, f), t) for t, f in list(texts.items())[:4]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _merged(out)


def formatted(events: DataFrame, per: list[str], style: str = "dense", order: str = "final_score") -> DataFrame:
    """(per..., context): each group's events in order of score as dense lines, summaries or JSON."""
    if style == "json":
        line = F.to_json(F.struct("event_type", "importance", "summary", "characters", "locations", "keywords"))
    elif style == "summary":
        line = F.concat(F.lit("- "), F.col("summary"))
    else:
        line = embed_text()
    out = joined(events, per, line, [*falling(F.col(order)), F.col("event_id")], {"json": ",", "summary": "\n"}.get(style, "\n\n"))
    text = F.concat(F.lit("["), "text", F.lit("]")) if style == "json" else F.col("text")
    return out.select(*per, text.alias("context"))


def vectorization_tip(events: DataFrame, chat_length: int | None = None) -> Column:
    """Aggregate column: the message after the last window that is stored, else the chat's length."""
    return F.coalesce(F.max("source_window_end") + 1, F.lit(chat_length).cast("int"))


def assert_unique(events: DataFrame, key: str = "hash") -> DataFrame:
    """events, or an error when two rows of a batch have one hash."""
    n = F.count("*").over(Window.partitionBy(key))
    return events.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two events with hash "), F.col(key).cast("string")))).otherwise(F.lit(None).cast("string"))).where("_ok IS NULL").drop("_n", "_ok")
