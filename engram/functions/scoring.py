"""Scores of events and of fused lists as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Default weights of the event score.
WEIGHTS = {"cosine": 0.55, "importance": 0.20, "persist": 0.15, "recency": 0.10}


def normalize_weights(w: dict[str, float]) -> dict[str, float]:
    total = sum(w[k] for k in WEIGHTS)
    return dict(WEIGHTS) if total <= 0 else {k: w[k] / total for k in WEIGHTS}


def overfetch(k: int) -> int:
    return min(100, max(10, 2 * k))


def hybrid_overfetch(k: int) -> int:
    return min(3 * k, 100)


def anchor_amount(value: float | None) -> float:
    return 0.20 if value is None else max(0.0, min(0.5, value))


def name_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two lists of names without case; 0 where either is empty."""
    low = lambda x: F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), F.lower))
    x, y = low(a), low(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def recency(window_end: Column, length: int) -> Column:
    """Halved every fifth of the chat, or every 40 messages if that is more; 0.5 for an empty chat."""
    if not length:
        return F.lit(0.5)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.lit(length) - F.coalesce(window_end, F.lit(0))) / max(40.0, 0.2 * length))


def anchor(keywords: Column, text: str, amount: float) -> Column:
    """amount if the text has one of the keywords of two letters or more."""
    if not text or amount <= 0:
        return F.lit(0.0)
    hit = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (F.length(k) >= 2) & F.lit(text.lower()).contains(F.lower(k)))
    return F.when(hit, amount).otherwise(0.0)


def event_score(similarity: Column, importance: Column, persist: Column, window_end: Column, length: int, weights: dict[str, float] = WEIGHTS) -> Column:
    return (
        weights["cosine"] * F.coalesce(similarity, F.lit(0.0))
        + weights["importance"] * F.coalesce(importance, F.lit(5)) / 10
        + weights["persist"] * F.when(persist, 1.0).otherwise(0.0)
        + weights["recency"] * recency(window_end, length)
    )


def fused_display(vector: Column, text: Column, rank_share: Column, saturation: float = 3.0) -> Column:
    """The score shown for a fused row: what its similarity and its saturated text score say, shaded by its rank."""
    t = F.when(text.isNull() | (text == 0), 0.0).otherwise(text / (text + saturation))
    v = F.coalesce(vector, F.lit(0.0))
    both = F.least(F.lit(1.0), (0.55 * v + 0.45 * t) * (1 + 0.08 * F.least(v, t)) * (0.95 + 0.05 * rank_share))
    shade = 0.9 + 0.1 * rank_share
    out = F.when((v > 0.01) & (t > 0.01), both).when(v > 0.01, v * 0.55 * shade).when(t > 0.01, t * 0.6 * shade).otherwise(rank_share * 0.25)
    return F.least(F.lit(1.0), out)


def keyword_weight(importance: Column, base: float = 1.5) -> Column:
    return base + 0.2 + ((importance - 1) / 9) * 0.6
