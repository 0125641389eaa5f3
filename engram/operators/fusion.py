"""Fusion of a dense and a text result list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import fused_display


def ranked(rows: DataFrame, key: str, score: Column, per: list[str] | None = None) -> DataFrame:
    """rows with rank, 1-based by score, then key."""
    w = Window.partitionBy(*(per or [])).orderBy(score.desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(w))


def reciprocal_rank(dense: DataFrame, text: DataFrame, key: str = "id", k: int = 60) -> DataFrame:
    """(key, vector_score, text_score, vector_rank, text_rank, rrf, score) by reciprocal rank fusion.

    dense(key, score) and text(key, score) are bounded result lists. Rows with a null key are skipped.
    """
    v = ranked(dense.where(F.col(key).isNotNull()), key, F.col("score")).select(F.col(key), F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    t = ranked(text.where(F.col(key).isNotNull()), key, F.col("score")).select(F.col(key), F.col("score").alias("text_score"), F.col("rank").alias("text_rank"))
    both = v.join(t, key, "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", part("vector_rank") + part("text_rank"))
    share = F.col("rrf") / F.max("rrf").over(Window.partitionBy())
    return both.withColumn("score", fused_display(F.col("vector_score"), F.col("text_score"), share))


def _min_max(rows: DataFrame) -> Column:
    w = Window.partitionBy()
    span = F.max(F.coalesce("score", F.lit(0.0))).over(w) - F.min(F.coalesce("score", F.lit(0.0))).over(w)
    return (F.coalesce("score", F.lit(0.0)) - F.min(F.coalesce("score", F.lit(0.0))).over(w)) / F.when(span == 0, 1.0).otherwise(span)


def weighted(dense: DataFrame, text: DataFrame, key: str = "id", alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(key, vector_norm, text_norm, score): min-max scores of both lists, weighted."""
    v = dense.where(F.col(key).isNotNull()).select(F.col(key), _min_max(dense).alias("vector_norm"))
    t = text.where(F.col(key).isNotNull()).select(F.col(key), _min_max(text).alias("text_norm"))
    out = v.join(t, key, "full_outer").fillna(0.0, ["vector_norm", "text_norm"])
    return out.withColumn("score", alpha * F.col("vector_norm") + beta * F.col("text_norm"))


def rescored(candidates: DataFrame, text: DataFrame, key: str = "id", alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Dense candidates (key, score) with the text score over the list's best: alpha * dense + beta * text / max."""
    t = text.select(F.col(key), F.col("score").alias("bm25_score"))
    out = candidates.withColumnRenamed("score", "vector_score").join(t, key, "left").fillna(0.0, ["bm25_score"])
    top = F.greatest(F.max("bm25_score").over(Window.partitionBy()), F.lit(0.0001))
    return out.withColumn("score", alpha * F.col("vector_score") + beta * F.col("bm25_score") / top)


def dense_sparse(dense: DataFrame, sparse: DataFrame, key: str, top_k: int) -> DataFrame:
    """Both lists to 4 * top_k, fused by reciprocal ranks with k = 1, so a row first in both has score 1."""
    cut = lambda d: d.orderBy(F.col("score").desc(), F.col(key)).limit(4 * top_k)
    v = ranked(cut(dense), key, F.col("score")).select(key, F.col("rank").alias("vector_rank"))
    t = ranked(cut(sparse), key, F.col("score")).select(key, F.col("rank").alias("text_rank"))
    part = lambda c: F.coalesce(1 / (1 + F.col(c)), F.lit(0.0))
    out = v.join(t, key, "full_outer").withColumn("score", part("vector_rank") + part("text_rank"))
    return out.orderBy(F.col("score").desc(), F.col(key)).limit(top_k)


def spearman(a: DataFrame, b: DataFrame, key: str = "id", top: int = 20) -> DataFrame:
    """One row (overlap, only_a, only_b, rho) of two ranked lists (key, rank); a missing row ranks after the list."""
    x, y = a.select(key, F.col("rank").alias("ra")), b.select(key, F.col("rank").alias("rb"))
    j = x.join(y, key, "full_outer")
    w = Window.partitionBy()
    j = j.withColumns({"na": F.count("ra").over(w), "nb": F.count("rb").over(w)})
    j = j.withColumns({"fa": F.coalesce("ra", F.col("na") + 1), "fb": F.coalesce("rb", F.col("nb") + 1)})
    n = F.count("*")
    rho = 1 - 6 * F.sum((F.col("fa") - F.col("fb")) * (F.col("fa") - F.col("fb"))) / (n * (n * n - 1))
    inside = (F.col("ra") <= top) & (F.col("rb") <= top)
    return j.agg(F.count_if(inside).alias("overlap"), F.count_if(F.col("rb").isNull()).alias("only_a"), F.count_if(F.col("ra").isNull()).alias("only_b"), F.when(n > 1, rho).otherwise(1.0).alias("rho"))
