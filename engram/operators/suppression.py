"""Suppression of near copies in order of score: the rows that a walk would keep, found by rounds over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import name_overlap
from ..sources.work import removed, settled

GAP, OVERLAP, ESCAPE = 10, 0.6, 0.75


def _similarity(events: DataFrame) -> Column:
    return F.coalesce(*(F.col(c).cast("double") for c in ("score", "vector_score") if c in events.columns), F.lit(0.0))


def _native(events: DataFrame) -> Column:
    return F.coalesce("rerank_applied", F.lit(False)) if "rerank_applied" in events.columns else F.lit(False)


def copy_pairs(events: DataFrame, gap: int = GAP, per: list[str] | None = None, order: str = "final_score", tie: str = "event_id", row: str = "_row") -> DataFrame:
    """(a, b): row a comes before b in the order, and b repeats it if a is kept.

    Rows meet by event type, name and block of gap windows, or a neighbouring block, so only rows that share a name near each other are
    paired; rows without a window meet all of their type that share a name.
    """
    keys = ["event_type", *(per or [])]
    names = F.array_distinct(F.transform(F.coalesce("characters", F.array().cast("array<string>")), F.lower))
    rows = events.select(
        F.col(row).alias("i"), F.struct(*keys).alias("k"), F.col("source_window_end").cast("long").alias("end"), F.struct(-F.coalesce(F.when(~F.isnan(order), F.col(order)), F.lit(float("-inf"))), F.col(tie), F.col(row)).alias("o"),
        _similarity(events).alias("sim"), _native(events).alias("native"), names.alias("names"),
    )
    rows = rows.withColumns({"n": F.size("names"), "block": F.floor(F.col("end") / max(1, gap))}).withColumn("name", F.explode("names")).drop("names")
    a = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns))
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
    same = a.a_k.eqNullSafe(b.b_k) & (a.a_name == b.b_name)
    near = b.withColumn("at", F.explode(F.array(*(F.col("b_block") + d for d in (-1, 0, 1)))))
    dated = a.join(near, a.a_k.eqNullSafe(near.b_k) & (a.a_name == near.b_name) & (a.a_block == near["at"])).where(F.abs(F.col("a_end") - F.col("b_end")) < gap).drop("at")
    undated = a.where("a_end IS NULL").join(b, same).unionByName(a.where("a_end IS NOT NULL").join(b.where("b_end IS NULL"), same))
    escapes = ~F.col("b_native") & ~F.col("a_native") & (F.col("b_sim") >= ESCAPE)
    pairs = dated.unionByName(undated).where((F.col("a_o") < F.col("b_o")) & ~escapes)
    shared = pairs.groupBy(F.col("a_i").alias("a"), F.col("b_i").alias("b")).agg(F.count("*").alias("c"), F.first("a_n").alias("m"), F.first("b_n").alias("n"))
    return shared.where(F.col("c") / (F.col("m") + F.col("n") - F.col("c")) >= OVERLAP).select("a", "b")


def dropped_rows(pairs: DataFrame) -> tuple[DataFrame | None, int]:
    """(the rows that a walk in order would drop, the rounds it took); None if there are no pairs.

    A row that no undecided row comes before is kept, and drops those that repeat it; rows that are dropped drop nothing. Each round decides
    all such rows at once, so there are as many rounds as the longest chain of rows that each repeat the one before,
    not as many as rows. Every round is a written table of the pairs left.
    """
    live, gone, rounds = settled(pairs, "pairs"), None, 0
    while not live.isEmpty():
        rounds += 1
        kept = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        drop = settled(live.join(kept, "a", "left_semi").select(F.col("b").alias("i")).distinct(), "dropped")
        left = live.join(drop, live.b == drop.i, "left_anti").join(drop, live.a == drop.i, "left_anti")
        left = settled(left, "pairs")
        removed(live)
        live, gone = left, drop if gone is None else gone.unionByName(drop)
    removed(live)
    return gone, rounds


def near_copies_dropped(events: DataFrame, gap: int = GAP, per: list[str] | None = None, order: str = "final_score", tie: str = "event_id") -> DataFrame:
    """events without those that repeat a better one: same type, cast overlap of 0.6, windows less than gap apart or unknown.

    A row repeats only what was kept itself. Two rows that the server has not ranked both stay if the later is 0.75 similar itself. Rows
    of another type, or of another value of per, never meet; nulls there are a value. Null scores come last; ties go by tie.
    """
    rows = settled(events.withColumn("_row", F.monotonically_increasing_id()), "events")
    gone, _ = dropped_rows(copy_pairs(rows, gap, per, order, tie))
    return (rows if gone is None else rows.join(gone, rows["_row"] == gone.i, "left_anti")).drop("_row")


def few_kept(candidates: DataFrame, gap: int = GAP, order: str = "final_score", tie: str = "event_id") -> DataFrame:
    """near_copies_dropped for the few candidates of a lookup: one row holds them in order, and an expression walks over it."""
    fields = F.struct(
        (-F.coalesce(F.when(~F.isnan(order), F.col(order)), F.lit(float("-inf")))).alias("o"), F.col(tie).alias("t"), F.col("event_type").alias("kind"), F.col("source_window_end").cast("long").alias("end"),
        F.col("characters").alias("names"), _similarity(candidates).alias("sim"), _native(candidates).alias("native"), F.struct(*candidates.columns).alias("row"),
    )
    one = candidates.agg(F.array_sort(F.collect_list(fields), lambda x, y: F.when(F.struct(x["o"], x["t"]) < F.struct(y["o"], y["t"]), -1).when(F.struct(x["o"], x["t"]) > F.struct(y["o"], y["t"]), 1).otherwise(0)).alias("c"))

    def repeats(x: Column, y: Column) -> Column:
        close = F.coalesce(F.abs(x["end"] - y["end"]) < gap, F.lit(True))
        escapes = ~y["native"] & ~x["native"] & (y["sim"] >= ESCAPE)
        return x["kind"].eqNullSafe(y["kind"]) & close & ~escapes & (name_overlap(x["names"], y["names"]) >= OVERLAP)

    kept = F.aggregate("c", F.slice("c", 1, 0), lambda done, y: F.when(F.exists(done, lambda x: repeats(x, y)), done).otherwise(F.concat(done, F.array(y))))
    return one.select(F.explode(F.transform(kept, lambda k: k["row"])).alias("r")).select("r.*")
