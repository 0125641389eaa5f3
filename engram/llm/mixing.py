"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ._base import unused, written

#: Rows of one (source, size) cell that are ranked together, about; a larger cell is split by id.
CELL_ROWS = 1 << 16


def source_targets(sizes: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) with one row for each source, null being one.

    Sources in code point order, null last, take the weights in turn. target = min(most * size, level * weight),
    level being where the targets add up to share times all sizes: what is cut from a full source is dealt
    again by weight until no source is above its limit. The windows see one row for each source.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.col(size_col)).cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    per = per.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    left = F.lit(share) * F.col("all_size").cast("double") - (F.sum("cap").over(fill) - F.col("cap")).cast("double")
    per = per.withColumn("level", left / (F.col("all_w") - F.sum("w").over(fill) + F.col("w")).cast("double"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    per = per.withColumn("level", F.coalesce(first["level"], F.lit(math.inf)))
    return per.select("source", "source_size", F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w").cast("double")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with _source_size, _target and _copies: how often the mix takes each row.

    Within a source every document is expected target / source size times. In order of size, then id, the expectations
    are added up, from one random offset of the source, and a document is taken once for each whole number
    that is passed at it. A document's copies are its expectation rounded up or down, by chance, so each is taken as often as
    its rate on the average over seeds; documents of neighbouring sizes together are within one copy of their
    expectation, so the words taken miss the target by the source's largest document at most. As a rate is at most a whole
    number, most, no document is taken more than most times. The offset is a hash of the source's name and the
    seed, so reruns agree.

    The sum before a document is rate * rank, so only ranks are needed: counts of (source, size, range of ids) cells are added
    up in two short windows and a row is ranked within its cell. No window holds a source: ranges of ids are
    as many as make cells of about CELL_ROWS rows, and have no part in the result.

    docs needs a non-null long size and may not have the three names above (ValueError); other names may be any. Null sources are a
    source of their own; a source of size 0 has rate 0 and takes nothing. Null ids go first within their size; rows of
    one id, and those without, are in order of a hash of the whole row, and equal rows are taken one by one.
    """
    clash = {"_source_size", "_target", "_copies"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns of the result: {sorted(clash)}")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size"), F.xxhash64(*docs.columns).alias("h"))
    count, low, high = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    parts = max(1, -(-count // CELL_ROWS))
    width = float(max(1, -(-((high or 0) - (low or 0) + 1) // parts)))
    by_id = F.floor((F.col("id").cast("double") - F.lit(float(low or 0))) / width)
    by_hash = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts) - parts - 1
    rows = rows.withColumn("part", F.coalesce(by_id, by_hash))
    cells = written(rows.groupBy("key", "size", "part").agg(F.count("*").alias("n")), "cells")
    by_size = cells.groupBy("key", "size").agg(F.sum("n").alias("m"))
    before_size = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_part = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_size = by_size.withColumn("below", F.sum("m").over(before_size) - F.col("m"))
    of_source = cells.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), (F.col("n") * F.col("size")).alias("size"))
    goals = source_targets(of_source, "source", "size", weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    goals = goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", rate.alias("rate"))
    placed = cells.withColumn("within", F.sum("n").over(before_part) - F.col("n")).join(by_size.join(goals, "key").hint("merge"), ["key", "size"])
    placed = placed.select("key", "size", "part", (F.col("below") + F.col("within")).alias("before"), "source_size", "target", "rate")
    in_cell = Window.partitionBy("key", "size", "part").orderBy(F.col("id").asc_nulls_first(), "h")
    out = rows.withColumn("rank", F.row_number().over(in_cell)).join(placed.hint("merge"), ["key", "size", "part"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    at = lambda k: F.floor(k.cast("double") * F.col("rate") + offset)
    rank = F.col("before") + F.col("rank")
    return out.select("row.*", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), (at(rank) - at(rank - 1)).cast("long").alias("_copies"))


def repeated(docs: DataFrame, copies_col: str = "_copies") -> DataFrame:
    """Each row as often as copies_col says, without that column."""
    copy = unused(docs, "_copy")
    n = F.greatest(F.col(copies_col), F.lit(0)).cast("int")
    return docs.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n))).drop(copy, copies_col)
