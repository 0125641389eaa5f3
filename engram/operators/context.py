"""Query texts and the assembly of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import bind


def query_text(messages: DataFrame, n: int, conv: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """The last n messages of each conversation that aren't the system's, newest first, one a line."""
    m = messages.where(F.coalesce(F.col(speaker), F.lit("")) != system).withColumn("_r", F.row_number().over(Window.partitionBy(conv).orderBy(F.col(order).desc()))).where(F.col("_r") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_r", F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return m.groupBy(conv).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("query_text"))


def ordered_text(text: Column, order: list[Column], joint: str = "\n\n") -> Column:
    """Aggregate column: texts in order, joined; null texts are left out, and of none the text is null."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), text.alias("t")))))
    return bind(rows, lambda r: F.when(F.size(r) > 0, F.array_join(F.transform(r, lambda x: x["t"]), joint)))


def falling(c: Column) -> list[Column]:
    """Keys of which the ascending order is c's descending one, nulls last."""
    return [c.isNull(), ~F.isnan(c.cast("double")), -c]


def joined(rows: DataFrame, per: list[str], text: Column, order: list[Column], joint: str = "\n\n", most: tuple[str, ...] = ()) -> DataFrame:
    """(per..., text, most...): all texts of each group in order, joined, and the greatest values of the columns `most`.

    Rows are dealt by ranges of group and order, each range joins its own part of a group, and a group joins those parts: however
    large it is, no task sorts or holds its rows. Order must be total within a group.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = rows.select(*per, *(o.alias(k) for o, k in zip(order, keys)), text.alias("_t"), *most).repartitionByRange(*per, *keys)
    parts = ranged.withColumn("_part", F.spark_partition_id()).groupBy(*per, "_part").agg(ordered_text(F.col("_t"), [F.col(k) for k in keys], joint).alias("_t"), *(F.max(m).alias(m) for m in most))
    return parts.groupBy(*per).agg(ordered_text(F.col("_t"), [F.col("_part")], joint).alias("text"), *(F.max(m).alias(m) for m in most))


def wrapped(text: Column, context: Column | None = None, tag: Column | None = None) -> Column:
    """A context line before, an XML tag around; null or empty ones are left out."""
    out = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"), text)).otherwise(text) if context is not None else text
    if tag is None:
        return out
    return F.when(F.coalesce(tag, F.lit("")) != "", F.concat(F.lit("<"), tag, F.lit(">\n"), out, F.lit("\n</"), tag, F.lit(">"))).otherwise(out)


def position(chunks: DataFrame, default: tuple[int, int] = (0, 2)) -> DataFrame:
    """Where a chunk goes: its own place, its override's, the collection's, the default - the first that is known."""
    pick = lambda c, d: F.coalesce(*(F.col(x) for x in (c, f"override_{c}", f"collection_{c}") if x in chunks.columns), F.lit(d))
    return chunks.withColumns({"position": pick("position", default[0]), "depth": pick("depth", default[1])})


def assembled(chunks: DataFrame, per: list[str] | None = None, global_context: str = "", global_tag: str = "") -> DataFrame:
    """(per..., context): chunks by score within collections, each wrapped, collections by their best score, wrapped again.

    chunks(collection_id, hash, text, score, context, xml_tag, collection_context, collection_tag).
    """
    per = per or []
    one = wrapped(F.col("text"), F.col("context"), F.col("xml_tag"))
    rows = chunks.select(*per, "collection_id", "hash", "score", one.alias("text"), F.col("score").alias("best"), F.col("collection_context").alias("cc"), F.col("collection_tag").alias("ct"))
    by = joined(rows, [*per, "collection_id"], F.col("text"), [*falling(F.col("score")), F.col("hash")], most=("best", "cc", "ct"))
    by = by.withColumn("text", wrapped(F.col("text"), F.col("cc"), F.col("ct")))
    out = by.groupBy(*per).agg(ordered_text(F.col("text"), [*falling(F.col("best")), F.col("collection_id")]).alias("context"))
    return out.withColumn("context", wrapped(F.col("context"), F.lit(global_context), F.lit(global_tag)))


def injected(chunks: DataFrame, global_context: str = "", global_tag: str = "") -> DataFrame:
    """One text for each (position, depth); with several places the global wrapping is left out."""
    places = chunks.select("position", "depth").distinct().limit(2).count()
    many = places > 1
    return assembled(chunks, ["position", "depth"], "" if many else global_context, "" if many else global_tag)


def without_attachments(text: Column, marker: str) -> Column:
    """What follows the attachment part of a message."""
    return F.trim(F.when(text.contains(marker), F.substring_index(text, marker, -1)).otherwise(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")
