"""Chunks of texts and of conversations. Every strategy gives one row a chunk with its place in the unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import packing

CHUNK_SIZE = 500


def _exploded(df: DataFrame, chunks: Column, strategy: str) -> DataFrame:
    """A row for each chunk: chunk_index, total_chunks, strategy and text replace the text.

    The list itself is not carried along with each row; and it is exploded as an outer one, as otherwise a filter on its size is inferred
    below it that makes all chunks once more.
    """
    rest = [c for c in df.columns if c != "text"]
    counted = df.withColumn("_c", chunks).withColumn("_n", F.size("_c"))
    out = counted.select(*rest, F.posexplode_outer("_c").alias("chunk_index", "text"), F.col("_n").alias("total_chunks"), F.lit(strategy).alias("strategy"))
    return out.where("chunk_index IS NOT NULL")


def _trimmed(parts: Column) -> Column:
    strip = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def paragraphs(df: DataFrame) -> DataFrame:
    """Blank lines and rules of dashes divide."""
    return _exploded(df, _trimmed(F.split(F.coalesce("text", F.lit("")), r"\n\n+|(?m)^---+$")), "paragraph")


def sections(df: DataFrame) -> DataFrame:
    """Markdown headers begin a chunk."""
    return _exploded(df, _trimmed(F.split(F.coalesce("text", F.lit("")), r"(?m)(?=^#{1,6}\s+.+$)")), "section")


def sentences(df: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Sentences packed up to size."""
    return _exploded(df, packing.by_sentences(F.col("text"), size), "sentence")


def adaptive(df: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Paragraphs packed up to size; those beyond it by sentences, then words."""
    return _exploded(df, packing.by_paragraphs(F.col("text"), size), "adaptive")


def dialogue(df: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Quoted speech is never cut unless it alone is longer than size."""
    return _exploded(df, packing.by_speech(F.col("text"), size), "dialogue")


def whole(df: DataFrame, strategy: str = "per_message") -> DataFrame:
    """Each unit is a chunk: messages, entries, fields."""
    return df.withColumns({"chunk_index": F.lit(0), "total_chunks": F.lit(1), "strategy": F.lit(strategy)})


def combined(df: DataFrame, per: list[str], order: str, size: int = CHUNK_SIZE) -> DataFrame:
    """All texts of a unit in order, then adaptive."""
    joined = df.groupBy(*per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return adaptive(joined, size)


def numbered(messages: DataFrame, conv: str, order: str) -> DataFrame:
    return messages.withColumn("idx", F.row_number().over(Window.partitionBy(conv).orderBy(order)) - 1)


def message_batches(messages: DataFrame, conv: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text", size: int = 4) -> DataFrame:
    """Every `size` messages of a conversation with their speakers, the rest as a shorter last one. size 2 are turns."""
    m = numbered(messages, conv, order).withColumn("batch", F.floor(F.col("idx") / size).cast("int"))
    line = F.concat(F.lit("["), F.coalesce(F.col(speaker), F.lit("Character")), F.lit("]: "), F.coalesce(F.col(text), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return m.groupBy(conv, "batch").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"), F.count("*").cast("int").alias("messages"), F.min("idx").alias("start_index"), F.max("idx").alias("end_index"))


def count_windows(messages: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", size: int = 2, overlap: int = 0) -> DataFrame:
    """Complete windows of `size` messages that begin every size - overlap; the tail that fills none is dropped.

    A message is copied into the windows that hold it, at most size / step of them, found by arithmetic, so the windows are one grouping
    and no join.
    """
    size = max(2, size)
    step = size - max(0, min(size - 1, overlap))
    m = numbered(messages, conv, order).withColumn("n", F.count("*").over(Window.partitionBy(conv)))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)).cast("int")
    m = m.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("idx") / step).cast("int")))).where(F.col("w") * step + size <= F.col("n"))
    rows = F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.col(text), F.lit("")).alias("t"))))
    out = m.groupBy(conv, "w").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))
    return out.select(conv, (F.col("w") * step).cast("int").alias("window_start"), (F.col("w") * step + size - 1).cast("int").alias("window_end"), "text")


def last_window_start(n: Column, size: int, overlap: int) -> Column:
    size = max(2, size)
    step = size - max(0, min(size - 1, overlap))
    return F.when(n >= size, F.floor((n - size) / step) * step)


STRATEGIES = {"per_message": whole, "conversation_turns": lambda m, **k: message_batches(m, size=2, **k), "message_batch": message_batches, "adaptive": adaptive, "paragraph": paragraphs, "section": sections, "sentence": sentences, "per_entry": lambda d: whole(d, "per_entry"), "per_field": lambda d: whole(d, "per_field"), "per_page": lambda d: whole(d, "per_page"), "combined": combined, "dialogue": dialogue}
UNIT_STRATEGIES = {"per_message", "conversation_turns", "message_batch", "per_entry", "per_field", "per_page"}


def chunk(df: DataFrame, strategy: str, **options) -> DataFrame:
    """Unknown strategies are adaptive."""
    return STRATEGIES.get(strategy, adaptive)(df, **options)


def batches_of(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Fixed-size batches of a small table."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))

