"""Streams of messages: complete windows once each, cooldowns, debounced invalidation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import window_fingerprint
from ..operators.chunking import count_windows
from .windows import keyed_windows


def fingerprinted(messages: DataFrame, size: int, overlap: int, conv: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Complete windows with a fingerprint of their messages: an edited message makes another window."""
    h = messages.withColumn("_h", F.xxhash64(F.concat_ws(":", F.col(speaker), F.col(text))).cast("string"))
    w = count_windows(h, conv, order, "_h", size, overlap)
    return w.select(conv, "window_start", "window_end", window_fingerprint(F.split("text", "\n")).alias("fingerprint"))


def unprocessed(windows: DataFrame, ledger: DataFrame, marker: int = 0, conv: str = "conv_id") -> DataFrame:
    """Windows from the marker on that the ledger of done fingerprints doesn't have."""
    return windows.where(F.col("window_start") >= marker).join(ledger.select(conv, "fingerprint"), [conv, "fingerprint"], "left_anti")


def window_sync(messages: DataFrame, folder: str, handle: Callable[[DataFrame], DataFrame], size: int = 6, overlap: int = 0, conv: str = "conv_id", checkpoint: str | None = None, **options):
    """A stream writer: hands each complete window to handle, once, and again if one of its messages is edited soon after.

    handle(windows) returns the rows to store, under events/batch=N; what is late or missing (see keyed_windows) is under notes/batch=N. Windows
    come from the stream's state, so nothing that is stored is read again; a batch that is run again writes the same folders again.
    """
    base = folder.rstrip("/")

    def batch(rows: DataFrame, number: int) -> None:
        handle(rows.where(F.col("kind").isin("new", "edited"))).write.mode("overwrite").parquet(f"{base}/events/batch={number}")
        rows.where(F.col("kind").isin("late", "gap")).write.mode("overwrite").parquet(f"{base}/notes/batch={number}")

    def kept_batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # the state is advanced once for both tables
        try:
            batch(rows, number)
        finally:
            rows.unpersist()

    windows = keyed_windows(messages, size, overlap, conv, **options)
    return windows.writeStream.foreachBatch(kept_batch).option("checkpointLocation", checkpoint or f"{base}/checkpoint")


def cooldown(activations: DataFrame, key: str, at: str, most: int, wait: int, checkpointed: bool = True) -> DataFrame:
    """Stream of (key, at) with allowed: fewer than `most` before, and `wait` messages since the last allowed one."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for f in frames:
            f = f.sort_values(at)
            allowed = []
            for t in f[at]:
                ok = n < most and (last is None or t - last >= wait)
                if ok:
                    n, last = n + 1, int(t)
                allowed.append(ok)
            yield pd.DataFrame({key: f[key], at: f[at], "allowed": allowed})
        state.update((n, last))

    fields = dict(activations.dtypes)
    return activations.groupBy(key).applyInPandasWithState(step, f"{key} {fields[key]}, {at} {fields[at]}, allowed boolean", "n int, last long", "append", "NoTimeout")


def debounced(changes: DataFrame, key: str, ts: str, gap: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """One row for each run of changes of a key, when none has come for `gap`."""
    return changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("changes"), F.max(ts).alias("last_change"))


def sync_status(total: int, done: int, has_collection: bool) -> str:
    if total <= 0:
        return "no-chat"
    if not has_collection:
        return "no-collection"
    return "ahead" if done > total else "full" if done == total else "partial"


def tip_after(tip: int | None, end: int) -> int:
    """The tip never moves back."""
    return max(tip or 0, end + 1)
