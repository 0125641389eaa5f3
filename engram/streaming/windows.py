"""Count windows of a stream of messages, from state kept for each conversation: no stored message is read again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import window_fingerprint

_STATE = "next int, at array<int>, hash array<string>, text array<string>, start array<int>, print array<string>"


@dataclass
class Tail:
    """What a conversation's state holds: its open messages, those of the last windows, and what these windows were made of."""

    size: int
    step: int
    keep: int
    next: int = 0  # start of the first window that has not fired
    messages: dict[int, tuple[str, str]] = field(default_factory=dict)  # place -> (hash, text)
    fired: dict[int, str] = field(default_factory=dict)  # start -> the hashes behind it

    def _window(self, start: int, kind: str) -> tuple[int, int, str, list[str], list[str]]:
        own = [self.messages[i] for i in range(start, start + self.size)]
        self.fired[start] = ":".join(h for h, _ in own)
        return start, start + self.size - 1, kind, [h for h, _ in own], [t for _, t in own]

    def _ready(self, start: int) -> bool:
        return all(i in self.messages for i in range(start, start + self.size))

    def _go_on(self) -> Iterator[tuple]:
        while self._ready(self.next):
            yield self._window(self.next, "new")
            self.next += self.step
        low = self.next - self.keep * self.step
        self.messages = {i: m for i, m in self.messages.items() if i >= low}
        self.fired = {s: p for s, p in self.fired.items() if s >= low}

    def add(self, rows: list[tuple[int, str, str]]) -> list[tuple]:
        """Messages (place, hash, text), the later of one place in its stead; returns windows (start, end, kind, hashes, texts).

        new: complete for the first time. edited: fired before, and one of its messages has changed. late: a message older than all that
        is kept, alone; its windows are to be made again from what is stored.
        """
        low, out, changed = self.next - self.keep * self.step, [], set()
        for at, h, text in rows:
            if at < low:
                out.append((at, at, "late", [h], [text]))
            elif self.messages.get(at, ("",))[0] != h:
                self.messages[at] = (h, text)
                changed.add(at)
        for start in sorted(self.fired):
            if any(start <= i < start + self.size for i in changed) and ":".join(self.messages[i][0] for i in range(start, start + self.size)) != self.fired[start]:
                out.append(self._window(start, "edited"))
        return [*out, *self._go_on()]

    def skip(self) -> list[tuple]:
        """Go on behind the first missing message, if others have come after it; the windows with it are given as one gap."""
        missing = next(i for i in range(self.next, max(self.messages, default=self.next) + 2) if i not in self.messages)
        after = min((i for i in self.messages if i > missing), default=None)
        if after is None:
            return []
        start, self.next = self.next, -(-after // self.step) * self.step
        return [(start, self.next - 1, "gap", [], []), *self._go_on()]


def keyed_windows(messages: DataFrame, size: int, overlap: int = 0, conv: str = "conv_id", place: str = "turn", speaker: str = "role", text: str = "text", version: str | None = None, keep: int = 2, stall_ms: int | None = None) -> DataFrame:
    """Stream of (conv, window_start, window_end, kind, text, fingerprint) of windows of size messages, one every size - overlap.

    place counts a conversation's messages from 0. They may come in any order and more than once; of one place the greatest version (or the
    last to come) stands. Each complete window comes once as new, and again as edited if a message of one of the last keep windows
    is another one now; what is older comes as late. The state is those windows and the open tail. If a message is missing
    for stall_ms although others came after it, the windows with it are given up as one gap.
    """
    size = max(2, size)
    step = size - max(0, min(size - 1, overlap))
    hashed = F.xxhash64(F.concat_ws(":", F.col(speaker), F.col(text))).cast("string")
    rank = F.col(version).cast("string") if version else F.lit("")
    rows = messages.where(F.col(place).isNotNull()).select(F.col(conv).alias("conv"), F.col(place).cast("int").alias("at"), hashed.alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"), rank.alias("rank"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = Tail(size, step, keep)
        if state.exists:
            n, at, hashes, texts, starts, prints = state.get
            tail.next, tail.messages, tail.fired = int(n), dict(zip(map(int, at), zip(hashes, texts))), dict(zip(map(int, starts), prints))
        if state.hasTimedOut:
            out = tail.skip()
        else:
            rows = pd.concat(list(frames)).sort_values("rank", kind="stable")
            out = tail.add([(int(a), h, t) for a, h, t in zip(rows["at"], rows["hash"], rows["text"])])
        order = sorted(tail.messages)
        state.update((tail.next, order, [tail.messages[i][0] for i in order], [tail.messages[i][1] for i in order], list(tail.fired), list(tail.fired.values())))
        if stall_ms is not None and any(i > tail.next for i in order):
            state.setTimeoutDuration(stall_ms)
        yield pd.DataFrame([(key[0], *w) for w in out], columns=["conv", "window_start", "window_end", "kind", "hashes", "texts"])

    kind = rows.schema["conv"].dataType.simpleString()
    timer = GroupStateTimeout.NoTimeout if stall_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = rows.groupBy("conv").applyInPandasWithState(run, f"conv {kind}, window_start int, window_end int, kind string, hashes array<string>, texts array<string>", _STATE, "append", timer)
    return out.select(F.col("conv").alias(conv), "window_start", "window_end", "kind", F.array_join("texts", "\n").alias("text"), window_fingerprint(F.col("hashes")).alias("fingerprint"))
