"""Windows in keyed state against all windows of the messages that stand in the end."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.streaming import sync
from engram.streaming.windows import Tail

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size, step", [(2, 2), (3, 1), (4, 3)])
def test_a_tail_gives_each_window_once_whatever_the_order(size, step):
    rng = random.Random(size)
    for _ in range(60):
        n = rng.randrange(0, 25)
        sent = [(i, f"h{i}", f"m{i}") for i in range(n)]
        sent += rng.choices(sent, k=n // 2) if n else []
        blocks = [sent[i : i + 4] for i in range(0, len(sent), 4)]
        tail, got = Tail(size, step, keep=100), []
        for b in rng.sample(blocks, len(blocks)):
            got += tail.add(b)
        want = [(s, s + size - 1, "new", [f"h{i}" for i in range(s, s + size)], [f"m{i}" for i in range(s, s + size)]) for s in range(0, n - size + 1, step)]
        assert sorted(got) == want


def test_edits_replace_their_message_and_old_ones_are_told():
    tail = Tail(2, 2, keep=1)
    assert [w[:3] for w in tail.add([(i, f"h{i}", f"m{i}") for i in range(7)])] == [(0, 1, "new"), (2, 3, "new"), (4, 5, "new")]
    assert sorted(tail.messages) == [4, 5, 6] and list(tail.fired) == [4]
    assert tail.add([(4, "h4", "m4"), (6, "h6", "m6")]) == []  # sent again
    assert tail.add([(5, "x", "edit"), (6, "y", "tail edit")]) == [(4, 5, "edited", ["h4", "x"], ["m4", "edit"])]
    assert tail.add([(1, "z", "old")]) == [(1, 1, "late", ["z"], ["old"])]
    assert tail.add([(7, "h7", "m7")]) == [(6, 7, "new", ["y", "h7"], ["tail edit", "m7"])]
    tail.add([(i, f"h{i}", "m") for i in range(8, 2000)])
    assert len(tail.messages) <= 4 and len(tail.fired) == 1  # the state does not grow


def test_a_missing_message_is_given_up():
    tail = Tail(2, 2, keep=1)
    assert tail.add([(0, "a", "a"), (3, "d", "d"), (4, "e", "e"), (5, "f", "f")]) == []
    assert [w[:3] for w in tail.skip()] == [(0, 3, "gap"), (4, 5, "new")]
    assert tail.skip() == []


def run(spark, tmp_path, batches, **options):
    src = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        sync.window_sync(stream, f"{tmp_path}/out", lambda w: w, **options).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out/events").collect(), spark.read.parquet(f"{tmp_path}/out/notes").collect()


def test_windows_over_restarts_and_edits(spark, tmp_path):
    """Each batch is a query of its own, so the state comes from the checkpoint."""
    batches = [
        [(c, i, "u", f"m{i}") for c in (1, 2) for i in range(5)],
        [(1, 3, "u", "edited"), (1, 5, "u", "m5"), (2, 4, "u", "m4")],
        [(1, 4, "u", "tail"), (1, 0, "u", "too old"), (2, 6, "u", "m6")],
    ]
    events, notes = run(spark, tmp_path, batches, size=2, keep=1)
    got = Counter((r.conv_id, r.window_start, r.kind, r.text) for r in events)
    assert got == Counter([
        (1, 0, "new", "m0\nm1"), (1, 2, "new", "m2\nm3"), (2, 0, "new", "m0\nm1"), (2, 2, "new", "m2\nm3"),
        (1, 2, "edited", "m2\nedited"), (1, 4, "new", "m4\nm5"), (1, 4, "edited", "tail\nm5"),
    ])
    assert [(r.conv_id, r.kind, r.text) for r in notes] == [(1, "late", "too old")]
    stored = spark.createDataFrame([(1, i, "u", t) for i, t in enumerate(["m0", "m1", "m2", "edited", "tail", "m5"])], SCHEMA)
    prints = {(r.window_start, r.fingerprint) for r in sync.fingerprinted(stored, 2, 0).collect()}
    assert prints <= {(r.window_start, r.fingerprint) for r in events}  # as the batch job makes them
    assert sync.unprocessed(sync.fingerprinted(stored, 2, 0), spark.createDataFrame([(1, f) for _, f in prints], "conv_id long, fingerprint string")).count() == 0


def test_cooldown_and_debounce_streams(spark, tmp_path):
    spark.createDataFrame([("k", i) for i in range(0, 100, 5)] + [("j", 3)], "key string, at long").coalesce(1).write.parquet(f"{tmp_path}/a")
    stream = sync.cooldown(spark.readStream.schema("key string, at long").parquet(f"{tmp_path}/a"), "key", "at", 3, 12)
    stream.writeStream.format("memory").queryName("cooled").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r["at"]) for r in spark.table("cooled").where("allowed").collect()) == [("j", 3), ("k", 0), ("k", 15), ("k", 30)]
    times = [("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:00:30"), ("x", "2024-01-01 00:05:00"), ("y", "2024-01-01 01:00:00")]
    spark.createDataFrame(times, "key string, ts string").select("key", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/b")
    out = sync.debounced(spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/b"), "key", "ts")
    out.writeStream.format("memory").queryName("bounced").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r.changes) for r in spark.table("bounced").collect()) in ([("x", 1), ("x", 2)], [("x", 1), ("x", 2), ("y", 1)])
