"""Near copies against a walk in order of score."""

import random

import pytest

from engram.operators import suppression

SCHEMA = "event_id long, event_type string, score double, final_score double, source_window_end int, characters array<string>, rerank_applied boolean, lookup string"


def walk(rows, gap, per=False):
    kept = []
    for r in sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else float("-inf")), r[0])):
        names = {x.lower() for x in r[5] or []}
        for k in kept:
            other = {x.lower() for x in k[5] or []}
            close = r[4] is None or k[4] is None or abs(r[4] - k[4]) < gap
            same = r[1] == k[1] and (not per or r[7] == k[7]) and close and names and other and len(names & other) / len(names | other) >= 0.6
            if same and not (not r[6] and not k[6] and (r[2] or 0) >= 0.75):
                break
        else:
            kept.append(r)
    return sorted(k[0] for k in kept)


def events(seed, n=200):
    rng = random.Random(seed)
    cast = [["Ann"], ["ann", "Bob"], ["Ann", "Bob", "Cid"], ["Dora"], [], None, ["Bob", "Cid"]]
    return [
        (i, rng.choice(["combat", "travel", None]), rng.choice([0.2, 0.74, 0.75, 0.9, None]), rng.choice([0.1, 0.5, 0.5, 0.9, None]), rng.choice([None, *range(60)]) if rng.random() < 0.3 else rng.randrange(60), rng.choice(cast), rng.choice([True, False, False, None]), rng.choice(["x", "y"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_a_walk(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(r.event_id for r in suppression.near_copies_dropped(df, gap=5).collect()) == walk(rows, 5)
    assert sorted(r.event_id for r in suppression.few_kept(df, gap=5).collect()) == walk(rows, 5)
    assert sorted(r.event_id for r in suppression.near_copies_dropped(df, gap=5, per=["lookup"]).collect()) == sorted(walk([r for r in rows if r[7] == "x"], 5) + walk([r for r in rows if r[7] == "y"], 5))


def test_rounds_are_as_many_as_the_longest_chain(spark):
    """Rows 0..29 each repeat the one before and no other: every second one stays."""
    chain = [(i, "combat", 0.1, 1 - i / 100, 9 * i, ["Ann"], False, "x") for i in range(30)]
    alone = [(100 + i, "combat", 0.1, 0.5, 1000 * i, [f"p{i}"], False, "x") for i in range(50)]
    df = spark.createDataFrame(chain + alone, SCHEMA).selectExpr("*", "event_id AS _row")
    gone, rounds = suppression.dropped_rows(suppression.copy_pairs(df, gap=10))
    assert sorted(r.i for r in gone.collect()) == list(range(1, 30, 2)) and rounds == 15
    star = spark.createDataFrame([(i, "combat", 0.1, 1 - i / 1000, 5, ["Ann"], False, "x") for i in range(100)], SCHEMA).selectExpr("*", "event_id AS _row")
    gone, rounds = suppression.dropped_rows(suppression.copy_pairs(star))
    assert gone.count() == 99 and rounds == 1


def test_no_rows_and_no_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suppression.near_copies_dropped(none).collect() == [] and suppression.few_kept(none).collect() == []
