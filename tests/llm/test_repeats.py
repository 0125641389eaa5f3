import random

import numpy as np
import pyarrow as pa
import pytest

from engram.llm import repeats
from engram.llm.fmindex import FMIndex, Marks
from engram.llm.repeats import Shard, without_repeats


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def brute(rows, window=13):
    first, gone = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in rows:
        w, g = t.split(), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                g.update(range(k, k + window))
        gone[i] = len(g)
    return gone


def test_marks_find_the_ones_around():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        bits = rng.random(n) < 0.02
        bits[0] = True
        at = np.append(np.flatnonzero(bits), n)
        i = np.arange(n)
        m = Marks(bits)
        assert (m.before(i) == at[np.searchsorted(at, i, "right") - 1]).all()
        assert (m.after(i) == at[np.searchsorted(at, i, "right")]).all()


def test_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        own = [[rng.randint(1, 4) for _ in range(rng.randint(5, 30))] for _ in range(rng.randint(1, 8))]
        stream = [[rng.randint(1, 5) for _ in range(rng.randint(1, 30))] for _ in range(5)]
        index = FMIndex(np.concatenate(own), np.array([len(x) for x in own]), np.arange(len(own)), 7, 5)
        sizes = np.array([len(x) for x in stream])
        long, low, high = index.matches(np.cumsum(sizes) - sizes, sizes, np.concatenate(stream))
        at = 0
        for s in stream:
            for k in range(len(s)):
                has = lambda p: [j for j, x in enumerate(own) if any(x[q : q + len(p)] == p for q in range(len(x) - len(p) + 1))]
                want = max((m for m in range(1, 6) if k + m <= len(s) and has(s[k : k + m])), default=0)
                assert long[at] == want
                if want:
                    assert sorted(set(index.owner[low[at] : high[at]])) == has(s[k : k + want])
                at += 1


def segments(rows):
    return pa.array([t.encode() for _, t in rows], pa.binary()), np.array([i for i, _ in rows])


def test_the_search_decides(monkeypatch):
    base = [f"w{k}" for k in range(40)]
    shard = Shard(*segments([(5, " ".join(base)), (3, " ".join(base[10:30]))]), 13)
    got = shard.earliest(pa.array([" ".join(["x", *base[5:30]]).encode()], pa.binary()))[0]
    assert list(got[1:]) == [5] * 5 + [3] * 8 and got[0] > 5
    monkeypatch.setattr(FMIndex, "matches", lambda self, starts, sizes, stream: (np.zeros(len(stream), np.int64),) * 3)
    assert min(shard.earliest(pa.array([" ".join(base).encode()], pa.binary()))[0]) > 5


def test_words_are_compared_not_hashes(spark):
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    one = " ".join([a] * 20)
    rows = [(1, one), (2, " ".join([b] * 20)), (3, one), (4, " ".join([thue_morse(64)] * 5 + [thue_morse(1024, "xy")] * 15))]
    got = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20, 4: 0}
    # two sequences of words in the same relation
    x = [f"a{c}" for c in thue_morse(1024)]
    y = [f"a{c}" for c in thue_morse(1024, "ba")]
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, "\t".join(x) + "\n\n")]
    got = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [1 << 10, 4])
def test_an_anchor_of_many_segments_is_cut_into_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", block)
    rng = random.Random(8)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(5)}"
        rows.append((1000 - i, "  ".join(w)))
    want = brute(rows)
    assert {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert sum(want.values()) > 10000


def test_an_index_is_made_of_whole_pairs_of_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "INDEX_SEGMENTS", 7)
    rng = random.Random(2)
    rows, ids = [], iter(range(10000))
    for anchor in range(6):
        base = [f"v{anchor}_{k}" for k in range(30)]  # equal windows have equal anchors
        for k in range(rng.randint(1, 30)):
            w = list(base)
            w[rng.randrange(30)] = f"e{rng.randrange(4)}"
            i = next(ids)
            rows.append((anchor, 0, 0, str(i).encode(), " ".join(w).encode(), i, i, k % 3 < 2, k % 3 > 0))
    names = ["anchor", "i", "j", "key", "words", "first", "last", "indexed", "streamed"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 11])], names) for k in range(0, len(rows), 11)]
    got = {k: f for b in repeats._searched(13)(iter(batches)) for k, f in zip(b["key"].to_pylist(), b["firsts"].to_pylist())}
    assert got and not set(got) & {r[3] for r in rows if not r[8]}
    for r in (r for r in rows if r[8]):
        w = r[4].split()
        for p in range(len(w) - 12):
            here = [x for x in rows if x[0] == r[0] and x[7] and any(x[4].split()[q : q + 13] == w[p : p + 13] for q in range(18))]
            least = min((x[5] for x in here), default=r[6])
            assert (got[r[3]][p] if r[3] in got else r[6]) == least or least >= r[6]
