import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from engram.llm import minhash
from engram.llm.minhash import minhash_components

SF = "/root/testdata/sf0.01"


def sets_of(rows, ngram):
    out = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else set())
    return out


def brute(rows, ngram, num, den):
    sets = sets_of(rows, ngram)
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in by[g]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("ngram,num", [(3, 85), (5, 80)])
def test_whole_table_equals_brute_force(spark, ngram, num):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ngram, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_components(docs, ngram=ngram, numerator=num).collect()}
    assert got == want


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(100))
    near = text.replace("w50 ", "x50 ")
    rows = [(1, text), (2, near), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "One TWO"), (8, "two one"), (9, text), (9, text), (None, text), (10, "a " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "component": F.lit("x"), "d1": F.lit(0)})
    got = defaultdict(list)
    for r in minhash_components(docs, ngram=3, numerator=85).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(98, 1, True)] and got[2] == [(98, 1, False)] and got[9] == [(98, 1, False)] * 2
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)]
    assert got[6] == [(1, 6, True)] and got[7] == [(1, 6, False)] and got[8] == [(1, 8, True)]
    assert got[None] == [(98, None, True)] and got[10] == [(1, 10, True)]
    assert minhash_components(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_stays_one(spark):
    base = [f"v{k}" for k in range(150)]
    rows = [(i, " ".join(base[:j] + [f"edit{i}"] + base[j + 1 :])) for i in range(3000) for j in [(i * 7) % 150]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert minhash_components(docs, ngram=3, numerator=85).where("component_id <> 0").count() == 0


@pytest.mark.parametrize("original", [0, 700, 1500])
def test_unlinked_copies_of_one_original_are_joined_by_it(spark, original):
    """1,500 copies with six words edited each, so that copies link to the original alone, whatever its id."""
    base = [f"v{k}" for k in range(300)]
    draw = random.Random(5)
    rows = [(original, " ".join(base))]
    for i in range(1501):
        if i != original:
            at = set(draw.sample(range(5, 295, 5), 6))
            rows.append((i, " ".join(f"e{i}" if k in at else w for k, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert minhash_components(docs, ngram=3, numerator=85).where("component_id <> 0").count() == 0


def test_boilerplate_that_all_share_hides_no_link(spark):
    """1,000 pairs; all documents are near the threshold by boilerplate, only the two of a pair are above it."""
    shared = [f"s{k}" for k in range(1000)]
    rows = [(i, " ".join([*shared, *(f"p{i // 2}_{k}" for k in range(31)), *(f"d{i}_{k}" for k in range(70))])) for i in range(2000)]
    want = brute(rows[:6], 3, 85, 100)
    assert [want[i][1] for i in range(6)] == [0, 0, 2, 2, 4, 4]
    got = {r.doc_id: r.component_id for r in minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), ngram=3, numerator=85).collect()}
    assert got == {i: i // 2 * 2 for i in range(2000)}


def test_regions_beyond_a_block_descend_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 40)
    shared = [f"s{k}" for k in range(200)]
    rows = [(i, " ".join([*shared, *(f"p{i // 2}_{k}" for k in range(6)), *(f"d{i}_{k}" for k in range(14))])) for i in range(300)]
    assert brute(rows[:4], 3, 85, 100)[3][1] == 2
    got = {r.doc_id: r.component_id for r in minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), ngram=3, numerator=85).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}


def test_repetitive_words_have_hashes_of_their_own(spark):
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    u = t.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in minhash_components(spark.createDataFrame([(1, t), (2, u), (3, t.upper())], "doc_id long, text string"), ngram=3, numerator=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
