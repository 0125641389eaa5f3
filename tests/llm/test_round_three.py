"""Resampling, nearest neighbours and source divergence against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import neighbours
from engram.llm.divergence import possible_terms, source_divergence, term_counts
from engram.llm.neighbours import MultiIndex, nearest
from engram.llm.queries import QUERIES
from engram.llm.resample import resampled

A_Z = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
SF = "/root/testdata/sf0.001"


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(A_Z))


def plain_resampled(docs, target, buckets, most, percent, least, seed):
    runs = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(at(g) for _, x in docs for g in runs(x)), Counter(at(g) for x in target for g in runs(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f = runs(x)
        weight = sum(gain[at(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_a_plain_version(spark, most):
    rng = random.Random(most)
    vocabulary = ["Äpfel", "ÉCLAIR", "Zug", "42", "日本語", "x\0y", "don't", "A-B", *(f"W{i}" for i in range(30))]
    docs = [(i, rng.choice([" ", "\t", "\n", "; "]).join(rng.choices(vocabulary, k=rng.choice([1, 5, 25, 60])))) for i in range(60)]
    docs += [(None, "a " * 30), (60, None), (61, ""), (62, " .,;\0 "), (7, docs[7][1]), (7, docs[7][1]), (63, "long " * 50_000)]
    target = ["W1 W2 W3 42 日本語", None, "", "Zug Zug w1"]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "w": F.lit(1), "id": F.lit(2), "part": F.lit(3)}).repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampled(rows, bench, most=most, buckets=97, percent=40, least_words=5)
    assert Counter(map(tuple, got.collect())) == plain_resampled(docs, target, 97, most, 40, 5, 2024)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampled(none, some).collect() == []
    assert [tuple(r) for r in resampled(some, none, least_words=1, percent=100, buckets=7).select("doc_id", "n_features", "rank").collect()] == [(1, 3, 1)]


def test_ranks_of_many_ranges_have_no_gap(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 9), 25)).alias("text"))
    got = resampled(docs, docs.where("doc_id < 9")).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)


def plain_divergence(docs, least, most_terms):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    terms = lambda t: words(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, n, groups, out = Counter(), Counter(), defaultdict(set), []
    for t, lang, s in docs:
        groups[lang].add(s)
        df.update((lang, w) for w in set(terms(t)))
        n.update((lang, s, w) for w in terms(t))
    for lang, sources in groups.items():
        kept = sorted(w for (x, w), c in df.items() if x == lang and c >= least)
        share = lambda counts: {w: 1 + 10**9 * (counts[w] + 5) // (sum(counts.values()) + 5 * len(kept)) for w in kept}
        counts = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        p, q = {s: share(counts[s]) for s in sources}, share({w: sum(counts[s][w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            over = [(p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", over, most_terms)):
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return Counter(out)


def divergence_docs(seed):
    rng = random.Random(seed)
    vocabulary = ["Äpfel", "ÉCLAIR", "Zug", "日本語", "a1b", "don't", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = [(" ".join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.choice([0, 1, 8, 40]))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", None, "S1"])) for _ in range(200)]
    return docs + [(None, "en", "only null"), ("", "xx", "a"), ("word", "xx", "b"), ("123 456", "yy", "alone"), ("long tail " * 40_000, "en", "s2"), docs[0], docs[0]]


@pytest.mark.parametrize("width", [1 << 16, 8])
def test_divergence_equals_a_plain_version_even_with_a_crowded_sketch(spark, width):
    docs = divergence_docs(width)
    rows = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"n": F.lit("clash"), "term": F.lit(1), "docs": F.lit(2)}).repartition(6)
    got = source_divergence(rows, least=10, most_terms=5, width=width)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_divergence(docs, 10, 5)


def test_the_sketch_discards_before_the_shuffle_and_loses_no_term(spark):
    docs = [(f"common rare{i} " + "twice " * (i % 2), "en", f"s{i % 3}") for i in range(100)]
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = spark.createDataFrame([(t.translate(letters), lang, s) for t, lang, s in docs], "text string, lang string, source string").repartition(7)
    counts = term_counts(rows, least=30)
    assert {r.term for r in counts.collect()} == {"common", "twice"}
    assert {r.term for r in term_counts(rows, least=30, width=1, depth=1).collect()} > {"common", "twice"}
    assert np.unpackbits(possible_terms(rows, 101)).sum() == 0


def test_divergence_of_an_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


@pytest.mark.parametrize("held_rows", [3, 40, 1 << 20])
def test_counts_of_a_task_are_added_up_and_sent_on_when_they_are_many(spark, held_rows):
    docs = divergence_docs(5) * 5
    rows = spark.createDataFrame(docs, "text string, lang string, source string").fillna("").coalesce(1)
    with_batches = rows.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r.lang, r.source, r.term): r.n for r in term_counts(rows, 1, held_rows=held_rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    assert got == dict(Counter((lang or "", s or "", w) for t, lang, s in docs for w in words(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")))


def exact(rows, k, every):
    """rows: (id, vector)."""
    out = []
    for q, v in {(q, v) for q, v in rows if q % every == 0}:
        best = {}
        for i, x in rows:
            if i != q:
                s = 0.0
                for a, b in zip(v, x):
                    s += a * b
                best[i] = max(best.get(i, -math.inf), s)
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_neighbours_without_a_margin_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), tuple(map(float, v))) for i, v in enumerate(rng.normal(size=(300, 7)).round(2))]
    rows += [(1000 + i, rows[40][1]) for i in range(50)] + [(2000 + i, rows[41][1]) for i in range(30)]  # equal vectors
    odd = [(9001, None), (9002, [0.0] * 7), (9003, [None] + [1.0] * 6), (9004, [math.nan] * 7), (9005, [math.inf] * 7), (9006, []), (9007, [1.0] * 3), (None, [1.0] * 7), (9020, None)]
    table = spark.createDataFrame([(i, list(v)) for i, v in rows] + odd + [(5, list(rows[5][1]))], "vec_id long, embedding array<double>").withColumns({"id": F.lit("clash"), "v": F.lit(1), "a": F.lit(2)}).repartition(4)
    got = sorted(map(tuple, nearest(table, k=5, every=10, margin=math.inf, centroids=8).collect()))
    assert got == exact(rows, 5, 10)


def test_neighbours_of_small_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nearest(few).collect())) == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert nearest(few.where("vec_id < 0")).collect() == []
    assert nearest(few.where("vec_id = 0")).collect() == []
    one = spark.createDataFrame([(i, [float(i)]) for i in range(1, 30)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest(one, k=2).orderBy("rank").collect()] == [29, 28]


def test_recall_of_the_query(spark):
    """On the given vectors, which are like noise, and on clustered ones, where few cells are read."""
    rows = [(r.vec_id, tuple(map(float, r.embedding))) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in exact(rows, 20, 20)}
    got = QUERIES["op12_neighbours"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.95 * len(want)
    x = dict(rows)
    assert all(abs(r.score - sum(a * b for a, b in zip(x[r.query_id], x[r.vec_id]))) < 1e-12 for r in got)


def test_pairs_of_centroids_come_by_summed_score():
    rng = np.random.default_rng(2)
    for _ in range(50):
        cells = rng.integers(0, 4, (5, 6))
        index = MultiIndex(np.zeros((5, 1)), np.zeros((6, 1)), np.zeros(2), cells)
        a, b, n = rng.normal(size=5), rng.normal(size=6), int(rng.integers(1, 90))
        order = sorted(((a[i] + b[j], cells[i, j]) for i in range(5) for j in range(6)), reverse=True)
        seen, want = 0, -math.inf
        for s, c in order:
            seen += c
            if seen >= n:
                want = s
                break
        assert index.reach(a, b, n) == want


def test_shards_hold_their_rows():
    counts = np.array([10, 5000, 0, 9000, 4000, 200, 1])
    first, parts = neighbours._shards(counts)
    held = Counter()
    for c, f, p in zip(counts, first, parts):
        for j in range(p):
            held[f + j] += -(-c // p)
    assert max(held.values()) <= neighbours.SHARD_ROWS and len(held) == max(held) + 1
