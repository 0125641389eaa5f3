"""A small test for each finding of round 3 that held."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import hashing, text as tx, vectors
from engram.operators import keywords, reformat, text_index
from engram.plans import more, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def sql_rows(name: str, d: str) -> list[tuple]:
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{d}/{f}{'/*.parquet' if os.path.isdir(f'{d}/{f}') else ''}')")
    return con.execute(registry.ORACLES[name]).fetchall()


@pytest.mark.parametrize("first", ["0 Stra\u00dfe", "_0 under", " _ 0 both_", "0 \ufb01ne", None])
def test_title_lookup_finds_titles_that_case_does_not_lead_back_to(spark, tmp_path, first):
    titles = ([first, first.replace("_", " ").strip()] if first else []) + ["zz"]
    rows = [(i, f"https://a.com/{i}", f"<title>{t}</title>") for i, t in enumerate(titles)] if first else [(0, "https://a.com/0", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.key, r.title) for r in registry.QUERIES["title_lookup"](spark, str(tmp_path)).collect()}
    assert got == set(sql_rows("title_lookup", str(tmp_path))) and (got or first is None)


def test_event_format_has_every_event(spark, tmp_path):
    rows = [(i, "a" if i % 3 else None if i % 2 else "b", i % 7, None if i % 50 == 1 else float(i * 37 % 11), '{"k": 1}') for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: r.context for r in registry.QUERIES["event_format"](spark, str(tmp_path)).collect()}
    assert got == dict(sql_rows("event_format", str(tmp_path))) and got["a"].count("\n") == 1999 and got["b"].count("\n") == 499


def test_context_text_has_every_chunk_above_the_threshold(spark, tmp_path):
    docs = [(i, f"text {i}" if i % 9 else None, f"s{i % 4}") for i in range(500)]
    vectors = [(i, [1.0, (i * 7 % 40) / 10.0]) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["context_text"](spark, str(tmp_path)).collect()[0].context
    assert got == sql_rows("context_text", str(tmp_path))[0][0] and got.count("note\n") == 400 - 45


def test_stems_of_many_words_are_those_of_the_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = ["", "a", "Ties", "agreed", "eed", "feed", "ed", "ing", "sing", "hopping", "falling", "Straßen", "İstanbuling", "nationalization", "caresses", "s", "ss", "bless", "probate", "cease", "一ing", "\U0001d4b3ing", "rational", "conflated", "sized", None]
    words = docs.select(F.explode(tx.latin_tokens(F.col("text"), 1)).alias("w")).distinct().unionByName(spark.createDataFrame([(w,) for w in made], "w string"))
    both = words.select("w", tx.stem(F.col("w")).alias("a"), tx.stems(F.col("w")).alias("b"), hashing.fnv1a(F.col("w")).alias("h")).collect()
    assert [r for r in both if r.a != r.b] == [] and len(both) > 40000
    assert all(hashing.fnv1a_word(r.w) == r.h for r in both if r.w is not None)


def test_sparse_vectors_neither_stems_nor_hashes_each_token_in_the_plan(spark):
    df = registry.QUERIES["sparse_vectors"](spark, SF)
    old = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.explode(tx.tokenize(F.col("text"), dedupe=False)).alias("t")).groupBy("doc_id", hashing.fnv1a(F.col("t")).alias("index")).agg(F.count("*").alias("tf"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(df.select("doc_id", "index", "tf")) == rows(old)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "ational" not in plan


def test_tfidf_keywords_shuffles_short_lists_only(spark):
    plan = registry.QUERIES["tfidf_keywords"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Generate") == 1


def test_frequency_keywords_shuffles_short_lists_only(spark):
    plan = registry.QUERIES["frequency_keywords"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Union" not in plan and plan.count("Generate") == 1


def test_nearest_many_holds_a_bounded_tile_and_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.repeat(rng.integers(-2, 3, (60, 4)), 7, axis=0).astype(float)
    rows = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")
    want = {}
    for q in range(0, len(m), 5):
        a = [(0.0 if not (n := math.sqrt(sum(x * x for x in m[q])) * math.sqrt(sum(x * x for x in v))) else float(m[q] @ v) / n) for v in m]
        want[q] = sorted(range(len(m)), key=lambda i: (-round(a[i], 12), i))[:9]
    for size in ((1 << 15, 1 << 13, 1 << 21), (50, 20, 64)):
        for name, n in zip(("SHARD_ROWS", "QUERY_ROWS", "BLOCK_VALUES"), size):
            monkeypatch.setattr(vectors, name, n)
        got = {}
        for r in vectors.nearest_many(rows, rows.where("id % 5 = 0").withColumnRenamed("id", "query_id"), 9, "id", "v").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    tile = max(len(x[0]) for x in vectors._k_best(m, np.arange(len(m)), m, 9))
    assert tile <= 9 * max(1, vectors.BLOCK_VALUES // 60) and len(list(vectors._k_best(m, np.arange(len(m)), m, 9))) > 1


def test_chains_are_streamed_and_go_on_over_the_ends_of_frames(spark):
    rows = [(i, n // 3 if i % 2 else 0, n, n % 3 if i % 2 else n, None, f"{i} {n}") for i in range(40) for n in range(6)]
    batches = spark.createDataFrame(rows, "doc_id long, chain int, batch int, part int, section_title string, text string").repartition(5)
    record = lambda text, title, names, missing: [{"name": f"{text}#{len(names)}", "body": "b"}]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = reformat.extracted(batches, record, coverage=None)
        got = {(r.doc_id, r.batch, r.pos, r.record.name) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, n, p, f"{i} {n}#{p}") for i in range(40) for n in range(6) for p in [n % 3 if i % 2 else n]}
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_keyword_patterns_find_what_they_did_in_linear_time(spark):
    import random

    rng = random.Random(6)
    parts = ["[", "]", "(", ")", "*", "/", "_", " ", "  ", "\n", "\t", "\x0b", "'s", "[keyword: ", "[Keywords ", "a", "B", "Zb", "Wort", "Word", "word's", "9", "é", "Kind", "İstan", "東京", "都", "【東京】", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (3000, None)], "id long, text string")
    old_tags = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)\s*\[keywords?[:\s][^\]]*\]", ""), rf"\[[^\]{tx.CJK}]{{1,30}}\]", " ")
    old_compound, old_names = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]+[/_][A-Za-z0-9_]+(?![A-Za-z0-9_])", r"\b[A-Z][a-z]{3,}\b"
    found = lambda p: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0))
    words = F.concat(F.regexp_extract_all(F.lower("text"), F.lit(keywords.LATIN_WORD), F.lit(0)), tx.cjk_tokens(F.col("text")))
    both = docs.select(
        keywords._untagged(F.col("text")).alias("a"), F.trim(F.regexp_replace(old_tags, r"\s+", " ")).alias("b"), found(keywords.COMPOUND).alias("c"), found(old_compound).alias("d"),
        found(keywords.CAPITALISED).alias("e"), found(old_names).alias("f"), keywords._replaced(F.col("text"), keywords.CITATIONS, " ", ")").alias("g"), F.regexp_replace("text", keywords.CITATIONS, " ").alias("h"), "text", words.alias("w"),
    ).collect()
    assert [r for r in both if (r.a, r.c, r.e, r.g) != (r.b, r.d, r.f, r.h)] == []
    assert [r for r in both if r.text is not None and keywords._latin_and_pieces(r.text) != [r.w]] == []
    broken = docs.limit(1).select(F.lit(1).alias("id"), F.expr("cast(X'C3' as string) || ' Words words'").alias("text"))
    assert [tuple(r) for r in keywords.frequency_keywords(broken, "id", F.col("text")).select("keyword", "n").collect()] == [("words", 2)]
    long = spark.createDataFrame([(1, "((((" * 100_000 + " [keyword:" * 40_000 + " " * 100_000 + "tail")], "id long, text string")  # was quadratic
    assert [r.keyword for r in keywords.frequency_keywords(long, "id", F.col("text"), "aggressive").collect()] == ["keyword", "tail"]


@pytest.mark.parametrize("bits, most", [(9, 1 << 19), (2, 1 << 19), (9, 5), (3, 1)])
def test_index_makes_a_blocks_postings_where_its_documents_are(spark, monkeypatch, tmp_path, bits, most):
    monkeypatch.setattr(text_index, "BLOCK_BITS", bits)
    monkeypatch.setattr(text_index, "BLOCK_HITS", most)
    kept, settled = [], text_index.settled
    monkeypatch.setattr(text_index, "settled", lambda df, name: kept.extend(df.columns) or settled(df, name))
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{i * j % 7}" for j in range(i % 5)) if i % 9 else None, f"w{i % 3} t") for i in range(40)], "id string, text string, title string").repartition(2)
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index", 4, "string")
    index.upsert(docs, "id", tx.tokenize_simple(F.col("text")), tx.tokenize_simple(F.col("title")))
    index.upsert(docs.where("id < 'd2'"), "id", tx.tokenize_simple(F.lit("w1 new new")))
    assert "terms" not in kept  # they were, twice, and each posting was shuffled
    own, posts = index._table("docs"), index._table("postings").collect()
    want = {}
    for r in own.collect():
        for t in r.terms:
            want.setdefault((r.seg, t.term), []).append((r.id, t.tf, t.extra, r.length))
    got, of = {}, {}
    for r in posts:
        hits = [tuple(h) for h in r.hits]
        got.setdefault((r.seg, r.term), []).extend(hits)
        of.setdefault((r.seg, r.block), set()).update(h[0] for h in hits)
        content = [h[3] for h in hits if h[1]]
        assert (r.most_tf, r.most, r.least_length, r.least_content, r.content, r.every) == (max(h[1] for h in hits), max(h[1] + h[2] for h in hits), min(h[3] for h in hits), min(content, default=None), len(content), len(hits))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len({(r.seg, r.term, r.block) for r in posts}) == len(posts)
    assert all(len(ids) <= 1 << bits for ids in of.values()) and len({(s, i) for (s, _), ids in of.items() for i in ids}) == sum(map(len, of.values()))


def test_simple_tokens_are_what_is_between_other_signs(spark):
    rows = [("A_b, c\u00e9d \x0b\u212a9\n\n!? \u6771x y'z",), ("",), (None,), (" \t",), ("\u0130x--0",)]
    old = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"[^\w\s]", " "), r"\s+"), lambda t: t != "")
    both = spark.createDataFrame(rows, "t string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("text").alias("t")))
    assert both.where(old != tx.tokenize_simple(F.col("t"))).count() == 0 and both.count() > 1000
