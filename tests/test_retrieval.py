import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from engram.functions import cleaning, hashing, scoring, text as tx, vectors
from engram.operators import bm25, chunking, entities, events, fusion, joins, keywords, rules, wiki
from engram.plans import registry
from engram.sources import readers
from engram.sources.store import ChunkStore
from engram.streaming import sync


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("word,stem", [("running", "run"), ("agreed", "agree"), ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relate"), ("is", "is"), ("goodness", "good"), ("conflated", "conflate")])
def test_stems(spark, word, stem):
    assert one(spark, tx.stem(F.lit(word))) == stem


def test_tokens_hashes_and_strings(spark):
    assert one(spark, tx.tokenize(F.lit("The runners run, running!"))) == ["runner", "run"]
    assert one(spark, tx.cjk_tokens(F.lit("勇者之 a 剣"))) == ["勇者", "者之", "剣"]
    assert one(spark, hashing.fnv1a(F.lit("hello"))) == 1335831723
    assert one(spark, tx.similarity(F.lit("Kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, tx.title_case(F.lit("the lord of rings"))) == "The Lord of Rings"
    assert one(spark, tx.slugify(F.lit("Crème  Brûlée!"))) == "creme-brulee"
    assert one(spark, cleaning.clean(F.lit("a<thinking>x\ny</thinking> <b>b</b>"), cleaning.active_rules("comprehensive"))) == "a b"


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(v(1.0, 0.0), v(0.0, 0.0))) == 0
    assert one(spark, vectors.cosine(v(1.0, 1.0), v(-1.0, -1.0))) == pytest.approx(-1)
    assert one(spark, vectors.jaccard(v(0.0), v(0.0))) == 1
    with pytest.raises(Exception):
        one(spark, vectors.cosine(v(1.0), v(1.0, 2.0)))


def test_bm25_prefers_matches_and_fields(spark):
    docs = spark.createDataFrame([(1, "the cat sat on mats", "cat"), (2, "a cat and a dog", ""), (3, "nothing here", "")], "id long, text string, title string")
    tok = tx.tokenize(F.col("text"))
    plain = {r.id: r.bm25_score for r in bm25.bm25(docs, ["cat"], "id", tok).collect()}
    boosted = {r.id: r.bm25_score for r in bm25.bm25(docs, ["cat"], "id", tok, tx.tokenize(F.col("title"))).collect()}
    assert set(plain) == {1, 2} and boosted[1] > plain[1] and bm25.bm25(docs, [], "id", tok).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5), (None, 0.4)], "id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 1.0)], "id long, score double")
    out = {r.id: r for r in fusion.reciprocal_rank(a, b).collect()}
    assert set(out) == {1, 2, 3} and all(0 <= r.score <= 1 for r in out.values()) and out[2].rrf == pytest.approx(1 / 62 + 1 / 61)


def test_rules(spark):
    ctx = spark.createDataFrame([(["Hello there", "bye"], ["Ann", "Bob"], "Bob", 7)], "recent_messages array<string>, message_speakers array<string>, last_speaker string, message_count int")
    ask = lambda r: ctx.select(rules.compile_rule(r).alias("x")).first().x
    assert ask({"type": "pattern", "settings": {"patterns": ["hello"]}}) and not ask({"type": "pattern", "settings": {"patterns": ["hello"], "caseSensitive": True}})
    assert ask({"type": "speaker", "settings": {"values": ["Ann", "Bob"], "matchType": "all"}}) and not ask({"type": "speaker", "settings": {"values": ["Ann"]}})
    assert not ask({"type": "nonsense"}) and ask({"type": "nonsense", "negate": True}) and not ask({"type": "pattern", "settings": {"patterns": ["/(/"]}})
    assert rules.rule_errors({"type": "pattern"}) == ["no patterns"]


def test_near_copies(spark):
    rows = [("a", "x", 0.9, 0.4, 5, ["A"]), ("b", "x", 0.8, 0.4, 9, ["a"]), ("c", "x", 0.7, 0.4, 15, ["a"]), ("d", "x", 0.6, 0.8, 6, ["a"]), ("e", "y", 0.5, 0.1, 5, ["a"])]
    df = spark.createDataFrame(rows, "event_id string, event_type string, final_score double, score double, source_window_end int, characters array<string>")
    assert {r.event_id for r in events.near_copies_dropped(df).collect()} == {"a", "c", "d", "e"}
    assert scoring.normalize_weights({"cosine": 0, "importance": 0, "persist": 0, "recency": 0}) == scoring.WEIGHTS


def test_windows_and_chunks(spark):
    m = spark.createDataFrame([(1, i, "u", f"m{i}") for i in range(7)], "conv_id long, turn long, role string, text string")
    assert [(r.window_start, r.text) for r in chunking.count_windows(m, size=3).orderBy("window_start").collect()] == [(0, "m0\nm1\nm2"), (3, "m3\nm4\nm5")]
    assert chunking.message_batches(m, size=4).count() == 2
    d = spark.createDataFrame([(1, "# A\nx\n\n# B\ny"), (2, None)], "id long, text string")
    assert [r.text for r in chunking.sections(d).collect()] == ["# A\nx", "# B\ny"]
    long = spark.createDataFrame([(1, "word " * 200 + ". " + "other text. " * 30)], "id long, text string")
    assert all(len(r.text) <= 60 for r in chunking.adaptive(long, 60).collect())


def test_entities_and_glossary():
    raw = '```json\n{"items": [{"name": "Ann", "body": "Ann rules.", "keywords": ["k", {"text": "K", "importance": 99}], "relationships": ["Bob"]}]}\n```'
    e = entities.validate(entities.parse_array(raw)[0])
    assert e["keywords"] == [{"text": "k", "importance": 5}] and e["relationships"] == [{"target": "Bob", "type": ""}] and e["entry_type"] == "other"
    more = {**e, "name": "Annie", "aliases": ["ann"], "body": "Ann rules. Twice."}
    assert len(entities.merge([e, more])) == 1 and entities.merge([e, more])[0]["body"] == "Ann rules. Twice."
    assert entities.validate({"name": "x"}) is None and entities.parse_array('{"a": 1}\n{"b": 2}') == [{"a": 1}, {"b": 2}]
    assert entities.glossary("the Federal Bureau of Investigation (FBI) and Threat Level (QQQ).") == [{"acronym": "FBI", "full_name": "Federal Bureau of Investigation"}]


def test_page_upsert_keeps_fetched_content(spark):
    s = "key string, title string, content_fetched int, content string"
    old = spark.createDataFrame([("a", "A", 1, "full"), ("b", "B", 0, None)], s)
    out = {r.key: r for r in wiki.upserted(old, spark.createDataFrame([("a", "A2", 0, None), ("c", "C", 0, None)], s)).collect()}
    assert (out["a"].title, out["a"].content, out["a"].status) == ("A2", "full", "updated") and out["b"].status == "kept" and out["c"].status == "added"


def test_store_and_readers(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", "hash long, text string, vector array<float>")
    rows = lambda *r: spark.createDataFrame(list(r), store.schema)
    store.upsert("c", rows((1, "a", [1.0]), (2, "b", [2.0])))
    store.upsert("c", rows((2, "b2", [3.0])))
    store.delete("c", rows((1, "", [0.0])))
    assert [(r.hash, r.text) for r in store.scan("c").collect()] == [(2, "b2")] and store.collections() == ["c"]
    with pytest.raises(ValueError):
        store.upsert("c", rows((3, "x", [float("nan")])))
    (tmp_path / "chat.jsonl").write_text("\n".join(json.dumps(x) for x in [{"chat_metadata": {}}, {"name": "A", "mes": "hi", "is_user": True}, {"name": "S", "mes": "sys", "is_system": True}, {"name": "B", "mes": "", "text": "yo"}]))
    assert [(r.name, r.mes) for r in readers.chat_jsonl(spark, str(tmp_path / "chat.jsonl")).orderBy("idx").collect()] == [("A", "hi"), ("B", "yo")]
    png = readers.PNG + b"\0\0\0\0IEND\xaeB`\x82"
    assert readers.png_read(readers.png_write(png, "k", '{"a": "é"}'), "k") == '{"a": "é"}'


def test_each_window_is_handled_once(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    src = tmp_path / "in"
    handle = lambda w: w.select("conv_id", "window_start")
    for k, rows in enumerate([[(1, i, "u", f"m{i}") for i in range(5)], [(1, i, "u", f"m{i}") for i in range(5, 8)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = sync.window_sync(spark.readStream.schema(schema).parquet(str(src)), f"{tmp_path}/out", handle, size=2).trigger(availableNow=True).start()
        q.awaitTermination()
    got = Counter(r.window_start for r in spark.read.parquet(f"{tmp_path}/out/events").collect())
    assert got == Counter([0, 2, 4, 6]) and sync.sync_status(4, 4, True) == "full" and sync.tip_after(9, 3) == 9


def test_joins_and_entry(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, 0.95)], "hash long, score double")
    links = spark.createDataFrame([(1, 2, "soft"), (1, 3, "force"), (9, 1, "soft")], "hash long, target_hash long, mode string")
    assert {r.hash: r.score for r in joins.soft_linked(hits, links).collect()} == {1: 0.5, 2: 1.0}
    assert joins.force_linked(hits, links, spark.createDataFrame([(3, "t"), (4, "t")], "hash long, text string")).first().hash == 3
    assert __spark_entry__.entry(spark).count() == 10 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain_words(spark, text, least):
    """(sentences, [(sentence, form, word, proper)]) of a text of plain sentences."""
    parts = [p for p in (p.strip() for p in re.split(r"[.!?\n]+", text)) if len(p) > 2]
    stops = set(tx.stop_words("en"))
    proper = {w.lower() for w in re.findall(r"\b[A-Z][a-z]{3,}\b", text)}
    rows = [(k, w) for k, p in enumerate(parts) for w in p.lower().split() if len(w) >= least and w not in stops]
    stems = dict(spark.createDataFrame(sorted({(w,) for _, w in rows}), "w string").select("w", tx.stem(F.col("w"))).collect())
    return len(parts), [(k, w, w if w in proper or len(w) <= 3 else stems[w], w in proper) for k, w in rows]


def test_keywords_of_whole_texts_equal_brute_force(spark, tmp_path):
    draw = random.Random(7)
    names = [f"{a}{b}{c}" for a in ("bar", "cor", "del", "fen") for b in ("mi", "to", "ra") for c in ("ning", "ted", "nes", "x", "lo")]
    sentence = lambda some: " ".join(w.capitalize() if draw.random() < 0.05 else w for w in draw.choices(some, k=9)) + ". "
    # the words of the first 5,000 characters are not those of the rest
    docs = [(i, "".join(sentence(names[:20]) for _ in range(n)) + "".join(sentence(names[20:]) for _ in range(2 * n))) for i, n in enumerate((3, 20, 90))]
    assert len(docs[2][1]) > 10000
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tfidf, frequency = {}, {}
    for i, text in docs:
        for least, out in ((3, tfidf), (4, frequency)):
            n, rows = plain_words(spark, text, least)
            forms, tf, df = Counter((w, f) for _, f, w, _ in rows), Counter(w for _, _, w, _ in rows), Counter(w for _, w in {(k, w) for k, _, w, _ in rows})
            capital = {w for w in tf if w[0].upper() + w[1:] in text}
            shown = {w: min((-c, f) for (v, f), c in forms.items() if v == w)[1] for w in tf}
            score = {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) * (1.3 if w in capital else 1) if least == 3 else c for w, c in tf.items()}
            top = sorted(score, key=lambda w: (-round(score[w], 9), w))[:15]
            for rank, w in enumerate(top, 1):
                out[i, rank] = (shown[w], pytest.approx(score[w], abs=2e-6), pytest.approx(1.5 + score[w] / score[top[0]] * 0.5 if least == 3 else min(3, 1.5 + 0.1 * (score[w] - 1)), abs=2e-6))
    assert {(r[0], r[1]): tuple(r[2:]) for r in registry.QUERIES["tfidf_keywords"](spark, str(tmp_path)).collect()} == tfidf
    assert {(r[0], r[1]): tuple(r[2:]) for r in registry.QUERIES["frequency_keywords"](spark, str(tmp_path)).collect()} == frequency


def test_keyword_levels_scan_as_much_as_the_reference():
    assert {k: (v["scan"], v["keep"]) for k, v in keywords.LEVELS.items()} == {"minimal": (1500, 5), "balanced": (5000, 12), "aggressive": (None, 15)}


def test_stemmed_tokens_are_those_of_all_languages(spark, tmp_path):
    docs = [(1, "Running runners", "en"), (2, "Les relations nationales", "fr"), (3, "hopping", None), (4, "running Häuser", "de"), (5, None, "es")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {w for _, text, _ in docs for w in re.findall(r"\w+", (text or "").lower())}
    got = registry.QUERIES["stemmed_tokens"](spark, str(tmp_path)).collect()
    assert len(got) == len(words) and {r.word for r in got} == words
    assert {r.word: r.stem for r in got} == {w: one(spark, tx.stem(F.lit(w))) for w in words}
