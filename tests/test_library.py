"""Operators that no query shows: the store, imports, filters, composites on rows made by hand."""

import itertools
import json
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import bloom, cleaning, vectors
from engram.operators import bm25, chunking, entities, events, keywords, retrieval, text_index
from engram.plans import more, registry  # noqa: F401
from engram.sources import readers, store

CHUNK = "hash long, text string, vector array<float>, note string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), CHUNK)


def test_store_keeps_changes_apart_until_it_compacts(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", CHUNK, deltas=3)
    s.upsert("c", rows(spark, (1, "a", [1.0], "x"), (2, "b", [2.0], "y"), (2, "b", [2.0], "y")))
    s.upsert("c", rows(spark, (2, "b2", [3.0], "z"), (3, "c", [1.0], "w")))
    s.update("c", spark.createDataFrame([(2, None), (99, "q")], "hash long, note string"))
    assert sorted((r.hash, r.text, r.note) for r in s.scan("c").collect()) == [(1, "a", "x"), (2, "b2", None), (3, "c", "w")]
    assert [e["kind"] for e in s._log("c")] == ["delta"] * 3
    s.delete("c", rows(spark, (1, None, None, None), (7, None, None, None)))
    assert [e["kind"] for e in s._log("c")] == ["whole"] and sorted(r.hash for r in s.hashes("c").collect()) == [2, 3]
    s.upsert("c", rows(spark, (1, "new", [5.0], None)))
    assert [(r.hash, r.text) for r in s.chunk("c", 1).collect()] == [(1, "new")] and s.chunk("c", 8).count() == 0
    assert s.stats("c").first().chunks == 3 and [r.hash for r in s.page("c", 1, 1).collect()] == [2]
    # only one bucket of the whole table is read
    plan = s.chunk("c", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket" in plan
    s.vacuum("c", keep_seconds=-1)
    assert s.scan("c").count() == 3 and s.collections() == ["c"]
    with pytest.raises(ValueError):
        s.upsert("c", rows(spark, (4, "d", [float("inf")], None)))
    s.purge_all()
    assert s.collections() == [] and s.scan("c").count() == 0


def test_a_number_has_one_writer(spark, tmp_path):
    a, b = (store.ChunkStore(spark, f"file://{tmp_path}/store", CHUNK) for _ in range(2))
    a.upsert("c", rows(spark, (1, "a", [1.0], None)))
    entries = b._entries
    stale = [entries("c")]
    b._entries = lambda c: stale.pop() if stale else entries(c)  # b has not seen that a takes the next number
    a.upsert("c", rows(spark, (2, "b", [1.0], None)))
    assert b._published("c", b._written("c", "delta", rows(spark, (3, "c", [1.0], None)).selectExpr("*", "false AS _gone", "CAST(NULL AS array<string>) AS _set"))) == 3
    assert sorted(r.hash for r in a.scan("c").collect()) == [1, 2, 3] and [e["number"] for e in a._entries("c")] == [1, 2, 3]


class Noted(store.ChunkStore):
    """A store with its real log, whose folders are dicts in memory."""

    folders: dict

    def _written(self, collection, kind, rows, base=0):
        name = f"f{len(self.folders)}"
        self.folders[name] = dict(rows)
        return f"{kind}~{base}~{name}"

    def _rows(self, collection, log=None, bucket=None):
        out = {}
        for e in self._log(collection) if log is None else log:
            out.update(self.folders[e["folder"]])
        return out


def steps(s, order, work):
    """Each of a, b, c writes at its first letter and publishes at its second; a writer that is not done has no effect on the others."""
    made = {}
    for who in order:
        made[who] = s._published("c", made[who]) if who in made else work[who]()


def test_two_writers_and_a_compaction_lose_nothing_in_any_order(spark, tmp_path):
    for n, order in enumerate(sorted(set(itertools.permutations("aabbcc")))):
        s = Noted(spark, f"file://{tmp_path}/{n}", CHUNK, deltas=99)
        s.folders = {}
        s._published("c", s._written("c", "delta", {0: "old", 1: "old"}))
        steps(s, order, {"a": lambda: s._written("c", "delta", {1: "a", 2: "a"}), "b": lambda: s._written("c", "delta", {3: "b"}), "c": lambda: s._compacted("c")})
        assert s._rows("c") == {0: "old", 1: "a", 2: "a", 3: "b"}, order
        s.compact("c")
        assert s._rows("c") == {0: "old", 1: "a", 2: "a", 3: "b"} and len(s._log("c")) == 1, order


@pytest.mark.parametrize("order", ["cabbac", "acbcba"])
def test_writers_and_a_compaction_on_files(spark, tmp_path, order):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", "hash long, text string", deltas=99)
    full = lambda *r: spark.createDataFrame(list(r), "hash long, text string").selectExpr("*", "false AS _gone", "CAST(NULL AS array<string>) AS _set").coalesce(1)
    s._published("c", s._written("c", "delta", full((0, "old"), (1, "old"))))
    steps(s, order, {"a": lambda: s._written("c", "delta", full((1, "a"), (2, "a"))), "b": lambda: s._written("c", "delta", full((3, "b"))), "c": lambda: s._compacted("c")})
    assert sorted(map(tuple, s.scan("c").collect())) == [(0, "old"), (1, "a"), (2, "a"), (3, "b")]


def test_a_dead_writer_blocks_nobody_and_keeps_its_folder_for_a_while(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", CHUNK)
    s.upsert("c", rows(spark, (1, "a", [1.0], None)))
    s._written("c", "delta", rows(spark, (9, "lost", [1.0], None)).selectExpr("*", "false AS _gone", "CAST(NULL AS array<string>) AS _set"))
    (tmp_path / "store/c/drafts/dead").mkdir()
    s.upsert("c", rows(spark, (2, "b", [1.0], None)))
    folders = lambda: len(list((tmp_path / "store/c/data").iterdir()))
    s.vacuum("c")
    assert sorted(r.hash for r in s.scan("c").collect()) == [1, 2] and folders() == 3
    s.vacuum("c", keep_seconds=-1)
    assert folders() == 2 and s.scan("c").count() == 2


def test_updates_of_different_columns_both_hold(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", CHUNK)
    s.upsert("c", rows(spark, (1, "a", [1.0], "x"), (2, "b", [1.0], "y"), (3, "c", [1.0], "z")))
    s.compact("c")
    s.update("c", spark.createDataFrame([(1, "new"), (3, "new")], "hash long, note string"))
    s.update("c", spark.createDataFrame([(1, "text"), (4, "text")], "hash long, text string"))
    s.delete("c", spark.createDataFrame([(3,)], "hash long"))
    s.update("c", spark.createDataFrame([(3, "late")], "hash long, note string"))
    want = [(1, "text", "new"), (2, "b", "y")]
    assert sorted((r.hash, r.text, r.note) for r in s.scan("c").collect()) == want
    s.compact("c")
    assert sorted((r.hash, r.text, r.note) for r in s.scan("c").collect()) == want
    s.delete_where("c", F.col("note") == "y")
    assert [r.hash for r in s.scan("c").collect()] == [1]


def test_an_export_comes_back(spark, tmp_path):
    two = rows(spark, (1, "a", [1.0], None), (2, "b", [2.0], None)).drop("note")
    readers.write_export(two, F.struct(F.lit("c").alias("id"), F.lit("s").alias("source"), F.lit("m").alias("model")), f"{tmp_path}/out")
    back = readers.exported(spark, f"{tmp_path}/out")
    assert sorted((r.version, r.collection_id, r.hash, r.text, r.vector) for r in back.collect()) == [("1.0.0", "c", 1, "a", [1.0]), ("1.0.0", "c", 2, "b", [2.0])]
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", "hash long, text string, vector array<float>")
    store.import_collection(s, "d", back, None, "s", "m")
    assert s.scan("d").count() == 2
    whole = {"version": "1.0", "collection": {"id": "e"}, "chunks": [{"hash": 5, "text": "x"}, {"hash": 6, "text": "y"}]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.json").write_text(json.dumps(whole))
    (tmp_path / "docs/many.json").write_text(json.dumps(whole | {"collection": {"id": "f"}}, indent=2))
    assert sorted((r.collection_id, r.hash) for r in readers.exported(spark, f"{tmp_path}/docs").collect()) == [("e", 5), ("e", 6), ("f", 5), ("f", 6)]
    (tmp_path / "none.json").write_text(json.dumps({"version": "1.0", "rows": []}))
    with pytest.raises(Exception, match="without chunks"):
        readers.exported(spark, f"{tmp_path}/none.json").collect()
    (tmp_path / "empty.json").write_text(json.dumps(whole | {"chunks": []}))
    assert readers.exported(spark, f"{tmp_path}/empty.json").collect() == []


def test_import_uses_vectors_again_or_makes_them(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", "hash long, text string, vector array<float>")
    schema = "version string, collection_id string, source string, model string, hash long, text string, vector array<float>"
    good = spark.createDataFrame([("1.0.0", "c", "s", "m", 1, "a", [1.0]), ("1.0.0", "c", "s", "m", 2, " ", [1.0]), ("1.0.0", "c", "s", "m", 3, "b", [2.0])], schema)
    assert store.import_collection(s, "c", good, None, "s", "m")["vectors_usable"] and sorted(r.hash for r in s.scan("c").collect()) == [1, 3]
    with pytest.raises(ValueError):
        store.import_collection(s, "d", good, None, "s", "other")
    store.import_collection(s, "d", good, lambda t: F.array(F.length(t).cast("float")), "s", "other")
    assert {r.hash: list(r.vector) for r in s.scan("d").collect()} == {1: [1.0], 3: [1.0]}
    with pytest.raises(ValueError):
        store.import_collection(s, "e", good.withColumn("version", F.lit("9")), None, "s", "m")


def test_events_to_store(spark):
    raw = spark.createDataFrame([("c", "combat", "Ann wins", ["Ann"]), ("c", "travel", "to town", [])], "collection_id string, event_type string, summary string, characters array<string>")
    none = F.array().cast("array<string>")
    e = raw.withColumns({c: none for c in ("locations", "items", "keywords", "open_threads")} | {c: F.lit(None).cast("string") for c in ("date_time", "cause", "result")})
    out = store.event_rows(e).collect()
    assert {r.text for r in out} == {"[combat] Ann wins\nCHARS: Ann", "[travel] to town"} and len({r.hash for r in out}) == 2
    with pytest.raises(Exception):
        store.event_rows(e.unionByName(e)).collect()


def test_chat_lines_are_numbered_across_parts_of_a_file(spark, tmp_path):
    lines = [json.dumps({"chat_metadata": {}}), *(json.dumps({"name": "A", "mes": f"m{i} " + "x" * 200}) for i in range(500)), "", json.dumps({"name": "B", "mes": "end"})]
    (tmp_path / "chat.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.chat_jsonl(spark, str(tmp_path / "chat.jsonl")).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.mes.split()[0] for r in got] == [*(f"m{i}" for i in range(500)), "end"] and got[0].idx == 1


def test_chat_json_text_lorebook_and_export(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"messages": [{"name": "A", "content": "hi", "is_user": True}, {"name": "S", "mes": "x", "is_system": True}]}))
    assert [(r.name, r.mes, r.is_user) for r in readers.chat_json(spark, str(tmp_path / "a.json")).collect()] == [("A", "hi", True)]
    (tmp_path / "a.txt").write_text("You: one\nAnn: two\nnot a line\nYou: three")
    assert [(r.name, r.mes, r.is_user) for r in readers.chat_txt(spark, str(tmp_path / "a.txt")).orderBy("idx").collect()] == [("You", "one", True), ("Ann", "two", False), ("You", "three", True)]
    book = spark.createDataFrame([("b", 1, "", ["Key"], "body"), ("b", 2, "Name", [], " ")], "book string, uid int, comment string, key array<string>, content string")
    assert [r.text for r in readers.lorebook(book).collect()] == ["# Key\nbody"]
    readers.write_export(rows(spark, (1, "a", [1.0], None)), F.struct(F.lit("c").alias("id")), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").select("version", "collection.id", "chunk.text").first()[:] == ("1.0.0", "c", "a")


def test_bloom_filter_has_no_false_negatives(spark):
    own, other = spark.range(5000).withColumnRenamed("id", "k"), spark.range(100000, 120000).withColumnRenamed("id", "k")
    bits, hashes = bloom.shape(5000, 0.01)
    b = bloom.build(own, "k", bits, hashes)
    assert b.count() <= bits // 64 and bloom.maybe_in(own, "k", b, bits, hashes).count() == 5000
    assert bloom.maybe_in(other, "k", b, bits, hashes).count() < 600


def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v[7] = 0
    e = spark.createDataFrame([(i, i % 3 if i < 58 else 10 + i, [float(x) for x in v[i]]) for i in range(60)], "id long, g long, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for r in vectors.pairwise(e, "g", "id", "v").collect():
        m = unit[[i for i in range(58) if i % 3 == r.g]]
        s = (m @ m.T)[np.triu_indices(len(m), 1)]
        assert (r.pairs, r.mean_similarity, r.max_similarity) == (len(s), pytest.approx(s.mean()), pytest.approx(s.max()))
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 40)  # blocks of queries
    got = vectors.nearest_many(e.select("id", "v"), e.where("id % 5 = 0").select(F.col("id").alias("query_id"), "v"), 3, "id", "v").collect()
    assert len(got) == 36
    for r in got:
        order = np.lexsort((np.arange(60), -np.round(unit @ unit[r.query_id], 12)))
        assert r.score == pytest.approx((unit @ unit[r.query_id])[order[r["rank"] - 1]])


def test_text_index_scores_as_the_scan_does_through_changes(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(40)])
    make = lambda ids: [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=np.arange(40, 0, -1) / 820)), str(rng.choice(vocabulary)) if rng.random() < 0.5 else None) for i in ids]
    df = lambda rows: spark.createDataFrame(rows, "id long, text string, title string").repartition(3)
    asked = ((["w0", "w5", "w39"], True), (["w1", "w2"], False), (["absent"], True), ([], False))
    for tok, asked in ((F.split("text", " "), asked[:1]), (F.array_distinct(F.split("text", " ")), asked)):
        tok, title = F.filter(tok, lambda t: t != ""), F.filter(F.array(F.col("title")), lambda t: t.isNotNull())
        index = text_index.TextIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 4)
        now = {r[0]: r for r in make(range(60))}
        index.upsert(df(list(now.values())), "id", tok, title)
        more = make(range(50, 80))
        now |= {r[0]: r for r in more}
        index.upsert(df(more), "id", tok, title)
        index.delete(spark.createDataFrame([(3,), (55,), (999,)], "id long"))
        now = {i: r for i, r in now.items() if i not in (3, 55)}
        again = make([55])
        index.upsert(df(again), "id", tok, title)
        now |= {r[0]: r for r in again}
        docs = df(list(now.values()))
        for q, boosted in asked:
            want = {r.id: (r.bm25_score, r.matched) for r in bm25.bm25(docs, q, "id", tok, title if boosted else None).collect()}
            got = {r.id: (r.bm25_score, r.matched) for r in index.search(q, boosted=boosted).collect()}
            assert got == {i: (pytest.approx(s), m) for i, (s, m) in want.items()}
            top = index.search(q, 5, boosted).collect()
            assert [r.id for r in top] == sorted(want, key=lambda i: (-round(want[i][0], 9), i))[:5]


def test_text_index_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_BITS", 3)
    docs = spark.range(800).repartition(1).select("id", F.when(F.col("id").between(160, 175), "rare common").otherwise("common other").alias("text"))
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index").upsert(docs, "id", F.split("text", " "))
    top = index.search(["rare", "common"], 10).collect()
    assert len(top) == 10 and all(160 <= r.id <= 175 and r.matched == 2 for r in top)
    total, read = index.skipped
    assert total >= 100 and read <= 4


def test_near_copies_walk_equals_the_plain_one(spark):
    rng = np.random.default_rng(5)
    data = [(i, "ab"[i % 2], float(rng.random()), float(rng.random()), None if rng.random() < 0.05 else int(rng.integers(0, 200)), [str(x) for x in rng.choice(4, 2, replace=False)]) for i in range(300)]
    df = spark.createDataFrame(data, "event_id long, event_type string, final_score double, score double, source_window_end int, characters array<string>")
    kept: list = []
    for r in sorted(data, key=lambda r: (-r[2], r[0])):
        same = lambda k: k[1] == r[1] and (k[4] is None or r[4] is None or abs(k[4] - r[4]) < 10) and len(set(k[5]) & set(r[5])) / len(set(k[5]) | set(r[5])) >= 0.6
        if r[3] >= 0.75 or not any(same(k) for k in kept):
            kept.append(r)
    assert {r.event_id for r in events.near_copies_dropped(df).collect()} == {r[0] for r in kept}


def test_event_retrieval_takes_the_best_of_each_lookup(spark):
    e = spark.createDataFrame([(i, "t", i / 100, 5, False, i * 20, [f"c{i}"], ["k"], False, "a" if i % 2 else "b") for i in range(60)], "event_id long, event_type string, score double, importance int, should_persist boolean, source_window_end int, characters array<string>, keywords array<string>, rerank_applied boolean, lookup string")
    got = [r.event_id for r in events.retrieved(e, None, 1200, 3).collect()]
    assert got == [59, 58, 57] and events.retrieved(e.limit(0), None, 10, 3).count() == 0


def test_enriched_chunks(spark):
    c = spark.createDataFrame([(1, "A character covered in brown fur fur.", "Brown Fur", None), (2, "Himbofication is a process.", "Should Not Win", "Himbofication"), (3, "", None, None)], "hash long, text string, page_title string, name string")
    c = c.withColumn("record_keywords", F.when(F.col("name").isNotNull(), F.array(F.struct(F.lit("Muscle").alias("text"), F.lit(10).alias("importance")), F.struct(F.lit("x").alias("text"), F.lit(None).cast("int").alias("importance")))))
    out = {r.hash: r for r in retrieval.enriched(c, "hash", "wiki", "src", "minimal").collect()}
    assert (out[1].entry_name, out[2].entry_name, out[3].entry_name) == ("Brown Fur", "Himbofication", None) and out[3].keywords == []
    words = {k.text: round(k.weight, 3) for k in out[2].keywords}
    assert words["himbofication"] == 2.0 and words["muscle"] == 2.3 and words["x"] == round(1.5 + 0.2 + 4 / 9 * 0.6, 3)
    assert [k.weight for k in out[2].keywords] == sorted((k.weight for k in out[2].keywords), reverse=True)
    chat = retrieval.enriched(c.withColumn("speaker", F.lit("Ann")), "hash", "chat", "src").where("hash = 1").first()
    assert "ann" in {k.text for k in chat.keywords}


def test_keywords_have_compounds_brackets_and_budgets(spark):
    docs = spark.createDataFrame([(1, "The divine/time rule. 【勇者之劍】 guards gates, gates and [魔法] [OOC note] (cited words) *starred* Tom's castle. [KEYWORDS: leaked]")], "id long, text string")
    out = {r.keyword: r.weight for r in keywords.frequency_keywords(docs, "id", F.col("text"), "aggressive").collect()}
    assert out["勇者之劍"] == out["魔法"] == 3.0 and out["divine_time"] == 1.7 and out["gates"] == 1.6
    assert not {"leaked", "cited", "starred", "note"} & set(out)
    top = keywords.tfidf_keywords(docs, "id", F.col("text"), "minimal").orderBy("rank").collect()
    assert [r.keyword for r in top[:2]] == ["勇者之劍", "魔法"] and len(top) == 5 and max(r.weight for r in top) == 2.0
    head = " ".join(chr(0x4E00 + i) + chr(0x4E00 + i + 1) for i in range(0, 60, 2)) + " " + "x" * 200
    tail = " ".join((chr(0x5000 + i) + chr(0x5000 + i + 1) + " ") * 3 for i in range(0, 100, 2)) + " latin words words here"
    q = spark.createDataFrame([(1, head + tail), (2, "only latin words words"), (3, None)], "id long, text string")
    got = {i: [r.keyword for r in keywords.query_keywords(q, "id", F.col("text")).where(F.col("id") == i).orderBy("rank").collect()] for i in (1, 2, 3)}
    assert len(got[1]) == 50 + 4 and sum(w[0] < "倀" for w in got[1][:50]) == 15 and got[1][50] == "words"
    assert got[2] == ["words", "latin"] and got[3] == []
    long = "word. " * 249 + "breaks here and goes on"
    assert len(re.sub(r"\s", "", long)) < len(long) and keywords.tfidf_keywords(spark.createDataFrame([(1, long)], "id long, text string"), "id", F.col("text"), "minimal").count() > 0


@pytest.mark.parametrize("preset,before,after", [
    ("html_formatting", "<font color=red>a</font> <span style='x' style=\"color: red\">b</span> <em>c</em>", "a b c"),
    ("metadata_blocks", "a<div style=\"display: none\">x\ny</div><details>s\nt</details>b", "ab"),
    ("ai_reasoning", "a<thinking>x</thinking><tucao>y</tucao>b", "ab"),
    ("nuclear", "<p>a</p><br/>b", "ab"),
    ("mvu_game_maker", "a<UpdateVariable>x\n</UpdateVariable><combat_log>y</combat_log><Weather_System k=1>z</Weather_System>b", "ab"),
    ("fatbody_dnd", "Ann hits. *(1d20+5 = 18)* *(Status: fine)*\nROUND 2 begins\n- Saves: Fort +3\n**Orc 7/12 HP**\nThe end.", "Ann hits.  \n\nThe end."),
    ("wiki_noise", "**10 June** Have you heard? news (x#verification) text 3 8 Q  4 3 E  1.3k 2.8k E\n2 post(s) on this page were hidden [why]\n[Read More](u)\nAdvanced Options\nkept", "text \n\nkept"),
    ("none", " <b>a</b> ", "<b>a</b>"),
])
def test_cleaning_presets(spark, preset, before, after):
    got = spark.range(1).select(cleaning.clean(F.lit(before), cleaning.active_rules(preset)).alias("x")).first().x
    assert got == after


def test_presets_name_rules_that_exist():
    assert all(r in cleaning.BUILT_IN for p in cleaning.PRESETS.values() for r in p) and len(cleaning.BUILT_IN) == 40
    assert "strip_all_html" not in cleaning.DEFAULT_ON and len(cleaning.active_rules("custom")) == len(cleaning.DEFAULT_ON)


def test_chunkers_on_texts_that_divide(spark):
    d = spark.createDataFrame([(1, "one\n\ntwo\n---\nthree\n\n\n# Head\nx\n## Sub\ny"), (2, ""), (3, None)], "id long, text string")
    assert [r.text for r in chunking.chunk(d, "paragraph").orderBy("chunk_index").collect()] == ["one", "two", "three", "# Head\nx\n## Sub\ny"]
    assert [r.text for r in chunking.chunk(d, "section").orderBy("chunk_index").collect()] == ["one\n\ntwo\n---\nthree", "# Head\nx", "## Sub\ny"]
    s = spark.createDataFrame([(1, "A b c. D e f! " * 40)], "id long, text string")
    got = [r.text for r in chunking.sentences(s, 50).orderBy("chunk_index").collect()]
    assert " ".join(got).split() == ("A b c. D e f! " * 40).split() and all(len(x) <= 50 for x in got) and len(got) < 20
    talk = spark.createDataFrame([(1, 'He said "a long speech that stays whole here" and left. ' * 3)], "id long, text string")
    assert all(r.text.count('"') % 2 == 0 for r in chunking.chunk(talk, "dialogue", size=80).collect())


def test_glossary_rows(spark):
    d = spark.createDataFrame([(1, "the Federal Bureau of Investigation (FBI) met."), (2, "nothing")], "doc_id long, text string")
    g = d.select("doc_id", F.explode(entities.glossary_of("text")).alias("g")).select("doc_id", "g.acronym", "g.full_name")
    assert [tuple(r) for r in g.collect()] == [(1, "FBI", "Federal Bureau of Investigation")]
    assert {"glossary", "knn_many", "chunk_retrieval"} <= set(registry.QUERIES)
