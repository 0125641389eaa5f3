"""Reformatting against plain versions: batches, chains, repair, merge, links."""

import random
import re
import sys

from pyspark import cloudpickle

from engram.operators import entities, reformat

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests
PAD = "This sentence pads the section well past the tiny test budget so it must split across multiple calls."
ROSTER = "# Intro\n\nShort intro paragraph.\n\n## Roster\n\n" + "\n\n".join(f"***Hero {x}*** leads a squad. {PAD}" for x in "ABC")


def docs(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)


def entry(name, body="Some body.", **more):
    return {"entry_type": "character", "name": name, "body": body, **more}


def plain_batches(text, size):
    out, now = [], ""
    sections = [s.strip() for s in re.split(r"(?m)(?=^#{1,6}\s+.+$)", text) if s.strip()]
    for s in sections:
        if len(s) > size:
            out += [(now, None)] if now else []
            now, sub, first = "", "", True
            for p in [p.strip() for p in re.split(r"\n\n+|(?m:^---+$)", s) if p.strip()]:
                if sub and len(sub) + len(p) + 2 > size:
                    out.append((sub, None if first else s.split("\n")[0].strip()))
                    sub, first = p, False
                else:
                    sub = f"{sub}\n\n{p}" if sub else p
            out += [(sub, None if first else s.split("\n")[0].strip())]
        elif now and len(now) + len(s) + 2 > size:
            out.append((now, None))
            now = s
        else:
            now = f"{now}\n\n{s}" if now else s
    return out + ([(now, None)] if now else [])


def test_batches_and_chains_equal_a_plain_version(spark):
    rng = random.Random(3)
    bits = ["# Head\n", "\n## Sub\n", "words and more. ", "x" * 40, "\n\n", "\n---\n", "日本語 ", "\n", "plain "]
    texts = ["".join(rng.choices(bits, k=rng.choice([0, 1, 10, 80]))) for _ in range(120)] + [ROSTER, None, " \n ", "# Only\n\n" + "p. " * 2000]
    got = {}
    for r in reformat.batched(docs(spark, *texts), size=90).collect():
        got.setdefault(r.doc_id, []).append((r.batch, r.text, r.section_title, r.chain, r.part))
    for i, t in enumerate(texts):
        want, chain = [], -1
        for k, (text, title) in enumerate(plain_batches(t or "", 90)):
            chain += title is None
            want.append((k, text, title, chain))
        mine = sorted(got.get(i, []))
        assert [m[:4] for m in mine] == want, repr(t)
        assert all(m[4] == k - next(j for j, w in enumerate(want) if w[3] == m[3]) for k, m in enumerate(mine))


def test_a_long_section_tells_each_batch_what_came_before(spark):
    def extract(text, title, names, missing):
        return [entry(f"Hero-{len(names) + 1} of {title}", f"after {', '.join(names)}.")]

    out = reformat.extracted(reformat.batched(docs(spark, ROSTER, "# Topic\n\nOne short paragraph."), size=200), extract, coverage=None)
    rows = {(r.doc_id, r.batch): (r.chain, r.record.name, r.record.body) for r in out.collect()}
    assert rows[0, 0] == (0, "Hero-1 of None", "after .") and rows[0, 1][:2] == (1, "Hero-1 of None")
    assert rows[0, 2] == (1, "Hero-2 of ## Roster", "after Hero-1 of None.") and rows[0, 3][2] == "after Hero-1 of None, Hero-2 of ## Roster."
    assert rows[1, 0][:2] == (0, "Hero-1 of None") and len(rows) == 5


PROFILE = "\n\n".join([
    "# Sympathizers", "## Definition and Structure", "Sympathizers are a decentralized network of citizens advocating equality. They communicate through encrypted messaging and library marginalia.",
    "## Stigma and Terms", 'The linguistic arsenal includes "traitor", "gender traitor", "softhead", and slang like "simp" and "equality-pilled".',
])
THIN = entry("Sympathizers", "Sympathizers are a decentralized network of citizens advocating equality. They communicate through encrypted messaging and library marginalia.")
REPAIR = entry("Sympathizers: Stigma and Terms", 'The linguistic arsenal includes "traitor", "gender traitor", "softhead", and slang like "simp" and "equality-pilled".')


def run(spark, extract):
    rows = reformat.extracted(reformat.batched(docs(spark, PROFILE)), extract).orderBy("pos").collect()
    return [(r.record.name, r.repaired) for r in rows if r.record], [r.warning for r in rows if r.warning]


def test_repair_asks_once_for_what_was_left_out(spark):
    def extract(text, title, names, missing):
        if missing:
            assert names == ["Sympathizers"] and [m["title"] for m in missing] == ["Stigma and Terms"] and "softhead" in text and "softhead" in missing[0]["missing"]
        return [REPAIR] if missing else [THIN]

    assert run(spark, extract) == ([("Sympathizers", False), ("Sympathizers: Stigma and Terms", True)], [])
    names, warnings = run(spark, lambda text, title, names, missing: [THIN])
    assert [n for n, _ in names] == ["Sympathizers"] * 2 and warnings == ["still under-captured: Stigma and Terms"]

    def broken(text, title, names, missing):
        if missing:
            raise ValueError("model rejected prompt")
        return '```json\n[{"entry_type": "organization", "name": "Sympathizers", "body": "short"}]\n```'

    names, warnings = run(spark, broken)
    assert names == [("Sympathizers", False)] and warnings == ["repair failed: model rejected prompt"]


def test_a_failing_batch_leaves_its_chain_going(spark):
    def extract(text, title, names, missing):
        if "Hero B" in text:
            raise ValueError("timeout")
        return [entry("x" + "y" * len(names))]

    rows = reformat.extracted(reformat.batched(docs(spark, ROSTER), size=200), extract, coverage=None).collect()
    assert sorted((r.batch, r.record and r.record.name, r.warning) for r in rows) == [(0, "x", None), (1, "x", None), (2, None, "failed: timeout"), (3, "xy", None)]


def test_merge_of_records_of_several_chains_and_links(spark):
    text = f"# Security\n\nThe Gestapo investigates. {PAD}\n\n# Law\n\nThe Gestapo appears again, and so does the Court. {PAD}"

    def extract(text, title, names, missing):
        first = "# Security" in text
        e = {"entry_type": "organization", "name": "Gestapo" if first else "GESTAPO", "aliases": [] if first else ["Secret Police"], "traits": ["a" if first else "b"], "body": "Long body from the first call." if first else "Body two. Long body from the first call."}
        return [e] if first else [e, entry("Court", aliases=["the court"])]

    batches = reformat.batched(docs(spark, text), size=200)
    records = reformat.extracted(batches, extract, coverage=None)
    one = reformat.merged(records)
    rows = one.orderBy("place").collect()
    assert [(r.record.name, r.copies) for r in rows] == [("Gestapo", 2), ("Court", 1)]
    assert rows[0].record.traits == ["a", "b"] and rows[0].record.aliases == ["Secret Police"] and rows[0].record.body == "Body two. Long body from the first call."

    def link(text, names):
        assert names == ["Gestapo", "Court"]
        return [("secret police", "THE COURT", "fears"), ("Gestapo", "court", "Fears"), ("Gestapo", "gestapo", "is"), ("Nobody", "Court", "x")]

    got = reformat.linked(one, batches, link).orderBy("place").collect()
    assert [(x.target, x.type) for x in got[0].record.relationships] == [("Court", "fears"), ("Court", "Fears")] and got[1].record.relationships == []


def test_grounding(spark):
    batches = reformat.batched(docs(spark, "# A\n\nThe Iron Chancelor rules Berlin."))
    out = reformat.extracted(batches, lambda *a: [entry("Iron Chancellor", aliases=["Otto"], keywords=["berlin", "betrayal"])], coverage=None)
    r = reformat.verified(out, batches).first()
    assert r.name_grounded and r.ungrounded_aliases == ["Otto"] and r.ungrounded_keywords == ["betrayal"]


def test_bodies_lose_nothing():
    a, b = "First fact. Second fact, which is long.", "Third fact. First fact."
    assert entities.merge_bodies(a, b) == f"{a}\n\nThird fact." == entities.merge_bodies(b, a)
    assert entities.merge_bodies("", "x") == "x"


def test_a_failing_scorer_leaves_the_scores(spark):
    from engram.sources import hooks

    rows = spark.createDataFrame([(1, "a", 0.5), (2, "bb", 0.25)], "id long, text string, score double").coalesce(1)

    def broken(q, t):
        raise ValueError("no model")

    assert sorted(map(tuple, hooks.reranked(rows, broken, "q").collect())) == [(1, "a", 0.5), (2, "bb", 0.25)]
    assert sorted(r.score for r in hooks.reranked(rows, lambda q, t: t.str.len() / 1.0, "q").collect()) == [1.0, 2.0]
    assert hooks.reranked(rows, None, "q") is rows
