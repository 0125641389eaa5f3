"""Chunks against plain versions that walk over the pieces."""

import random
import re

import pytest
from pyspark.sql import functions as F

from engram.operators import chunking, packing

ENDS = re.compile(r"(?<=[.!?。！？])\s*")
SF = "/root/testdata/sf0.001"


def packed(pieces, size, joint):
    out, now = [], ""
    for p in pieces:
        if len(now) + len(p) + len(joint) <= size:
            now = now + joint + p if now else p
        else:
            if now:
                out.append(now)
            now = p
    return [*out, now] if now else out


def sentences(text, size):
    return packed([s.strip() for s in ENDS.split(text) if s.strip()], size, " ")


def long_paragraph(text, size):
    out, now = [], ""
    for s in [s for s in ENDS.split(text) if s]:
        if len(now) + len(s) + 1 <= size:
            now = now + " " + s if now else s
            continue
        if now:
            out.append(now)
        now = s
        if len(s) > size:
            *full, now = packed(s.split(), size, " ")
            out += full
    return [*out, now] if now else out


def paragraphs(text, size):
    out, now = [], ""
    for p in (p.strip() for p in re.split(r"\n\n+", text)):
        if not p:
            continue
        if len(now) + len(p) + 2 <= size:
            now = now + "\n\n" + p if now else p
            continue
        out += [now] if now else []
        now = ""
        if len(p) > size:
            out += long_paragraph(p, size)
        else:
            now = p
    return [*out, now] if now else out or [text]


def speech(text, size):
    out, now, last = [], "", 0
    for m in re.finditer(r"\"[^\"]+\"|'[^']+'|「[^」]+」|『[^』]+』", text):
        now += text[last : m.start()]
        if len(now) + len(m[0]) <= size:
            now += m[0]
        else:
            out += [now.strip()] if now.strip() else []
            now = m[0]
        last = m.end()
    now += text[last:]
    out += [now.strip()] if now.strip() else []
    return [c for x in out for c in ([x] if len(x) <= size else paragraphs(x, size))]


PLAIN = {"sentence": sentences, "adaptive": paragraphs, "dialogue": speech}


def texts(seed):
    rng = random.Random(seed)
    bits = ["word", "Wörter", "日本語", "a", "x" * 30, "...", "?!", ". ", "! ", "。", "\n\n", "\n\n\n", "\n", "  ", "\t", " ", " ", " ", '"', "'", '"she said. no"', "'it is'", "「はい。いいえ」", "『a\n\nb』", "🙂", " ", "—"]
    return ["".join(rng.choices(bits, k=rng.choice([0, 1, 3, 30, 300]))) for _ in range(150)]


@pytest.mark.parametrize("strategy", sorted(PLAIN))
@pytest.mark.parametrize("size", [1, 12, 60])
def test_chunks_equal_a_walk_over_the_pieces(spark, strategy, size):
    rows = [*enumerate(texts(size)), (1000, "no end " * 3000), (1001, "One. " * 3000), (1002, '"' + "q " * 100 + '" he said. ' * 5)]
    got = {}
    for r in chunking.chunk(spark.createDataFrame(rows, "id long, text string").repartition(4), strategy, size=size).collect():
        got.setdefault(r.id, {})[r.chunk_index] = (r.text, r.total_chunks)
    for i, text in rows:
        want = PLAIN[strategy](text, size)
        mine = got.get(i, {})
        assert [mine[k][0] for k in sorted(mine)] == want, repr(text)
        assert all(n == len(want) for _, n in mine.values()) and sorted(mine) == list(range(len(want)))


@pytest.mark.parametrize("strategy", sorted(PLAIN))
def test_chunks_of_the_whole_table(spark, strategy):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.chunk_index): r.text for r in chunking.chunk(docs, strategy).collect()}
    assert got == {(r.doc_id, k): c for r in docs.collect() for k, c in enumerate(PLAIN[strategy](r.text or "", 500))}


def test_nulls_marks_and_plans(spark):
    rows = spark.createDataFrame([(1, None), (2, "a﷐b. c﷒"), (3, "  ")], "id long, text string")
    assert [(r.id, r.text) for r in chunking.sentences(rows).collect()] == [(2, "ab. c")]
    assert [(r.id, r.text) for r in chunking.adaptive(rows).orderBy("id").collect()] == [(1, None), (2, "ab. c"), (3, "  ")]
    for strategy in PLAIN:
        plan = chunking.chunk(rows, strategy)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


def test_set_apart(spark):
    df = spark.createDataFrame([(["a", "b" * 9, "c" * 9, "d"],)], "p array<string>")
    got = df.select(packing.packed(packing.set_apart(F.col("p"), 5, lambda p: F.concat(p, F.lit("!"))), 5).alias("c")).first().c
    assert got == ["a", "b" * 9 + "!", "c" * 9 + "!", "d"]
