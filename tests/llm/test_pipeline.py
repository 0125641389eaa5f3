import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm._base import table, written
from engram.llm.queries import ORACLES

sys.path.insert(0, os.path.dirname(__file__))
from test_minhash import brute  # noqa: E402
from test_operators import WORD, leaked, normal  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_quality(rows):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLES["op2_quality"])
    at = [c[0] for c in got.description]
    kept = {r[at.index("doc_id")] for r in got.fetchall() if r[at.index("kept")]}
    return [r for r in rows if r["doc_id"] in kept]


def plain_near_duplicates(rows):
    found = brute([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)
    return [r for r in rows if found[r["doc_id"]][1] == r["doc_id"]]


def edits(p, t):
    """Fewest edits between p and a part of t, a character of p at a time over all places of t."""
    t = np.array([ord(c) for c in t])
    step = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(p, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def plain_decontamination(rows):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    eights = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    grams = [(x["text"], eights(normal(x["text"]))) for x in items]

    def clean(text):
        own = eights(normal(text))
        # an item within its budget shares a gram; short items are looked for in any case
        def has(t, g):
            p = normal(t)
            if len(p) < 32:
                return leaked(t, text) is not None
            return bool(g & own) and edits(p, normal(text)) <= min(int(0.06 * len(p)), (len(p) - 7) * 2 // 3 // 8)

        return not any(has(t, g) for t, g in grams)

    return [r for r in rows if clean(r["text"])]


def plain_mixture(rows):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sources = sorted({r["source"] for r in rows if r["source"] is not None}) + ([None] if any(r["source"] is None for r in rows) else [])
    total = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, target = dict(total), {}
    while left:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > 2 * total[s]]
        for s in full or list(left):
            target[s] = float(2 * total[s]) if full else level * weight[s]
            del left[s]
    out = []
    for s in sources:
        rate = target[s] / total[s] if total[s] else 0.0
        key = "" if s is None else f"={s}"
        offset = int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:8], 16) / 2**32
        for k, r in enumerate(sorted((r for r in rows if r["source"] == s), key=lambda r: (size(r), r["doc_id"])), 1):
            out += [r] * (math.floor(k * rate + offset) - math.floor((k - 1) * rate + offset))
    return out


def plain_tokens(rows):
    whole, want, start = Tokenizer.from_file(corpus_pipeline.TOKENIZER), [], 0
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        ids = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_each_stage_and_the_whole_equal_plain_versions(spark):
    docs, rows = table(spark, SF, "documents"), pq.read_table(f"{SF}/documents.parquet").to_pylist()
    columns = docs.columns
    key = lambda r: tuple(r[c] for c in columns)
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_quality, plain_near_duplicates, plain_decontamination, plain_mixture)):
        docs, before = written(stage(spark, docs, SF), name.replace(" ", "-")), len(rows)
        rows = plain(rows)
        assert docs.columns == columns and rows and (len(rows) < before or name == "source mixture")
        assert Counter(map(tuple, docs.collect())) == Counter(map(key, rows))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == plain_tokens(rows)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "alpha beta"), (1, text), (2, text + " end"), (2, text + " end"), (None, text), (3, None), (3, ""), (4, "alpha beta"), (5, "gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit("x"), "id": F.lit(7)})
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "alpha beta"), (1, text), (3, None), (3, ""), (5, "gamma")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_stages_take_empty_tables_nulls_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b c " * 30, "en", "s"), (2, "", "en", None), (2, "x y " * 40, None, "s")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({"_words": F.lit(1), "size": F.lit("clash"), "key": F.lit("k"), "row": F.lit(2)})
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns and out.count() <= 2 * some.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == some.count()
