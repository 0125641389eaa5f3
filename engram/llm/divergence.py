"""How far the sources of a language diverge: exact term counts behind a count-min sketch of document frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._base import dropped, small_batches, tidy, written
from ._text import U64, byte_view, chunks, mix64, word_hashes

#: Everything but ASCII letters and bytes of other characters becomes a space, A-Z become a-z.
_PLAIN = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Cells in a row of the sketch, and rows of it. A task holds a byte a cell; the merged sketch is broadcast as a bit a cell.
WIDTH, DEPTH = 1 << 20, 4
#: Cells that travel together while sketches are merged.
BLOCK = 1 << 16
#: Distinct (lang, source, term) that a task gathers before it sends them on.
HELD_ROWS = 1 << 20
SCALE = 1_000_000_000


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every term of some texts, in order, and the distinct terms by code."""
    raw, off = byte_view(text)
    plain = np.frombuffer(raw.tobytes().translate(_PLAIN), np.uint8)
    on = np.zeros(len(plain) + 2, bool)
    on[1:-1] = plain != 0x20
    begins, ends = on[1:-1] & ~on[:-2], on[1:-1] & ~on[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(plain))]
    begins[inner], ends[inner - 1] = on[1:-1][inner], on[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    column = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(plain[plain != 0x20].tobytes()))
    coded = column.dictionary_encode()
    return np.searchsorted(off, start, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _counts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, np.ndarray, pa.Array]]:
    """For runs of about a megabyte of text: the distinct (lang, source, term) with their documents and occurrences, the terms' codes and the terms."""
    _, off = byte_view(batch.column("text"))
    for i, j in chunks(off):
        row, code, terms = _terms(batch.column("text").slice(i, j - i))
        if not len(row):
            continue
        lang, source = (batch.column(c).slice(i, j - i).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        in_doc, n = np.unique(row * len(terms) + code, return_counts=True)
        cell, back = np.unique(group[in_doc // len(terms)] * len(terms) + in_doc % len(terms), return_inverse=True)
        of_group, code = cell // len(terms), cell % len(terms)
        yield pa.table({
            "lang": lang.dictionary.take(pa.array(of_group // len(source.dictionary))), "source": source.dictionary.take(pa.array(of_group % len(source.dictionary))),
            "docs": np.bincount(back, minlength=len(cell)), "n": np.bincount(back, weights=n, minlength=len(cell)).astype(np.int64),
        }), code, terms


def _cells(lang: pa.ChunkedArray, code: np.ndarray, terms: pa.Array, width: int, depth: int) -> np.ndarray:
    """The cell of each (lang, term) in each row of the sketch: depth arrays."""
    hashes = lambda a: word_hashes(*(lambda raw, off: (raw, off[:-1], off[1:]))(*byte_view(a)))
    langs = lang.combine_chunks().dictionary_encode()
    h = mix64(hashes(terms)[code] + mix64(hashes(langs.dictionary))[langs.indices.to_numpy()])
    return np.stack([j * width + (mix64(h + U64(j)) % U64(width)).astype(np.int64) for j in range(depth)])


def possible_terms(docs: DataFrame, least: int, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """Bits of the cells of a count-min sketch of document frequencies that hold least or more; docs(text, lang, source) without nulls.

    A (lang, term) that occurs in least documents has all its cells set; others may have, by collisions. Each task adds
    its rows up in one sketch whose cells stop at least, so sums still tell what reaches it. Sketches travel in blocks and
    are added as they come: a merging task holds its own blocks, however many tasks send. The driver gets depth * width bits.
    """
    kind = np.uint8 if least < 256 else np.uint32

    def sketched(batches):
        cells = np.zeros(depth * width, kind)
        for batch in batches:
            for counts, code, terms in _counts(batch):
                at = _cells(counts["lang"], code, terms, width, depth)
                for row in at:  # several sources of one lang share a cell
                    where, back = np.unique(row, return_inverse=True)
                    more = np.bincount(back, weights=counts["docs"].to_numpy()) + cells[where]
                    cells[where] = np.minimum(more, least).astype(kind)
        for b in range(0, len(cells), BLOCK):
            if cells[b : b + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b // BLOCK], pa.int32()), "cells": pa.array([cells[b : b + BLOCK].tobytes()], pa.binary())})

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                got = np.frombuffer(cells, kind).astype(np.int64)
                held[b] = np.minimum(held.get(b, 0) + got, least)
        for b, cells in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(cells >= least).tobytes()], pa.binary())})

    spark = docs.sparkSession
    blocks = -(-depth * width // BLOCK)
    with small_batches(spark):
        rows = docs.mapInArrow(tidy(sketched), "block int, cells binary").repartition(blocks, "block").mapInArrow(tidy(merged), "block int, bits binary").collect()
    bits = np.zeros(depth * width, bool)
    for r in rows:
        got = np.unpackbits(np.frombuffer(r.bits, np.uint8))
        n = min(BLOCK, len(bits) - r.block * BLOCK)
        bits[r.block * BLOCK : r.block * BLOCK + n] = got[:n]
    return np.packbits(bits)


def term_counts(docs: DataFrame, least: int, width: int = WIDTH, depth: int = DEPTH, held_rows: int = HELD_ROWS) -> DataFrame:
    """(lang, source, term, docs, n) of all terms that may be in least documents of their lang; docs as possible_terms takes.

    What the sketch rules out is discarded in the task that reads it; what is left is counted exactly.
    """
    spark = docs.sparkSession
    held_bits = spark.sparkContext.broadcast(possible_terms(docs, least, width, depth))

    def added(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
        return out.rename_columns({"docs_sum": "docs", "n_sum": "n"}).select(["lang", "source", "term", "docs", "n"])

    def survivors(batches):
        bits, held, rows = np.unpackbits(held_bits.value).view(bool), [], 0
        for batch in batches:
            for counts, code, terms in _counts(batch):
                keep = bits[_cells(counts["lang"], code, terms, width, depth)].all(0)
                found = counts.append_column("term", terms.take(pa.array(code)).cast(pa.string())).filter(pa.array(keep))
                held.append(found.select(["lang", "source", "term", "docs", "n"]))
                rows += held[-1].num_rows
                if rows > 2 * held_rows:
                    held = [added(held)]
                    rows = held[0].num_rows
                    if rows > held_rows:
                        yield from held[0].to_batches(1 << 16)
                        held, rows = [], 0
        if held:
            yield from added(held).to_batches(1 << 16)

    found = docs.mapInArrow(tidy(survivors), "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(n: str, total: str, terms: str = "terms") -> str:
    """1 + floor(SCALE (n + 5) / (total + 5 terms)), exact; null where the lang has no terms."""
    return f"1L + ((CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 5 AS DECIMAL(20,0))) div CAST(nullif({total} + 5 * {terms}, 0) AS DECIMAL(20,0)))"


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, most_terms: int = 50, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its lang, and the terms it has more of.

    A lang keeps the terms of at least `least` of its documents. A group's share of a kept term is p = 1 + floor(1e9 (count + 5) / (N + 5 V)),
    N being its occurrences of all V kept terms. part 'pair': the sum of abs(p - q) over the kept terms for each
    other source; part 'term': p - q against the whole lang, for terms that the group has, where positive, the first most_terms.

    Terms that a group has not all share one p, so only counts above zero are joined: two sources differ by V times the
    difference of those, mended where one of them has the term (from its distribution of counts), and again where both have it (the
    join of sparse counts, summed in the tasks). All arithmetic is in whole numbers.

    Null texts, langs and sources are empty strings; a group without terms is compared like others. A lang without kept terms has
    pairs of value 0 and no term rows; a lang with one source has no pairs. Ties go by item in UTF-8 order; rows count as often as they
    are there. An empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counts = written(term_counts(rows, least, width, depth), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    kept = written(counts.drop("docs").join(terms.drop("docs"), ["lang", "term"]), "kept")
    dropped(counts)

    langs = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("_")).drop("_").join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_n", "terms", "lang_n"])
    groups = written(groups.withColumn("p0", F.coalesce(F.expr(_share("0", "own_n")), F.lit(0))), "groups")
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "own_n")))

    over = cells.withColumn("value", F.col("p") - F.expr(_share("all_n", "lang_n"))).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    term = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").where(F.col("source") < F.col("other")).select("lang", "source", "other", (F.col("terms") * gap("p0", "q0")).alias("value"))
    alike = cells.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m")).join(other, "lang").where(F.col("source") != F.col("other"))
    one = alike.select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), (F.col("m") * (gap("p", "q0") - gap("p0", "q0"))).alias("value"))
    mine = cells.select("lang", "term", "source", "p", "p0")
    both = mine.join(mine.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).where(F.col("source") < F.col("other"))
    both = both.select("lang", "source", "other", (gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")).alias("value"))
    parts = [x.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")) for x in (base, one, both)]
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("source").alias("b"))))
    pairs = pairs.select("lang", "value", ends.alias("e")).select("lang", F.col("e.a").alias("source"), F.lit("pair").alias("part"), F.col("e.b").alias("item"), "value")
    far = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.withColumn("rank", F.row_number().over(far)).unionByName(term)
