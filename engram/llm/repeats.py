"""Removing passages that an earlier document has, by FM-indices over shards of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._base import dropped, released, tidy, written
from ._text import U64, byte_view, chunks, grams, spread, words_of
from .fmindex import FMIndex

#: Words of the gram whose least hash names a window's shard, and windows of a segment at most.
ANCHOR, MOST_WINDOWS = 4, 64
#: Bits that a segment's number of windows takes beside its place in one number.
WINDOW_BITS = 7
#: Segments that one FM-index holds, about; a shard is cut between anchors.
INDEX_SEGMENTS = 1 << 16
#: Different segments of an anchor that are indexed, and that are streamed, at once, about; an anchor with more is cut into blocks.
BLOCK_SEGMENTS = 1 << 10

_SPACES = bytes(32 if 9 <= k <= 13 else k for k in range(256))


def _segments(w, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window's place in it, windows, anchor) of runs of windows with the same anchor.

    A window's anchor is the least hash of its ANCHOR-word grams, so equal windows have equal anchors wherever they are.
    """
    n = w.count
    g = grams(w.hash, ANCHOR)
    wide = window - ANCHOR + 1
    have, least = 1, g
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    some = np.maximum(n - window + 1, 0)
    at = np.repeat(w.first[:-1], some) + spread(some)
    doc = np.repeat(np.arange(len(n)), some)
    anchor = least[at] if len(at) else np.zeros(0, U64)
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(at)))
    pieces = -(-size // MOST_WINDOWS)
    start = np.repeat(run, pieces) + spread(pieces) * MOST_WINDOWS
    size = np.minimum(MOST_WINDOWS, np.repeat(run + size, pieces) - start)
    return doc[start], (at[start] - w.first[doc[start]]) if len(start) else start, size, anchor[start]


class Spelt:
    """The words of some documents as text: any run of them joined by single spaces, whatever stood between."""

    def __init__(self, w):
        self.w, self.text = w, w.raw.tobytes().translate(_SPACES)
        self.sizes = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])

    def joined(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Words first to last - 1, for arrays of both; empty where there are none."""
        some = last > first
        begin = np.where(some, self.w.start[np.minimum(first, len(self.w.start) - 1)] if len(self.w.start) else 0, 0)
        end = np.where(some, self.w.end[np.maximum(last, 1) - 1] if len(self.w.start) else 0, 0)
        plain = end - begin == np.where(some, self.sizes[last] - self.sizes[first] - 1, 0)
        return [self.text[a:b] if p else b" ".join(self.text[a:b].split()) for a, b, p in zip(begin.tolist(), end.tolist(), plain.tolist())]


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _sketch(window: int):
    """A row for each segment, and one with no windows and the digest of its words for each document. at: place and windows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_view(batch.column(1))
            for i, j in chunks(off):
                ids = batch.column(0).slice(i, j - i).to_numpy()
                w = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, place, size, anchor = _segments(w, window)
                for k in range(0, len(doc), 1 << 16):
                    b = slice(k, k + (1 << 16))
                    cols = [anchor[b].view(np.int64), ids[doc[b]], place[b].astype(np.int64) << WINDOW_BITS | size[b]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(doc[b]), pa.binary())], ["anchor", "id", "at", "digest"])
                whole = [_digest(t) for t in Spelt(w).joined(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int64)), pa.array(ids), pa.array(w.count << WINDOW_BITS), pa.array(whole, pa.binary())], ["anchor", "id", "at", "digest"])

    return run


def _contents(window: int):
    """The words of the segments that a document's row lists, and their digest."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_view(batch.column(1))
            listed = [batch.column(k) for k in (2, 3)]
            for i, j in chunks(off):
                w = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], hashed=False)
                spelt = Spelt(w)
                part = [c.slice(i, j - i) for c in listed]
                many = np.diff(part[0].offsets.to_numpy())
                at, anchor = (c.flatten().to_numpy() for c in part)
                place, windows = at >> WINDOW_BITS, at & ((1 << WINDOW_BITS) - 1)
                doc = np.repeat(np.arange(j - i), many)
                ids = batch.column(0).slice(i, j - i).to_numpy()[doc]
                first = w.first[doc] + place
                for a in range(0, len(doc), 1 << 14):
                    b = slice(a, a + (1 << 14))
                    words = spelt.joined(first[b], first[b] + windows[b] + window - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[b]), pa.array([_digest(x) for x in words], pa.binary()), pa.array(ids[b]), pa.array(place[b].astype(np.int32)), pa.array(words, pa.binary())], ["anchor", "key", "id", "place", "words"])

    return run


class Shard:
    """An FM-index of segments, earliest first: a shard of the corpus that streamed segments are searched in."""

    def __init__(self, segments: pa.Array, first: np.ndarray, window: int):
        by_age = np.argsort(first, kind="stable")
        lists = pc.split_pattern(segments.take(pa.array(by_age)), " ")
        words = lists.flatten().dictionary_encode()
        self.window, self.first, self.known = window, first[by_age], words.dictionary
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.index = FMIndex(words.indices.to_numpy().astype(np.int64) + 1, sizes, np.arange(len(sizes)), len(self.known) + 2, window)

    def earliest(self, segments: pa.Array) -> list[np.ndarray]:
        """For each window of each segment the least first document of the index's segments that have it, by backward search;
        the greatest long where none has.
        """
        lists = pc.split_pattern(segments, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        spelt = pc.index_in(lists.flatten(), value_set=self.known)
        stream = pc.fill_null(spelt, len(self.known)).to_numpy().astype(np.int64) + 1
        long, low, high = self.index.matches(offsets[:-1] - offsets[0], np.diff(offsets), stream)
        found = np.full(len(long), np.iinfo(np.int64).max)
        hit = np.flatnonzero(long == self.window)
        found[hit] = self.first[self.index.least_owner(low[hit], high[hit])]
        return [found[a : b - self.window + 1] for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])]


def _searched(window: int):
    """Segments come in order of anchor and pair of blocks; an index is made of whole pairs.

    Of each pair the first block's segments are indexed, those that some other segment comes after, and the second's are streamed
    through the index, those that come after some other.
    """

    def results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        youngest: dict[tuple, int] = {}
        oldest: dict[tuple, int] = {}
        for *pair, _, _, first, last, indexed, streamed in rows:
            pair = tuple(pair)
            if streamed:
                youngest[pair] = max(last, youngest.get(pair, last))
            if indexed:
                oldest[pair] = min(first, oldest.get(pair, first))
        library = [r for r in rows if r[7] and r[5] < youngest.get(r[:3], r[5])]
        search = [r for r in rows if r[8] and r[6] > oldest.get(r[:3], r[6])]
        if not library or not search:
            return
        shard = Shard(pa.array([r[4] for r in library], pa.binary()), np.array([r[5] for r in library], np.int64), window)
        found = shard.earliest(pa.array([r[4] for r in search], pa.binary()))
        keep = [k for k, (f, r) in enumerate(zip(found, search)) if f.min() < r[6]]
        yield pa.RecordBatch.from_arrays([pa.array([search[k][3] for k in keep], pa.binary()), pa.array([found[k] for k in keep], pa.list_(pa.int64()))], ["key", "firsts"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "i", "j", "key", "words", "first", "last", "indexed", "streamed"))):
                if len(held) >= INDEX_SEGMENTS and held[-1][:3] != r[:3]:
                    yield from results(held)
                    held = []
                held.append(r)
        yield from results(held)

    return run


def _kept(window: int, with_text: bool):
    """n_words, n_removed, the kept words' digest and text, from a row's starts of repeated windows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_view(batch.column("text"))
            all_ids, copies, starts = (batch.column(c) for c in ("id", "copy", "starts"))
            for i, j in chunks(off):
                w = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], hashed=False)
                n = w.count
                part = starts.slice(i, j - i)
                many = np.diff(part.offsets.to_numpy())
                at = part.flatten().to_numpy() + np.repeat(w.first[:-1], many)
                cover = np.zeros(len(w.start) + window + 1, np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover)[: len(w.start)] > 0
                copy = np.array(copies.slice(i, j - i)) & (n >= window)
                gone |= np.repeat(copy, n)
                stay = np.flatnonzero(~gone)
                size = w.end[stay] - w.start[stay] + 1  # and a space
                packed = np.full(int(size.sum()), 32, np.uint8)
                begin = np.cumsum(size) - size
                inner = spread(size - 1)
                packed[np.repeat(begin, size - 1) + inner] = w.raw[np.repeat(w.start[stay], size - 1) + inner]
                kept = np.searchsorted(stay, w.first)
                edge = np.append(begin, len(packed))[kept]
                view = memoryview(packed)
                digests = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:])]
                texts = [bytes(view[a : max(a, b - 1)]) if with_text else None for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([all_ids.slice(i, j - i), pa.array(n), pa.array(n - np.diff(kept)), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row, by windows of `window` consecutive words;
    kept_text is null unless with_text.

    A word is removed if a window that covers it also starts in a document with a smaller id. Kept words are joined by one
    space. Words are runs without ASCII white space, unchanged. Null, empty and blank texts have no words; texts of fewer words
    than a window lose none. Rows with a null id are neither earlier nor later than any other and keep all. Of
    repeated ids none is earlier than the other. Other columns aren't read; an empty table gives an empty result.

    Plan. Every window belongs to the shard of its anchor, so equal windows meet without sending any document to every
    shard; runs of windows with one anchor are segments. (1) Only anchors, ids and places are shuffled, reduced to the least and
    greatest id for each anchor before that: anchors of one document only, nearly all, are done. (2) The rest of the
    segments, but those of documents that copy an earlier one word for word, get their words as text; equal segments become one
    row with the least and greatest id, again before the shuffle, so a passage that a third of the corpus has is one row a task. (3) A
    shard builds an FM-index of the segments that others come after and streams those others through it by backward search;
    matching statistics of a whole window report a range of suffixes, whose least document is what the window
    wants. Words are compared as they are, not by hashes. An anchor of very many different segments is cut into blocks, and each
    pair of blocks, one indexed and one streamed, is a group of its own, which bounds what a task holds. (4) Segments take the answers back to their
    documents in a join on the digest (BLAKE2b, 128 bits) of their words, which adaptive execution splits where one segment has
    very many documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = texts.where("id IS NOT NULL AND text IS NOT NULL")
    sketch = written(known.mapInArrow(_sketch(window), "anchor long, id long, at long, digest binary"), "segments")
    whole = sketch.where(f"digest IS NOT NULL AND at >= {window << WINDOW_BITS}").select("digest", "id")
    same = whole.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copies = written(whole.join(same, "digest").where("id > first").select("id").distinct(), "copies")
    segments = sketch.where("digest IS NULL")
    shared = segments.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    listed = written(segments.select("anchor", "id", "at").join(shared, "anchor", "left_semi").join(copies, "id", "left_anti"), "listed")
    dropped(sketch)
    released(spark)
    per_doc = listed.groupBy("id").agg(F.collect_list(F.struct("at", "anchor")).alias("s")).select(F.col("id").alias("k"), "s.at", "s.anchor")
    spelt = known.join(per_doc, F.col("id") == F.col("k")).select("id", "text", "at", "anchor")
    spelt = written(spelt.mapInArrow(_contents(window), "anchor long, key binary, id long, place int, words binary"), "spelt")
    dropped(listed)
    released(spark)
    distinct = written(spelt.groupBy("anchor", "key", "words").agg(F.min("id").alias("first"), F.max("id").alias("last")), "distinct")
    places = written(spelt.select("key", "id", "place"), "places")
    dropped(spelt)
    released(spark)
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_SEGMENTS)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / BLOCK_SEGMENTS).cast("int").alias("blocks"))
    rows = distinct.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a segment is indexed in its block, for all others to be streamed, and streamed through all blocks; alone, it is one row
    own, blocks = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, j, indexed, streamed: F.struct(i.alias("i"), j.alias("j"), indexed.alias("indexed"), streamed.alias("streamed"))
    indexed = F.transform(blocks, lambda k: pair(own, k, F.lit(True), k == own))
    streamed = F.transform(F.filter(blocks, lambda k: k != own), lambda k: pair(k, own, F.lit(False), F.lit(True)))
    rows = rows.withColumn("p", F.explode(F.concat(indexed, streamed)))
    rows = rows.select("anchor", "p.i", "p.j", "key", "words", "first", "last", "p.indexed", "p.streamed")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    answers = written(rows.mapInArrow(_searched(window), "key binary, firsts array<long>"), "answers")
    dropped(distinct)
    released(spark)
    starts = places.join(answers, "key")
    starts = starts.select("id", F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("id"), F.col("place") + i)), lambda x: x.isNotNull()).alias("s")).where(F.size("s") > 0)
    gone = starts.groupBy("id").agg(F.flatten(F.collect_list("s")).alias("starts"), F.lit(False).alias("copy"))
    gone = gone.unionByName(copies.select("id", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    gone = written(gone.withColumnRenamed("id", "k"), "gone")
    dropped(places, answers, copies)
    released(spark)
    out = texts.join(gone, F.col("id") == F.col("k"), "left").select("id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), F.coalesce("copy", F.lit(False)).alias("copy"))
    out = out.mapInArrow(_kept(window, with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col)
