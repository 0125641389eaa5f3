"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._base import tidy, written
from ._text import U64, byte_view, chunks

#: q-grams are Q characters, each mapped to a byte, so a gram is one 64-bit number.
Q = 8
#: Bytes of benchmark text that a task holds at once; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 16 << 20
#: Pairs of a place and an item with the same gram that are counted at once.
MOST_PAIRS = 1 << 21
#: Characters of a stretch of text that is counted at once, at least.
STRETCH = 1 << 18

#: Normal form, byte by byte: A-Z in lower case; ASCII letters, digits and bytes of other characters stay;
#: everything else is a space, and spaces in a row are one.
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def normalised(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a byte for each character, its code point, where documents begin and the last ends) of documents in normal form.

    A space stands before each document and after the last, so document d and its borders are [at[d], at[d + 1]]. An ASCII
    character is its own byte; others share the bytes from 128 on by a hash.
    """
    b = np.frombuffer(raw.tobytes().translate(_NORMAL.tobytes()), np.uint8)
    b = np.insert(b, off, np.uint8(32))
    at = off + np.arange(len(off))
    space = b == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[at] = True
    point = b
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead) or (b >= 128).any():
        keep &= (b & 0xC0) != 0x80
        first, rest = b[lead].astype(np.int32), [np.append(b, np.zeros(3, np.uint8))[lead + k].astype(np.int32) & 63 for k in (1, 2, 3)]
        two, three = (first & 31) << 6 | rest[0], (first & 15) << 12 | rest[0] << 6 | rest[1]
        value = np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]))
        point = b.astype(np.int32)
        point[lead] = value
        b = b.copy()
        b[lead] = 128 + ((value.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(57)).astype(np.uint8)
    return b[keep], point[keep], np.cumsum(keep)[at] - 1


def gram_codes(b: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on as a number."""
    if len(b) < Q:
        return np.zeros(0, U64)
    b = np.ascontiguousarray(b)
    return np.ndarray(len(b) - Q + 1, "<u8", b.data, strides=(1,))


class Items:
    """A block of benchmark items: their grams in order, a bitmap of these, edit budgets and least counts.

    An item of n characters within e edits of a region shares at least n - Q + 1 - Q * e grams with it (the q-gram
    lemma). e = rate * n, less where that would leave fewer grams than a third of the item's. Items of fewer than `short`
    characters have no budget and count with the spaces around them: they are found as whole words. Those that are
    shorter than a gram even so are `tiny`: length -> their codes in order, and items.
    """

    def __init__(self, ids: list[int], texts: list[bytes], rate: float, short: int = 32):
        self.ids, self.plain, self.text, self.point = [], [], [], []
        for i, t in zip(ids, texts):
            t = np.frombuffer(t, np.uint8)
            b, point, _ = normalised(t, np.array([0, len(t)]))
            inner = np.flatnonzero(b != 32)
            if not len(inner):
                continue
            border = int(inner[-1] - inner[0] + 1 < short)
            span = slice(inner[0] - border, inner[-1] + 1 + border)
            self.ids.append(i)
            self.text.append(b[span].tobytes())
            self.point.append(point[span].astype(np.int32))
            self.plain.append(bool((b[span] < 128).all()))
        self.size = np.array([len(t) for t in self.text], np.int64)
        grams = np.maximum(self.size - Q + 1, 0)
        self.edits = np.where(self.size < short + 2, 0, np.minimum((rate * self.size).astype(np.int64), grams * 2 // 3 // Q))
        self.least = np.maximum(grams - Q * self.edits, 1)
        codes = [gram_codes(np.frombuffer(t, np.uint8)) for t in self.text]
        code = np.concatenate([*codes, np.zeros(0, U64)])
        item = np.repeat(np.arange(len(self.text)), grams)
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.bits = max(16, int(len(code) * 32).bit_length())
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.slot(code)] = True
        self.reach = int((self.size + self.edits).max(initial=0))
        # a region of any item shows at least so many grams of the block within its reach
        self.dense = int(self.least[grams > 0].min(initial=1 << 30))
        self.tiny: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.size[grams == 0]):
            mine = np.flatnonzero(self.size == n)
            code = np.array([int.from_bytes(self.text[k], "little") for k in mine], U64)
            self.tiny[int(n)] = code[np.argsort(code)], mine[np.argsort(code)]

    def slot(self, code: np.ndarray) -> np.ndarray:
        h = code * U64(0x9E3779B97F4A7C15)
        h >>= U64(64 - self.bits)
        return h.view(np.int64)

    def edits_in(self, i: int, text: bytes, point: np.ndarray, shift: int) -> int:
        """Fewest edits between item i and a part of a region, up to its budget; more if there is none. The part starts about at shift."""
        e, k = int(self.edits[i]), text.find(self.text[i])
        while k >= 0:
            if self.plain[i] or (point[k : k + len(self.point[i])] == self.point[i]).all():
                return 0
            k = text.find(self.text[i], k + 1)
        return band_distance(self.point[i], point, shift, 2 * e + 1) if e else 1


def band_distance(item: np.ndarray, region: np.ndarray, shift: int, most: int) -> int:
    """Least edits between the item and some part of the region, up to most; else most + 1. Both are code points.

    The part starts within most of place shift. Rows are the item's characters, the band is 2 * most + 1 wide, both ends of the region are free.
    """
    n, width = len(item), 2 * most + 1
    lead = 2 * most + 1 + max(0, most - shift)
    text = np.full(lead + len(region) + 2 * most + n + 1, -1, np.int32)
    text[lead : lead + len(region)] = region
    at = lead + shift - most
    row = np.zeros(width, np.int64)  # starting anywhere in the band is free
    steps = np.arange(width)
    for i in range(n):
        part = text[at + i : at + i + width]
        if len(part) < width:
            part = np.concatenate([part, np.full(width - len(part), -1, np.int32)])
        new = row + (part != item[i])  # match or change: the same diagonal
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item left out
        new = np.minimum.accumulate(new - steps) + steps  # characters of the region left out
        row = new
        if row.min() > most:
            return most + 1
    return int(row.min())


def _hits(b: np.ndarray, point: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(document, item, edits) of some normalised documents."""
    seen: dict[tuple[int, int], int] = {}
    for n, (codes, mine) in items.tiny.items():
        code = gram_codes(np.append(b, np.zeros(Q - 1, np.uint8))) & U64((1 << 8 * n) - 1)
        lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
        where = np.flatnonzero(hi > lo)
        doc = np.searchsorted(at, where, "right") - 1
        for w, d in zip(where.tolist(), doc.tolist()):
            if d < len(at) - 1 and w + n - 1 <= at[d + 1]:
                for i in mine[lo[w] : hi[w]]:
                    if (point[w : w + n] == items.point[i]).all():
                        seen[(d, int(i))] = 0
    code = gram_codes(b)
    if len(code) and len(items.code):
        hit = items.map[items.slot(code)]
        for k in range(1, Q - 1):  # grams beyond a document's last border are none
            ends = at[1:] - k
            hit[ends[(ends >= 0) & (ends < len(hit))]] = False
        hit[at[-1] :] = False
        _counted(b, point, at, items, code, np.flatnonzero(hit), seen)
    return [(d, i, edits) for (d, i), edits in seen.items()]


def _counted(b: np.ndarray, point: np.ndarray, at: np.ndarray, items: Items, code: np.ndarray, places: np.ndarray, seen: dict) -> None:
    """Counts shared grams in bands, some places at a time, and aligns where a band has enough; adds to seen."""
    if not len(places):
        return
    # keep hits with enough others within an item's reach on their right, or that are such others themselves
    right = np.minimum(places + items.reach, len(code))
    opens = np.searchsorted(places, right) - np.arange(len(places)) >= items.dense
    if not opens.any():
        return
    cover = np.zeros(len(code) + 1, np.int64)
    np.add.at(cover, places[opens], 1)
    np.add.at(cover, right[opens], -1)
    places = places[np.cumsum(cover)[places] > 0]
    lo, hi = np.searchsorted(items.code, code[places]), np.searchsorted(items.code, code[places], "right")
    # in stretches of text: an alignment that begins in one ends within the reach of its last place, so what is counted twice is
    # half of it at most
    stretch = max(STRETCH, 4 * items.reach)
    begin = 0
    while begin < len(places):
        end = int(np.searchsorted(places, places[begin] + stretch))
        over = int(np.searchsorted(places, places[end - 1] + 2 * items.reach, "right"))
        _parted(b, point, at, items, places[begin:over], lo[begin:over], hi[begin:over], 0, len(items.ids), seen)
        begin = end


def _parted(b: np.ndarray, point: np.ndarray, at: np.ndarray, items: Items, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int, last: int, seen: dict) -> None:
    """Counts the pairs of these places with the items from first to last - 1, MOST_PAIRS of them at once: more are halved by items,
    and those of a single item by its bands of diagonals.

    Entries of one gram are in order of item, then place, so each part of a place's pairs is a run of them.
    """
    some = hi > lo
    places, lo, hi = places[some], lo[some], hi[some]
    total = int((hi - lo).sum())
    if total <= MOST_PAIRS:
        if total:
            _banded(b, point, at, items, places, lo, hi - lo, seen)
    elif last - first > 1:
        middle = (first + last) // 2
        cut = _run_search(items.item, lo, hi, np.full(len(lo), middle))
        _parted(b, point, at, items, places, lo, cut, first, middle, seen)
        _parted(b, point, at, items, places, cut, hi, middle, last, seen)
    else:
        _one_item(b, point, at, items, places, lo, hi, first, seen)


def _run_search(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each run [lo, hi) of sorted values the first place whose value is not below the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        below = open_ & (values[np.minimum(middle, len(values) - 1)] < wanted)
        lo, hi = np.where(below, middle + 1, lo), np.where(open_ & ~below, middle, hi)
    return lo


def _one_item(b: np.ndarray, point: np.ndarray, at: np.ndarray, items: Items, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, i: int, seen: dict) -> None:
    """The bands of one item with very many pairs: each band's counts by document come from the lengths of runs; no pair is made."""
    e = int(items.edits[i])
    half, shift = e + 1, items.reach + 1
    doc_of = np.searchsorted(at, places, "right") - 1
    low, high = int(places[0] - items.size[i] + shift) // half - 1, int(places[-1] + shift) // half
    for band in range(low, high + 1):
        begin = band * half - shift  # diagonals of the band: begin to begin + 2 * half - 1
        near = slice(int(np.searchsorted(places, begin)), int(np.searchsorted(places, begin + 2 * half + items.size[i])))
        if near.start >= near.stop:
            continue
        p = places[near]
        # diagonal = place - place in the item, so the item's places lie between p - begin - 2 * half + 1 and p - begin
        a = _run_search(items.place, lo[near], hi[near], p - begin - 2 * half + 1)
        z = _run_search(items.place, a, hi[near], p - begin + 1)
        docs, back = np.unique(doc_of[near], return_inverse=True)
        count = np.bincount(back, weights=z - a)
        for d in docs[count >= items.least[i]].tolist():
            _align(b, point, at, items, i, d, begin, seen)


def _align(b: np.ndarray, point: np.ndarray, at: np.ndarray, items: Items, i: int, d: int, begin: int, seen: dict) -> None:
    """Aligns an item with a document's region from the diagonal begin on; adds to seen."""
    if seen.get((d, i), 1) == 0:
        return
    e = int(items.edits[i])
    low = max(0, begin - int(at[d]) - e)
    part = slice(int(at[d]) + low, min(int(at[d + 1]) + 1, max(int(at[d]), begin) + int(items.size[i]) + 4 * e + 4))
    edits = items.edits_in(i, b[part].tobytes(), point[part], begin + e - int(at[d]) - low)
    if edits <= e:
        seen[(d, i)] = min(edits, seen.get((d, i), edits))


def _banded(b: np.ndarray, point: np.ndarray, at: np.ndarray, items: Items, places: np.ndarray, lo: np.ndarray, n: np.ndarray, seen: dict) -> None:
    where = np.repeat(places, n)
    pick = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    item, diagonal = items.item[pick], where - items.place[pick]
    # bands of twice the budget that overlap by half: each alignment lies wholly in one of them
    half = items.edits[item] + 1
    shift = items.reach + 1
    band = (diagonal + shift) // half
    keys = np.concatenate([np.stack([item, band, diagonal, where], 1), np.stack([item, band - 1, diagonal, where], 1)])
    doc_of = np.searchsorted(at, keys[:, 3], "right") - 1
    order = np.lexsort((keys[:, 3], keys[:, 1], keys[:, 0], doc_of))
    keys, doc_of = keys[order], doc_of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (doc_of[1:] != doc_of[:-1]) | (keys[1:, 0] != keys[:-1, 0]) | (keys[1:, 1] != keys[:-1, 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(keys)))
    for f in first[count >= items.least[keys[first, 0]]]:
        i, d = int(keys[f, 0]), int(doc_of[f])
        _align(b, point, at, items, i, d, int(keys[f, 1]) * (int(items.edits[i]) + 1) - shift, seen)


def _found(column: pa.Array, items: Items) -> Iterator[tuple[int, int, list[dict[int, int]]]]:
    """(first row, end row, edits by item for each row) for runs of rows."""
    raw, off = byte_view(column)
    for i, j in chunks(off):
        b, point, at = normalised(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        by: list[dict[int, int]] = [{} for _ in range(j - i)]
        for d, k, edits in _hits(b, point, at, items):
            item = int(items.ids[k])
            by[d][item] = min(edits, by[d].get(item, edits))
        yield i, j, by


def _scan(block, rate: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(block, rate)
        for batch in batches:
            for i, j, by in _found(batch.column(1), items):
                got = [sorted(x.items()) for x in by]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([[x for x, _ in g] for g in got], pa.list_(pa.int64())), pa.array([[e for _, e in g] for g in got], pa.list_(pa.int32()))], ["id", "item_ids", "edits"])

    return run


def _clean(block, rate: float, text: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(block, rate)
        for batch in batches:
            for i, j, by in _found(batch.column(text), items):
                yield batch.slice(i, j - i).filter(pa.array([not x for x in by], pa.bool_()))

    return run


_last: list = [None, None]


def _items(block, rate: float) -> Items:
    """Made once for each worker and block."""
    if _last[0] != (block.id, rate):
        rows = block.value
        _last[:] = [(block.id, rate), Items([r[0] for r in rows], [r[1] for r in rows], rate)]
    return _last[1]


class _Block:
    """A broadcast with a name."""

    def __init__(self, id: str, sent):
        self.id, self.sent = id, sent

    @property
    def value(self):
        return self.sent.value


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[_Block]:
    """The benchmark, measured first: one broadcast up to block_bytes, else parts of about that size by a hash of the items."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    out = []
    for k in range(n):
        rows = [(r.item, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toLocalIterator()]
        out.append(_Block(uuid.uuid4().hex, spark.sparkContext.broadcast(sorted(rows))))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.06, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which leaks() finds no item, with all their columns, whatever their names; nothing is shuffled."""
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(_clean(block, rate, docs.columns.index(text_col)), docs.schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.06, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, contaminated, item_ids, edits) for each row: the items found in it, in order, and the fewest edits of each.

    Text and items are compared character by character in normal form: A-Z in lower case, ASCII that is no letter or digit a
    space, spaces in a row one. An item is in a document if a part of it is within rate * length edits of the
    whole item (fewer for items of little over 32 characters, see Items); an item of fewer characters is, if it is there without an edit as
    whole words. Null and blank items are not looked for. Null and empty texts have no leak; null and repeated
    ids are judged row by row; either table may be empty. Other columns aren't read.

    The benchmark is measured first. Up to block_bytes it is one broadcast; a larger one is split by a hash of its
    items into blocks of that size, which scan the documents one after another; rows are then numbered in a written table.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    kind = "item_ids array<long>, edits array<int>"
    if len(blocks) == 1:
        flat = texts.mapInArrow(_scan(blocks[0], rate), f"id {dict(texts.dtypes)['id']}, {kind}")
    else:
        rows = written(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
        parts = [rows.select("row", "text").mapInArrow(_scan(block, rate), f"row long, {kind}") for block in blocks]
        one = reduce(DataFrame.unionByName, parts).where(F.size("item_ids") > 0).select("row", F.explode(F.arrays_zip("item_ids", "edits")).alias("x")).groupBy("row", "x.item_ids").agg(F.min("x.edits").alias("e"))
        one = one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("item_ids").alias("i"), "e"))).alias("x")).select("row", F.col("x.i").alias("item_ids"), F.col("x.e").alias("edits"))
        none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("item_ids", "array<long>"), ("edits", "array<int>"))]
        flat = rows.select("row", "id").join(one, "row", "left").select("id", *none)
    return flat.select(F.col("id").alias(id_col), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "edits")
