"""MinHash near-duplicates with an LSH forest.

Plan: sketch every document (one pass, JVM to Arrow once) -> one row for each distinct shingle set ->
one row for each set and order, range-partitioned and sorted by the order's key -> neighbours of the
longest common prefix as candidates -> candidates confirmed on full sets -> connected components ->
regions of equal prefixes that hold more rows than neighbours reach, and more than one component: each is
followed down to longer prefixes until its parts fit a block, whose rows are all compared on full sets ->
connected components again -> regions beyond a block that still hold several components: all against all,
in pairs of blocks -> connected components again. So no pair that shares a prefix is left out, however
many rows share it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._base import dropped, released, tidy, written
from ._text import U64, byte_view, chunks, mix64, shingle_sets, words_of
from .components import connected_components

#: Orders of the forest, hash values between the starts of two orders' keys, values in a key, and the
#: common prefix that makes neighbours candidates. 0.85^3 shared prefixes in each of 16 orders miss a
#: pair at the threshold with probability 2.4e-7 (1e-5 at 0.8).
ORDERS, STEP, KEY, LEAST_PREFIX = 16, 4, 8, 3
VALUES = ORDERS * STEP
#: Sorted neighbours after each row that are candidates; the leader of the row's region is one besides.
NEIGHBOURS = 3
#: Rows and shingles of one block of a crowded region, about; each task holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * U64(2) + _rng.integers(0, 2, VALUES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * U64(2) + U64(1)

_SKETCH = "id long, n_shingles long, d1 long, d2 long, keys binary, bits long"
_ROWS = "a long, b long, stub boolean, o int, k1 long, k2 long, id long, n long, bits long"


def _signature(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each min-hash, and one bit of each packed into a word, for non-empty sets."""
    sig = np.empty((len(at) - 1, VALUES), np.uint16)
    for k in range(VALUES):
        sig[:, k] = (mix64(np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], at[:-1])) >> U64(17)).astype(np.uint16)
    bits = np.packbits((sig >> 9).astype(np.uint8) & 1, axis=1, bitorder="little")[:, :8].copy().view(np.int64).ravel()
    return sig, bits


def _sketches(ngram: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_view(batch.column(1))
            for i, j in chunks(off):
                w = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                sets, at = shingle_sets(w, ngram)
                n = np.diff(at)
                full = n > 0
                d = np.zeros((2, j - i), np.int64)
                keys = np.zeros((j - i, VALUES), np.uint16)
                bits = np.zeros(j - i, np.int64)
                if full.any():
                    own = np.append(at[:-1][full], at[-1])
                    whole = b"".join(hashlib.blake2b(sets[a:b].data, digest_size=16).digest() for a, b in zip(own[:-1], own[1:]))
                    d[:, full] = np.frombuffer(whole, np.int64).reshape(-1, 2).T
                    keys[full], bits[full] = _signature(sets, own)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), j - i, [None, pa.py_buffer(keys.astype(">u2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(d[0]), pa.array(d[1]), packed.cast(pa.binary()), pa.array(bits)], ["id", "n_shingles", "d1", "d2", "keys", "bits"])

    return run


@tidy
def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each order: its key is KEY values of the signature from the order's start, round the end."""
    for batch in batches:
        for i in range(0, len(batch), 2048):
            part = batch.slice(i, 2048)
            sig = np.stack([np.frombuffer(x, ">u2") for x in part.column("keys").to_pylist()])
            cols = {c: part.column(c).to_numpy() for c in ("id", "n_shingles", "bits")}
            for o in range(ORDERS):
                take = [(o * STEP + k) % VALUES for k in range(KEY)]
                key = np.ascontiguousarray(sig[:, take]).view(">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), o, np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(cols["id"]), pa.array(cols["n_shingles"]), pa.array(cols["bits"])], ["o", "k1", "k2", "id", "n", "bits"])


def _neighbours(threshold: float, far: int):
    """Streams one sorted range: candidates of each row, and the range's first and last rows as stubs."""
    names = ["o", "k1", "k2", "id", "n", "bits"]

    def near(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs can reach the threshold by their sizes and likely do by their sketch bits."""
        low, high = np.minimum(x["n"][i], x["n"][j]), np.maximum(x["n"][i], x["n"][j])
        return (low >= threshold * high - 1e-9) & (np.bitwise_count((x["bits"][i] ^ x["bits"][j]).view(np.uint64)) <= far) & (x["id"][i] != x["id"][j])

    def pairs(x: dict, new: int) -> np.ndarray:
        """new: rows before it have been handled already."""
        found = []
        n = len(x["id"])
        prefix = x["k1"] >> 16
        for lag in range(1, NEIGHBOURS + 1):
            j = np.arange(max(new, lag), n)
            i = j - lag
            ok = (x["o"][i] == x["o"][j]) & (prefix[i] == prefix[j])
            i, j = i[ok], j[ok]
            found.append((i, j))
        for parts in ((prefix,), (x["k1"],), (x["k1"], x["k2"] >> 32), (x["k1"], x["k2"])):  # the leader of the region at growing depths
            same = np.ones(n, bool)
            same[:1] = False
            same[1:] = x["o"][1:] == x["o"][:-1]
            for p in parts:
                same[1:] &= p[1:] == p[:-1]
            leader = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            j = np.arange(new, n)
            j = j[j - leader[j] > NEIGHBOURS]
            found.append((leader[j], j))
        i, j = (np.concatenate(c) for c in zip(*found))
        ok = near(x, i, j)
        a, b = x["id"][i[ok]], x["id"][j[ok]]
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
        return np.unique(both, axis=0) if len(both) else both

    def stubs(x: dict, at: slice) -> pa.RecordBatch:
        m = len(x["id"][at])
        none = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.ones(m, bool)), *(pa.array(x[c][at]) for c in names)], ["a", "b", "stub", *names])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            if not len(batch):
                continue
            got = {c: batch.column(c).to_numpy() for c in names}
            if x is None:
                keep, x = 0, got
                yield stubs(x, slice(0, NEIGHBOURS))
            else:
                # the rows just before, and before them the leaders of the regions that may go on
                keep = len(x["id"])
                x = {c: np.concatenate([x[c], got[c]]) for c in names}
            both = pairs(x, keep)
            m = len(both)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.zeros(m, bool)), pa.nulls(m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in range(5))], ["a", "b", "stub", *names])
            n = len(x["id"])
            last = {n - k for k in range(1, NEIGHBOURS + 1) if n >= k}
            for shift in (x["k1"] >> 16, x["k1"]):
                run_on = (x["o"] == x["o"][-1]) & (shift == shift[-1])
                last.add(int(np.argmax(run_on)))
            run_on = (x["o"] == x["o"][-1]) & (x["k1"] == x["k1"][-1])
            for shift in (x["k2"] >> 32, x["k2"]):
                last.add(int(np.argmax(run_on & (shift == shift[-1]))))
            x = {c: x[c][sorted(last)] for c in names}
        if x is not None:
            yield stubs(x, slice(-NEIGHBOURS, None))

    return run


def _stub_pairs(rows: DataFrame, threshold: float, far: int) -> DataFrame:
    """Candidates across the borders of ranges: a few rows of each range, sorted again."""
    w = Window.orderBy("o", "k1", "k2", "id")
    stubs = rows.where("stub").select("o", "k1", "k2", "id", "n", "bits").distinct()
    me = F.struct("o", "k1", "id", "n", "bits")
    out = stubs.select(me.alias("me"), F.array(*(F.lag(me, k).over(w) for k in range(1, NEIGHBOURS + 1))).alias("before")).select("me", F.explode("before").alias("it"))
    ok = (F.col("me.o") == F.col("it.o")) & (F.shiftright("me.k1", 16) == F.shiftright("it.k1", 16)) & (F.col("me.id") != F.col("it.id"))
    ok &= F.least("me.n", "it.n") >= F.lit(threshold) * F.greatest("me.n", "it.n") - 1e-9
    ok &= F.bit_count(F.col("me.bits").bitwiseXOR(F.col("it.bits"))) <= far
    return out.where(ok).select(F.least("me.id", "it.id").alias("a"), F.greatest("me.id", "it.id").alias("b"))


def _sets(ngram: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_view(batch.column(1))
            for i, j in chunks(off):
                sets, at = shingle_sets(words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], lower=True), ngram)
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * 8).tobytes()), pa.py_buffer(sets.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed], ["id", "s"])

    return run


def _confirmed(numerator: int, denominator: int):
    """Pairs with denominator * |intersection| >= numerator * |union|."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(denominator * both >= numerator * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _linked(numerator: int, denominator: int):
    """Links between two blocks of a region, or within one: a spanning forest of all that there are."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in group.column("s").chunk(0)]
        size = np.array([len(x) for x in sets])
        names, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), size)
        # shingles of one row are in no intersection
        row, column = row[often[column] > 1], (np.cumsum(often > 1) - 1)[column[often[column] > 1]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        both = np.zeros((len(left), len(right)), np.float32)
        width = 2048
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (start, start + width))
            has = np.zeros((len(ids), width), np.float32)
            has[row[a:b], column[a:b] - start] = 1
            both += has[left] @ has[right].T
        both = both.astype(np.int64)
        ok = denominator * both >= numerator * (size[left][:, None] + size[right][None, :] - both)
        near = np.zeros((len(ids), len(ids)), bool)
        near[np.ix_(left, right)] = ok
        near |= near.T
        new = np.ones(len(ids), bool)
        found = []
        for k in range(len(ids)):
            queue = [k] if new[k] else []
            new[k] = False
            for x in queue:
                more = np.flatnonzero(near[x] & new)
                new[more] = False
                queue.extend(more)
                found.append(np.stack([np.full(len(more), ids[x]), ids[more]], 1))
        pairs = np.sort(np.concatenate(found), axis=1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _regions(rows: DataFrame, depth: int) -> DataFrame:
    """The rows in regions of equal first `depth` key values that neighbours do not reach all of and that hold several components;
    blocks: how many blocks the region's rows fill."""
    p1 = F.shiftright("k1", 16 * (4 - min(depth, 4))).alias("p1")
    p2 = F.shiftright("k2", 16 * (8 - depth)) if depth > 4 else F.lit(0).cast("long")
    keyed = rows.select("o", "k1", "k2", "id", "n", "component", p1, p2.alias("p2"))
    regions = keyed.groupBy("o", "p1", "p2").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("component").alias("least"), F.max("component").alias("most"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    regions = regions.where((F.col("rows") > NEIGHBOURS + 1) & (F.col("least") < F.col("most"))).select("o", "p1", "p2", blocks.alias("blocks"))
    return written(keyed.join(regions.hint("merge"), ["o", "p1", "p2"]).withColumn("depth", F.lit(depth)), "regions")


def _region_links(texts: DataFrame, members: DataFrame, ngram: int, numerator: int, denominator: int) -> DataFrame:
    """Links among the rows of each region, all against all on full sets, in pairs of blocks."""
    wanted = members.select("id").distinct()
    sets = written(texts.where("text IS NOT NULL").join(wanted.hint("merge"), "id").mapInArrow(_sets(ngram), "id long, s binary").distinct(), "sets")
    region = ["o", "depth", "p1", "p2"]
    m = members.select(*region, "id", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select(*region, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block")
    out = m.join(sets.hint("merge"), "id").groupBy(*region, "i", "j").applyInArrow(_linked(numerator, denominator), "a long, b long")
    out = written(out.where("a <> b").distinct(), "links")
    dropped(sets)
    released(texts.sparkSession)
    return out


def _crowded(texts: DataFrame, classes: DataFrame, found: DataFrame, ngram: int, numerator: int, denominator: int) -> DataFrame:
    """Components with the links in the regions of more rows than neighbours reach, where found leaves several components."""

    def keyed(now: DataFrame) -> DataFrame:
        c = classes.join(now, F.col("id") == F.col("node"), "left").select("id", "n_shingles", "keys", F.coalesce("component", "id").alias("bits"))
        return c.mapInArrow(_orders, "o int, k1 long, k2 long, id long, n long, bits long").withColumnRenamed("bits", "component")

    def merged(now: DataFrame, links: DataFrame) -> DataFrame:
        return connected_components(now.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))

    tables = [_regions(keyed(found), LEAST_PREFIX)]
    if tables[0].isEmpty():
        return found
    leaves, large = tables[0].where("blocks = 1"), tables[0].where("blocks > 1")
    crowded = not large.isEmpty()
    for depth in range(LEAST_PREFIX + 1, KEY + 1):
        if large.isEmpty():
            break
        tables.append(_regions(large, depth))
        leaves, large = leaves.unionByName(tables[-1].where("blocks = 1")), tables[-1].where("blocks > 1")
    found = merged(found, _region_links(texts, leaves, ngram, numerator, denominator))
    if crowded:
        rest = _regions(keyed(found), LEAST_PREFIX)
        found = merged(found, _region_links(texts, rest, ngram, numerator, denominator))
        dropped(rest)
    dropped(*tables)
    return found


def minhash_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, numerator: int = 80, denominator: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, links, classes): sketches of all documents, confirmed links of neighbours between classes of equal sets.

    sketches(id, n_shingles, d1, d2): documents with equal (d1, d2, n_shingles) have equal sets.
    links(a, b): a < b are the smallest ids of two classes whose sets have denominator * |intersection|
    >= numerator * |union|. Chains and stars are linked; pairs within a class are not spelt out.
    Regions of more rows than neighbours reach are left to _crowded.
    """
    spark = docs.sparkSession
    threshold = numerator / denominator
    off = VALUES * (1 - threshold) / 2  # sketch bits that differ at the threshold: mean, and 6 deviations more
    far = math.ceil(off + 6 * math.sqrt(off * (1 + threshold) / 2))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(texts.mapInArrow(_sketches(ngram), _SKETCH), "sketches")
    classes = written(
        sketches.where("n_shingles > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits")),
        "classes",
    )
    keyed = classes.select("id", "n_shingles", "keys", "bits").mapInArrow(_orders, "o int, k1 long, k2 long, id long, n long, bits long")
    sort = ["o", "k1", "k2", "id"]
    rows = written(keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_neighbours(threshold, far), _ROWS), "candidates")
    pairs = written(rows.where("NOT stub").select("a", "b").unionByName(_stub_pairs(rows, threshold, far)).distinct(), "pairs")
    dropped(rows)
    released(spark)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # the ids grow with the corpus: one plan at every size, not a broadcast while they happen to be few
    sets = texts.where("text IS NOT NULL").join(wanted.hint("merge"), "id").mapInArrow(_sets(ngram), "id long, s binary")
    sets = written(sets, "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    links = written(both.mapInArrow(_confirmed(numerator, denominator), "a long, b long").distinct(), "links")
    dropped(sets, pairs)
    released(spark)
    return sketches, links, classes


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; the whole texts count.

    A-Z are lower-cased; words are runs without ASCII white space; the set is the distinct shingles of
    ngram words, or the whole sequence where there are fewer words. Null, empty and blank texts have an
    empty set and are linked with nothing. Equal texts, repeated rows included, share a component. A row
    with a null id is linked with nothing: it has a null component and is kept. Rows of one id are one document, linked by any
    of its texts. Sets are equal if 128 bits of BLAKE2b over their 64-bit shingle hashes are. Other columns of docs are
    not read, so their names can't clash. An empty table gives an empty result.
    """
    sketches, links, classes = minhash_links(docs, id_col, text_col, ngram, numerator, denominator)
    found = connected_components(links)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _crowded(texts, classes, found, ngram, numerator, denominator)
    of_class = classes.select("d1", "d2", "n_shingles", "id").join(found, F.col("id") == F.col("node"), "left")
    of_class = of_class.select("d1", "d2", F.col("n_shingles").alias("size"), F.coalesce("component", "id").alias("component"))
    me = sketches.select("id", "n_shingles", "d1", "d2")
    joined = me.join(of_class, (me.d1 == of_class.d1) & (me.d2 == of_class.d2) & (me.n_shingles == of_class["size"]) & me.id.isNotNull(), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
