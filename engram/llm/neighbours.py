"""Nearest neighbours by inner product through an inverted multi-index: two codebooks, one for each half of a vector."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._base import dropped, tidy, written
from ._text import spread

#: Distinct vectors that the codebooks are fitted on, and their bytes, at most.
FIT_ROWS, FIT_BYTES = 16_384, 32 << 20
#: Centroids of a half at most: a cell is a pair of them.
CENTROIDS = 256
#: Entries that the heap gathers for a query before the second search bounds the rest.
FIRST_ENTRIES = 512
#: Standard deviations of a residual's inner product below the k-th best found, down to which cells are read.
MARGIN = 3.5
#: Entries of a shard, and queries that meet one together, about.
SHARD_ROWS, QUERY_ROWS = 4096, 32_768
#: Scores held at once by a task.
BLOCK_SCORES = 4 << 20


def fitted(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's rounds from evenly picked rows; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        of = nearest_code(x, c)
        total, n = np.zeros_like(c), np.bincount(of, minlength=k)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest_code(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) / 2 - x @ c.T).argmin(1)


@dataclass
class MultiIndex:
    """Codebooks of both halves, residual variance of each dimension, and the entries of each cell."""

    left: np.ndarray
    right: np.ndarray
    spread: np.ndarray
    cells: np.ndarray | None = None  # entries of (left code, right code)

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_code(x[:, : self.half], self.left), nearest_code(x[:, self.half :], self.right)

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of queries with both codebooks: a cell's score is the sum of its two."""
        return q[:, : self.half] @ self.left.T, q[:, self.half :] @ self.right.T

    def reach(self, a: np.ndarray, b: np.ndarray, entries: int) -> float:
        """Score of the cell at which the entries of the best cells are as many as asked for, or -inf if all are fewer.

        Pairs of centroids leave a heap by falling summed score: both halves are sorted, and a pair brings in the next one of each half.
        """
        by_a, by_b = np.argsort(-a), np.argsort(-b)
        a, b, held = a[by_a], b[by_b], self.cells[np.ix_(by_a, by_b)]
        heap, seen = [(-(a[0] + b[0]), 0, 0)], 0
        while heap:
            score, i, j = heapq.heappop(heap)
            seen += held[i, j]
            if seen >= entries:
                return -score
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        return -np.inf


def fit(sample: np.ndarray, centroids: int = CENTROIDS) -> MultiIndex:
    """An index without entries, from a sample of vectors."""
    x = sample.astype(np.float64)
    half = max(1, x.shape[1] // 2)
    k = int(max(1, min(centroids, 2 * np.sqrt(len(x)))))
    index = MultiIndex(fitted(x[:, :half], k), fitted(x[:, half:], k), np.zeros(x.shape[1]))
    a, b = index.codes(x)
    index.spread = ((x - np.concatenate([index.left[a], index.right[b]], 1)) ** 2).mean(0)
    return index


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a finite vector other than zero, without null components and of the commonest length."""
    kind = "float" if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    wide = lambda x: x.cast("double")
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == float("inf")))
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd & F.exists(vector_col, lambda x: wide(x) != 0)
    v = F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
    rows = rows.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return rows.where(F.size("v") == (length.d if length else 0))


def _shards(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each left code: small codes share one, a large one has several."""
    first, parts, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for code, n in enumerate(counts):
        if held and held + n > SHARD_ROWS:
            at, held = at + 1, 0
        first[code], held = at, held + int(n)
        if n > SHARD_ROWS:
            parts[code] = -(-int(n) // SHARD_ROWS)
            at, held = at + int(parts[code]), 0
    return first, parts


def _searched(entries: DataFrame, asked: DataFrame, index: Broadcast, blocks: int, dims: int, k: int) -> DataFrame:
    """(q, e, score): for each query and shard the k best entries of the cells whose score is at least the query's bound, of those that reach its floor.

    A task has one shard's entries and the queries that come to it one batch after another.
    """
    kind = entries.schema["v"].dataType.simpleString()
    first, parts = _shards(index.value.cells.sum(1))
    lits = lambda x: F.array(*map(F.lit, x.tolist()))
    shard = F.get(lits(first), F.col("a")) + F.pmod(F.xxhash64("id"), F.get(lits(parts), F.col("a")))
    entries = entries.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), "id", "v", "a", "b", F.lit(0.0).alias("least"), F.lit(0.0).alias("floor"))

    def sent(batches):
        for batch in batches:
            least = batch.column("least").to_numpy()
            a, b = index.value.scores(_matrix(batch.column("v"), dims))
            row, code = np.nonzero(a + b.max(1)[:, None] >= least[:, None])
            row, code = np.repeat(row, parts[code]), np.repeat(first[code], parts[code]) + spread(parts[code])
            pair = np.unique(np.stack([row, code]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            for i in range(0, pair.shape[1], 1 << 14):
                row, to = pair[:, i : i + (1 << 14)]
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), *(some.column(c) for c in ("q", "v", "least", "floor"))], ["shard", "q", "v", "least", "floor"])

    queries = asked.mapInArrow(tidy(sent), f"shard long, q long, v {kind}, least double, floor double")
    queries = queries.select("shard", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), F.col("q").alias("id"), "v", F.lit(0).alias("a"), F.lit(0).alias("b"), "least", "floor")

    def searched(batches):
        key, gathered, held = None, [], None
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy() for c in ("shard", "block", "side")])
            cuts = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                if (part[0, i], part[1, i]) != key:
                    key, gathered, held = (part[0, i], part[1, i]), [], None
                some = batch.slice(i, j - i)
                if part[2, i] == 0:
                    gathered.append(some)
                elif gathered:
                    held = held or [np.concatenate(x) for x in zip(*((_matrix(g.column("v"), dims), g.column("id").to_numpy(), g.column("a").to_numpy(), g.column("b").to_numpy()) for g in gathered))]
                    yield from _best(index.value, *held, some.column("id").to_numpy(), _matrix(some.column("v"), dims), some.column("least").to_numpy(), some.column("floor").to_numpy(), k)

    n = min(20_000, blocks * int((first + parts).max()))
    rows = entries.unionByName(queries).repartition(n, "shard", "block").sortWithinPartitions("shard", "block", "side")
    return rows.mapInArrow(tidy(searched), "q long, e long, score double")


def _best(index: MultiIndex, x: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, floors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of the entries x in cells within each query's bound, of no less than its floor; scores are summed in order of dimension."""
    step = max(1, BLOCK_SCORES // len(x))
    for i in range(0, len(q), step):
        some = q[i : i + step]
        of_a, of_b = index.scores(some)
        near = of_a[:, a] + of_b[:, b] >= least[i : i + step, None]
        read = np.flatnonzero(near.any(0))
        if not len(read):
            continue
        score = np.where(near[:, read], some @ x[read].T, -np.inf)
        floor = np.partition(score, len(read) - k, axis=1)[:, len(read) - k] if len(read) > k else np.full(len(some), -np.inf)
        floor = np.maximum(floor, floors[i : i + step])
        row, col = np.nonzero((score >= (floor - 1e-12 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]) & (score > -np.inf))
        exact = np.zeros(len(row))
        for d in range(x.shape[1]):
            exact += some[row, d] * x[read[col], d]
        order = np.lexsort((ids[read[col]], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        mine = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i + row[mine]]), pa.array(ids[read[col[mine]]]), pa.array(exact[mine])], ["q", "e", "score"])


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, margin: float = MARGIN, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each row whose id is divisible by every.

    Each half of a vector is quantised by its own codebook, fitted on at most FIT_ROWS distinct vectors; every row is indexed in the
    cell of its two codes. Equal vectors are one entry. A query's pairs of centroids are traversed by summed score
    with a heap until FIRST_ENTRIES entries are gathered; these are reranked by their vectors, which gives a k-th best score. An
    entry that beats it from a cell of lower score must make up the difference by its residual, whose inner
    product with the query has a known spread: the second search reads every cell down to margin such deviations below the
    k-th best. So the share that is read follows the data: few cells where vectors cluster, a large share where they
    are like noise and no index can do better. No cell, shard or list of candidates is cut; margin = inf is exact.

    Shards are runs of the first half's codes of about SHARD_ROWS entries (a larger code is split by hash); a query goes to those that
    may hold cells within its bound, and brings at most k + 1 rows back from each, in the second search only such as reach the k-th best.

    Null ids, null vectors, and those that are zero or hold null or non-finite components take no part, nor do vectors of another
    length than the commonest. A query never finds its own id; if ids repeat, a vector is found under each of its ids once, and
    an id asks with each of its vectors, the best score of an id counting. Ties go to the smaller id; with fewer candidates, all
    are returned. An empty table gives an empty result. Other columns aren't read.
    """
    spark = rows.sparkSession
    valid = written(_valid(rows, id_col, vector_col).distinct(), "vectors")
    # of equal vectors only the first k + 1 ids can be among any query's k nearest
    members = written(valid.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1), "members")
    entries = members.where("r = 1").select("id", "v")
    head = entries.select(F.size("v").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = head.d
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(max(1, min(FIT_ROWS, FIT_BYTES // (8 * dims)))).select("v").toArrow()["v"].combine_chunks()
    index = fit(_matrix(sample, dims), centroids)
    codebooks = spark.sparkContext.broadcast(index)

    def coded(batches):
        for batch in batches:
            a, b = codebooks.value.codes(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["id", "v", "a", "b"])

    kind = entries.schema["v"].dataType.simpleString()
    entries = written(entries.mapInArrow(tidy(coded), f"id long, v {kind}, a int, b int"), "entries")
    cells = np.zeros((len(index.left), len(index.right)), np.int64)
    for r in entries.groupBy("a", "b").agg(F.count("*").alias("n")).toLocalIterator():  # a row a cell: centroids squared at most
        cells[r.a, r.b] = r.n
    index = spark.sparkContext.broadcast(replace(index, cells=cells))

    def starting(batches):
        for batch in batches:
            a, b = index.value.scores(_matrix(batch.column("v"), dims))
            least = np.array([index.value.reach(x, y, FIRST_ENTRIES) for x, y in zip(a, b)])
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))], ["q", "v", "least"])

    asking = valid.where(F.pmod("id", F.lit(every)) == 0)
    asked = asking.groupBy("v").agg(F.min("id").alias("q")).select("q", "v").repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "q")
    asked = written(asked.mapInArrow(tidy(starting), f"q long, v {kind}, least double"), "asked")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "e")
    found = _searched(entries, asked.withColumn("floor", F.lit(float("-inf"))), index, blocks, dims, k + 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    kth = found.groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    apart = F.aggregate(F.zip_with("v", F.array(*(F.lit(float(s)) for s in index.value.spread)), lambda x, s: x.cast("double") * x * s), F.lit(0.0), lambda s, x: s + x)
    below = F.col("kth") - F.lit(float(margin)) * F.sqrt(apart) if np.isfinite(margin) else F.lit(float("-inf"))
    bound = F.when(F.col("n") > k, F.least("least", below)).otherwise(F.lit(float("-inf")))
    floor = F.when(F.col("n") > k, F.col("kth")).otherwise(F.lit(float("-inf")))
    again = written(asked.join(kth, "q").select("q", "v", bound.alias("least"), floor.alias("floor")), "bounds")
    found = _searched(entries, again, index, blocks, dims, k + 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = written(found.drop("r"), "found")
    dropped(entries, again)

    # from classes of equal vectors back to rows
    ids = members.join(members.where("r = 1").select(F.col("id").alias("e"), "v"), "v").select("e", "id")
    lists = found.join(ids, "e").groupBy("q", "id").agg(F.max("score").alias("score"))
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= k + 1)
    by = asking.join(asked.select("q", "v"), "v").select("q", F.col("id").alias("query_id"))
    out = by.join(lists, "q").where(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
