"""Vector metrics over array columns, in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors must have the same length")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; an error where lengths differ."""
    size = norm(a) * norm(b)
    return _same_length(a, b, F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def angular_distance(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Places above the threshold in both over those in either; 1 where there are none."""
    both = _sum(F.zip_with(a, b, lambda x, y: F.when((x > threshold) & (y > threshold), 1.0).otherwise(0.0)))
    either = _sum(F.zip_with(a, b, lambda x, y: F.when((x > threshold) | (y > threshold), 1.0).otherwise(0.0)))
    return _same_length(a, b, F.when(either == 0, 1.0).otherwise(both / either))


def hamming(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return _same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: F.when(F.abs(x.cast("double") - y.cast("double")) > tolerance, 1.0).otherwise(0.0))))


def hamming_normalized(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(hamming(a, b, tolerance) / F.size(a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(n, F.size(a)).alias("n")), lambda p: p["x"].cast("double") / p["n"]))


def is_valid(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def is_binary(a: Column) -> Column:
    return F.forall(a, lambda x: (x == 0) | (x == 1))


def is_quantized(a: Column) -> Column:
    return F.forall(a, lambda x: x == F.floor(x))


def profile(a: Column) -> Column:
    return F.struct(F.size(a).alias("dims"), F.array_min(a).alias("least"), F.array_max(a).alias("most"), is_binary(a).alias("is_binary"), is_quantized(a).alias("is_quantized"))


METRICS = {"cosine": cosine, "jaccard": jaccard, "hamming": lambda a, b: F.greatest(F.lit(0.0), 1 - hamming_normalized(a, b))}


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """The k rows most similar to one query vector: a scan and a top-k, without a shuffle of the vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.withColumn("score", METRICS[metric](F.col(vector_col), q))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


#: Vectors of one shard of rows and of one block of queries, and scores that a task holds at once.
SHARD_ROWS, QUERY_ROWS, BLOCK_VALUES = 1 << 15, 1 << 13, 1 << 20


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles; none is a matrix without rows."""
    flat = pc.list_flatten(vectors)
    values = flat.to_numpy().astype(np.float64, copy=False)
    sizes = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(sizes) > 1:
        raise ValueError("vectors must have the same length")
    return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines row by row, summed in the order of the components, so that equal vectors have equal ones."""
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        x += a[:, j] * a[:, j]
        y += b[:, j] * b[:, j]
    size = np.sqrt(x) * np.sqrt(y)
    return np.where(size == 0, 0.0, dot / np.where(size == 0, 1.0, size))


def _k_best(asked: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int):
    """(query row, id, score) of the k best of m for each row of asked: products in tiles, what may be among the best is scored again."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    # of equal vectors only the k first by id can be among the k best
    _, same = np.unique(m, axis=0, return_inverse=True)
    by = np.argsort(same.ravel(), kind="stable")
    start = np.flatnonzero(np.diff(same.ravel()[by], prepend=-1))
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    few = np.sort(by[place < k])
    ids, m, unit = ids[few], m[few], _unit(m[few]).T
    n = min(k, len(ids))
    step = max(1, BLOCK_VALUES // max(1, len(ids)))
    for at in range(0, len(asked), step):
        q = asked[at : at + step]
        near = _unit(q) @ unit
        least = np.partition(near, len(ids) - n, axis=1)[:, len(ids) - n] - 1e-9
        row, col = np.nonzero(near >= least[:, None])
        del near
        score = np.concatenate([_cosines(q[row[i : i + 65536]], m[col[i : i + 65536]]) for i in range(0, len(row), 65536)])
        best = np.lexsort((ids[col], -score, row))
        row, col, score = row[best], col[best], score[best]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        yield at + row[top], ids[col[top]], score[top]


def nearest_many(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_col: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank): the k rows most similar by cosine to each query vector.

    Rows are dealt to shards and queries to blocks; a task compares one shard with one block, in tiles of BLOCK_VALUES products, and keeps each
    query's k best of the shard; the best of all shards are found by query. So a task's memory does not grow with either table, and
    neither passes through the driver. Vectors of length zero have similarity 0; null ones take no part; ties go to the smaller id. Ids are longs.
    """
    r = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    a = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col).cast("long").alias("q"), F.col(vector_col).alias("v"))
    shards, blocks = (max(1, -(-t.count() // size)) for t, size in ((r, SHARD_ROWS), (a, QUERY_ROWS)))
    dealt = lambda t, key, own, n, other, copies: t.withColumns({own: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})
    r, a = dealt(r, "i", "s", shards, "b", blocks), dealt(a, "q", "b", blocks, "s", shards)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            names, ids = left.column("q").to_numpy(), right.column("i").to_numpy()
            asked, m = _matrix(left.column("v")), _matrix(right.column("v"))
            if asked.shape[1] != m.shape[1]:
                raise ValueError("vectors must have the same length")
            out += [(names[q], i, x) for q, i, x in _k_best(asked, ids, m, k)]
        q, i, x = (np.concatenate(c) for c in zip(*out))
        return pa.table({"q": pa.array(q), "i": pa.array(i), "score": pa.array(x)})

    out = a.groupBy("s", "b").cogroup(r.groupBy("s", "b")).applyInArrow(run, "q long, i long, score double")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "i")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_col), F.col("i").alias(id_col), "score", "rank")


#: Vectors of one block of a pairwise comparison.
BLOCK_ROWS = 2048


def pairwise(rows: DataFrame, per: str, id_col: str, vector_col: str) -> DataFrame:
    """(per, pairs, mean_similarity, max_similarity): cosines of all pairs within each group, in pairs of blocks of about BLOCK_ROWS rows.

    A large group is cut by a hash of the ids, so that no task has more than two blocks of it.
    """
    size = rows.groupBy(per).agg(F.count("*").alias("_n")).select(F.col(per).alias("_g"), F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"))
    r = rows.select(F.col(per).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(size, F.col("g").eqNullSafe(F.col("_g")))
    r = r.withColumn("b", F.pmod(F.xxhash64("id"), "_blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    r = r.select("g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "v")

    def run(t: pa.Table) -> pa.Table:
        block = t.column("b").to_numpy()
        m = np.array(t.column("v").to_pylist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        first, last = block == block.min(), block == t.column("j")[0].as_py()
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        if not one and (block.min() == block.max()):
            score = np.zeros(0)
        else:
            s = m[first] @ m[last].T
            score = s[np.triu_indices(len(s), 1)] if one else s.ravel()
        most = [float(score.max())] if len(score) else [None]
        return pa.table({"g": t.column("g").slice(0, 1), "n": pa.array([len(score)], pa.int64()), "s": pa.array([float(score.sum())]), "m": pa.array(most, pa.float64())})

    kind = dict(rows.dtypes)[per]
    out = r.groupBy("g", "i", "j").applyInArrow(run, f"g {kind}, n long, s double, m double").groupBy("g").agg(F.sum("n").alias("pairs"), F.sum("s").alias("s"), F.max("m").alias("max_similarity"))
    return out.where("pairs > 0").select(F.col("g").alias(per), "pairs", (F.col("s") / F.col("pairs")).alias("mean_similarity"), "max_similarity")
