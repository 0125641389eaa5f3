"""An inverted index in a folder: blocks of postings with bounds, changes as further segments, top-k that skips blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import bind
from ..sources.work import hadoop, removed, settled
from .bm25 import COVERAGE, DELTA, FIELD_BOOST, K1, B, _count, term_score

#: Documents of a block are 2 ** BLOCK_BITS, fewer if they have more postings than BLOCK_HITS; blocks whose scores set the threshold at first.
BLOCK_BITS, BLOCK_HITS, FIRST_BLOCKS = 9, 1 << 19, 4
_SCHEMAS = {
    "docs": "id {id}, length int, terms array<struct<term:string,tf:int,extra:int>>",
    "postings": "term string, block long, hits array<struct<id:{id},tf:int,extra:int,length:int>>, most_tf int, most int, least_length int, least_content int, content long, every long, bucket int",
    "terms": "term string, content long, every long, bucket int",
    "totals": "n long, length long",
    "dead": "id {id}, of int",
}


def _inverted(docs: pa.Table, block: int) -> pa.RecordBatch:
    """A row for each term of a block's documents: its postings with their bounds and counts."""
    lists = docs.column("terms").combine_chunks()
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
    there = flat.field("term").is_valid().to_numpy(zero_copy_only=False)
    flat, row = flat.filter(pa.array(there)), row[there]
    terms = flat.field("term").dictionary_encode()
    codes = terms.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    every = np.bincount(codes, minlength=len(terms.dictionary))
    ends = np.concatenate([[0], np.cumsum(every)])
    starts, row = ends[:-1], row[order]
    tf, extra, length = (np.asarray(x)[i] for x, i in ((flat.field("tf"), order), (flat.field("extra"), order), (docs.column("length"), row)))
    of = lambda f, x: f.reduceat(x, starts) if len(starts) else x[:0]
    none = np.iinfo(np.int32).max
    content = of(np.minimum, np.where(tf > 0, length, none))
    hits = pa.StructArray.from_arrays([docs.column("id").combine_chunks().take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (tf, extra, length))], ["id", "tf", "extra", "length"])
    columns = {
        "term": terms.dictionary, "block": pa.array(np.full(len(starts), block), pa.int64()), "hits": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits),
        "most_tf": pa.array(of(np.maximum, tf), pa.int32()), "most": pa.array(of(np.maximum, tf + extra), pa.int32()), "least_length": pa.array(of(np.minimum, length), pa.int32()),
        "least_content": pa.array(content, pa.int32(), mask=content == none), "content": pa.array(of(np.add, (tf > 0).astype(np.int64)), pa.int64()), "every": pa.array(every, pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _in_blocks(bits: int, most_hits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_inverted() of a task's documents, as many at a time as a block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows, hits = TaskContext.get().partitionId() << (33 - bits), [], 0, 0
        for batch in batches:
            sums, at = np.cumsum(pc.fill_null(batch.column("terms").value_lengths(), 0).to_numpy()), 0
            while at < len(sums):
                before = sums[at - 1] if at else 0
                n = min((1 << bits) - rows, int(np.searchsorted(sums[at:], before + most_hits - hits, "right")))
                n = max(n, 0 if rows else 1)
                if n:
                    held.append(batch.slice(at, n))
                    at, rows, hits = at + n, rows + n, hits + int(sums[at + n - 1] - before)
                if at < len(sums) or rows == 1 << bits:
                    yield _inverted(pa.Table.from_batches(held), block)
                    block, held, rows, hits = block + 1, [], 0, 0
        if held:
            yield _inverted(pa.Table.from_batches(held), block)

    return run


class TextIndex:
    """BM25+ over documents that come, change and go.

    A change is a segment: its documents with their terms; for each term and block of documents the postings, with the greatest
    frequency and the least length among them; what it adds to each term's document frequency and to the number and length of
    documents; and the (segment, id) of earlier rows that it replaces or deletes, whose terms it takes off again. So the statistics
    are sums over segments of what a query's buckets hold, and equal those of a scan. A segment counts once its mark is there. One
    writer at a time.

    A search for the k best bounds each block by its greatest frequencies and least lengths, scores the blocks of the highest bounds, and
    reads of the rest only those whose bound reaches the k-th score found. skipped has (blocks with a term, blocks read) of the last one.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, id_type: str = "long"):
        self.spark, self.folder, self.buckets, self.id_type, self.skipped = spark, folder.rstrip("/"), buckets, id_type, None

    def _segments(self) -> list[int]:
        fs, p = hadoop(self.spark, self.folder)
        done = p(f"{self.folder}/done")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(done)) if fs.exists(done) else []

    def _table(self, name: str) -> DataFrame | None:
        """A table of all segments that count, with their numbers."""
        schema = _SCHEMAS[name].format(id=self.id_type)
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{s}/{name}").withColumn("seg", F.lit(s)) for s in self._segments()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _frequencies(self, docs: DataFrame, sign: int) -> DataFrame:
        term = docs.select(F.explode("terms").alias("t")).select("t.*")
        return term.groupBy("term").agg((sign * F.count_if(F.col("tf") > 0)).alias("content"), (sign * F.count("*")).alias("every"))

    def _put(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Write a segment of docs(id, length, terms) that takes gone(id), by default the ids of docs, away from earlier ones."""
        number, before = max(self._segments(), default=0) + 1, self._table("docs")
        path = f"{self.folder}/{number}"
        docs.select("id", "length", "terms").write.mode("overwrite").parquet(f"{path}/docs")
        own = self.spark.read.schema(_SCHEMAS["docs"].format(id=self.id_type)).parquet(f"{path}/docs")
        if before is None:
            old = own.select("id", "length", F.lit(0).alias("seg")).limit(0)
        else:  # which rows go is settled by their ids, before their terms are read
            old = before.select("id", "length", "seg").join(self._table("dead").select(F.col("of").alias("seg"), "id"), ["seg", "id"], "left_anti")
            old = old.join((own if gone is None else gone).select("id").distinct(), "id", "left_semi").select("id", "length", "seg")
        old = settled(old, "replaced")
        # a block's documents are in one task, so its postings are made there and nothing is shuffled
        schema = ", ".join(c for c in _SCHEMAS["postings"].format(id=self.id_type).split(", ") if c != "bucket int")
        blocks = own.mapInArrow(_in_blocks(BLOCK_BITS, BLOCK_HITS), schema).withColumn("bucket", self._bucket(F.col("term")))
        blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        put = self.spark.read.schema(_SCHEMAS["postings"].format(id=self.id_type)).parquet(f"{path}/postings").select("term", "content", "every")
        if before is not None:
            put = put.unionByName(self._frequencies(before.join(old, ["seg", "id"], "left_semi"), -1))
        df = put.groupBy("term").agg(F.sum("content").alias("content"), F.sum("every").alias("every"))
        df.withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        size = lambda d, s: d.agg((s * F.count("*")).alias("n"), (s * F.coalesce(F.sum("length"), F.lit(0))).alias("length"))
        size(own, 1).unionByName(size(old, -1)).write.mode("overwrite").parquet(f"{path}/totals")
        old.select("id", F.col("seg").alias("of")).write.mode("overwrite").parquet(f"{path}/dead")
        removed(old)
        fs, p = hadoop(self.spark, self.folder)
        fs.create(p(f"{self.folder}/done/{number}"), True).close()

    def upsert(self, docs: DataFrame, id_col: str, tokens: Column, title: Column | None = None, tags: Column | None = None) -> "TextIndex":
        """Add documents, in place of those of the same ids. Ids must be distinct here. Title and tag tokens count FIELD_BOOST times and add no length."""
        boost = F.array().cast("array<string>")
        for x in (title, tags):
            if x is not None:
                boost = F.concat(boost, F.coalesce(x, F.array().cast("array<string>")))

        boosted = title is not None or tags is not None

        def measured(t: Column, more: Column) -> Column:
            entry = lambda w: F.struct(w.alias("term"), _count(t, w).cast("int").alias("tf"), (FIELD_BOOST * _count(more, w)).cast("int").alias("extra"))
            return F.struct(F.size(t).alias("length"), F.transform(F.array_union(t, more), entry).alias("terms"))

        def listed(t: Column, more: Column) -> Column:  # distinct tokens, the usual case: only the boosted ones need counting
            extra = lambda w: (FIELD_BOOST * _count(more, w)).cast("int")
            own = F.transform(t, lambda w: F.struct(w.alias("term"), F.lit(1).alias("tf"), (F.when(F.array_contains(more, w), extra(w)).otherwise(0) if boosted else F.lit(0)).alias("extra")))
            rest = F.transform(F.array_except(more, t), lambda w: F.struct(w.alias("term"), F.lit(0).alias("tf"), extra(w).alias("extra")))
            return F.struct(F.size(t).alias("length"), (F.concat(own, rest) if boosted else own).alias("terms"))

        # bound, or each use would make the tokens again
        made = bind(F.struct(tokens.alias("t"), boost.alias("b")), lambda x: F.when(F.size(F.array_distinct(x["t"])) == F.size(x["t"]), listed(x["t"], x["b"])).otherwise(measured(x["t"], x["b"])))
        rows = docs.select(F.col(id_col).alias("id"), made.alias("m"))
        self._put(rows.select("id", "m.length", "m.terms"))
        return self

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        docs = self._table("docs")
        if docs is not None:
            self._put(docs.select("id", "length", "terms").limit(0), ids.select(F.col(id_col).alias("id")))

    def search(self, query: list[str], k: int | None = None, boosted: bool = False, k1: float = K1, b: float = B, coverage: bool = True, digits: int | None = None) -> DataFrame:
        """(id, bm25_score, matched) of the k best documents, or of all with a term of the query. boosted: title and tags count.

        digits: scores are rounded to so many before they are ranked, by way of 9, as sums in another order differ beyond those; equal ones go by id.
        """
        ask, postings = sorted(set(query)), self._table("postings")
        if postings is None or not ask:
            return self.spark.createDataFrame([], f"id {self.id_type}, bm25_score double, matched int")
        wanted = [r[0] for r in self.spark.createDataFrame([(q,) for q in ask], "term string").select(self._bucket(F.col("term"))).distinct().collect()]
        hers = lambda t: t.where(F.col("bucket").isin(wanted) & F.col("term").isin(ask))
        n, length = self._table("totals").agg(F.sum("n"), F.sum("length")).first()
        df = {r.term: r.df for r in hers(self._table("terms")).groupBy("term").agg(F.sum("every" if boosted else "content").alias("df")).collect()}
        average = float(length or 0) / (n or 1) or 1.0
        weights = F.create_map(*(F.lit(x) for q in ask for x in (q, max(0.0, math.log((n - df.get(q, 0) + 0.5) / (df.get(q, 0) + 0.5))) + DELTA)))
        weight, more = F.element_at(weights, F.col("term")), lambda c: 1 + COVERAGE * c / len(ask) if coverage else F.lit(1.0)
        rows, dead = hers(postings), self._table("dead").select(F.col("of").alias("seg"), "id")

        def scored(some: DataFrame) -> DataFrame:
            hit = some.select("seg", "term", F.inline("hits")).join(dead, ["seg", "id"], "left_anti")
            hit = hit if boosted else hit.where("tf > 0")
            tf = (F.col("tf") + F.col("extra") if boosted else F.col("tf")).cast("double")
            out = hit.groupBy("id").agg(F.sum(term_score(tf, weight, F.col("length"), F.lit(average), k1, b)).alias("s"), F.count("*").cast("int").alias("matched"))
            score = F.col("s") * more(F.col("matched"))
            return out.select("id", (score if digits is None else F.round(F.round(score, 9), digits)).alias("bm25_score"), "matched")

        if k is None:
            return scored(rows)
        most = F.col("most" if boosted else "most_tf").cast("double")
        bound = term_score(most, weight, F.col("least_length" if boosted else "least_content"), F.lit(average), k1, b)
        blocks = rows.where(most > 0).groupBy("seg", "block").agg((F.sum(bound) * more(F.count("*"))).alias("bound"))
        blocks = settled(blocks, "blocks")
        first = blocks.orderBy(F.col("bound").desc(), "seg", "block").limit(FIRST_BLOCKS).select("seg", "block")
        best = scored(rows.join(F.broadcast(first), ["seg", "block"], "left_semi")).orderBy(F.col("bm25_score").desc()).limit(k).agg(F.min("bm25_score"), F.count("*")).first()
        up = 0.0 if digits is None else 10.0**-digits  # rounding lifts a score by less
        least = best[0] - up - 1e-9 * (1 + abs(best[0])) if best[1] == k else -1.0
        read = blocks.where(F.col("bound") >= least)
        self.skipped = (blocks.count(), read.count())
        return scored(rows.join(read.select("seg", "block"), ["seg", "block"], "left_semi")).orderBy(F.col("bm25_score").desc(), F.col("id").asc_nulls_last()).limit(k)
