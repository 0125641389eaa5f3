"""A chunk store on Parquet, one folder a collection."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import event_hash
from ..functions.vectors import is_valid
from ..operators.events import assert_unique, embed_text
from .readers import import_errors
from .work import hadoop


class ChunkStore:
    """Insert, delete, update, scan and look up chunks by (collection_id, hash).

    A change is a folder of the rows it touches, in buckets of their hashes. It counts once the log has an entry for it: a folder under
    the next number, moved there whole from a draft, which file systems do for one writer only; the other takes the next number. So
    a reader sees all of a change or nothing, a writer that dies leaves a draft that blocks nobody, and a task that is run
    again does no harm. After `deltas` changes the collection is written as one again; that entry names the number up to which it
    has all changes, and those that came in meanwhile, or while it was written, still come on top of it. An update has the columns that it sets and no
    others, so two updates of different columns both hold. A look-up reads one bucket, a scan the columns asked for.
    """

    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str, schema: str, deltas: int = 16):
        self.spark, self.path, self.schema, self.deltas = spark, path.rstrip("/"), schema, deltas

    def _fs(self):
        return hadoop(self.spark, self.path)

    def _entries(self, collection: str) -> list[dict]:
        """What is in the log, by number: {number, kind, folder, base}."""
        fs, p = self._fs()
        top = p(f"{self.path}/{collection}/log")
        out = []
        for s in fs.listStatus(top) if fs.exists(top) else []:
            for f in fs.listStatus(s.getPath()):
                if not f.isDirectory():  # the entry's one file; its name says it all
                    kind, base, folder = f.getPath().getName().split("~")
                    out.append({"number": int(s.getPath().getName()), "kind": kind, "base": int(base), "folder": folder})
        return sorted(out, key=lambda e: e["number"])

    def _log(self, collection: str) -> list[dict]:
        """The entries that count: the last whole table and the changes that it does not have."""
        entries = self._entries(collection)
        whole = max((e for e in entries if e["kind"] == "whole"), key=lambda e: (e["base"], e["number"]), default=None)
        changes = [e for e in entries if e["kind"] != "whole" and e["number"] > (whole["base"] if whole else 0)]
        return [whole, *changes] if whole else changes

    def _written(self, collection: str, kind: str, rows: DataFrame, base: int = 0) -> str:
        """Write rows that nobody reads yet; returns the name of their entry."""
        folder = uuid.uuid4().hex
        bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64("hash"), F.lit(self.BUCKETS)).cast("int"))
        bucketed.write.partitionBy("_bucket").parquet(f"{self.path}/{collection}/data/{folder}")
        return f"{kind}~{base}~{folder}"

    def _published(self, collection: str, entry: str) -> int:
        """Put an entry into the log under the next free number."""
        fs, p = self._fs()
        draft = p(f"{self.path}/{collection}/drafts/{uuid.uuid4().hex}")
        fs.create(p(draft, entry), False).close()
        fs.mkdirs(p(f"{self.path}/{collection}/log"))
        while True:
            number = max((e["number"] for e in self._entries(collection)), default=0) + 1
            to = p(f"{self.path}/{collection}/log/{number:09d}")
            try:
                fs.rename(draft, to)
            except Exception as e:  # noqa: BLE001 - a number that is taken is an error on some file systems
                if not fs.exists(to):
                    raise e
            if fs.exists(p(to, entry)):
                return number
            inside = p(to, draft.getName())  # others move a folder into the one that is there
            if fs.exists(inside):
                fs.rename(inside, draft)

    def _commit(self, collection: str, kind: str, rows: DataFrame) -> None:
        self._published(collection, self._written(collection, kind, rows))
        if len(self._log(collection)) > self.deltas:
            self.compact(collection)

    def _read(self, collection: str, entry: dict, bucket: int | None) -> DataFrame:
        schema = self.spark.createDataFrame([], self.schema).schema
        if entry["kind"] != "whole":
            schema = schema.add("_gone", T.BooleanType()).add("_set", T.ArrayType(T.StringType()))
        rows = self.spark.read.schema(schema.add("_bucket", T.IntegerType())).parquet(f"{self.path}/{collection}/data/{entry['folder']}")
        return rows if bucket is None else rows.where(F.col("_bucket") == bucket)

    def _rows(self, collection: str, log: list[dict] | None = None, bucket: int | None = None) -> DataFrame:
        """The collection's rows: what the last change of a hash says, and what updates after it set, on top of the whole table."""
        log = self._log(collection) if log is None else log
        empty = self.spark.createDataFrame([], self.schema)
        cols = [c for c in empty.columns if c != "hash"]
        base = self._read(collection, log[0], bucket).drop("_bucket") if log and log[0]["kind"] == "whole" else empty
        changes = [self._read(collection, e, bucket).drop("_bucket").withColumn("_n", F.lit(e["number"])) for e in log if e["kind"] != "whole"]
        if not changes:
            return base
        whole = F.when(F.col("_set").isNull(), F.col("_n"))
        sets = lambda c: F.when(F.col("_set").isNull() | F.array_contains("_set", c), F.col("_n"))
        last = reduce(DataFrame.unionByName, changes).groupBy("hash").agg(
            F.max(whole).alias("_full"), F.max_by("_gone", whole).alias("_gone"), *(F.max_by(F.struct(F.col(c).alias("v")), sets(c)).alias(f"_{i}") for i, c in enumerate(cols)),
        )
        both = base.withColumn("_here", F.lit(True)).join(last, "hash", "full_outer")
        alive = F.when(F.col("_full").isNotNull(), ~F.col("_gone")).otherwise(F.col("_here"))
        value = lambda i, c: F.when(F.col(f"_{i}").isNotNull(), F.col(f"_{i}.v")).when(F.col("_full").isNull(), F.col(c)).alias(c)
        return both.where(alive).select("hash", *(value(i, c) for i, c in enumerate(cols))).select(*empty.columns)

    def scan(self, collection: str) -> DataFrame:
        return self._rows(collection)

    def compact(self, collection: str) -> None:
        """Write the collection as one table. What came before stays for readers that have begun, until vacuum()."""
        self._published(collection, self._compacted(collection))

    def _compacted(self, collection: str) -> str:
        log = self._log(collection)
        return self._written(collection, "whole", self._rows(collection, log), max((e["number"] for e in log if e["kind"] != "whole"), default=log[0]["base"] if log else 0))

    def vacuum(self, collection: str, keep_seconds: float = 24 * 3600) -> None:
        """Delete folders that don't count and have not been touched for so long: younger ones may be a writer's or a reader's."""
        fs, p = self._fs()
        keep = {e["folder"] for e in self._log(collection)}
        for s in fs.listStatus(p(f"{self.path}/{collection}/data")):
            if s.getPath().getName() not in keep and s.getModificationTime() < 1000 * (time.time() - keep_seconds):
                fs.delete(s.getPath(), True)

    def _changed(self, collection: str, rows: DataFrame, gone: bool = False, only: list[str] | None = None) -> None:
        like = self.spark.createDataFrame([], self.schema)
        full = like.unionByName(rows.select(*[c for c in like.columns if c in rows.columns]), allowMissingColumns=True).select(*like.columns)
        names = F.array(*map(F.lit, only)) if only else F.lit(None).cast("array<string>")
        self._commit(collection, "delta", full.withColumns({"_gone": F.lit(gone), "_set": names}))

    def upsert(self, collection: str, rows: DataFrame) -> None:
        """Rows by hash, the first of equal ones; columns they lack are null. Vectors must be finite and not empty (ValueError)."""
        new = rows.dropDuplicates(["hash"])
        if "vector" in new.columns and not new.where(~F.coalesce(is_valid(F.col("vector")), F.lit(False))).isEmpty():
            raise ValueError("vectors must be finite and not empty")
        self._changed(collection, new)

    def delete(self, collection: str, hashes: DataFrame) -> None:
        """Rows of these hashes go; unknown ones do no harm."""
        self._changed(collection, hashes.select("hash").distinct(), gone=True)

    def delete_where(self, collection: str, condition: Column) -> None:
        """Rows that meet a condition on the stored columns go, as all chunks of a file."""
        self.delete(collection, self.scan(collection).where(condition))

    def update(self, collection: str, changes: DataFrame) -> None:
        """New values, nulls included, of the columns that changes has; unknown hashes, and those that are deleted before it, are left out."""
        cols = [c for c in changes.columns if c != "hash"]
        if cols:
            self._changed(collection, changes.dropDuplicates(["hash"]), only=cols)

    def purge(self, collection: str) -> None:
        fs, p = self._fs()
        fs.delete(p(f"{self.path}/{collection}"), True)

    def purge_all(self) -> None:
        for c in self.collections():
            self.purge(c)

    def hashes(self, collection: str) -> DataFrame:
        return self.scan(collection).select("hash")

    def chunk(self, collection: str, h: int) -> DataFrame:
        """The chunk of a hash: one bucket is read."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(h).cast("long")), F.lit(self.BUCKETS))).first()[0]
        return self._rows(collection, bucket=bucket).where(F.col("hash") == h)

    def page(self, collection: str, offset: int = 0, limit: int = 100, vectors: bool = False) -> DataFrame:
        rows = self.scan(collection)
        return (rows if vectors or "vector" not in rows.columns else rows.drop("vector")).orderBy("hash").offset(offset).limit(limit)

    def stats(self, collection: str) -> DataFrame:
        return self.scan(collection).agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))

    def collections(self) -> list[str]:
        fs, p = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(p(self.path))) if fs.exists(p(self.path)) else []


def embedded(rows: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """rows with a vector by a hook, usually a pandas UDF; rows whose vector isn't finite go."""
    return rows.withColumn("vector", embed(F.col(text))).where(is_valid(F.col("vector")))


def event_rows(events: DataFrame, per: str = "collection_id") -> DataFrame:
    """Valid events as rows to store: their text, its hash, and the fields as they are; two of one hash in a batch are an error."""
    out = events.withColumn("text", embed_text())
    return assert_unique(out.withColumn("hash", event_hash(F.col("text"))), "hash")


def import_collection(store: ChunkStore, collection: str, rows: DataFrame, embed: Callable[[Column], Column] | None = None, source: str | None = None, model: str | None = None) -> dict:
    """Put an export's rows (readers.export_chunks) into a collection; returns what import_errors says.

    Rows without text go. Vectors are used again if all rows have one of one size and the model is ours, else all texts are embedded
    anew; without a hook for that, or with a vector that isn't finite, it is an error and nothing is written.
    """
    full = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    said = import_errors(full, source, model).first().asDict()
    if said["bad_version"] or said["bad_vectors"]:
        raise ValueError(f"not an export of ours, or vectors that aren't finite: {said}")
    if not said["vectors_usable"]:
        if embed is None:
            raise ValueError("the vectors can't be used again, and there is no hook to make new ones")
        full = embedded(full.drop("vector"), embed)
    like = store.spark.createDataFrame([], store.schema).columns
    store.upsert(collection, full.select(*[c for c in like if c in full.columns]))
    return said
