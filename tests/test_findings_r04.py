"""A small test for each finding of round 4 that held."""

import os

import duckdb
from pyspark.sql import functions as F

from engram.plans import more, registry  # noqa: F401


def sql_rows(name: str, d: str) -> list[tuple]:
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{d}/{f}/*.parquet')")
    return con.execute(registry.ORACLES[name]).fetchall()


def test_indexed_topk_ranks_by_the_rounded_score(spark, tmp_path):
    """Scores that differ from the seventh digit on are equal in the SQL; the lower ids have the lower ones, in a block of their own."""
    words = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), i)), " ")
    ids = spark.range(0, 107985, 1, 8)
    n = F.when(F.col("id") < 5, 6001).when(F.col("id") >= 107965, 6000)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(n.isNotNull(), F.concat(F.lit("asked "), words(n))).alias("text"), F.lit(None).cast("string").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "asked")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sql_rows("indexed_topk", str(tmp_path))
    assert [r[0] for r in want] == [*range(5), *range(107965, 107980)] and len({r[1] for r in want}) == 1
    assert [tuple(r) for r in registry.QUERIES["indexed_topk"](spark, str(tmp_path)).collect()] == want
