"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._base import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node it reaches.

    Every round hangs each node's neighbours on the smallest node it knows (Kiveris et al., 2014): an
    aggregate of one row a node and a join, so a node with very many neighbours is a skewed join that
    adaptive execution splits, not a list in one task. Edges with a null end and loops are ignored; an
    empty table gives an empty result. Each round is a written table, the one before it is deleted. Rounds go on until one
    changes nothing; they are about the logarithm of the longest path, squared at the worst.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        large = written(_star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True), "star")
        small = written(_star(large, large=False), "star")
        dropped(now, large)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node hang on its smallest one; else those below it and the node itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()
