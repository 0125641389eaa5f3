"""A Bloom filter as a table of 64-bit words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def shape(n: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n keys and a rate of false positives; bits are a multiple of 64."""
    bits = max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def places(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key, by double hashing."""
    a, b = F.xxhash64(key), F.hash(key).cast("long")
    step = lambda i: F.pmod(F.pmod(a, F.lit(bits)) + i.cast("long") * (F.pmod(b, F.lit(bits - 1)) + 1), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), step)


def build(rows: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the words that have a bit set; as many rows at most as bits / 64."""
    at = rows.select(F.explode(places(F.col(key), bits, hashes)).alias("p"))
    return at.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))


def maybe_in(rows: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """rows whose key may be in the filter: all that are, and few that aren't. The filter is one short array for every task."""
    words = bloom.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("_w"))
    mask = lambda p: F.coalesce(F.element_at("_w", F.call_function("shiftright", p, F.lit(6))), F.lit(0).cast("long"))
    has = lambda p: F.call_function("shiftright", mask(p), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.crossJoin(F.broadcast(words)).where(F.forall(places(F.col(key), bits, hashes), has)).drop("_w")
