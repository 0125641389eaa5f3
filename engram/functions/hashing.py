"""Hashes with fixed results, over the code points of strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_32 = 0xFFFFFFFF


def _codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(s: Column) -> Column:
    """FNV-1a of 32 bits, one step a character. The product is made in two halves, which stay within a long."""

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        low = x.bitwiseAND(F.lit(0xFFFF)) * 0x01000193
        high = F.shiftright(x, 16) * 0x01000193
        return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_32))

    return F.aggregate(_codes(s), F.lit(0x811C9DC5).cast("long"), step)


def fnv1a_word(word: str) -> int:
    """fnv1a() of one string."""
    h = 0x811C9DC5
    for c in word:
        h = (h ^ ord(c)) * 0x01000193 & _32
    return h


def djb2(s: Column) -> Column:
    """The xor variant of djb2, 32 bits."""
    return F.aggregate(_codes(s), F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseXOR(c).bitwiseAND(F.lit(_32)))


def event_hash(s: Column) -> Column:
    """53 bits of two djb2 lanes: the upper 21 of the second over the first."""

    def step(a: Column, c: Column) -> Column:
        one = (a["a"] * 33).bitwiseXOR(c).bitwiseAND(F.lit(_32))
        two = (a["b"] * 33).bitwiseXOR(c).bitwiseXOR(F.shiftleft(c, 16)).bitwiseAND(F.lit(_32))
        return F.struct(one.alias("a"), two.alias("b"))

    zero = F.struct(F.lit(5381).cast("long").alias("a"), F.lit(0xABCDEF).cast("long").alias("b"))
    return F.aggregate(_codes(s), zero, step, lambda a: F.shiftright(a["b"], 11) * 4294967296 + a["a"])


def content_hash(s: Column) -> Column:
    return F.xxhash64(s)


def window_fingerprint(hashes: Column) -> Column:
    """Hashes as strings in string order, joined by commas."""
    return F.array_join(F.array_sort(F.transform(hashes, lambda h: h.cast("string"))), ",")
