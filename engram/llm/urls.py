"""URL rules by a sorted sweep over reversed hosts."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._base import tidy, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def reversed_host(host) -> Column:
    """a.b.c as c.b.a. with a last dot: a host's key starts with the keys of all domains above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """The rules' hosts that cover the key that a sorted sweep is at, outermost first, each with its sorted paths.

    A host key k covers [k, k + U+10FFFF): itself and its subdomains. Keys, and paths of equal keys, must come in ascending order.
    Of the rules that fit, the longest host and path together win, then the longer host, then the verdict first in code point order.
    """

    def __init__(self):
        self.stack: list[tuple[str, list[str], dict[str, str]]] = []

    def at(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, verdict: str) -> None:
        self.at(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, [], {}))
        _, paths, verdicts = self.stack[-1]
        if path not in verdicts:
            paths.append(path)
        verdicts[path] = min(verdict, verdicts.get(path, verdict))

    def find(self, key: str, path: str) -> tuple[str, str, str] | None:
        """(reversed host, path, verdict) of the rule that wins."""
        self.at(key)
        best = None
        for host, paths, verdicts in self.stack:
            p = self._longest(paths, path)
            if p is not None and (best is None or len(host) + len(p) >= len(best[0]) + len(best[1])):
                best = (host, p, verdicts[p])
        return best

    @staticmethod
    def _longest(paths: list[str], path: str) -> str | None:
        """The longest of the sorted paths that path starts with."""
        i = bisect.bisect_right(paths, path)
        while i:
            p = paths[i - 1]
            if path.startswith(p):
                return p
            n = 0
            while n < min(len(p), len(path)) and p[n] == path[n]:
                n += 1
            i = bisect.bisect_right(paths, path[:n], 0, i)  # all that path starts with are prefixes of the common part
        return None


def _swept(id_col: str, default: str):
    """Rows in order of range, key, rules first, path: rules go on the stack, urls are judged by it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for batch in batches:
            urls, rules, verdicts = [], [], []
            for i, (part, is_url, key, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "is_url", "key", "path", "verdict")))):
                if part != now:
                    sweep, now = Sweep(), part
                if not is_url:
                    sweep.rule(key, path, verdict)
                    continue
                hit = sweep.find(key, path)
                urls.append(i)
                rules.append(".".join(reversed(hit[0][:-1].split("."))) + hit[1] if hit else None)
                verdicts.append(hit[2] if hit else default)
            b = batch.take(pa.array(urls, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    return run


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages. rules(host, path, verdict).

    host is what follows the first :// up to / ? # or the end, A-Z lower-cased; path goes on up to ? or #.
    Null urls and those without :// have both empty and match only rules with an empty host, of
    which there are none: such rules, and rules with a null, are ignored. A rule fits its host and subdomains
    where the path starts with its own; the longest wins. Rows without a rule get the default verdict.
    Repeated urls and ids are judged row by row; other columns aren't read; an empty table gives an empty result.

    Urls are cut into ranges of (reversed host, path, hash of the id), so that a host, or a url, of any share of all rows is many
    ranges of about the same size. A rule goes to each range that meets the interval of its host; the ranges' borders, one pair a partition,
    are what the driver sees. Each range is one sorted stream of rules and urls: a task holds the rules that cover
    the key where it is, and nothing else.
    """
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
    clean = clean.select(reversed_host(F.translate("host", _UPPER, _LOWER)).alias("key"), F.col("path"), F.col("verdict")).distinct()
    kind = dict(pages.dtypes)[id_col]
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", F.when(F.col("host") == "", "").otherwise(reversed_host(F.col("host"))))
    urls = written(urls.repartitionByRange(F.col("key"), F.col("path"), F.xxhash64("id")).withColumn("range", F.spark_partition_id()), "urls")
    borders = urls.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    spans = F.array(*(F.struct(F.lit(r.range).alias("range"), F.lit(r.low).alias("low"), F.lit(r.high).alias("high")) for r in borders)) if borders else F.array().cast("array<struct<range:int,low:string,high:string>>")
    last = F.concat("key", F.lit("\U0010ffff"))
    met = clean.withColumn("span", F.explode(F.filter(spans, lambda b: (b["high"] >= F.col("key")) & (b["low"] < last))))
    met = met.select("span.range", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("host"), "path", "key", F.lit(False).alias("is_url"), "verdict")
    both = urls.select("range", "id", "host", "path", "key", F.lit(True).alias("is_url"), F.lit(None).cast("string").alias("verdict")).unionByName(met)
    both = both.repartition("range").sortWithinPartitions("range", "key", "is_url", "path")
    return both.mapInArrow(_swept(id_col, default), f"{id_col} {kind}, host string, path string, rule string, verdict string")
