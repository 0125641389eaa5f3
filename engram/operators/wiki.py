"""Wiki pages: store, basket, search with facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import title_tokens

#: Size facets and their lower bounds in bytes.
BUCKETS = (("gt20k", 20 * 1024), ("5to20k", 5 * 1024), ("1to5k", 1024), ("lt1k", 0))


def size_bucket(size: Column) -> Column:
    out = None
    for name, low in BUCKETS:
        test = F.coalesce(size, F.lit(0)) >= low
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("lt1k")


def page_key(library: Column, title: Column) -> Column:
    return F.concat(library, F.lit("::"), title)


def upserted(pages: DataFrame, new: DataFrame, key: str = "key", content: tuple[str, ...] = ("content", "plaintext", "fetched_at", "content_fetched")) -> DataFrame:
    """pages with the rows of new put in by key: the newer wins, but one that was not fetched never takes away content that was.

    status is added, updated or kept.
    """
    n = new.select(F.col(key).alias("_k"), F.struct(*new.columns).alias("n"))
    o = pages.select(F.col(key).alias("_k"), F.struct(*pages.columns).alias("o"))
    both = o.join(n, "_k", "full_outer")
    hold = (F.coalesce("n.content_fetched", F.lit(0)) == 0) & (F.coalesce("o.content_fetched", F.lit(0)) == 1)
    value = lambda c: F.when(F.col("n").isNull() | (hold if c in content else F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "kept").otherwise("updated")
    return both.select(*(F.col("_k").alias(c) if c == key else value(c).alias(c) for c in pages.columns), status.alias("status"))


def updated(pages: DataFrame, changes: DataFrame, columns: list[str], key: str = "key") -> DataFrame:
    """New values for known keys; unknown keys are left out."""
    c = changes.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_{x}") for x in columns))
    out = pages.join(c, F.col(key) == F.col("_k"), "left")
    return out.withColumns({x: F.when(F.col("_k").isNotNull(), F.col(f"_{x}")).otherwise(F.col(x)) for x in columns}).drop("_k", *(f"_{x}" for x in columns))


def basket_added(basket: DataFrame, new: DataFrame) -> DataFrame:
    """The first added_at of a page stays."""
    return basket.unionByName(new).groupBy("page_key").agg(F.min_by("library_id", "added_at").alias("library_id"), F.min_by("title", "added_at").alias("title"), F.min("added_at").alias("added_at"))


def basket_list(basket: DataFrame, pages: DataFrame) -> DataFrame:
    """By library and title, without pages that are gone."""
    return basket.join(pages.select(F.col("key").alias("page_key")), "page_key", "left_semi").orderBy("library_id", "title")


def basket_text(basket: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: the fetched pages of the basket as one text, and a fingerprint of each."""
    p = basket.join(pages.where("content_fetched = 1").select(F.col("key").alias("page_key"), "plaintext"), "page_key")
    row = F.struct("library_id", "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("plaintext", F.lit(""))).alias("t"), F.sha1(F.coalesce("plaintext", F.lit("")).cast("binary")).alias("f"))
    return p.agg(F.array_sort(F.collect_list(row)).alias("r")).select(F.array_join("r.t", "\n\n---\n\n").alias("text"), F.col("r.f").alias("fingerprints"))


def without_library(pages: DataFrame, basket: DataFrame, library: str) -> tuple[DataFrame, DataFrame]:
    return pages.where(F.col("library_id") != library), basket.where(F.col("library_id") != library)


def _begins(tokens: Column, term: str) -> Column:
    return F.exists(tokens, lambda x: x.startswith(term))


def _named(values: Column, facet: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))


def matches(query: str, title: Column, text: Column | None = None) -> Column:
    """/regex/ on the title and a line end, or every word of the query begins a word of the title (or text); nothing asked matches all."""
    q = (query or "").strip()
    if not q:
        return F.lit(True)
    import re

    if re.fullmatch(r"/.+/[a-z]*", q, re.I):
        body, _, flags = q[1:].rpartition("/")
        flags = "".join(f for f in flags.lower() if f in "ims")
        return F.concat(title, F.lit("\n")).rlike(f"(?{flags}){body}" if flags else body)
    terms = [t for t in re.split(r"[\W_]+", q.lower()) if t]
    tokens = title_tokens(text if text is not None else title)
    out = F.lit(bool(terms))
    for t in terms:
        out = out & _begins(tokens, t)
    return out


def facets(pages: DataFrame, categories: list[str] = (), buckets: list[str] = (), fetched: bool | None = None, libraries: list[str] = ()) -> DataFrame:
    """(facet, value, n): what each facet would leave under all filters but its own.

    pages(library_id, categories, size_bytes, content_fetched). One pass: a row is expanded to its value in each facet that the other filters
    let through, then counted.
    """
    bucket = size_bucket(F.col("size_bytes"))
    done = F.coalesce(F.col("content_fetched"), F.lit(0)) == 1
    ok = {
        "categories": F.arrays_overlap("categories", F.array(*map(F.lit, categories))) if categories else F.lit(True),
        "size": bucket.isin(list(buckets)) if buckets else F.lit(True),
        "fetched": done == F.lit(fetched) if fetched is not None else F.lit(True),
        "libraries": F.col("library_id").isin(list(libraries)) if libraries else F.lit(True),
    }
    values = {"categories": F.coalesce("categories", F.array().cast("array<string>")), "size": F.array(bucket), "fetched": F.array(F.when(done, "fetched").otherwise("unfetched")), "libraries": F.array("library_id")}
    none = F.array().cast("array<struct<facet:string,value:string>>")
    parts = []
    for f, v in values.items():
        others = F.lit(True)
        for g, test in ok.items():
            if g != f:
                others = others & F.coalesce(test, F.lit(False))
        parts.append(F.when(others, _named(v, f)).otherwise(none))
    return pages.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def searched(pages: DataFrame, query: str = "", fulltext: bool = False, limit: int | None = None, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(pages found, by title and key; facets of those that the query matches)."""
    pool = pages.where(matches(query, F.col("title"), F.col("plaintext") if fulltext else None))
    out = pool
    if filters.get("categories"):
        out = out.where(F.arrays_overlap("categories", F.array(*map(F.lit, filters["categories"]))))
    if filters.get("buckets"):
        out = out.where(size_bucket(F.col("size_bytes")).isin(list(filters["buckets"])))
    if filters.get("fetched") is not None:
        out = out.where((F.coalesce("content_fetched", F.lit(0)) == 1) == F.lit(filters["fetched"]))
    if filters.get("libraries"):
        out = out.where(F.col("library_id").isin(list(filters["libraries"])))
    out = out.orderBy(F.lower("title"), "key").offset(offset)
    return (out.limit(limit) if limit is not None else out), facets(pool, **filters)


def continued(rows: DataFrame) -> DataFrame:
    """Categories of pages that come in several parts."""
    return rows.groupBy("page_id").agg(F.first("title").alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))


def usage(pages: DataFrame) -> DataFrame:
    return pages.groupBy("library_id").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + F.coalesce(F.octet_length("plaintext"), F.lit(0))).alias("bytes"))
