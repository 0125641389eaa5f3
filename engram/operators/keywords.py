"""Keywords of texts, queries and collections."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import CJK, bind, cjk_tokens, stem, stem_word, stop_words

#: Characters scanned and keywords kept at each level.
LEVELS = {"minimal": {"scan": 1500, "keep": 5}, "balanced": {"scan": 5000, "keep": 12}, "aggressive": {"scan": None, "keep": 15}}
MOST_WEIGHT, BASE_WEIGHT = 3.0, 1.5
#: Fixed values of the extraction: what is cut from a text, what a capitalised word, a compound and a bracketed term are.
TAGS = (r"(?i)(?<!\s)\s*+\[keywords?[:\s][^\]]*\]", rf"\[[^\]{CJK}]{{1,30}}\]")
CITATIONS, ITALICS, POSSESSIVE = r"\([^)]+\)", r"\*[^*]+\*", r"'s\b"
CAPITALISED, COMPOUND, LATIN_WORD = r"[A-Z](?<=\b[A-Z])[a-z]{3,}\b", r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9_]++/[A-Za-z0-9_]++|[A-Za-z0-9_][A-Za-z0-9]*+_[A-Za-z0-9_]++)", r"(?<![a-z0-9_])[a-z]{4,}(?![a-z0-9_])"
BRACKETS = (r"【([^】\n]{2,20})】", r"\[([^\]\n]{2,20})\]")


def _replaced(text: Column, pattern: str, by: str, end: str) -> Column:
    """text with by for each match of a pattern that ends in end. Behind the last end nothing is looked for, or each beginning there would be followed to the end of the text."""

    def split(t: Column) -> Column:
        return bind(F.substring_index(t, end, -1), lambda rest: F.concat(F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(rest)), pattern, by), rest))

    return bind(text, split)


def _untagged(text: Column) -> Column:
    text = _replaced(_replaced(F.coalesce(text, F.lit("")), TAGS[0], "", "]"), TAGS[1], " ", "]")
    return F.trim(F.regexp_replace(text, r"\s(?:\s+|(?<! ))", " "))  # of any white but single spaces


def bracket_terms(text: Column) -> Column:
    """Terms of 2 to 20 letters in square or lenticular brackets that have a letter of a script without word spaces."""
    both = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in BRACKETS))
    return F.array_distinct(F.filter(F.transform(both, F.trim), lambda t: t.rlike(f"[{CJK}]")))


def _kept(word: Column, n: Column, singles: list[str] | None) -> Column:
    """Whether a piece of a script without word spaces may be a keyword: of one letter only in modes that list such ones, if it is listed or repeated."""
    alone = (F.length(word) < 2) & word.rlike(f"[{CJK}]")
    return ~alone | ((n >= 2) | word.isin(singles) if singles is not None else F.lit(False))


def _scanned(text: Column, level: str, at_space: bool) -> Column:
    """As much of a text as the level scans, up to a space where there is one in its last fifth."""
    scan = LEVELS[level]["scan"]
    if not scan:
        return text
    cut = F.substring(text, 1, scan)
    if not at_space:
        return cut
    last = scan - F.instr(F.reverse(cut), " ")
    return F.when((F.length(text) > scan) & F.contains(cut, F.lit(" ")) & (last > scan * 0.8), F.substring(cut, F.lit(1), last)).otherwise(cut)


_COUNTS = "array<struct<word:string,tf:bigint,df:int,form:string>>"
_SPACELESS, _RUNS, _LATIN = re.compile(f"[{CJK}]"), re.compile(f"[{CJK}]+"), re.compile(LATIN_WORD)


@lru_cache(1 << 17)
def _stemmed(form: str) -> str:
    return form if len(form) <= 3 or _SPACELESS.search(form) else stem_word.__wrapped__(form)  # kept once, here


def _tally(said: list[list[str]], proper: set[str], stops: frozenset[str]) -> list[tuple]:
    forms = Counter(chain.from_iterable(said))
    for f in stops & forms.keys():
        del forms[f]
    word = {f: f if f in proper else _stemmed(f) for f in forms}
    df, out = Counter(), {}
    for s in said if len(said) > 1 else ():
        df.update({word[f] for f in s if f in word})
    for f, w in word.items():
        c = forms[f]
        if w in out:
            tf, most, form = out[w]
            out[w] = (tf + c, c, f) if (-c, f) < (-most, form) else (tf + c, most, form)
        else:
            out[w] = (c, c, f)
    return [(w, tf, df[w] if df else 1, form) for w, (tf, _, form) in out.items()]


def _counted(text: Column, names: Column, mode: str, sentences: Callable[[str], list[list[str]]], most: Callable[[list[tuple]], list[tuple]] = list) -> Column:
    """A text's words without stop words: frequency, sentences with it, and the most frequent form, the first in order on a tie.

    A word is the form itself of names, short words and those without word spaces, else the form's stem. Text and names go to Python as
    strings, which sentences takes apart there: lists of words took most of the time on their way. most: which of the words come back.
    """
    stops = frozenset(stop_words(mode))

    def run(texts: pa.Array, proper: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for i in range(0, len(texts), 64):
            rows = [most(_tally(sentences(t or ""), set((p or "").split(" ")), stops)) for t, p in zip(texts.slice(i, 64).to_pylist(), proper.slice(i, 64).to_pylist())]
            columns = zip(*chain.from_iterable(rows)) if any(rows) else [()] * 4
            fields = [pa.array(c, f.type) for c, f in zip(columns, kind.value_type)]
            parts.append(pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type))))
        return pa.concat_arrays(parts)

    kind = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64()), ("df", pa.int32()), ("form", pa.string())]))
    run.__annotations__ = {"texts": pa.Array, "proper": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _COUNTS)(F.make_valid_utf8(text), names)


def _joined(text: str) -> list[list[str]]:
    """Sentences in lines of words between spaces."""
    return [s.split(" ") if s else [] for s in text.split("\n")]


def _latin_and_pieces(text: str) -> list[list[str]]:
    """LATIN_WORD and cjk_tokens() of a text, as one sentence."""
    runs = [] if text.isascii() else _RUNS.findall(text)
    return [_LATIN.findall(text.lower()) + [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]]


def _names(text: Column) -> Column:
    """Capitalised words in lower case, between spaces."""
    return F.lower(F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))), " "))


def tfidf_keywords(docs: DataFrame, id_col: str, text: Column, level: str = "balanced", base: float = BASE_WEIGHT, mode: str = "en", least: int = 3, singles: list[str] | None = None) -> DataFrame:
    """(id, rank, keyword, score, weight): words by tf * (ln((S + 1) / (sentences with it + 1)) + 1), 1.3 times as much if the text has it capitalised.

    A text's sentences are its corpus. Terms in brackets come before all others. The most frequent form of a stem is shown, the first in
    order on a tie. A text is counted and ranked in its row, and nothing is shuffled; ids are taken to be distinct.
    """
    clean = F.regexp_replace(_scanned(_untagged(text), level, True), POSSESSIVE, "")
    keep = LEVELS[level]["keep"]

    def words(x: Column) -> Column:
        plain = F.regexp_replace(F.lower(F.regexp_replace(x, f"[{CJK}]", " ")), r"[^\w\s'-]", " ")
        return F.concat(F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= max(1, least)), cjk_tokens(x))

    def measured(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"[.!?。！？\n]+"), F.trim), lambda s: F.length(s) > 2)
        said = bind(parts, lambda p: F.when(F.size(p) == 0, F.array(t)).otherwise(p))
        terms = F.array_except(bracket_terms(t), F.array(*map(F.lit, stop_words(mode))))
        return bind(said, lambda p: F.struct(F.size(p).alias("s"), F.array_join(F.transform(p, lambda x: F.array_join(words(x), " ")), "\n").alias("said"), _names(t).alias("names"), terms.alias("terms")))

    caps = F.array_join(F.array_distinct(F.regexp_extract_all(_untagged(text), F.lit(r"\p{Lu}\S*"), F.lit(0))), " ")
    d = docs.select(F.col(id_col), caps.alias("caps"), bind(clean, measured).alias("m"))
    d = d.select(id_col, "caps", "m.s", "m.terms", _counted(F.col("m.said"), F.col("m.names"), mode, _joined).alias("words"))

    def scored(w: Column) -> Column:
        first = F.substring(w["word"], 1, 1)
        title = F.concat(F.upper(first), F.substring(w["word"], F.lit(2), F.length(w["word"])))
        return F.when((F.upper(first) == first) | F.contains(F.col("caps"), title), 1.3).otherwise(1.0)

    def listed(own: Column) -> Column:  # bracketed terms that are no word already come before the words
        boost = own[0]["score"] * 1.5 + 10
        extra = F.transform(F.array_except("terms", F.transform(own, lambda w: w["word"])), lambda t: F.struct(t.alias("keyword"), boost.alias("score")))
        return F.when(F.size(own) > 0, F.slice(F.concat(extra, F.transform(own, lambda w: F.struct(w["form"].alias("keyword"), w["score"].alias("score")))), 1, keep))

    # what can't reach the list even if it is capitalised need not be looked up
    found = F.transform(F.filter("words", lambda w: _kept(w["word"], w["tf"], singles)), lambda w: F.struct((w["tf"] * (F.log((F.col("s") + 1) / (w["df"] + 1)) + 1)).alias("base"), w["word"].alias("word"), w["form"].alias("form")))
    able = bind(found, lambda a: bind(F.element_at(F.slice(F.sort_array(F.transform(a, lambda w: w["base"]), False), 1, keep), F.when(F.size(a) > 0, F.lit(-1)).otherwise(None)), lambda k: F.filter(a, lambda w: w["base"] * 1.3 >= k * 0.999999)))
    ranked = bind(F.transform(able, lambda w: bind(w["base"] * scored(w), lambda x: F.struct((-x).alias("o"), w["word"].alias("word"), w["form"].alias("form"), x.alias("score")))), lambda a: F.slice(F.array_sort(a), 1, keep))
    out = d.select(id_col, F.posexplode_outer(bind(ranked, listed)).alias("place", "k")).where("k IS NOT NULL")
    best = F.max("k.score").over(Window.partitionBy(id_col))
    return out.select(id_col, (F.col("place") + 1).alias("rank"), F.col("k.keyword").alias("keyword"), F.col("k.score").alias("score"), (F.lit(base) + F.col("k.score") / best * 0.5).alias("weight"))


def frequency_keywords(docs: DataFrame, id_col: str, text: Column, level: str = "balanced", base: float = BASE_WEIGHT, mode: str = "en", singles: list[str] | None = None) -> DataFrame:
    """(id, rank, keyword, n, weight): words of four Latin letters or more by frequency, weight base + 0.1 a repetition, 3 at most.

    Compounds (a/b, a_b, as a_b) weigh base + 0.2, terms in brackets 3. Of one keyword the highest weight counts. On a tie the more
    frequent comes first, then words, compounds and terms, each in order. A text is counted in its row; ids are taken to be distinct.
    """
    clean = F.regexp_replace(_replaced(_replaced(_untagged(text), CITATIONS, " ", ")"), ITALICS, " ", "*"), POSSESSIVE, "")
    stops, keep = stop_words(mode), LEVELS[level]["keep"]

    def measured(t: Column) -> Column:
        joined = F.when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("_")), F.regexp_extract_all(t, F.lit(COMPOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))
        compounds = F.transform(joined, lambda c: F.regexp_replace(F.lower(c), "[/_]", "_"))
        terms = F.array_except(bracket_terms(t), F.array(*map(F.lit, stops)))
        return F.struct(t.alias("said"), _names(t).alias("names"), F.array_distinct(F.filter(compounds, lambda c: F.length(c) >= 4)).alias("compounds"), terms.alias("terms"))

    d = docs.select(F.col(id_col), bind(_scanned(clean, level, False), measured).alias("m"))
    # weights rise with frequencies and words differ, so the first `keep` of them by frequency are all that the list can have
    able = lambda w: len(w[0]) > 1 or not _SPACELESS.search(w[0]) or (singles is not None and (w[1] >= 2 or w[0] in singles))
    first = lambda words: heapq.nsmallest(keep, filter(able, words), key=lambda w: (-w[1], w[0]))
    d = d.select(id_col, "m.compounds", "m.terms", _counted(F.col("m.said"), F.col("m.names"), mode, _latin_and_pieces, first).alias("words"))
    row = lambda keyword, n, weight, kind, word: F.struct((-weight).alias("_w"), (-n).alias("_n"), F.lit(kind).alias("kind"), word.alias("word"), keyword.alias("keyword"), n.alias("n"), weight.alias("weight"))
    weight = lambda n: F.least(F.lit(MOST_WEIGHT), base + 0.1 * (n - 1))
    words = F.transform("words", lambda w: row(w["form"], w["tf"], weight(w["tf"]), 0, w["word"]))
    other = lambda found, kind, w: F.transform(found, lambda k: row(k, F.lit(1).cast("long"), F.lit(min(MOST_WEIGHT, w)).cast("double"), kind, k))
    rows = d.select(id_col, F.explode_outer(F.concat(words, other("compounds", 1, base + 0.2), other("terms", 2, MOST_WEIGHT))).alias("x")).where("x IS NOT NULL").select(id_col, "x.*")
    order = ["_w", "_n", "kind", "word"]
    rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(id_col, "keyword").orderBy(*order))).where("_d = 1")
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col("rank") <= keep)
    return out.select(id_col, "rank", "keyword", "n", "weight")


def chat_keywords(text: Column, most: int = 8, mode: str = "en") -> Column:
    """Capitalised words within sentences and pieces of scripts without spaces, in order."""
    names = F.regexp_extract_all(text, F.lit(r"(?<=[a-z,;:] )[A-Z][a-z]{2,}\b"), F.lit(0))
    stops = F.array(*map(F.lit, stop_words(mode)))
    return F.slice(F.array_distinct(F.filter(F.concat(names, cjk_tokens(text)), lambda t: ~F.array_contains(stops, F.lower(t)))), 1, most)


def lorebook_keywords(keys: Column, secondary: Column, mode: str = "en") -> Column:
    none = F.array().cast("array<string>")
    low = F.transform(F.concat(F.coalesce(keys, none), F.coalesce(secondary, none)), lambda k: F.lower(F.trim(k)))
    stops = F.array(*map(F.lit, stop_words(mode)))
    return F.array_distinct(F.filter(low, lambda k: (F.length(k) >= 2) & ~F.array_contains(stops, k)))


def query_keywords(queries: DataFrame, id_col: str, text: Column, most: int = 50, mode: str = "en") -> DataFrame:
    """(id, rank, keyword): pieces of scripts without spaces, first the 15 most frequent of the first 240 characters, then those of the rest, most in
    all; Latin words by frequency, those of the beginning twice, fill the list, or come as 10 more behind a full one. Ties are in order.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    head = F.substring(low, 1, 240)
    stops = stop_words(mode)
    latin = lambda t: F.regexp_extract_all(t, F.lit(r"[a-z][a-z0-9'-]{2,}"), F.lit(0))
    tagged = lambda a, kind, h: F.transform(a, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t"), F.lit(h).alias("h"), F.lit(1).alias("n")))
    rows = queries.select(F.col(id_col), F.explode(F.concat(tagged(cjk_tokens(low), 0, 0), tagged(cjk_tokens(head), 0, 1), tagged(latin(low), 1, 0), tagged(latin(head), 1, 0))).alias("x")).select(id_col, "x.*")
    per = rows.where(~F.col("t").isin(stops)).groupBy(id_col, "kind", "t").agg(F.sum(F.when(F.col("h") == 0, 1).otherwise(0)).alias("n"), F.sum("h").alias("head"))
    early = min(15, most)
    place = lambda *o: F.row_number().over(Window.partitionBy(id_col, "kind").orderBy(*o))
    per = per.withColumn("at", place(F.col("head").desc(), "t")).withColumn("at", F.when((F.col("kind") == 0) & (F.col("head") > 0) & (F.col("at") <= early), F.col("at")))
    # those of the beginning fill their own share only, the rest the rest of the list
    per = per.withColumn("place", place(F.col("at").asc_nulls_last(), F.col("n").desc(), "t")).withColumn("early", F.count("at").over(Window.partitionBy(id_col, "kind")))
    cjk = (F.col("kind") == 0) & (F.col("at").isNotNull() | (F.col("place") - F.col("early") <= most - early))
    per = per.withColumn("_c", F.count_if(cjk).over(Window.partitionBy(id_col)))
    keep = cjk | ((F.col("kind") == 1) & (F.col("place") <= F.when(F.col("_c") >= most, 10).otherwise(most - F.col("_c"))))
    return per.withColumn("_keep", keep).where("_keep").withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("kind", "place"))).select(id_col, "rank", F.col("t").alias("keyword"))


def stem_key(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: F.when(F.length(t) > 3, stem(t)).otherwise(t)), " ")


def by_stem(rows: DataFrame, per: list[str], keyword: str = "keyword", weight: str = "weight") -> DataFrame:
    """One keyword for each stem, the one of highest weight."""
    w = Window.partitionBy(*per, "_k").orderBy(F.col(weight).desc(), F.col(keyword))
    return rows.withColumn("_k", stem_key(F.col(keyword))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def keyword_counts(rows: DataFrame, keywords: str = "keywords") -> DataFrame:
    return rows.select(F.explode(keywords).alias("k")).groupBy(F.lower("k").alias("keyword")).agg(F.count("*").alias("n"))


def has_keyword(keywords: Column, wanted: str) -> Column:
    """Whether any of a comma list is among the keywords, without case."""
    return F.arrays_overlap(F.transform(keywords, F.lower), F.array(*(F.lit(w.strip().lower()) for w in wanted.split(",") if w.strip())))


def size_summary(rows: DataFrame, per: str, text: str = "text") -> DataFrame:
    """Count, longest, mean and sum of lengths, and the beginning of the longest text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return rows.groupBy(per).agg(F.count("*").alias("chunks"), F.max(n).alias("max_chars"), F.avg(n).alias("avg_chars"), F.sum(n).alias("total_chars"), F.max_by(F.substring(text, 1, 80), F.struct(n, text)).alias("preview"))


def duplicate_hashes(rows: DataFrame, per: list[str], key: str = "hash") -> DataFrame:
    return rows.groupBy(*per, key).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)
