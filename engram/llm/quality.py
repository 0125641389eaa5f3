"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._base import SPACE, SPACE_RUN, written

WINDOW = 8


@dataclass(frozen=True)
class Risk:
    """Steps of a path of stricter and stricter cutoffs, of which a stratum goes as many as are certain enough to reject few good rows.

    alpha: share of good rows that all rules together may reject in a stratum. delta: probability that this is broken in any
    stratum. grid: rule -> cutoffs, lenient first; a value above a cutoff is rejected. Each cutoff is a step. The cutoffs
    are fixed numbers, not fitted, so all labelled rows are holdouts.
    """

    alpha: float = 0.02
    delta: float = 0.05
    grid: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_ratio": (0.3, 0.2, 0.1, 0.05, 0.02),
            "dup_line_ratio": (0.7, 0.5, 0.4, 0.3, 0.2),
            "repeat_ratio": (0.25, 0.2, 0.15, 0.1, 0.05),
            "bang_ratio": (0.2, 0.15, 0.1, 0.05, 0.02),
        }
    )

    def steps(self) -> list[tuple[str, float]]:
        """(rule, cutoff), the lenient cutoffs of all rules first."""
        depth = max(map(len, self.grid.values()))
        return [(f, cuts[k]) for k in range(depth) for f, cuts in self.grid.items() if k < len(cuts)]


RISK = Risk()


def _bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pairwise(hashes: Column, step: int) -> Column:
    """Hash of each element and the one step further on."""

    def pairs(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))

    return _bind(hashes, pairs)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    entry = "struct<h:bigint,i:int>"

    def covered(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        none = F.array(F.lit(None).cast(entry))
        near = F.zip_with(F.concat(none, F.slice(s, 1, n)), F.concat(F.slice(s, 2, n), none), lambda y, z: F.struct(y["h"].alias("y"), z["h"].alias("z")))
        starts = F.zip_with(s, near, lambda x, p: F.when(x["h"].eqNullSafe(p["y"]) | x["h"].eqNullSafe(p["z"]), x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(F.filter(starts, lambda i: i.isNotNull())), zero, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(F.sort_array(at), covered))

    return _bind(hashes, count)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns of keep, and longs n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (with a word) and n_bangs (exclamation marks).

    Null, empty and blank texts have zeros. The windows of 8 words are compared within one text by 64-bit
    hashes, joined in three doublings, so no window is ever built as a string or an array; a text costs
    n log n in its words only where a window repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _bind(F.btrim(text, F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))
    # one struct made by one expression: no projection can be folded into a lambda and be evaluated again
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_lines = _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u")))
    of_words = _bind(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeat_words(_pairwise(_pairwise(_pairwise(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)).alias("r")))
    d = docs.select(F.col(id_col), *(F.col(c) for c in keep), text.alias("_t"), of_lines.alias("_l"), of_words.alias("_w"))
    return d.select(
        id_col,
        *keep,
        F.col("_w.n").cast("long").alias("n_words"),
        F.col("_w.c").cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.col("_l.n") - F.col("_l.u")).cast("long").alias("n_dup_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )


def _per(value: str, of: str) -> Column:
    return F.col(value).cast("double") / F.greatest(F.col(of), F.lit(1)).cast("double")


def features() -> dict[str, Column]:
    return {"symbol_ratio": _per("n_symbols", "word_chars"), "dup_line_ratio": _per("n_dup_lines", "n_lines"), "repeat_ratio": _per("n_repeat_words", "n_words"), "bang_ratio": _per("n_bangs", "word_chars")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    stirling = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 5000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k < p * n; 1 otherwise.

    The largest term times the falling sum of ratios to it. Beyond so many terms the rest is bounded from above
    by a geometric series, so the value is never too small.
    """
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratio = lambda i: i.cast("double") / (n - i + 1) * ((1 - p) / p)
    zero = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))
    down = F.filter(F.transform(F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int")), lambda j: (k - j).cast("long")), lambda i: i > 0)
    total = F.aggregate(down, zero, lambda a, i: F.struct((a["s"] + a["t"] * ratio(i)).alias("s"), (a["t"] * ratio(i)).alias("t")), lambda a: a["s"] + F.when(k > terms, a["t"] * ratio(k) / (1 - ratio(k))).otherwise(0.0))
    return F.when(k < p * n, F.least(F.lit(1.0), F.exp(log_top) * total)).otherwise(1.0)


def risk_cutoffs(rows: DataFrame, stratum: str, good: str, risk: Risk = RISK) -> DataFrame:
    """(stratum, a column for each rule): the strictest cutoffs that are safe there, null where none is.

    rows: features; good: 1 for the holdouts, rows labelled good, 0 for those labelled bad, null for rows without a label. A stratum's
    path takes the steps that reject fewest of its unlabelled rows first. After each step the rules so far are safe if P(X <=
    rejected | n, alpha) <= delta / strata, rejected being the holdouts that any of them rejects: the exact
    (Clopper-Pearson) upper bound of their false rejection is then at most alpha. The steps are tested in order up to the first that
    fails, which needs no correction for their number (fixed-sequence testing: the holdouts have no part in the order, and
    a stratum goes wrong only by passing the first unsafe step); strata are corrected by Bonferroni, so all bounds hold
    together. Strata with few holdouts get no cutoff and lose no row.
    """
    steps = risk.steps()
    over = [rows[f] > c for f, c in steps]
    free = rows.where(F.col(good).isNull()).groupBy(F.col(stratum).alias("_s")).agg(F.transform(F.array_sort(F.array(*(F.struct(F.sum(x.cast("long")), F.lit(i).alias("i")) for i, x in enumerate(over)))), lambda x: x["i"]).alias("_order"))
    held = rows.where(F.col(good) == 1).select(F.col(stratum), F.array(*over).alias("_over"))
    held = held.join(free, F.col(stratum).eqNullSafe(F.col("_s")), "left").withColumn("_order", F.coalesce("_order", F.array(*map(F.lit, range(len(steps))))))
    # how many steps a row outlives; its first violated one in the stratum's order
    first = F.least(*(F.when(F.get("_over", F.lit(i)), F.array_position("_order", i)) for i in range(len(steps))), F.lit(len(steps) + 1).cast("long"))
    per = held.withColumn("_first", first).groupBy(stratum, "_order").agg(F.count("*").alias("n"), *(F.sum((F.col("_first") <= j).cast("long")).alias(f"_k{j}") for j in range(1, len(steps) + 1)))
    limit = F.lit(risk.delta) / F.count("*").over(Window.partitionBy())
    # rejections only grow along the path, so where a step passes those before it do
    per = per.withColumn("_went", F.greatest(F.lit(0), *(F.when(binomial_tail(F.col(f"_k{j}"), F.col("n"), risk.alpha) <= limit, F.lit(j)) for j in range(1, len(steps) + 1))))
    cut = lambda f: F.least(*(F.when(F.array_position("_order", i) <= F.col("_went"), F.lit(c)) for i, (g, c) in enumerate(steps) if g == f), F.lit(None).cast("double"))
    return per.select(stratum, *(cut(f).alias(f"cut_{f}") for f in risk.grid))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality", risk: Risk = RISK) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ...) for each row.

    labels(id, quality): the rows with quality 1 hold out what must not be rejected; a document labelled twice
    is good if all its labels are 1, null labels don't count. kept is false if the base fails or a feature
    exceeds its stratum's cutoff. Null texts count as empty and fail the base; null ids are judged
    like others but hold out nothing; a null stratum is a stratum. Empty labels give no cutoffs, an empty table an empty
    result. Other columns aren't read.
    """
    stats = written(text_statistics(docs.select(F.col(id_col), F.col(text_col), F.col(stratum).cast("string").alias("_stratum")), id_col, text_col, ("_stratum",)), "quality")
    cuts = risk_cutoffs(_marked(stats, labels, id_col, label_col), "_stratum", "_good", risk)
    return _judged(stats, cuts, risk).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality", risk: Risk = RISK) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns, judged where they are: no text is shuffled.

    Statistics of all rows are made first, as numbers, for the cutoffs; then each text is measured again where it is judged,
    which costs less than to bring the numbers to the texts by a shuffle. Columns may have any names. Nulls, empty texts and tables as
    in quality_verdicts.
    """
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(stratum).cast("string").alias("_stratum"))
    stats = written(text_statistics(sample, "_id", "_text", ("_stratum",)), "quality")
    cuts = written(risk_cutoffs(_marked(stats, labels.withColumnRenamed(id_col, "_id"), "_id", label_col), "_stratum", "_good", risk), "cutoffs")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), F.col(stratum).cast("string").alias("_stratum"))
    return _judged(text_statistics(rows, "_row", "_text", ("_stratum",)), cuts, risk).where("kept").select("_row.*")


def _marked(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Rows that the base passes, with _good: 1 if all labels of the id are 1, 0 if not, null without a label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_labelled")).agg((F.min(label_col) == 1).cast("int").alias("_good"))
    return stats.withColumns(features()).where(~base_failed()).join(known, F.col(id_col) == F.col("_labelled"), "left")


def _judged(stats: DataFrame, cuts: DataFrame, risk: Risk) -> DataFrame:
    """stats with base_failed and kept; strata are few, so their cutoffs are the small side of the join."""
    cuts = cuts.withColumnRenamed("_stratum", "_s")
    out = stats.withColumns(features() | {"base_failed": base_failed()}).join(cuts, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    bad = F.col("base_failed")
    for f in risk.grid:
        bad = bad | F.coalesce(F.col(f) > F.col(f"cut_{f}"), F.lit(False))
    return out.withColumn("kept", ~bad)
