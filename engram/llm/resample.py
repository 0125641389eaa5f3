"""Importance resampling towards a target corpus by hashed n-gram gains, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._base import dropped, written

#: Code points between words: ASCII without letters and digits.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SEPARATOR_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one sorted range, about, and the most ranges: their offsets are broadcast.
RANGE_ROWS, MOST_RANGES = 1 << 18, 20_000


def words(text: Column) -> Column:
    """array<string> of a text's words in their own case; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SEPARATOR_RUN))


def _lower(s: Column) -> Column:
    """A-Z lowered and nothing else; for ASCII that is lower(), which is faster than translate()."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, _UP, _LOW))


def grams(tokens: Column, most: int) -> Column:
    """array<string> of all runs of 1 to most consecutive tokens, joined by one space."""
    if most == 1:
        return tokens

    def spans(w: Column, k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: i + k <= F.size(w))
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))

    def runs(w: Column) -> Column:  # w is the tokens made once, not anew for each run
        return F.concat(w, *(spans(w, k) for k in range(2, most + 1)))

    return F.flatten(F.transform(F.array(tokens), runs))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(_lower(gram).cast("binary")), F.lit(buckets).cast("long"))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, most: int) -> DataFrame:
    """(bucket, n): features of all texts by crc32 modulo buckets. A task sends one row a bucket at most."""
    features = texts.select(F.explode(grams(words(F.col(text_col)), most)).alias("g"))
    return features.groupBy(_bucket(F.col("g"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, text_col: str, target_text_col: str, buckets: int, most: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

    s and t count a bucket's features in docs and target, S and T all of them. One row a bucket, so its
    window and its broadcasts are bounded by buckets.
    """
    n = lambda c: F.col(c).cast("double")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, of in (("s", bucket_counts(docs, text_col, buckets, most)), ("t", bucket_counts(target, target_text_col, buckets, most))):
        both = both.join(of.select("bucket", F.col("n").alias(name)), "bucket", "left")
    both = both.fillna(0, ["s", "t"])
    every = Window.partitionBy()
    both = both.withColumn("all_s", F.sum("s").over(every)).withColumn("all_t", F.sum("t").over(every))
    ratio = (n("t") + 1.0) * (n("all_s") + float(buckets)) / ((n("s") + 1.0) * (n("all_t") + float(buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for u from the first 32 bits of sha256('seed:id'); a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, most: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of docs: a sample without replacement, by Gumbel top-k, in proportion to exp(weight / 1000).

    weight is the floored mean of the gains of a document's features (0 without any), score adds Gumbel noise that depends on the
    id and the seed alone. Of the N documents with least_words words the floor(percent * N / 100) highest scores are drawn and
    ranked from 1; rank is null for the others.

    The texts are read twice, once for the bucket counts and once where each feature meets the gain table, which is
    broadcast (one row a bucket). A document's features are summed where they are, so a row a document is shuffled,
    whatever its length. The ranks come from one distributed sort: a row's place in its range plus the rows of the ranges before.

    Null and blank texts have no features, weight 0 and are not drawn; a null id is hashed as empty and goes last among
    ties. Equal scores go by smaller id, then weight, then features; rows repeated as a whole are ranked one by one. An empty
    target or an empty table is no error. Other columns aren't read and may have any names.
    """
    spark = docs.sparkSession
    gains = written(gain_table(docs, target, text_col, target_text_col, buckets, most), "gains")
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    features = rows.select("row", "id", F.size("w").alias("n_words"), F.explode_outer(grams(F.col("w"), most)).alias("g"))
    met = features.withColumn("bucket", _bucket(F.col("g"), buckets)).join(F.broadcast(gains), "bucket", "left")
    sums = met.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    scored = sums.select("id", "n_features", weight.alias("weight"), (weight + gumbel(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    scored = written(scored, "scores")
    dropped(gains)

    count, able = scored.agg(F.count("*"), F.count_if("able")).first()
    drawn = percent * able // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), "weight", "n_features"]
    ranges = min(MOST_RANGES, max(1, -(-count // RANGE_ROWS), spark.sparkContext.defaultParallelism))
    place = F.monotonically_increasing_id()  # 31 bits of the partition, 33 of the row within it
    placed = scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", place)
    placed = written(placed.select("*", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).drop("place"), "sorted")
    dropped(scored)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("at") + 1
    out = placed.join(F.broadcast(offsets), "part")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))
