"""A training corpus from documents in five stages, each one operator of engram.llm.

Every stage but the last returns the columns of its input, which may be any besides doc_id, text, lang and source, and may
have no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.llm._base import table, unused, word_count, written
from engram.llm.decontaminate import without_leaks
from engram.llm.minhash import minhash_components
from engram.llm.mixing import mixed, repeated
from engram.llm.quality import quality_filtered
from engram.llm.tokens import token_output

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep; null and empty texts go, each repeated row is judged alike."""
    return quality_filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the least id.

    Rows are what is compared, by numbers of their own in a written table: rows of one id with different texts are two documents,
    equal rows are copies. Ids that tie, and null ids, which come last, are in order of a hash of the text. Documents
    without words have no copies and stay.
    """
    row = unused(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = minhash_components(rows.select(row, "text"), id_col=row, ngram=5, numerator=80, denominator=100)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    grouped = written(found.select(row, "component_id").join(rows.select(row, order.alias("order")), row), "groups")
    stay = grouped.groupBy("component_id").agg(F.min("order")[row].alias(row)).select(row)
    gone = written(grouped.select(row).join(stay, row, "left_anti"), "copies")
    return rows.join(gone.hint("merge"), row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts and null ids stay."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; a null source is one, null texts have size 0."""
    size = unused(docs, "_words")
    return repeated(mixed(docs.withColumn(size, word_count(F.col("text"))), size_col=size)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the written corpus, read back from its files; a null text has the end id alone."""
    return token_output(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("source mixture", mixture), ("token output", tokens)]

#: SQL has neither the tokenizer nor the files; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
