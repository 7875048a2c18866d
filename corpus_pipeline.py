"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
documents; the last returns packed pieces. A stage sees only what the one before kept,
and its decisions take effect: rejected, duplicate and contaminated documents go, and
personal data is masked in the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import corpus
from corvane.llm.decontaminate import without_leaks
from corvane.llm.ngram_join import ngram_join
from corvane.llm.packing import pack
from corvane.llm.pii import mask_pii
from corvane.llm.quality import fit_voters, keep_good
from corvane.llm.url_filter import without_keys

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; texts it knows nothing of stay with the majority."""
    voters = fit_voters(docs, corpus.table(spark, sf_dir, "labels"), corpus.id_crc("doc_id", 3) != 1)
    return keep_good(docs, voters)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): of those with the smallest doc_id the first by text hash.

    Rows without an id belong to no group; of those with equal texts one stays.
    """
    classes = corpus.written(ngram_join(docs, shingle=5, threshold=80).select("doc_id", "component_id"), "classes")
    gone = corpus.written(classes.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = without_keys(docs, "doc_id", gone)  # texts that surely stay do not move
    again = classes.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():  # as where ids are keys: the texts need not move again
        return kept
    repeats = F.col("doc_id").eqNullSafe(F.col("again"))
    single = kept.join(again, repeats, "left_anti")
    # rows of one id, or of one text without an id, meet as one row a task
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text")).alias("row")
    apart = F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    many = kept.join(again, repeats, "left_semi").groupBy("doc_id", apart.alias("apart")).agg(first)
    return single.unionByName(many.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, corpus.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars counts the new text."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the edit search; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = corpus.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = corpus.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
