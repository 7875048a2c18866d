"""Views that several queries share, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table that one task takes.
TASK_ROWS = 50_000


def spread(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """df with about TASK_ROWS rows a task: files of few bytes may hold many rows, which Spark would give to one task."""
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), key)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of every document as one sequence."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.letters("text").alias("sequence"), "text")


SEQUENCES = "SELECT doc_id, lang, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence, text FROM documents"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as evaluated candidates: gates, scores and bucket columns."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.format_string("cand-%06d", k).alias("candidate_id"),
        "lang",
        "source",
        F.length("text").cast("long").alias("length"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("hard_gate_pass"),
        F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("artifact_free"),
        (k % 3 != 0).alias("context_pass"),
        (k % 5 != 0).alias("family_pass"),
        (k % 101 >= 30).alias("fold_pass"),
        (k * 37 % 1000 <= 900).alias("novelty_pass"),
        (k % 7 == 0).alias("audit_pass"),
        (k * 7919 % 1000 / 1000.0).alias("score"),
        (k * 37 % 1000 / 1000.0).alias("novelty"),
        (k % 101).cast("double").alias("fold"),
        F.when(k % 11 != 0, k * 13 % 60).alias("gap_error"),
        F.sha2("text", 256).alias("text_hash"),
    )


CANDIDATES = """
    SELECT d.doc_id, printf('cand-%06d', d.doc_id) AS candidate_id, lang, source, length(text)::BIGINT AS length,
           coalesce(quality = 1, true) AS hard_gate_pass, coalesce(toxic = 0, true) AS artifact_free,
           d.doc_id % 3 <> 0 AS context_pass, d.doc_id % 5 <> 0 AS family_pass, d.doc_id % 101 >= 30 AS fold_pass,
           d.doc_id * 37 % 1000 <= 900 AS novelty_pass, d.doc_id % 7 = 0 AS audit_pass,
           (d.doc_id * 7919 % 1000)::DOUBLE / 1000 AS score, (d.doc_id * 37 % 1000)::DOUBLE / 1000 AS novelty,
           (d.doc_id % 101)::DOUBLE AS fold, CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id * 13 % 60 END AS gap_error,
           sha256(text) AS text_hash
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def with_candidates(sql: str) -> str:
    return f"WITH c AS ({CANDIDATES}) {sql}"


def with_sequences(sql: str) -> str:
    return f"WITH s AS ({SEQUENCES}) {sql}"
