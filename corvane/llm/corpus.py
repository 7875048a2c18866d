"""What the llm operators share: reading, batching, scratch space, checksums, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python worker holds at a time.
BATCH_BYTES = 8 << 20
#: Text bytes whose hashes one shard holds.
SHARD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir).

    Where the session names none, a local master gets a folder of its own: driver and
    executors are one process there. On a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        root = context.getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, into: str | None = None) -> DataFrame:
    """df, written once to the shared folder (or a folder in it) and read again: its lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{into}/{name}-{uuid.uuid4().hex}" if into else scratch(spark, name)
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that no result reads any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches_and_shards(docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """Numbers of document batches and of hash shards that bound what a worker holds, and keep every core busy."""
    total = int(docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)
    least = partitions(docs.sparkSession)
    return max(least, -(-total // batch_bytes)), max(least, -(-total // shard_bytes))


def batch_key(count: int) -> Column:
    """The batch of a row, by id and text: rows without an id, or of one id, spread over the batches."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")


def id_crc(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)), F.lit(0).cast("long"))


#: Rows and text bytes that a fit takes to the driver at most (one text of each label beyond that).
SAMPLE_ROWS = 100_000
SAMPLE_BYTES = 64 << 20


def _place(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(1 << 30))


def bounded_sample(rows: DataFrame, label: str, id_col: str, per_label: int, *others: str) -> DataFrame:
    """About per_label rows of each label (fewer of each where there are very many labels), never more than twice that in all.

    Rows are chosen by a hash of the id (and other columns), so only labels are counted
    and the choice is the same for any partitioning; where ids repeat so often that the
    bound bites, the first by hash stay.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    labels = counts.count()
    if not labels:
        return rows.limit(0)
    each = max(1, min(per_label, SAMPLE_ROWS // labels))
    share = counts.select(F.col(label).alias("_label"), F.least(F.lit(1 << 30), F.ceil(F.lit((1 << 30) * each) / F.col("_n"))).alias("_share"))
    kept = rows.join(F.broadcast(share), F.col(label) == F.col("_label"))  # a row a label
    place = _place(id_col, *others)
    kept = kept.filter(place < F.col("_share")).orderBy(place / F.col("_share"), id_col, label, *others).limit(2 * each * labels)
    return kept.select(*rows.columns)


def bounded_texts(rows: DataFrame, id_col: str, most: int = 2 * SAMPLE_ROWS) -> list[Row]:
    """The rows (with a column text) in hash order on the driver, as far as `most` rows and SAMPLE_BYTES of text allow; one at least."""
    order = [_place(id_col, "text"), F.col(id_col), F.col("text")]
    sizes = [r["n"] or 0 for r in rows.orderBy(*order).limit(most).select(F.octet_length("text").alias("n")).collect()]
    total, kept = 0, 0
    while kept < len(sizes) and (not kept or total + sizes[kept] <= SAMPLE_BYTES):
        total, kept = total + sizes[kept], kept + 1
    return rows.orderBy(*order).limit(kept).collect()
