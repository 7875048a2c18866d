"""Operator 8, exact top-k search: pivot-table elimination.

Vectors are quantised to integers and scored by inner product. With one more
coordinate that brings every vector to the same length R, and a zero for queries,
|q - x|^2 = |q|^2 + R^2 - 2 q.x: a larger score is a smaller Euclidean distance, so the
triangle inequality bounds it. The pivot table, written once beside the vectors, holds
each one's distance to many pivots; for a query the largest |d(q, p) - d(x, p)| over the
pivots is a lower bound of its distance. Candidates are scored in order of that bound, a
few at a time, until the next bound cannot beat the k-th score: the rest is never
scored, and the result is exact. The k-th score starts at what the query reaches among
the sampled vectors, which are candidates themselves, so the first rows of a task are
pruned like the last.

Queries are a stated set, taken QUERY_BLOCK at a time: a block of bounded size goes to
every task of one scan of the pivot table, and each task returns k rows a query for each
of its batches. Nothing but those rows is shuffled. Pivots come from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import written

TOP = 10
SCALE = 1024
PIVOTS = 32
PIVOT_SAMPLE = 2048
QUERY_BLOCK = 4096
_STEP = 512
_EXACT = 2.0**53  # whole numbers up to here are exact as float64

_TABLE = "vec_id long, v array<long>, far array<double>"
_FOUND = "query_id long, vec_id long, score long"


def _usable(rows: DataFrame) -> DataFrame:
    """Ids with quantised vectors; rows with a null id, vector or component, or one that is not finite, go."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good = good & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(F.lit(SCALE) * x)).alias("v"))


def _matrix(column: pa.Array, size: int, exact: bool) -> np.ndarray:
    """Rows of a list column; as float64, whose products run fastest, where it holds all numbers and sums exactly."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if exact else np.int64).reshape(-1, size)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray, radius2: float) -> np.ndarray:
    """Distance of each row to each pivot, all brought to length sqrt(radius2) by one more coordinate."""
    norm2, pivot2 = (rows.astype(np.float64) ** 2).sum(1), (pivots.astype(np.float64) ** 2).sum(1)
    lift, pivot_lift = np.sqrt(np.maximum(radius2 - norm2, 0)), np.sqrt(np.maximum(radius2 - pivot2, 0))
    return np.sqrt(np.maximum(norm2[:, None] + pivot2 - 2 * (rows @ pivots.T) + (lift[:, None] - pivot_lift) ** 2, 0))


class Block:
    """A bounded block of queries: their distances to the pivots and the k-th score that each surely reaches."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, pivots: np.ndarray, radius2: float, top: int = TOP, sample: np.ndarray | None = None, sample_ids: np.ndarray | None = None):
        self.queries, self.ids, self.radius2, self.top = queries, ids, radius2, top
        self.norm2 = (queries.astype(np.float64) ** 2).sum(1)
        pivot2 = (pivots.astype(np.float64) ** 2).sum(1)
        self.far = np.sqrt(np.maximum(self.norm2[:, None] + radius2 - 2 * (queries @ pivots.T), 0)) if len(pivots) else np.zeros((len(queries), 0))
        self.slack = 1e-6 * (np.sqrt(radius2) + np.sqrt(self.norm2.max(initial=0))) + 1e-9
        self.floor = [-np.inf] * len(ids)
        if sample is not None and pivot2.size:
            for i, q in enumerate(queries):
                score = np.sort((sample @ q)[sample_ids != ids[i]])[::-1]
                if len(score) >= top:
                    self.floor[i] = float(score[top - 1])

    def reach(self, i: int, score: float) -> float:
        """The distance at which a row has this score."""
        return np.sqrt(max(self.norm2[i] + self.radius2 - 2.0 * score, 0.0)) + self.slack

    def search(self, rows: np.ndarray, ids: np.ndarray, table: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
        """The top rows for each query that can be among its best: (query, row, score); and how many rows were scored."""
        out, scored = [], 0
        columns = np.ascontiguousarray(table.T)
        for i, q in enumerate(self.queries):
            bound = np.zeros(len(rows))
            for column, d in zip(columns, self.far[i], strict=True):
                np.maximum(bound, np.abs(column - d), out=bound)
            limit = self.reach(i, self.floor[i]) if np.isfinite(self.floor[i]) else np.inf
            near = np.flatnonzero(bound <= limit)
            order = near[np.argsort(bound[near], kind="stable")]
            best_score, best_id = np.zeros(0, rows.dtype), np.zeros(0, np.int64)
            at = 0
            while at < len(order):
                # no row behind here can be nearer than its bound
                if len(best_score) == self.top and bound[order[at]] > self.reach(i, float(best_score[-1])):
                    break
                block = order[at : at + _STEP]
                at += len(block)
                block = block[ids[block] != self.ids[i]]
                scored += len(block)
                score = np.concatenate([best_score, rows[block] @ q])
                who = np.concatenate([best_id, ids[block]])
                first = np.lexsort((who, -score))[: self.top]
                best_score, best_id = score[first], who[first]
            out += [(int(self.ids[i]), int(w), int(s)) for s, w in zip(best_score, best_id, strict=True)]
        return out, scored


def _add_distances(pivots: np.ndarray, radius2: float, size: int, exact: bool):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_matrix(batch.column("v"), size, exact), pivots, radius2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "far"])

    return add


def _search(block: Block, size: int, exact: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _matrix(batch.column("far"), len(batch.column("far")[0]), True)
                found, _ = block.search(_matrix(batch.column("v"), size, exact), batch.column("vec_id").to_numpy(), far)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["query_id", "vec_id", "score"])

    return search


def exact_topk(rows: DataFrame, every: int = 100, top: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """The top rows by integer inner product for each row whose vec_id is divisible by `every`.

    rows: vec_id long, embedding array of numbers; other columns are not read. Each
    component x counts as floor(1024 * x). A query's candidates are all rows of another
    vec_id; ties go to the smaller vec_id. Returns query_id, rank (from 1), vec_id,
    score; fewer rows where there are fewer candidates.

    Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part. A shorter vector counts as filled up with zeros. A vec_id that occurs
    several times is as many candidates, and as a query stands for its smallest vector.
    Scores must fit in 64 bits. Empty: no rows.
    """
    spark = rows.sparkSession
    kept = _usable(rows)
    shape = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x * x)).alias("norm2")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, radius2 = shape["size"], float(shape["norm2"])
    exact = radius2 < _EXACT
    kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))))
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).collect()
    kind = np.float64 if exact else np.int64
    vectors = np.array([r["v"] for r in sample], kind).reshape(-1, size)
    chosen = choose_pivots(vectors, pivots)
    table = written(kept.mapInArrow(_add_distances(chosen, radius2, size, exact), _TABLE), "pivots")
    asked = table.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() * 5 // (4 * QUERY_BLOCK)))
    near = spark.createDataFrame([], _FOUND)
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()  # some QUERY_BLOCK rows
        if part:
            queries = Block(np.array([r["v"] for r in part], kind).reshape(-1, size), np.array([r["vec_id"] for r in part], np.int64), chosen, radius2, top, vectors, np.array([r["vec_id"] for r in sample], np.int64))
            near = near.union(table.mapInArrow(_search(queries, size, exact), _FOUND))
    # of a query's k rows from each batch the k best; Spark limits each task's groups before the exchange
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
