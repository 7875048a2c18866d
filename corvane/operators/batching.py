"""Batches of texts by length: greedy, from long to short, within a count, a span of lengths and a cost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cuts(classes: Iterator[pd.DataFrame], size: int, span: int, cost_limit: int, overhead: int) -> Iterator[pd.DataFrame]:
    """For each length, from long to short: how many of its rows the open batch takes and where that batch stands, then how many go to each batch after it.

    Rows of one length are alike to the greedy rule, so its state moves a length at a
    time: a batch number, its longest length, its rows and its cost.
    """
    batch, longest, held, spent = -1, 0, 0, 0
    for frame in classes:
        out = []
        for length, n in zip(frame["length"].tolist(), frame["n"].tolist(), strict=True):
            cost = max(1, length - overhead)
            room = 0
            if held and longest - length <= span:
                room = size - held
                if cost_limit > 0:
                    room = max(0, min(room, (cost_limit - spent) // cost))
            taken = min(n, room)
            each = size if cost_limit <= 0 else max(1, min(size, cost_limit // cost))
            out.append((length, taken, batch, held, each))
            held, spent, rest = held + taken, spent + taken * cost, n - taken
            if rest:
                batch += -(-rest // each)
                longest, held = length, (rest - 1) % each + 1
                spent = held * cost
        yield pd.DataFrame(out, columns=["length", "taken", "batch", "held", "each"])


def length_batches(rows: DataFrame, id_col: str, text: str, size: int = 16, span: int = 32, cost_limit: int = 0, overhead: int = 2) -> DataFrame:
    """Rows with `length`, `batch` and `slot`, as one greedy pass from long to short texts would batch them.

    A batch is closed before a row that would make it more than `size` rows, span more
    than `span` in length, or cost more than `cost_limit` (0: no limit); a row costs its
    length less `overhead`, at least 1. A row that alone costs more has a batch of its
    own. Texts of one length come in order of the MD5 of their id. Null texts have length 0,
    rows without an id come first of their length.

    The greedy pass is over counts of lengths, in one task: as many rows as there are
    different lengths, whatever the number of texts. Texts themselves are not moved.
    """
    if size < 1 or span < 0:
        raise ValueError("size must be at least 1 and span at least 0")
    slice_of = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    lengths = rows.select(F.col(id_col), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("length"), slice_of.alias("_md5")).withColumn("_slice", F.substring("_md5", 1, 2))
    # a length may hold most rows: they are counted and ranked in slices of the MD5
    slices = lengths.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    one = slices.groupBy("length").agg(F.sum("n").alias("n")).repartition(1).sortWithinPartitions(F.desc("length"))
    cuts = one.mapInPandas(lambda frames: _cuts(frames, size, span, cost_limit, overhead), "length long, taken long, batch long, held long, each long")
    # what belongs to a length is joined to its slices first, so rows meet it by length and slice, where they are, never by a hot length
    begin = slices.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("n")).drop("n").join(cuts, "length")
    place = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_md5", id_col)) - 1
    ranked = lengths.withColumn("_place", place).join(begin, ["length", "_slice"]).withColumn("rank", F.col("_before") + F.col("_place"))
    joined = F.col("rank") < F.col("taken")
    return ranked.select(
        id_col, "length",
        F.when(joined, F.col("batch")).otherwise(F.col("batch") + 1 + F.expr("(rank - taken) div each")).alias("batch"),
        F.when(joined, F.col("held") + F.col("rank")).otherwise((F.col("rank") - F.col("taken")) % F.col("each")).alias("slot"),
    )


def batch_report(batches: DataFrame, overhead: int = 2) -> DataFrame:
    """For each batch: rows, shortest and longest length, cost, and the share of a rectangle of its longest length that stays empty."""
    cost = F.greatest(F.col("length") - overhead, F.lit(1))
    report = batches.groupBy("batch").agg(F.count("*").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.sum(cost).alias("cost"), F.sum("length").alias("_all"))
    return report.withColumn("padding", F.when(F.col("longest") > 0, 1 - F.col("_all") / (F.col("longest") * F.col("n"))).otherwise(0.0)).drop("_all")
