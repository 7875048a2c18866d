"""Splits, matched joins, audits, ledgers and completeness checks over datasets and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import hash_order, ranked


def grouped_split(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """Whole groups in hash order go to `holdout` while their running size stays within the share; the rest is `train`.

    The running sum is over groups, one row each, and in two levels: over 4096 ranges of
    the hash, a table of fixed size, and within each range.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_o", hash_order(seed, group)).withColumn("_range", F.substring("_o", 1, 3))
    ranges = sizes.groupBy("_range").agg(F.sum("_n").alias("_rn"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_before"), F.sum("_rn").over(Window.partitionBy(F.lit(0))).alias("_all"))
    upto = sizes.join(F.broadcast(ranges), "_range").withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_range").orderBy("_o")))
    part = upto.select(group, F.when(F.col("_upto") <= F.col("_all") * share, "holdout").otherwise("train").alias("part"))
    return df.join(part, group)


def length_matched(negatives: DataFrame, positives: DataFrame, id_n: str, id_p: str, size: str, seed: str) -> DataFrame:
    """Each negative with one positive of the same size, by hash. Positives are numbered within a size, so no group is paired in full."""
    p = positives.select(F.col(id_p).alias("positive"), size).withColumn("k", F.row_number().over(Window.partitionBy(size).orderBy(hash_order(seed, "positive"))))
    n = positives.groupBy(size).agg(F.count("*").alias("n"))
    left = negatives.select(F.col(id_n).alias("negative"), size).join(n, size)
    left = left.withColumn("k", (F.pmod(F.conv(F.substring(hash_order(seed, "negative"), 1, 8), 16, 10).cast("long"), F.col("n")) + 1).cast("int"))
    return left.join(p, [size, "k"]).select("negative", "positive", size)


def violations(df: DataFrame, key: Sequence[str], checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows with the first check that they break."""
    return df.select(*key, F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for c, code in checks)).alias("violation")).filter("violation IS NOT NULL")


def completeness(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are missing, unexpected or present more than once."""
    e = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    o = observed.groupBy(*key).agg(F.count("*").alias("_n"))
    both = e.join(o, list(key), "full_outer")
    return both.select(*key, F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate").alias("problem")).filter("problem IS NOT NULL")


def illegal_steps(df: DataFrame, order: Sequence[str], within: Sequence[str], state: str, allowed: dict[str | None, Sequence[str]], any_start: bool = False, may_stay: bool = False) -> DataFrame:
    """Events whose state may not follow the state before them (None: the start). With any_start any state may be the first, with may_stay any may follow itself."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = F.lag(state).over(w)
    legal = (before.isNull() & F.lit(any_start)) | (before.eqNullSafe(F.col(state)) & F.lit(may_stay))
    for was, nexts in allowed.items():
        legal = legal | ((before.isNull() if was is None else before.eqNullSafe(F.lit(was))) & F.col(state).isin(list(nexts)))
    return df.withColumn("before", before).withColumn("_ok", legal).filter(~F.col("_ok")).drop("_ok")


def gap_free_prefix(df: DataFrame, step: str, within: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Steps 0, 1, 2 ... up to the first gap; of several rows for a step the last in order."""
    last = ranked(df, [*within, step], order, "_k").filter("_k = 1").drop("_k")
    w = Window.partitionBy(*within).orderBy(step)
    return last.withColumn("_p", F.row_number().over(w) - 1).filter(F.col(step) == F.col("_p")).drop("_p")


def within_budget(df: DataFrame, order: Sequence[str], within: Sequence[str], cost: str, budget: float) -> DataFrame:
    """Rows in order while their running cost stays within the budget."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def upsert(base: DataFrame, news: DataFrame, key: Sequence[str]) -> DataFrame:
    """base without rows whose key is in news, and news."""
    return base.join(news.select(*key).distinct(), list(key), "left_anti").unionByName(news)
