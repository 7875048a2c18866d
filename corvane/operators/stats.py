"""Run statistics: summaries, quantile flavours, intervals, exact tests, resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_quantile(values: Column, q: float) -> Column:
    """Element floor((n-1) q) of the ordered values: no interpolation."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(q)) + 1).cast("int"))


def round_quantile(values: Column, q: float) -> Column:
    """Element round((n-1) q) of the ordered values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.round((F.size(ordered) - 1) * F.lit(q)) + 1).cast("int"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, asks: Sequence[tuple[str, float, str]], scratch: Callable[[DataFrame], DataFrame], bins: int = 1024) -> DataFrame:
    """Exact elements of each group's ordered values, one column each, by histogram refinement.

    asks: column name, share q, and floor or round: the element of rank floor((n - 1) q)
    or round((n - 1) q), halves away from 0. Every pass counts the values that can still
    be asked for in `bins` equal bins between their least and most, with map-side combine,
    and goes on with the bin that holds the rank and the values that bound it. A group is
    never brought together, however large; passes end once those values are equal, after
    two to four on values that spread. Nulls and NaN are left out; a group without values
    gives no row.
    """
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]
    known = df.select(*(F.col(k).alias(f"v_{k}") for k in keys), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    rank = lambda q, how: (F.floor if how == "floor" else F.round)((F.col("n") - 1) * F.lit(q)).cast("long")
    ends = known.groupBy(*(F.col(f"v_{k}").alias(f"k_{k}") for k in keys)).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("ask"), rank(q, how).alias("rank")) for name, q, how in asks)))
    names = [*(f"k_{k}" for k in keys), "ask"]
    live = scratch(ends.filter("n > 0").select("*", each.alias("x")).select(*names[:-1], "x.ask", "x.rank", "low", "high", F.lit(0).cast("long").alias("below")))
    done = live.limit(0)
    while True:
        done = done.unionByName(live.filter("low = high"))
        live = live.filter("low < high")
        if live.isEmpty():
            break
        rule = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
        for x in same("v_", "k_"):
            rule = rule & x
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).alias("bin")
        counts = known.join(live, rule).groupBy(*names, "rank", "below", place).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*names).orderBy("bin")) + F.col("below")  # `bins` rows
        found = counts.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        live = scratch(found.select(*names, "rank", "low", "high", (F.col("upto") - F.col("c")).alias("below")))
    return done.groupBy(*(F.col(f"k_{k}").alias(k) for k in keys)).agg(*(F.max(F.when(F.col("ask") == name, F.col("low"))).alias(name) for name, _, _ in asks))


# fixed values: shares and number of a family's statistics, and its position ranges where no record has sites
FAMILY_SHARES = (("low", 0.05), ("middle", 0.5), ("high", 0.95))
TOP_MOTIFS = 12
POSITION_RANGES = {"serine": (0.45, 0.75), "aspartate": (0.72, 0.92), "histidine": (0.82, 0.98)}


def family_stats(df: DataFrame, sequence: str, motifs: Column, sites: Column, scratch: Callable[[DataFrame], DataFrame], top: int = TOP_MOTIFS) -> DataFrame:
    """One row: length quantiles, the most frequent motifs (ties by name), and 5 to 95 percent ranges of the relative positions of S, D and H.

    sites: places (from 1) in the sequence, of which the first three in order must be
    S, D and H for a record's positions to count.
    """
    rows = df.select(F.col(sequence).alias("s"), motifs.alias("motifs"), sites.alias("sites"))
    place = F.slice(F.array_sort(F.filter("sites", lambda p: (p >= 1) & (p <= F.length("s")))), 1, 3)
    letter = F.array_join(F.transform(place, lambda p: F.substring(F.col("s"), p, F.lit(1))), "")
    share = F.when(letter == "SDH", F.transform(place, lambda p: p / F.length("s")))
    rows = scratch(rows.select(F.length("s").alias("n"), "motifs", share.alias("share")))  # sequences are read once
    out = order_statistics(rows, [], "n", [(name, q, "floor") for name, q in FAMILY_SHARES], scratch)
    counts = rows.select(F.explode("motifs").alias("motif")).groupBy("motif").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "motif").limit(top)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "motif"))), lambda x: x["motif"])
    out = out.join(counts.agg(ranked.alias("motifs")), F.lit(True), "full")  # one row and one row of `top`
    fit = rows.filter("share IS NOT NULL").select(*(F.element_at("share", k + 1).alias(name) for k, name in enumerate(POSITION_RANGES)))
    for name, (low, high) in POSITION_RANGES.items():
        found = order_statistics(fit, [], name, [(f"{name}_low", 0.05, "floor"), (f"{name}_high", 0.95, "floor")], scratch)
        out = out.join(found, F.lit(True), "left").fillna({f"{name}_low": low, f"{name}_high": high})
    return out


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, population deviation, least, median, 5 and 95 percent (interpolated), nearest-rank 90 percent, most."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.min(v).alias("least"), F.percentile(v, 0.5).alias("median"),
        F.percentile(v, 0.05).alias("p05"), F.percentile(v, 0.95).alias("p95"), F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{value}`)").alias("p90_rank"), F.max(v).alias("most"),
    )


def auc(df: DataFrame, keys: Sequence[str], value: str, positive: Column) -> DataFrame:
    """Share of positive-negative pairs that are in order, ties half: from mean ranks, not from pairs.

    Equal values are counted first, so the ordered pass sees one row a distinct value.
    """
    counts = df.groupBy(*keys, value).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = counts.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    return w.groupBy(*keys).agg(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")).alias("auc"))


# fixed values: two-sided 95 percent t quantiles by sample size; other sizes use the normal one
T_QUANTILES = {3: 4.3026527297, 6: 2.5705818356}
NORMAL = 1.9599639845


def mean_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and 95 percent interval; a single value is its own interval."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"), F.count_if(F.col(value) > 0).alias("positive"))
    t = F.coalesce(*(F.when(F.col("n") == k, F.lit(x)) for k, x in T_QUANTILES.items()), F.lit(NORMAL))
    half = F.when(F.col("n") > 1, t * F.col("s") / F.sqrt("n")).otherwise(0.0)
    return g.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "positive")


def sign_flip(df: DataFrame, keys: Sequence[str], value: str, order: str, most: int = 16) -> DataFrame:
    """Exact two-sided sign-flip test of the mean over all 2^n sign choices. Groups have at most `most` values."""
    g = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    g = g.withColumn("v", F.when(F.size("v") > most, F.raise_error(F.lit("too many values for an exact test"))).otherwise(F.col("v")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    flips = F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("v")).cast("int") - 1))
    d = g.select(*keys, "v", F.abs(total).alias("seen"), flips.alias("mask"))
    flipped = F.aggregate(
        F.zip_with("v", F.sequence(F.lit(0), F.size("v") - 1), lambda x, i: F.when(F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2 == 1, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x
    )
    return d.groupBy(*keys).agg(F.count("*").alias("permutations"), F.avg((F.abs(flipped) >= F.col("seen") - 1e-12).cast("double")).alias("p_value"))


def seed_bootstrap(df: DataFrame, model: str, unit: str, value: str, samples: int, seed: str) -> DataFrame:
    """Two-level bootstrap: units drawn within each model, means over models; 95 percent interval of the draws.

    Draws come from a hash of (seed, sample, model, place), so they do not depend on partitioning.
    """
    ranked = df.select(model, value, (F.row_number().over(Window.partitionBy(model).orderBy(unit)) - 1).alias("place"), F.count("*").over(Window.partitionBy(model)).alias("size"))
    draws = ranked.select(model, "size", "place", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"))
    pick = F.pmod(F.xxhash64(F.lit(seed), "draw", model, "place"), F.col("size")).cast("int")
    chosen = draws.select("draw", model, pick.alias("place")).join(ranked.select(model, "place", value), [model, "place"])
    means = chosen.groupBy("draw", model).agg(F.avg(value).alias("m")).groupBy("draw").agg(F.avg("m").alias("m"))
    return means.agg(F.count("*").alias("samples"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def contrasts(df: DataFrame, keys: Sequence[str], arm: str, treatment: str, control: str, value: str) -> DataFrame:
    """Treatment minus control of the same keys, where both exist."""
    g = df.groupBy(*keys).agg(F.max(F.when(F.col(arm) == treatment, F.col(value))).alias("t"), F.max(F.when(F.col(arm) == control, F.col(value))).alias("c"))
    return g.filter("t IS NOT NULL AND c IS NOT NULL").select(*keys, (F.col("t") - F.col("c")).alias("delta"))


#: Most distinct calibration values that share_below takes to every task (16 MB).
MAX_CALIBRATION = 1_000_000


def share_below(df: DataFrame, calibration: DataFrame, value: str, against: str, name: str = "percentile", most: int = MAX_CALIBRATION) -> DataFrame:
    """Share of calibration values at or below each value (0 without calibration, null for null).

    Up to `most` distinct values go to the tasks as one sorted array, where each batch is
    one binary search. Beyond that, values and calibration are dealt over ranges that hold
    about equal parts of the calibration, and counted within each.
    """
    known = calibration.select(F.col(against).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    counts = known.groupBy("_v").agg(F.count("*").alias("_k"))
    if counts.count() > most:
        return _share_by_ranges(df, known, value, name)
    rows = sorted((r["_v"], r["_k"]) for r in counts.collect())
    ordered, upto = np.array([v for v, _ in rows], np.float64), np.cumsum([0, *(k for _, k in rows)])

    @F.pandas_udf("double")
    def share(x: pd.Series) -> pd.Series:
        at = upto[np.searchsorted(ordered, x.to_numpy(np.float64), side="right")] / max(1, upto[-1])
        return pd.Series(at).where(x.notna(), None)

    return df.withColumn(name, share(F.col(value).cast("double")))


def _share_by_ranges(df: DataFrame, known: DataFrame, value: str, name: str, ranges: int = 4096) -> DataFrame:
    """share_below over more distinct values than a task may hold. The cuts only balance the ranges; the counts are exact."""
    cuts = np.array(sorted(set(known.approxQuantile("_v", [i / ranges for i in range(1, ranges)], 0.0005))))

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(np.float64), side="left").astype(np.int32))

    kept = known.groupBy("_v").agg(F.count("*").alias("_k")).withColumn("_r", place("_v"))
    sums = np.zeros(len(cuts) + 2, np.int64)
    for r in kept.groupBy("_r").agg(F.sum("_k").alias("_k")).collect():  # a row a range
        sums[r["_r"] + 1] = r["_k"]
    before = np.cumsum(sums).tolist()
    asked = df.select(F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").distinct().withColumn("_r", place("_v"))
    both = kept.select("_r", "_v", "_k").union(asked.select("_r", "_v", F.lit(0).cast("long")))
    w = Window.partitionBy("_r").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_k").over(w) + F.element_at(F.array(*map(F.lit, before)), F.col("_r") + 1)
    shares = both.withColumn("_upto", upto).groupBy("_v").agg((F.max("_upto") / F.lit(float(before[-1]))).alias(name))
    return df.withColumn("_v", F.col(value).cast("double")).join(shares, "_v", "left").select(*df.columns, name)


def structural_grades(df: DataFrame, calibration: DataFrame, measures: Sequence[tuple[str, bool]]) -> DataFrame:
    """`grade`: mean of each row's percentiles among the calibration's values of the same columns.

    measures: column, and whether larger is better (share at or below) or smaller is
    (share at or above). A null value, or a column that the calibration lacks, does not count.
    """
    names = []
    for column, larger in measures:
        known = calibration.select((F.col(column) if larger else -F.col(column)).alias("_c")).filter("_c IS NOT NULL")
        if not known.isEmpty():
            names.append(f"_share_{column}")
            df = share_below(df.withColumn("_x", F.col(column) if larger else -F.col(column)), known, "_x", "_c", names[-1]).drop("_x")
    parts = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<double>")
    return df.withColumn("grade", F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts))).drop(*names)


def product_of_experts(rows: DataFrame, sample: str, position: str, token: str, teacher: str, logprob: str, weights: dict[str, float], missing: float, top: int) -> DataFrame:
    """Per position the `top` tokens by weighted sum of log-probabilities, a missing one counting as `missing`; weights sum to 1 over the kept."""
    total = sum(weights.values())
    w = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, v / total)))
    scored = rows.groupBy(sample, position, token).agg(F.sum(w[F.col(teacher)] * (F.col(logprob) - missing)).alias("gain"), F.count("*").alias("coverage"))
    scored = scored.withColumn("combined", F.col("gain") + missing)
    k = Window.partitionBy(sample, position).orderBy(F.desc("combined"), token)
    kept = scored.withColumn("rank", F.row_number().over(k)).filter(F.col("rank") <= top)
    p = Window.partitionBy(sample, position)
    top_one = F.max("combined").over(p)
    kept = kept.withColumn("weight", F.exp(F.col("combined") - top_one)).withColumn("weight", F.col("weight") / F.sum("weight").over(p))
    return kept.select(sample, position, token, "rank", "coverage", "combined", "weight")
