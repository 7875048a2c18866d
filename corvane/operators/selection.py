"""Ranking, capped selection, Pareto fronts and greedy picks.

Rank- and cap-based selections are windows. Selections whose every step depends on all
picks before it are settled in rounds: several caps at once by reservations, leaders and
spread panels as the greedy independent set of a graph of near texts. Farthest-first makes
one distributed pass a pick. None has a limit on its rows, and none reads them on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.sources.records import scratch_table

from .similarity import class_pairs, text_classes


class Shortfall(ValueError):
    """A selection found fewer rows than were asked for."""


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row number within keys (1 is first)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return ranked(df, keys, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def pool_or_first(df: DataFrame, keys: Sequence[str], passing: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first n passing rows of each group, or its first row if none passes."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_pass", F.coalesce(passing, F.lit(False)))
    out = out.withColumn("_any", F.max(F.col("_pass")).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_pass"), *order)))
    return out.filter(F.when(F.col("_any"), F.col("_pass") & (F.col("_rank") <= n)).otherwise(F.col("_rank") == 1)).drop("_pass", "_any", "_rank")


def best_by_level(df: DataFrame, keys: Sequence[str], levels: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row a group: from the first level that any row meets, the first in order. The level is returned."""
    level = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(levels)), F.lit(len(levels)))
    return ranked(df.withColumn("level", level), keys, [F.col("level"), *order], "_rank").filter("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def capped(df: DataFrame, key: str, order: Sequence[Column], cap: int, top: int) -> DataFrame:
    """The first `top` rows in order among those within the cap of their key."""
    return top_per_group(df, [key], order, cap).orderBy(*order).limit(top)


def round_robin(df: DataFrame, source: str, order: Sequence[Column], cap: int, top: int) -> DataFrame:
    """One row of each source in turn, sources by name, each source in order, up to the cap."""
    out = ranked(df, [source], order, "turn").filter(F.col("turn") <= cap)
    return out.orderBy("turn", source).limit(top)


def in_one_task(df: DataFrame, order: Sequence[Column], schema: str | StructType, fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """A fold over few rows in order, in bounded chunks of one sorted stream; the fold carries its state."""
    return df.repartition(1).sortWithinPartitions(*order).mapInPandas(fold, schema)


def multi_capped(df: DataFrame, caps: dict[str, int], order: Sequence[Column], top: int, strict: bool = False, scratch: Callable[[DataFrame], DataFrame] = scratch_table) -> DataFrame:
    """Greedy: take a row if no key of it has reached its cap yet, until there are `top`. A null key is a key like others.

    In rounds of reservations: a row is taken once it is within every cap among the rows
    ahead of it that are not refused, and refused once rows ahead of it fill a cap. The
    first undecided row is decided in each round, in practice most are. Ranks stop at the
    cap, which Spark applies in each task before it shuffles, so a hot key costs its cap a
    task; rows behind the last place that can count are dropped.
    """
    placed = scratch(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))  # ascends with the order
    undecided, taken = placed.select("_at", *caps), placed.select("_at", *caps).limit(0)
    while min(caps.values(), default=1) > 0 and top > 0:
        pool, within = taken.unionByName(undecided), None
        for k, cap in caps.items():
            near = top_per_group(pool, [k], [F.col("_at")], cap).select("_at")
            within = near if within is None else within.join(near, "_at", "left_semi")
        taken = scratch(pool if within is None else pool.join(within, "_at", "left_semi"))
        rest = undecided.join(taken.select("_at"), "_at", "left_anti")
        for k, cap in caps.items():
            full = ranked(taken, [k], [F.col("_at")], "_rank").filter(F.col("_rank") == cap).select(F.col(k).alias("_key"), F.col("_at").alias("_full"))
            rest = rest.join(full, rest[k].eqNullSafe(F.col("_key")) & (rest["_at"] > F.col("_full")), "left_anti")
        last = taken.orderBy("_at").limit(top).agg(F.max("_at").alias("last"), F.count("*").alias("n")).first()
        undecided = scratch(rest.filter(F.col("_at") < last["last"]) if last["n"] == top else rest)
        if undecided.isEmpty():
            break
    picks = scratch(taken.orderBy("_at").limit(top).select("_at"))
    if strict and (found := picks.count()) < top:
        raise Shortfall(f"needed {top}, selected {found}")
    return placed.join(picks, "_at", "left_semi").orderBy("_at").select(*df.columns)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def spread_panel(df: DataFrame, text: str, order: Sequence[Column], least: int, top: int, scratch: Callable[[DataFrame], DataFrame] = scratch_table) -> DataFrame:
    """Greedy: take a row if its text is at least `least` edits from every row taken before, until there are `top`. Null texts are left out; `least` 0 takes all.

    The rows taken are the first of the greedy independent set of texts nearer than `least`.
    """
    named = df.filter(F.col(text).isNotNull())
    if least < 1:
        return named.orderBy(*order).limit(top)
    placed, _, _, heads = _heads(named, text, order, least - 1, scratch)
    picks = heads.orderBy("_first").limit(top)
    return placed.join(F.broadcast(picks), F.col("_at") == F.col("_first"), "left_semi").orderBy("_at").select(*df.columns)  # `top` rows


def _heads(df: DataFrame, text: str, order: Sequence[Column], most: int, scratch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """df placed in order (_at), the first place of each text, the near pairs of those places, and the places that lead.

    Leaders are the greedy independent set, in order, of the graph of texts within `most`
    edits: a text leads once every earlier neighbour follows another. Each round settles
    the texts without an undecided earlier neighbour and their followers; rounds, few
    unless texts form long chains, are written by `scratch`.
    """
    # ids handed out behind a global sort ascend with it
    placed = scratch(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    first = scratch(placed.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min("_at").alias("_first")))
    edges = scratch(class_pairs(text_classes(first, "_first", text), most).select("a", "b"))
    undecided, live, heads = first.select("_first"), edges, None
    while True:
        waiting = live.select(F.col("b").alias("_first")).distinct()
        fresh = scratch(undecided.join(waiting, "_first", "left_anti"))
        heads = fresh if heads is None else heads.union(fresh)
        if live.isEmpty():
            break
        follow = live.join(fresh, F.col("a") == F.col("_first"), "left_semi").select(F.col("b").alias("_first")).distinct()
        undecided = scratch(waiting.join(follow, "_first", "left_anti"))
        live = scratch(live.join(undecided, F.col("a") == F.col("_first"), "left_semi").join(undecided, F.col("b") == F.col("_first"), "left_semi"))
    return placed, first, edges, heads


def leaders(df: DataFrame, text: str, order: Sequence[Column], most: int, scratch: Callable[[DataFrame], DataFrame] = scratch_table) -> DataFrame:
    """Leader clustering: a row joins the first leader within `most` edits or becomes one. Adds `leader` (a rank from 0; null for null texts)."""
    placed, first, edges, heads = _heads(df, text, order, most, scratch)
    # ranks: numbers within the partitions of a sort, and the partitions' counts
    numbered = scratch(heads.orderBy("_first").withColumn("_k", F.monotonically_increasing_id()))
    part, bits = F.shiftright("_k", 33), F.lit((1 << 33) - 1)
    counts = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    ranks = numbered.withColumn("_p", part).join(F.broadcast(before), "_p").select("_first", (F.col("_before") + F.col("_k").bitwiseAND(bits)).alias("leader"))
    joins = edges.join(ranks, F.col("a") == F.col("_first")).groupBy(F.col("b").alias("_first")).agg(F.min("leader").alias("leader"))
    own = first.join(ranks.unionByName(joins.join(ranks, "_first", "left_anti")), "_first").select(text, "leader")
    return placed.join(own, text, "left").select(*df.columns, "leader")


def farthest_first(df: DataFrame, grams: str, order: Sequence[Column], top: int) -> DataFrame:
    """Start with the first row; each next row has the smallest largest Jaccard similarity to those taken. One distributed pass a pick.

    Rows of one set are taken in order, so its first `top` rows are all that can be. A row
    without grams is near to none.
    """
    kind = df.schema[grams].dataType.simpleString()
    sets = df.withColumn("_set", F.sort_array(F.array_distinct(F.coalesce(grams, F.array().cast(kind)))))
    rows = top_per_group(sets, ["_set"], order, top).withColumn("_id", F.monotonically_increasing_id()).withColumn("_near", F.lit(0.0))
    rows = rows.select(*df.columns, "_id", "_set", "_near").persist()
    taken: list[Row] = []
    try:
        while len(taken) < top:
            near = F.col("_near")
            for r in taken:
                last = F.array(*(F.lit(g) for g in r["_set"])).cast(kind)
                both = F.size(F.array_intersect("_set", last))
                near = F.greatest(near, both / F.greatest(F.size("_set") + F.lit(len(r["_set"])) - both, F.lit(1)))
            free = rows.filter(~F.col("_id").isin([r["_id"] for r in taken])) if taken else rows
            found = free.withColumn("_near", near).orderBy("_near", *order).limit(1).collect()
            if not found:
                break
            taken += found
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([tuple(r)[: len(df.columns)] for r in taken], df.schema)


def least_used(df: DataFrame, group: str, kind: str, order: Sequence[Column], top: int) -> DataFrame:
    """One row of each group in order: of the kind least used so far, ties by name.

    Every group gives one row, so the first `top` groups are all that is needed, and of
    them the first row of each kind.
    """
    heads = top_per_group(df.filter(F.col(group).isNotNull()), [group], order, 1).orderBy(*order).limit(top)
    turns = heads.select(F.col(group).alias("_head"), F.row_number().over(Window.orderBy(*order)).alias("_turn"))  # `top` rows
    some = top_per_group(df.join(F.broadcast(turns), F.col(group) == F.col("_head")).drop("_head"), [group, kind], order, 1)

    def fold(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[object, int] = {}
        held: pd.Series | None = None
        for rows in chunks:
            picks = []
            for _, row in rows.iterrows():
                if held is not None and row["_turn"] != held["_turn"]:
                    used[held[kind]] = used.get(held[kind], 0) + 1
                    picks.append(held)
                    held = None
                if held is None or (used.get(row[kind], 0), row[kind]) < (used.get(held[kind], 0), held[kind]):
                    held = row
            yield pd.DataFrame(picks, columns=rows.columns)
        if held is not None:
            yield held.to_frame().T

    # at most `top` rows a kind
    return in_one_task(some, [F.col("_turn"), F.col(kind)], some.schema, fold).orderBy("_turn").drop("_turn")


#: Most distinct points of local fronts that go to every task.
MAX_FRONT = 100_000


def _front(points: np.ndarray) -> np.ndarray:
    """Which of some distinct points no other dominates."""
    order = np.argsort(-points.sum(1), kind="stable")  # nothing behind has a larger sum, so nothing behind dominates
    kept = np.zeros(len(points), bool)
    front, held = np.empty((64, points.shape[1])), 0
    for at in range(0, len(order), 256):
        block = order[at : at + 256]
        beaten = np.zeros(len(block), bool)
        for part in range(0, held, 4096):
            rest = np.flatnonzero(~beaten)
            some = front[part : min(part + 4096, held)]
            beaten[rest] = (some[None] >= points[block[rest]][:, None]).all(2).any(1)
        begin = held
        for i in block[~beaten]:
            if not (front[begin:held] >= points[i]).all(1).any():
                if held == len(front):
                    front = np.concatenate([front, np.empty_like(front)])
                front[held], held, kept[i] = points[i], held + 1, True
    return kept


def _local_fronts(within: Sequence[str], axes: Sequence[str]):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            held = (rows if held is None else pd.concat([held, rows])).drop_duplicates(ignore_index=True)
            groups = held.groupby([*within, "_asks", "_shared"], dropna=False, sort=False).indices.values()
            points = held[list(axes)].to_numpy(np.float64)
            shared = held["_shared"].to_numpy()
            keep = []
            for g in groups:
                own = [k for k in range(len(axes)) if int(shared[g[0]]) >> k & 1]
                keep.append(g[_front(points[g][:, own])])
            held = held.iloc[np.concatenate(keep)] if keep else held
        if held is not None:
            yield held

    return fold


def pareto_front(df: DataFrame, id_col: str, axes: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row of the same group dominates: at least as good on every axis and better on one.

    Axes that are null in either row are left out of a comparison; rows that share none
    do not dominate each other. Which axes a row has is its mask. Rows of one mask meet
    those of another on the same shared axes, and there dominance is transitive: so a row
    need only be compared with the front of each mask's points on the axes they share.
    Each task keeps those fronts of its own rows, a second pass merges them, and rows join
    the fronts that are for their group and mask: a hash join, broadcast up to MAX_FRONT
    points.
    """
    mask = F.lit(0)
    for k, a in enumerate(axes):
        mask = mask + F.when(F.col(a).isNotNull(), F.lit(1 << k)).otherwise(0)
    rows = df.withColumn("_mask", mask)
    masks = sorted(r["_mask"] for r in rows.select("_mask").distinct().collect())  # at most 2 ** axes
    # each row as a point for every mask that is asked about, on the axes they share
    asks = F.explode(F.array(*(F.lit(m) for m in masks)).cast("array<int>"))
    points = rows.select(*within, *(F.col(a).cast("double").alias(a) for a in axes), "_mask", asks.alias("_asks")).withColumn("_shared", F.col("_mask").bitwiseAND(F.col("_asks"))).filter("_shared > 0")
    points = points.select(*within, "_asks", "_shared", *(F.when(F.col("_shared").bitwiseAND(1 << k) > 0, F.col(a)).alias(a) for k, a in enumerate(axes)))
    fronts = points.mapInPandas(_local_fronts(within, axes), points.schema).distinct().mapInPandas(_local_fronts(within, axes), points.schema)
    few = fronts.limit(MAX_FRONT + 1).count() <= MAX_FRONT
    others = fronts.select(*(F.col(c).alias(f"o_{c}") for c in [*within, *axes]), "_asks")
    rule, better = F.col("_mask") == F.col("_asks"), F.lit(False)
    for c in within:
        rule = rule & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    for a in axes:
        rule = rule & F.coalesce(F.col(f"o_{a}") >= F.col(a), F.lit(True))
        better = better | F.coalesce(F.col(f"o_{a}") > F.col(a), F.lit(False))
    return rows.join(F.broadcast(others) if few else others, rule & better, "left_anti").drop("_mask")


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, numbered by `copy`."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def batches(df: DataFrame, order: Sequence[Column], size: int, within: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of `size` rows within groups."""
    return ranked(df, within, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def hash_order(seed: str, *cols: str) -> Column:
    """An order that depends on the seed and the values alone, not on partitioning."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in cols)), 256)


def hash_ranked(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank") -> DataFrame:
    """Row number within keys by a column of hex hashes (1 is first), counted in two levels: 4096 ranges of the hash, and within each. No group meets in one task."""
    cut = df.withColumn("_range", F.substring(order, 1, 3))
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_own")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return cut.withColumn("_place", place).join(sizes, same).withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name)
