"""Admission and audit rules for training pairs, capacity-capped matching, partition reports."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import kernels
from corvane.functions import text as tx

from .selection import hash_order, hash_ranked


def _first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. As fields of an aggregate its columns hold back filters on them: one on a partition key would run before, on every copy."""
    first = F.min_by(F.struct(*df.columns), F.struct(order)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(first).select("_row.*")


def admitted_positives(df: DataFrame, sequence: str, described: Column, terms: Sequence[str], reviewed: Column, sites: Column, lengths: tuple[int, int], longest_repeat: int, order: str) -> DataFrame:
    """Natural positives: valid, of allowed length, about the subject, reviewed, annotated, free of long repeats, one of each sequence.

    The repeat kernel runs last, on what all cheap conditions left.
    """
    about = F.lit(False)
    for t in terms:
        about = about | F.contains(F.lower(described), F.lit(t))
    seq = F.upper(F.trim(F.col(sequence)))
    cheap = df.withColumn(sequence, seq).filter(tx.valid_alphabet(sequence) & F.length(sequence).between(*lengths) & about & reviewed & (F.size(sites) >= 3))
    first = _first_of_each(cheap, sequence, order)
    return first.withColumn("_r", kernels.longest_repeat(sequence)).filter(F.col("_r") <= longest_repeat).drop("_r")


def admitted_negatives(df: DataFrame, sequence: str, longest_repeat: int, order: str) -> DataFrame:
    """Generated negatives: valid, one of each, and with a repeat longer than allowed."""
    seq = F.upper(F.trim(F.col(sequence)))
    valid = df.withColumn(sequence, seq).filter(tx.valid_alphabet(sequence))
    first = _first_of_each(valid, sequence, order)
    return first.withColumn("repeat_length", kernels.longest_repeat(sequence)).filter(F.col("repeat_length") > longest_repeat)


def positive_audit(source: Column, record: Column, reviewed: Column, sites: Column, basis: Column) -> Column:
    """Code of the first rule that a natural positive breaks; null if it breaks none."""
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    return (
        F.when(blank(source) | blank(record) | reviewed.isNull() | sites.isNull() | blank(basis), "missing_field").when(source != "natural_reference_record", "wrong_source").when(~reviewed, "not_reviewed")
        .when(sites < 3, "too_few_sites").when(~(F.contains(basis, F.lit("natural")) & F.contains(basis, F.lit("active_site"))), "undocumented_basis")
    )


def edit_audit(chosen: Column, rejected: Column, piece: Column, replaced: Column, site: Column, window: Column) -> Column:
    """Code of the first rule that a one-window corruption breaks (site counts from 0); null if it breaks none."""
    end = site + window
    tail = lambda s: F.substring(s, end + 1, F.greatest(F.length(s), F.lit(1)))
    return (
        F.when(chosen.isNull() | rejected.isNull() | piece.isNull() | replaced.isNull() | site.isNull() | window.isNull(), "missing_field").when(window != F.length(piece), "piece_length")
        .when(window != F.length(replaced), "window_length").when((site < 0) | (end > F.length(chosen)) | (end > F.length(rejected)), "out_of_bounds").when(F.substring(rejected, site + 1, window) != piece, "piece_missing")
        .when((F.substring(chosen, F.lit(1), site) != F.substring(rejected, F.lit(1), site)) | (tail(chosen) != tail(rejected)), "differs_outside")
    )


def active_sites(sequence: Column, sites: Column) -> Column:
    """First three sites, ascending, if they are S, D and H and the first is the middle of a motif; else null."""
    s = F.slice(F.array_sort(F.filter(sites, lambda p: (p >= 1) & (p <= F.length(sequence)))), 1, 3)
    at = lambda k: F.substring(sequence, F.element_at(s, k), F.lit(1))
    return F.when((F.size(s) == 3) & (at(1) == "S") & (at(2) == "D") & (at(3) == "H") & F.substring(sequence, F.element_at(s, 1) - 2, F.lit(5)).rlike(f"^{tx.MOTIF}$"), s)


def pair_report(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """One row: pairs, blank ones, identical ones, repeated triples, prompts, lengths, most uses of a chosen text, length-matched share."""
    blank = F.coalesce(F.trim(F.col(prompt)) == "", F.lit(True)) | F.coalesce(F.trim(F.col(chosen)) == "", F.lit(True)) | F.coalesce(F.trim(F.col(rejected)) == "", F.lit(True))
    a = df.agg(
        F.count("*").alias("pairs"), F.count_if(blank).alias("blank"), F.count_if(F.col(chosen) == F.col(rejected)).alias("identical"), F.countDistinct(prompt).alias("prompts"),
        F.min(F.length(chosen)).cast("long").alias("shortest"), F.max(F.length(chosen)).cast("long").alias("longest"), F.count_if(F.length(chosen) == F.length(rejected)).alias("length_matched"),
    )
    triples = df.groupBy(prompt, chosen, rejected).agg((F.count("*") - 1).alias("k")).agg(F.sum("k").alias("repeated"))
    uses = df.groupBy(chosen).agg(F.count("*").alias("k")).agg(F.max("k").alias("most_uses"))
    return a.join(triples).join(uses)


def sparse_target_problem(tokens: Column, weights: Column) -> Column:
    """Code of the first shape rule that an array of target sets breaks; null if it breaks none. Weights of a used position sum to 1."""
    z = F.arrays_zip(tokens.alias("t"), weights.alias("w"))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(tokens.isNull() | weights.isNull(), "missing_field").when(F.size(tokens) != F.size(weights), "position_count").when(F.exists(z, lambda p: F.size(p["t"]) != F.size(p["w"])), "set_size")
        .when(F.exists(z, lambda p: F.size(p["t"]) == 0), "empty_set").when(F.exists(z, lambda p: (total(p["w"]) > 0) & (F.abs(total(p["w"]) - 1) > 1e-3)), "weight_sum")
    )


#: Most distinct sizes whose counts go to the driver.
MAX_SIZES = 2_000_000


def _reach(size: int) -> int:
    return max(5, round(size * 0.05))


def coupled(counts: dict[int, tuple[int, int]], uses: int) -> dict[int, int]:
    """Sizes whose matches depend on those of other sizes, with the component that they are in (its smallest size).

    counts: negatives and positives of each size. A size with more negatives than its
    positives have uses reaches into others; a size so reached may run out itself and
    reaches on. All others match within their own size.
    """
    stocked = sorted(s for s, (_, p) in counts.items() if p and uses > 0)
    parent: dict[int, int] = {}

    def root(s: int) -> int:
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    short = [s for s, (n, p) in counts.items() if n > uses * p]
    parent.update((s, s) for s in short)
    while short:
        s = short.pop()
        for t in stocked[bisect_left(stocked, s - _reach(s)) : bisect_right(stocked, s + _reach(s))]:
            if t not in parent:
                parent[t] = t
                if counts[t][0]:
                    short.append(t)
            low, high = sorted((root(s), root(t)))
            parent[high] = low
    return {s: root(s) for s in parent}


def _fold_component(uses: int):
    """Greedy matches of whole components in order of (component, positives first, hash): one component's open positives are held."""

    def fold(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component = None
        pool: dict[int, list[tuple[int, str, str]]] = {}  # a heap of (uses, order, id) for each size
        for part in chunks:
            out = []
            for r in part.itertuples():
                if r.component != component:
                    component, pool = r.component, {}
                if r.side:
                    heapq.heappush(pool.setdefault(r.size_, []), (0, r.o, r.id))
                    continue
                near = _reach(r.size_)
                sizes = [r.size_] if r.size_ in pool else [s for s in range(r.size_ - near, r.size_ + near + 1) if s in pool] if 2 * near < len(pool) else [s for s in pool if abs(s - r.size_) <= near]
                if sizes:
                    s = min(sizes, key=lambda s: pool[s][0])
                    used, o, name = heapq.heappop(pool[s])
                    if used + 1 < uses:
                        heapq.heappush(pool[s], (used + 1, o, name))
                    elif not pool[s]:
                        del pool[s]
                    out.append((r.id, name))
            yield pd.DataFrame(out, columns=["negative", "positive"])

    return fold


def capacity_match(negatives: DataFrame, positives: DataFrame, id_n: str, id_p: str, size: str, uses: int, seed: str) -> DataFrame:
    """Each negative in hash order with the least used positive of its size, else within 5 percent or 5, until uses run out.

    The counts of each size tell which sizes can want positives of others (`coupled`).
    All other sizes are matched by rank: the i-th negative takes positive i modulo their
    number, an equality join over ranks that are counted in two levels, so a size that
    holds most rows is spread. Coupled sizes are folded a component at a time, in
    parallel over components, as each choice there depends on those before it.
    """
    if uses <= 0:
        return negatives.sparkSession.createDataFrame([], "negative string, positive string")
    rows = negatives.select(F.lit(0).alias("side"), F.col(id_n).cast("string").alias("id"), F.col(size).cast("long").alias("size_")).union(positives.select(F.lit(1), F.col(id_p).cast("string"), F.col(size).cast("long")))
    rows = rows.filter("size_ IS NOT NULL").withColumn("o", hash_order(seed, "side", "id"))
    found = rows.groupBy("size_").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("p"))
    counts = {r["size_"]: (r["n"], r["p"]) for r in found.limit(MAX_SIZES + 1).collect()}  # a row a size
    if len(counts) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} distinct sizes")
    component = coupled(counts, uses)
    known = negatives.sparkSession.createDataFrame(list(component.items()) or [(-1, -1)], "c_size long, component long")
    labelled = rows.join(F.broadcast(known), F.col("size_") == F.col("c_size"), "left").drop("c_size")  # a row a coupled size

    free = hash_ranked(labelled.filter("component IS NULL"), ["side", "size_"], "o", "k")
    p = free.filter("side = 1").select("size_", (F.col("k") - 1).alias("k"), F.col("id").alias("positive"))
    sizes = F.broadcast(negatives.sparkSession.createDataFrame([(s, p) for s, (_, p) in counts.items() if p and s not in component] or [(-1, 1)], "size_ long, p long"))
    n = free.filter("side = 0").join(sizes, "size_").select("size_", F.pmod(F.col("k") - 1, F.col("p")).alias("k"), F.col("id").alias("negative"))
    alone = n.join(p, ["size_", "k"]).select("negative", "positive")

    tied = labelled.filter("component IS NOT NULL").repartition("component").sortWithinPartitions("component", F.desc("side"), "o")
    return alone.unionByName(tied.mapInPandas(_fold_component(uses), "negative string, positive string"))


def scored_once(rows: DataFrame, text: str, score: Column, name: str) -> DataFrame:
    """rows with the score of their text, which is computed once for each different text; rows without a text get the score of null.

    Copies are told apart by SHA-256, and only one text of each group and one score cross
    the network. A hot text's rows meet its one score in a broadcast or a split join.
    """
    keyed = rows.withColumn("_text", F.sha2(text, 256))
    once = keyed.groupBy("_text").agg(F.first(text).alias(text)).select(F.col("_text").alias("_scored"), score.alias(name))
    return keyed.join(once, keyed["_text"].eqNullSafe(once["_scored"]), "left").drop("_text", "_scored")
