"""Similarity joins and clusters over short sequences.

Candidates of joins come from an equality: hashes of pieces of distinct texts. Edit
distance is then checked with Spark's bounded levenshtein.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.kernels import nearest_kmer_sets, shortlist_identities
from corvane.sources.records import scratch_table

QUERY_BLOCK = 16384
#: Above so many pairs of a class and a reference, one of PILOT references gives bounds first.
PILOT_PAIRS, PILOT = 1 << 27, 16
PAIRS = 2048
#: Rows of a slice of a class of equal texts, and pairs of rows that a task writes out.
SLICE = 1024
TASK_PAIRS = 8 << 20


def nearest_by_kmers(queries: DataFrame, references: DataFrame, query_id: str, reference_id: str, sequence: str, k: int = 3, shortlist: int = 32, other: bool = False) -> DataFrame:
    """For each query its best edit identity among the `shortlist` references of largest k-mer Jaccard.

    Every reference counts, those that share no k-mer too; equal Jaccard goes to the
    smaller reference id, equal identity to the earlier place in the shortlist. Without
    an identity above 0 the reference is null. With `other` a query's own id is no
    reference of its.

    Queries of one text are a class and are compared once; QUERY_BLOCK classes at a time
    go to every task of one scan of the references, which returns a shortlist a task. Only
    ids cross the network there; texts are fetched for the shortlists that are left. Before a
    long scan, one of PILOT references a query is compared: the last place of that shortlist
    is a bound under which no reference of the whole one lies, so tasks look no further at
    sets that stay below, and return few rows. Every reference is read all the same.
    """
    q = scratch_table(queries.select(F.col(query_id).alias("q"), F.col(sequence).alias("q_seq")).filter("q IS NOT NULL"))
    r = scratch_table(references.select(F.col(reference_id).alias("r"), F.col(sequence).alias("r_seq")).filter("r IS NOT NULL AND r_seq IS NOT NULL"))
    classes = scratch_table(q.groupBy("q_seq").agg(F.min("q").alias("rep")))
    schema = f"q {q.schema['q'].dataType.simpleString()}, r {r.schema['r'].dataType.simpleString()}, jaccard double"
    n, most = classes.count(), shortlist + other
    blocks = max(1, -(-n * 5 // (4 * QUERY_BLOCK)))
    pilot = n * r.count() > PILOT_PAIRS
    near = q.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        part = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == block).collect()  # some QUERY_BLOCK rows
        asked = [(x["rep"], x["q_seq"] or "", 0.0) for x in part]
        if pilot and part:
            some = r.filter(F.pmod(F.xxhash64("r"), F.lit(PILOT)) == 0).mapInPandas(nearest_kmer_sets(asked, k, most, uuid.uuid4().hex), schema)
            last = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("jaccard")))).filter(F.col("rank") == most)
            bounds = {x["q"]: x["jaccard"] for x in last.collect()}
            asked = [(rep, text, bounds.get(rep, 0.0)) for rep, text, _ in asked]
        if part:
            near = near.union(r.mapInPandas(nearest_kmer_sets(asked, k, most, uuid.uuid4().hex), schema))
    best = Window.partitionBy("q").orderBy(F.desc("jaccard"), "r")
    # one more where an own id may be among them
    short = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).withColumnRenamed("q", "rep")
    # a query's pairs meet in one task, PAIRS of them or so, wherever their texts lay
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * shortlist // PAIRS))
    pairs = short.join(r, "r").join(classes, "rep").repartition(tasks, "rep").select("rep", "r", "rank", "jaccard", "q_seq", "r_seq")
    found = pairs.mapInPandas(shortlist_identities(shortlist), schema.replace("q ", "rep ", 1) + ", rank int, identity double")
    # what was not compared is nan
    found = found.withColumn("identity", F.nanvl("identity", F.lit(None).cast("double")))
    lists = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "r", "jaccard", "identity"))).alias("near"))
    members = q.join(classes.withColumnRenamed("q_seq", "c_seq"), F.col("q_seq").eqNullSafe(F.col("c_seq"))).select("q", "rep").join(lists, "rep", "left")
    own = F.filter("near", lambda x: x["r"] != F.col("q")) if other else F.col("near")
    ranked = F.filter(F.transform(F.slice(own, 1, shortlist), lambda x, i: F.struct(x["identity"].alias("identity"), (-i).alias("place"), x["jaccard"].alias("jaccard"), x["r"].alias("r"))), lambda x: x["identity"] > 0)
    out = members.select("q", F.array_max(ranked).alias("x"))
    return out.select(F.col("q").alias(query_id), F.col("x.r").alias(reference_id), F.coalesce("x.identity", F.lit(0.0)).alias("identity"), F.coalesce("x.jaccard", F.lit(0.0)).alias("jaccard"))


def text_classes(rows: DataFrame, id_col: str, text: str, block: Column | None = None) -> DataFrame:
    """Membership (id, rep): rows of one text (and block) are a class, named by its smallest id. Null texts and blocks are in none."""
    base = rows.select(F.col(id_col).alias("id"), F.col(text).alias("s"), (block if block is not None else F.lit(0)).alias("block")).filter("s IS NOT NULL AND block IS NOT NULL")
    reps = base.groupBy("block", "s").agg(F.min("id").alias("rep"))
    return base.join(reps, ["block", "s"]).select("id", "rep", "block", "s")


def class_pairs(classes: DataFrame, most: int) -> DataFrame:
    """Pairs (a < b) of classes of one block whose texts are within `most` edits.

    A text is cut into most + 1 pieces; within `most` edits one piece stays whole and
    moves by at most `most` places. Texts and the shifted cuts that another length would
    have made meet by a hash of (block, length, number, piece); ids alone go through
    that join, texts are fetched for the pairs that it finds.
    """
    pieces = most + 1
    base = classes.filter("id = rep").select("rep", "block", "s").distinct()
    n, width = F.length("s"), F.floor(F.length("s") / pieces).cast("int")
    key = F.xxhash64("block", "n", "i", F.expr("substring(s, at, w)")).alias("key")
    parts = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(n.alias("n"), i.alias("i"), (i * width + 1).alias("at"), F.when(i == most, n - i * width).otherwise(width).alias("w")))
    index = base.select("rep", "block", "s", F.explode(parts).alias("p")).select("rep", "block", "s", "p.*").select("rep", key)
    # probes: pieces of a text of length m as a text of length n within the band would have cut it
    lengths = F.filter(F.sequence(n - most, n + most), lambda m: m >= 0)
    cuts = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.transform(
        F.sequence(-F.lit(most), F.lit(most)),
        lambda d: F.struct(m.alias("n"), i.alias("i"), (i * F.floor(m / pieces).cast("int") + 1 + d).alias("at"), F.when(i == most, m - i * F.floor(m / pieces).cast("int")).otherwise(F.floor(m / pieces).cast("int")).alias("w")),
    )))))
    probe = base.select("rep", "block", "s", F.explode(cuts).alias("p")).select("rep", "block", "s", "p.*").filter("at >= 1").select(F.col("rep").alias("other"), key).distinct()
    near = index.join(probe, "key").filter("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    side = lambda x, y: base.select(F.col("rep").alias(x), F.col("s").alias(y), F.col("block").alias(f"{y}_block"))
    met = near.join(side("a", "s"), "a").join(side("b", "t"), "b").filter("s_block = t_block")
    return met.withColumn("distance", F.levenshtein("s", "t", most)).filter("distance >= 0").select("a", "b", "distance")


def edit_pairs(rows: DataFrame, id_col: str, text: str, most: int, block: Column | None = None, scratch: Callable[[DataFrame], DataFrame] = scratch_table) -> DataFrame:
    """Pairs (a < b) of rows within `most` edits, `block` being equal as well.

    The join is over distinct texts. All pairs of rows are written out here, those of
    equal texts too; `edit_clusters` and `nearest_by_edits` work on classes.

    Ids of a class are dealt into slices of some SLICE; two slices that meet are a cell.
    Cells, not pairs, cross the network, and tasks are as many as the pairs ask for.
    """
    classes = scratch(text_classes(rows, id_col, text, block))
    near = class_pairs(classes, most)
    own = classes.filter("id = rep").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("distance")).distinct()
    count = classes.groupBy("rep").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    dealt = classes.join(count, "rep").select("rep", "id", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"))
    slices = scratch(dealt.groupBy("rep", "slice").agg(F.collect_list("id").alias("ids")))
    side = lambda x, y: slices.select(F.col("rep").alias(x), F.col("slice").alias(f"{x}_slice"), F.col("ids").alias(y))
    met = near.unionByName(own).join(side("a", "left"), "a").join(side("b", "right"), "b").filter("a <> b OR a_slice <= b_slice")
    cells = scratch(met.select("left", "right", "distance", ((F.col("a") == F.col("b")) & (F.col("a_slice") == F.col("b_slice"))).alias("same")))
    total = cells.agg(F.sum(F.size("left").cast("long") * F.size("right"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAIRS))
    lines = cells.repartition(tasks).select("same", "distance", "right", F.explode("left").alias("x")).select("same", "distance", "x", F.explode("right").alias("y"))
    # a slice meets itself in both directions
    apart = lines.filter("x < y OR (x > y AND NOT same)")
    return apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def edit_clusters(rows: DataFrame, id_col: str, text: str, most: int, scratch, block: Column | None = None) -> DataFrame:
    """(id, component): components of texts within `most` edits, named by the smallest id; rows without a text are their own. Linear in the copies of a text."""
    classes = scratch(text_classes(rows, id_col, text, block))
    found = components(class_pairs(classes, most), classes.filter("id = rep"), "rep", scratch)
    known = classes.join(found, "rep").select(F.col("id").alias(id_col), "component")
    rest = rows.select(id_col).join(known, id_col, "left_anti")
    return known.unionByName(rest.withColumn("component", F.col(id_col)))


def nearest_by_edits(rows: DataFrame, id_col: str, text: str, most: int, scratch, block: Column | None = None) -> DataFrame:
    """Each row's nearest other row within `most` edits (id, nearest, distance; ties to the smaller id). Rows without one are left out."""
    classes = scratch(text_classes(rows, id_col, text, block))
    pairs = class_pairs(classes, most)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    near = both.groupBy(F.col("a").alias("rep")).agg(F.min(F.struct("distance", "b")).alias("x"))
    second = classes.filter("id <> rep").groupBy("rep").agg(F.min("id").alias("second"))
    known = classes.select("id", "rep").join(second, "rep", "left").join(near, "rep", "left")
    twin = F.when(F.col("id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    out = known.select(F.col("id").alias(id_col), F.coalesce(twin, "x.b").alias("nearest"), F.when(twin.isNotNull(), F.lit(0)).otherwise(F.col("x.distance")).alias("distance"))
    return out.filter("nearest IS NOT NULL")


def near_anchors(anchors: DataFrame, rows: DataFrame, id_col: str, text: str, low: float, *carry: Column) -> DataFrame:
    """(anchor, row, identity, carried columns) of rows with another text whose length allows an identity of `low`.

    Anchors are few by contract (a top-k); they are joined on bands of length that are
    as wide as `low` allows, so far lengths never meet.
    """
    band = F.floor(F.log(F.greatest(F.length(text), F.lit(1)).cast("double")) / -F.log(F.lit(low))).cast("int")
    a = anchors.select(F.col(id_col).alias("anchor"), F.col(text).alias("a_text"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    r = rows.select(F.col(id_col).alias("row"), F.col(text).alias("r_text"), *carry, band.alias("band"))
    longest = F.greatest(F.length("a_text"), F.length("r_text"), F.lit(1))
    near = a.join(r, "band").filter((F.col("a_text") != F.col("r_text")) & (F.abs(F.length("a_text") - F.length("r_text")) / longest <= 1 - low))
    return near.withColumn("identity", tx.identity("a_text", "r_text")).drop("band", "a_text", "r_text")


def at_thresholds(near: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each row once for every threshold that its identity meets, the stated few."""
    return near.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))).filter(F.col("identity") >= F.col("threshold"))


def neighbourhood(anchors: DataFrame, rows: DataFrame, id_col: str, text: str, thresholds: list[float], flag: Column) -> DataFrame:
    """For each anchor and identity threshold: neighbours, and those with and without the flag."""
    wide = at_thresholds(near_anchors(anchors, rows, id_col, text, min(thresholds), flag.alias("flag")), thresholds)
    return wide.groupBy("anchor", "threshold").agg(F.count("*").alias("neighbours"), F.count_if("flag").alias("flagged"), F.count_if(~F.col("flag")).alias("unflagged"))


def neighbourhood_reports(anchors: DataFrame, rows: DataFrame, id_col: str, text: str, thresholds: list[float], strict: Column, bridge: Column, bucket: Column, cluster: Column, priority: list[Column], examples: int) -> DataFrame:
    """One row for each anchor and threshold, those without a neighbour too.

    role (strict or bridge_only), neighbours, strict ones, those that only bridge, different
    prompt buckets (neither null nor empty), different clusters (not null), and the ids of up
    to `examples` neighbours: highest identity first, then by `priority`, then smaller id. A
    null flag is false.

    An anchor's first neighbours are found once (their ranks are cut in each task before
    they are exchanged); those at a threshold are the ones among them that meet it.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    keys = [c.alias(f"_{i}") for i, c in enumerate(priority)]
    near = near_anchors(anchors, rows, id_col, text, min(thresholds), yes(strict).alias("_strict"), yes(bridge).alias("_bridge"), F.nullif(bucket.cast("string"), F.lit("")).alias("_bucket"), cluster.alias("_cluster"), F.struct(*keys, F.col(id_col).alias("_row")).alias("_order"))
    wide = at_thresholds(near, thresholds)
    counts = wide.groupBy("anchor", "threshold").agg(
        F.count("*").alias("neighbours"), F.count_if("_strict").alias("strict"), F.count_if(F.col("_bridge") & ~F.col("_strict")).alias("bridge_only"),
        F.countDistinct("_bucket").alias("buckets"), F.countDistinct("_cluster").alias("clusters"),
    )
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("identity"), "_order"))
    first = near.withColumn("_rank", rank).filter(F.col("_rank") <= examples)
    first = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("_rank", "row", "identity"))).alias("_first"))
    asked = anchors.select(F.col(id_col).alias("anchor"), F.when(yes(strict), "strict").otherwise("bridge_only").alias("role"), F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    out = asked.join(counts, ["anchor", "threshold"], "left").join(first, "anchor", "left").fillna(0, ["neighbours", "strict", "bridge_only", "buckets", "clusters"])
    met = F.transform(F.filter("_first", lambda x: x["identity"] >= F.col("threshold")), lambda x: x["row"])
    return out.withColumn("examples", F.coalesce(met, F.slice(F.array(F.col("anchor")), 1, 0))).drop("_first")


def anchor_classes(anchors: DataFrame, rows: DataFrame, id_col: str, text: str, flag: Column, near: float = 0.95, wide: float = 0.9) -> DataFrame:
    """Class of each anchor by its neighbourhood: green with three near neighbours of both kinds, yellow with three near or five wide ones, else red."""
    found = neighbourhood(anchors, rows, id_col, text, [near, wide], flag)
    at = lambda t, c: F.coalesce(F.max(F.when(F.col("threshold") == t, F.col(c))), F.lit(0))
    found = found.groupBy(F.col("anchor").alias(id_col)).agg(at(near, "neighbours").alias("near"), at(near, "flagged").alias("strict"), at(near, "unflagged").alias("bridge"), at(wide, "neighbours").alias("wide"))
    out = anchors.select(id_col).join(found, id_col, "left").fillna(0, ["near", "strict", "bridge", "wide"])
    mixed = (F.col("near") >= 3) & (F.col("strict") > 0) & (F.col("bridge") > 0)
    return out.withColumn("class", F.when(mixed, "green").when((F.col("near") >= 3) | (F.col("wide") >= 5), "yellow").otherwise("red"))


def components(edges: DataFrame, nodes: DataFrame, id_col: str, scratch) -> DataFrame:
    """(id, component) with the smallest id that edges (a, b) reach; nodes without an edge are their own.

    Least labels travel along edges and then along labels, written to shared storage
    each round (`scratch` does that), until nothing changes.
    """
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = scratch(labels.join(seen, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        jump = step.select(F.col("id").alias("via"), F.col("component").alias("far"))
        step = scratch(step.join(jump, step.component == jump.via, "left").select("id", F.least("component", "far").alias("component"), "was"))
        labels = step.select("id", "component")
        if step.filter("component <> was").isEmpty():
            break
    return nodes.select(F.col(id_col).alias("id")).join(labels, "id", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component"))
