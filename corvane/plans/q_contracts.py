"""Queries over report trees, partition contracts and campaign gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import datasets, selection, stats
from corvane.sources import records, reports

from .catalog import register
from .views import candidates, table, with_candidates


def _tree(spark, sf_dir):
    """Orders as a tree of reports, a run a customer, with a summary for each market segment and thousand customers: many documents a file."""
    root = records.scratch_path(spark)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("step", (F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")) - 1).cast("long"))
    done, first = F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1")
    record = F.struct(
        "step", F.col("o_orderpriority").alias("prompt"), F.col("o_orderstatus").alias("extracted_sequence"), F.col("o_totalprice").alias("reward"),
        F.struct(done.alias("functional_bridge_passes"), (F.col("o_orderkey") % 5).cast("int").alias("motif_count")).alias("reward_components"),
    )
    runs = o.groupBy("c_mktsegment", "c_custkey").agg(F.array_sort(F.collect_list(record)).alias("records"), F.sort_array(F.collect_list(F.when(done, F.col("step")))).alias("f"), F.sort_array(F.collect_list(F.when(first, F.col("step")))).alias("s"))
    runs = records.scratch_table(runs.withColumn("run", F.concat(F.lit("run="), "c_custkey")))
    runs.select(F.to_json(F.struct("run", "records"))).write.text(f"{root}/runs")
    result = F.struct(F.concat(F.lit("x/"), "run", F.lit("/report.json")).alias("report_path"), F.col("f").alias("functional_bridge_steps"), F.col("s").alias("family_faithful_bridge_steps"))
    waves = runs.groupBy(F.concat_ws("-", "c_mktsegment", F.floor(F.col("c_custkey") / 1000)).alias("name")).agg(F.array_sort(F.collect_list(result)).alias("results"))
    waves.select(F.to_json(F.struct("name", "results"))).write.text(f"{root}/waves")
    return reports.read_documents(spark, f"{root}/waves", "part-*", reports.SUMMARY, lines=True), reports.read_documents(spark, f"{root}/runs", "part-*", reports.REPORT, lines=True)


_ORDERS = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS step, c_mktsegment || '-' || c_custkey // 1000 AS wave FROM orders JOIN customer ON o_custkey = c_custkey)"


@register("run_inventory", f"{_ORDERS} SELECT wave AS name, count(DISTINCT c_custkey) AS results, count_if(o_orderstatus = 'F')::BIGINT AS functional, count_if(o_orderpriority LIKE '1%')::BIGINT AS faithful FROM o GROUP BY 1")
def run_inventory(spark, sf_dir):
    return reports.inventory(_tree(spark, sf_dir)[0])


@register("report_hits", f"{_ORDERS} SELECT wave, 'run=' || c_custkey AS run, step, o_orderpriority AS prompt, o_orderstatus AS sequence, o_totalprice AS reward, o_orderstatus = 'F' AS functional, (o_orderkey % 5)::INTEGER AS motif_count FROM o WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '1%'")
def report_hits(spark, sf_dir):
    found = reports.hits(*_tree(spark, sf_dir)).select("wave", "run", "step", *reports.hit_columns())
    return found.select("wave", "run", "step", "prompt", "sequence", "reward", "functional", "motif_count")


@register("report_rows", f"{_ORDERS} SELECT 'run=' || c_custkey AS run, step, length(o_orderstatus)::INTEGER AS length, false AS trainable FROM o")
def report_rows(spark, sf_dir):
    r = _tree(spark, sf_dir)[1]
    return r.select("run", F.explode("records").alias("record")).select("run", F.col("record.step").alias("step"), *reports.hit_columns()).select("run", "step", "length", "trainable")


@register("partition_contract", with_candidates("""
    , g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY sha256('c|' || source)) AS k FROM c GROUP BY source), p AS (SELECT source, CASE WHEN k <= 3 THEN 'holdout' WHEN k <= 6 THEN 'challenge' ELSE 'train' END AS part FROM g),
    r AS (SELECT part, c.*, row_number() OVER (PARTITION BY part, text_hash ORDER BY doc_id) AS use FROM c JOIN p USING (source))
    SELECT part, count(*) AS rows, count(DISTINCT source) AS groups, count(DISTINCT text_hash) AS texts, max(use)::INTEGER AS most_uses FROM r WHERE use <= 2 GROUP BY part"""))
def partition_contract(spark, sf_dir):
    c = candidates(spark, sf_dir)
    groups = c.groupBy("source").agg(F.count("*").alias("n"))
    # sources are a small dimension here; for many groups use datasets.grouped_split, which sums in two levels
    k = F.row_number().over(Window.orderBy(selection.hash_order("c", "source")))
    part = groups.withColumn("k", k).select("source", F.when(F.col("k") <= 3, "holdout").when(F.col("k") <= 6, "challenge").otherwise("train").alias("part"))
    r = selection.ranked(c.join(F.broadcast(part), "source"), ["part", "text_hash"], [F.col("doc_id")], "use").filter("use <= 2")
    return r.groupBy("part").agg(F.count("*").alias("rows"), F.countDistinct("source").alias("groups"), F.countDistinct("text_hash").alias("texts"), F.max("use").alias("most_uses"))


@register("nested_subsets", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 10 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 = 0)) AS small_outside_large, (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 = 0)) AS other_outside_large")
def nested_subsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    large = d.filter("doc_id % 5 = 0")
    outside = lambda small, name: small.exceptAll(large).agg(F.count("*").alias(name))
    return outside(d.filter("doc_id % 10 = 0"), "small_outside_large").join(outside(d.filter("doc_id % 3 = 0"), "other_outside_large"))


@register("hybrid_pairs", """
    WITH p AS (SELECT p_partkey AS positive, p_size FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS negative, p_size FROM part WHERE p_partkey % 2 = 1), k AS (SELECT p_size, count(*) AS n FROM p GROUP BY 1),
    a AS (SELECT negative, n.p_size, row_number() OVER (PARTITION BY n.p_size ORDER BY sha256('h|' || negative)) - 1 AS r, k.n FROM n JOIN k ON n.p_size = k.p_size), b AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY sha256('h|' || positive)) - 1 AS r FROM p)
    SELECT negative, positive FROM a JOIN b ON a.p_size = b.p_size AND a.r % a.n = b.r WHERE a.r < 2 * a.n""")
def hybrid_pairs(spark, sf_dir):
    """Negatives dealt over positives of their size in turn, each positive at most twice."""
    p = table(spark, sf_dir, "part")
    place = lambda name: F.row_number().over(Window.partitionBy("p_size").orderBy(selection.hash_order("h", name))) - 1
    pos = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("positive"), "p_size").withColumn("r", place("positive")).withColumn("n", F.count("*").over(Window.partitionBy("p_size")))
    neg = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("negative"), "p_size").withColumn("k", place("negative"))
    n = pos.select("p_size", "n").distinct()
    return neg.join(n, "p_size").filter("k < 2 * n").withColumn("r", F.pmod("k", "n")).join(pos.select("positive", "p_size", "r"), ["p_size", "r"]).select("negative", "positive")


@register("control_contrasts", "SELECT a.seed, a.tag, round(a.v - b.v, 8) AS update_effect FROM (SELECT l_linenumber AS seed, l_returnflag AS tag, avg(l_tax) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) a JOIN (SELECT l_linenumber AS seed, l_returnflag AS tag, avg(l_tax) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) b ON a.seed = b.seed AND a.tag = b.tag")
def control_contrasts(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("tag"), "l_linestatus").agg(F.avg("l_tax").alias("v"))
    return stats.contrasts(m, ["seed", "tag"], "l_linestatus", "F", "O", "v").select("seed", "tag", F.round("delta", 8).alias("update_effect"))


@register("calibration_completeness", "SELECT 'missing' AS problem, count(*) AS n FROM (SELECT sha256(p_name) FROM part WHERE p_partkey % 4 = 0 EXCEPT SELECT sha256(p_name) FROM part WHERE p_partkey % 8 = 0) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT sha256(p_name) FROM part WHERE p_partkey % 8 = 0 EXCEPT SELECT sha256(p_name) FROM part WHERE p_partkey % 4 = 0)")
def calibration_completeness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.sha2("p_name", 256).alias("h"))
    found = datasets.completeness(p.filter("p_partkey % 4 = 0"), p.filter("p_partkey % 8 = 0").dropDuplicates(["h"]), ["h"])
    return found.agg(F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "unexpected").alias("unexpected")).unpivot([], ["missing", "unexpected"], "problem", "n")


@register("smoke_gate", "SELECT o_orderpriority AS suite, count_if(hits > 0) >= 5 AND max(hits) >= 100 AS passes FROM (SELECT o_orderpriority, year(o_orderdate) AS seed, count_if(o_orderstatus = 'F') AS hits FROM orders GROUP BY ALL) GROUP BY 1")
def smoke_gate(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("suite"), F.year("o_orderdate").alias("seed")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    return r.groupBy("suite").agg(((F.count_if(F.col("hits") > 0) >= 5) & (F.max("hits") >= 100)).alias("passes"))


@register("predicate_gate", "SELECT l_returnflag, bool_and(ok) AS passes, string_agg(CASE WHEN NOT ok THEN name END, ',' ORDER BY name) AS failed FROM (SELECT l_returnflag, unnest(['discount', 'quantity', 'tax']) AS name, unnest([avg(l_discount) < 0.06, avg(l_quantity) > 26, avg(l_tax) < 0.05]) AS ok FROM lineitem GROUP BY 1) GROUP BY 1")
def predicate_gate(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"))
    failed = F.filter(F.array(F.when(~(F.col("d") < 0.06), "discount"), F.when(~(F.col("q") > 26), "quantity"), F.when(~(F.col("t") < 0.05), "tax")), lambda x: x.isNotNull())
    return g.select("l_returnflag", (F.size(failed) == 0).alias("passes"), F.nullif(F.array_join(failed, ","), F.lit("")).alias("failed"))


@register("target_manifest", "SELECT count(*) AS targets, min(n) AS fewest, round(avg(n), 6) AS mean, max(n) AS most, sum(dropped)::BIGINT AS dropped FROM (SELECT l_orderkey, count(*) AS n, count_if(l_discount = 0) AS dropped FROM lineitem GROUP BY 1)")
def target_manifest(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") == 0).alias("dropped"))
    return t.agg(F.count("*").alias("targets"), F.min("n").alias("fewest"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.sum("dropped").alias("dropped"))


@register("source_contract", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown_source' WHEN c_mktsegment = 'MACHINERY' THEN 'already_evaluated' END AS violation FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_mktsegment = 'MACHINERY'")
def source_contract(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return datasets.violations(j, ["o_orderkey"], [(F.col("c_custkey").isNull(), "unknown_source"), (F.col("c_mktsegment") == "MACHINERY", "already_evaluated")])
