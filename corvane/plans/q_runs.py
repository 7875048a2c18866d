"""Queries over runs: aggregates, ordered state, audits, statistics, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import scores
from corvane.functions import text as tx
from corvane.operators import datasets, ledger, selection, stats
from corvane.sources import records

from .catalog import register
from .views import candidates, sequences, table, with_candidates, with_sequences

C = with_candidates


@register("source_contributions", C("SELECT source, count(*) AS hits, count_if(context_pass)::BIGINT AS functional, count_if(context_pass AND family_pass)::BIGINT AS faithful FROM c GROUP BY source"))
def source_contributions(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("source").agg(F.count("*").alias("hits"), F.count_if("context_pass").alias("functional"), F.count_if(F.col("context_pass") & F.col("family_pass")).alias("faithful"))


@register("coverage_stats", C("""
    , k AS (SELECT text_hash, count(*) AS n FROM c GROUP BY 1) SELECT (SELECT count(DISTINCT lang) FROM c) AS prompts, (SELECT count(DISTINCT source) FROM c) AS buckets, count(*) AS clusters, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM k"""))
def coverage_stats(spark, sf_dir):
    c = candidates(spark, sf_dir)
    k = c.groupBy("text_hash").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))
    return c.agg(F.countDistinct("lang").alias("prompts"), F.countDistinct("source").alias("buckets")).join(k)


@register("label_histogram", C("SELECT coalesce(lang, '*') AS lang, coalesce(reason, '*') AS reason, count(*) AS n FROM (SELECT lang, unnest(list_filter([CASE WHEN NOT family_pass THEN 'family' END, CASE WHEN NOT fold_pass THEN 'fold' END, CASE WHEN NOT novelty_pass THEN 'novelty' END], lambda x: x IS NOT NULL)) AS reason FROM c) GROUP BY GROUPING SETS ((lang, reason), (lang), ())"))
def label_histogram(spark, sf_dir):
    no = lambda c, x: F.when(~F.col(c), F.lit(x))
    r = candidates(spark, sf_dir).select("lang", F.explode(F.filter(F.array(no("family_pass", "family"), no("fold_pass", "fold"), no("novelty_pass", "novelty")), lambda x: x.isNotNull())).alias("reason"))
    g = r.groupingSets([[F.col("lang"), F.col("reason")], [F.col("lang")], []], F.col("lang"), F.col("reason")).agg(F.count("*").alias("n"))
    return g.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("reason", F.lit("*")).alias("reason"), "n")


@register("run_summary", """
    SELECT o_custkey, count(*) AS steps, count_if(o_orderstatus = 'F')::BIGINT AS finished, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished_rate, round(avg(o_totalprice), 7) AS mean_reward,
           round(coalesce(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 7) AS mean_pending, string_agg(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END, ',' ORDER BY o_orderkey) AS urgent FROM orders GROUP BY o_custkey""")
def run_summary(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    urgent = F.sort_array(F.collect_list(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderkey"))))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("steps"), F.count_if(done).alias("finished"), F.round(F.avg(done.cast("double")), 6).alias("finished_rate"), F.round(F.avg("o_totalprice"), 7).alias("mean_reward"),
        F.round(F.coalesce(F.avg(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))), F.lit(0.0)), 7).alias("mean_pending"), urgent.alias("u"),
    )
    return g.select(*[c for c in g.columns if c != "u"], F.nullif(F.array_join(F.col("u").cast("array<string>"), ","), F.lit("")).alias("urgent"))


@register("group_aggregate", """
    WITH r AS (SELECT o_orderpriority, year(o_orderdate) AS seed, count_if(o_orderstatus = 'F') AS hits, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderpriority, count(*) AS runs, round(min(hits / n), 6) AS least, round(median(hits / n), 6) AS median, round(max(hits / n), 6) AS most, round(avg(hits / n), 6) AS mean, round(var_pop(hits), 6) AS variance, bool_or(hits > 0) AS any_hit FROM r GROUP BY 1""")
def group_aggregate(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("seed")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("n")).withColumn("rate", F.col("hits") / F.col("n"))
    six = lambda c, n: F.round(c, 6).alias(n)
    return r.groupBy("o_orderpriority").agg(F.count("*").alias("runs"), six(F.min("rate"), "least"), six(F.percentile("rate", 0.5), "median"), six(F.max("rate"), "most"), six(F.avg("rate"), "mean"), six(F.var_pop("hits"), "variance"), F.bool_or(F.col("hits") > 0).alias("any_hit"))


@register("hit_fraction_by_index", """
    WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, o_orderstatus = 'F' AS hit FROM orders)
    SELECT i::INTEGER AS i, round(avg(hit::INT), 6) AS fraction FROM r GROUP BY i""")
def hit_fraction_by_index(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").alias("hit")))).alias("steps"))
    return runs.select(F.posexplode("steps").alias("i", "s")).groupBy("i").agg(F.round(F.avg(F.col("s.hit").cast("int")), 6).alias("fraction"))


@register("durability_gate", """
    WITH r AS (SELECT o_orderpriority AS g, year(o_orderdate) AS seed, count_if(o_orderstatus = 'F') AS hits, count(*) AS n FROM orders GROUP BY ALL)
    SELECT g, count_if(hits > 0) >= 3 AS seeds_ok, bool_and(hits >= ceil(0.15 * n)) AS coverage_ok, max(hits) - min(hits) <= 400 AS spread_ok, count_if(hits > 0) >= 3 AND bool_and(hits >= ceil(0.15 * n)) AND max(hits) - min(hits) <= 400 AS passes FROM r GROUP BY g""")
def durability_gate(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("seed")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("n"))
    g = r.groupBy("g").agg((F.count_if(F.col("hits") > 0) >= 3).alias("seeds_ok"), F.every(F.col("hits") >= F.ceil(F.lit(0.15) * F.col("n"))).alias("coverage_ok"), (F.max("hits") - F.min("hits") <= 400).alias("spread_ok"))
    return g.withColumn("passes", F.col("seeds_ok") & F.col("coverage_ok") & F.col("spread_ok"))


@register("arm_summary", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS deviation, min(l_quantity) AS least, round(median(l_quantity), 4) AS median, round(quantile_cont(l_quantity, 0.05), 4) AS p05, round(quantile_cont(l_quantity, 0.95), 4) AS p95, quantile_disc(l_quantity, 0.9) AS p90_rank, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def arm_summary(spark, sf_dir):
    d = stats.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return d.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("mean", "deviation")), "least", *(F.round(c, 4).alias(c) for c in ("median", "p05", "p95")), "p90_rank", "most")


@register("index_quantiles", """
    WITH o AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, max(CASE WHEN i = floor((n - 1) * 0.05::DOUBLE) THEN v END) AS low, max(CASE WHEN i = floor((n - 1) * 0.95::DOUBLE) THEN v END) AS high, max(CASE WHEN i = round((n - 1) * 0.9::DOUBLE) THEN v END) AS near FROM o GROUP BY p_brand""")
def index_quantiles(spark, sf_dir):
    asks = [("low", 0.05, "floor"), ("high", 0.95, "floor"), ("near", 0.9, "round")]
    return stats.order_statistics(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", asks, records.scratch_table)


@register("first_differences", """
    WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, count(gap) AS gaps, round(avg(gap / 1e6), 4) AS mean, round(median(gap / 1e6), 4) AS median, count_if(gap <= 0)::BIGINT AS not_increasing FROM g GROUP BY user_id""")
def first_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = e.select("user_id", gap.alias("gap"))
    return g.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.round(F.avg(F.col("gap") / 1e6), 4).alias("mean"), F.round(F.percentile(F.col("gap") / 1e6, 0.5), 4).alias("median"), F.count_if(F.col("gap") <= 0).alias("not_increasing"))


@register("calibration_percentiles", """
    WITH p AS (SELECT p_retailprice AS v, count(*) AS k FROM part GROUP BY 1), u AS (SELECT v, sum(k) OVER (ORDER BY v) / (SELECT count(*) FROM part) AS share FROM p)
    SELECT l_orderkey, l_linenumber, round(coalesce(share, 0), 6) AS percentile FROM lineitem ASOF LEFT JOIN u ON l_extendedprice >= v""")
def calibration_percentiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.share_below(li, table(spark, sf_dir, "part"), "l_extendedprice", "p_retailprice").select("l_orderkey", "l_linenumber", F.round("percentile", 6).alias("percentile"))


@register("token_costs", "SELECT source, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(sum(ceil(length(text) / 4)) * 2.5 / 1e6, 6) AS cost, min(length(text))::BIGINT AS least, round(avg(length(text)), 4) AS mean, max(length(text))::BIGINT AS most FROM documents GROUP BY source")
def token_costs(spark, sf_dir):
    n = F.length("text").cast("long")
    t = F.sum(F.ceil(n / 4))
    return table(spark, sf_dir, "documents").groupBy("source").agg(t.alias("tokens"), F.round(t * 2.5 / 1e6, 6).alias("cost"), F.min(n).alias("least"), F.round(F.avg(n), 4).alias("mean"), F.max(n).alias("most"))


@register("ordered_fingerprint", "SELECT o_custkey, sha256(string_agg(o_orderkey || '|' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY o_custkey")
def ordered_fingerprint(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("t"))))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r"))
    return g.select("o_custkey", F.sha2(F.array_join(F.col("r.t"), "\n"), 256).alias("fingerprint"))


@register("auc_by_source", C("""
    , p AS (SELECT lang, score AS s FROM c WHERE family_pass), n AS (SELECT lang, score AS s FROM c WHERE NOT family_pass)
    SELECT p.lang, round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM p JOIN n ON p.lang = n.lang GROUP BY p.lang"""))
def auc_by_source(spark, sf_dir):
    return stats.auc(candidates(spark, sf_dir), ["lang"], "score", F.col("family_pass")).select("lang", F.round("auc", 6).alias("auc"))


@register("wilson_intervals", "SELECT toxic, count(*) AS n, round((p + 3.8416 / (2 * n0)) / (1 + 3.8416 / n0) - 1.96 * sqrt(p * (1 - p) / n0 + 3.8416 / (4 * n0 * n0)) / (1 + 3.8416 / n0), 6) AS low, round((p + 3.8416 / (2 * n0)) / (1 + 3.8416 / n0) + 1.96 * sqrt(p * (1 - p) / n0 + 3.8416 / (4 * n0 * n0)) / (1 + 3.8416 / n0), 6) AS high FROM (SELECT toxic, avg(quality) OVER w AS p, (count(*) OVER w)::DOUBLE AS n0 FROM labels WINDOW w AS (PARTITION BY toxic)) GROUP BY ALL")
def wilson_intervals(spark, sf_dir):
    g = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = scores.wilson(F.col("k"), F.col("n"))
    return g.select("toxic", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("seed_contrasts", """
    WITH m AS (SELECT l_linestatus AS model, l_linenumber AS seed, l_returnflag AS arm, avg(l_discount) AS v FROM lineitem GROUP BY ALL), d AS (SELECT t.model, t.seed, t.v - c.v AS delta FROM m t JOIN m c ON t.model = c.model AND t.seed = c.seed AND t.arm = 'A' AND c.arm = 'N')
    SELECT model, count(*) AS n, round(avg(delta), 8) AS mean, round(avg(delta) - CASE WHEN count(*) > 1 THEN CASE count(*) WHEN 3 THEN 4.3026527297 WHEN 6 THEN 2.5705818356 ELSE 1.9599639845 END * stddev_samp(delta) / sqrt(count(*)) ELSE 0 END, 8) AS low, count_if(delta > 0)::BIGINT AS positive FROM d GROUP BY model""")
def seed_contrasts(spark, sf_dir):
    return stats.mean_interval(_deltas(spark, sf_dir), ["model"], "delta").select("model", "n", F.round("mean", 8).alias("mean"), F.round("low", 8).alias("low"), "positive")


def _deltas(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("v"))
    return stats.contrasts(m, ["model", "seed"], "arm", "A", "N", "v")


@register("sign_flip_test", """
    WITH m AS (SELECT l_linestatus AS model, l_linenumber AS seed, l_returnflag AS arm, avg(l_discount) AS v FROM lineitem GROUP BY ALL), d AS (SELECT t.model, t.seed, t.v - c.v AS delta, row_number() OVER (PARTITION BY t.model ORDER BY t.seed) - 1 AS i FROM m t JOIN m c ON t.model = c.model AND t.seed = c.seed AND t.arm = 'A' AND c.arm = 'N'),
    n AS (SELECT model, count(*) AS n, abs(sum(delta)) AS seen FROM d GROUP BY 1), k AS (SELECT model, n, seen, mask FROM n, unnest(range(0, 1 << n)) u(mask)),
    f AS (SELECT k.model, mask, any_value(seen) AS seen, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN delta ELSE -delta END)) AS s FROM k JOIN d ON k.model = d.model GROUP BY k.model, mask)
    SELECT model, count(*) AS permutations, round(avg((s >= seen - 1e-12)::INT), 8) AS p_value FROM f GROUP BY model""")
def sign_flip_test(spark, sf_dir):
    return stats.sign_flip(_deltas(spark, sf_dir), ["model"], "delta", "seed").select("model", "permutations", F.round("p_value", 8).alias("p_value"))


@register("sign_test", "SELECT 'all' AS test, wins::BIGINT AS wins, losses::BIGINT AS losses FROM (SELECT count_if(quality > toxic) AS wins, count_if(quality < toxic) AS losses FROM labels)")
def sign_test(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") > F.col("toxic")).alias("wins"), F.count_if(F.col("quality") < F.col("toxic")).alias("losses")).select(F.lit("all").alias("test"), "wins", "losses")


@register("sign_test_probability")
def sign_test_probability(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("wins"), F.count_if(F.col("o_orderkey") % 3 == 1).alias("losses"))
    return g.select("o_orderpriority", F.round(scores.sign_test(F.col("wins"), F.col("losses")), 8).alias("p_value"))


@register("hierarchical_bootstrap")
def hierarchical_bootstrap(spark, sf_dir):
    return stats.seed_bootstrap(_deltas(spark, sf_dir), "model", "seed", "delta", 10_000, "b")


@register("preference_loss", "SELECT l_returnflag, round(avg(CASE WHEN v >= 0 THEN ln(1 + exp(-v)) ELSE -v + ln(1 + exp(v)) END), 8) AS loss, round(avg((v > 0)::INT), 6) AS accuracy FROM (SELECT l_returnflag, 0.1 * (l_quantity - 25) AS v FROM lineitem) GROUP BY 1")
def preference_loss(spark, sf_dir):
    v = 0.1 * (F.col("l_quantity") - 25)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(-scores.log_sigmoid(v)), 8).alias("loss"), F.round(F.avg((v > 0).cast("int")), 6).alias("accuracy"))


@register("sparse_experts", """
    WITH r AS (SELECT l_orderkey AS s, l_linenumber AS p, l_suppkey % 5 AS tok, l_returnflag AS t, max(-l_discount * 10) AS lp FROM lineitem GROUP BY ALL), w(t, w) AS (VALUES ('A', 0.5::DOUBLE), ('N', 0.3), ('R', 0.2)),
    k AS (SELECT p, tok, t, avg(lp) AS lp FROM r GROUP BY ALL), g AS (SELECT p, tok, sum(w * (lp + 20)) - 20 AS combined, count(*) AS coverage FROM k JOIN w USING (t) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY combined DESC, tok) AS rank FROM g)
    SELECT p AS position, tok AS token, rank::INTEGER AS rank, coverage, round(combined, 6) AS combined, round(exp(combined) / sum(exp(combined)) OVER (PARTITION BY p), 6) AS weight FROM o WHERE rank <= 3""")
def sparse_experts(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 5).alias("token"), F.col("l_returnflag").alias("teacher")).agg(F.max(-F.col("l_discount") * 10).alias("lp"))
    k = r.groupBy("position", "token", "teacher").agg(F.avg("lp").alias("lp")).withColumn("sample", F.lit("s"))
    out = stats.product_of_experts(k, "sample", "position", "token", "teacher", "lp", {"A": 0.5, "N": 0.3, "R": 0.2}, -20.0, 3)
    return out.select("position", "token", "rank", "coverage", F.round("combined", 6).alias("combined"), F.round("weight", 6).alias("weight"))


@register("cost_rollup", "SELECT coalesce(o_orderstatus, '*') AS phase, coalesce(o_orderpriority, '*') AS wave, round(sum(o_totalprice), 2) AS cost, sum(o_totalprice) <= 1e9 AS within FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def cost_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return r.select(F.coalesce("o_orderstatus", F.lit("*")).alias("phase"), F.coalesce("o_orderpriority", F.lit("*")).alias("wave"), F.round("s", 2).alias("cost"), (F.col("s") <= 1e9).alias("within"))


@register("binned_means", "SELECT floor(l_quantity / 10)::BIGINT AS x, floor(l_discount * 100 / 2.5)::BIGINT AS y, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL")
def binned_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_discount") * 100 / 2.5).alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@register("family_stats", """
    WITH m AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS k FROM documents)
    SELECT max(CASE WHEN i = floor((k - 1) * 0.05::DOUBLE) THEN n END)::BIGINT AS low, max(CASE WHEN i = floor((k - 1) * 0.5::DOUBLE) THEN n END)::BIGINT AS middle, max(CASE WHEN i = floor((k - 1) * 0.95::DOUBLE) THEN n END)::BIGINT AS high FROM m""")
def family_stats(spark, sf_dir):
    # lengths are counted first: the ordered pass sees one row a distinct length
    c = table(spark, sf_dir, "documents").groupBy(F.length("text").alias("n")).agg(F.count("*").alias("k"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    u = c.withColumn("upto", F.sum("k").over(w)).withColumn("total", F.sum("k").over(Window.partitionBy(F.lit(0))))
    at = lambda q, n: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * F.lit(q)), F.col("n"))).cast("long").alias(n)
    return u.agg(at(0.05, "low"), at(0.5, "middle"), at(0.95, "high"))


#: One ledger a user, hashed row by row; then four kinds of tampering.
_LEDGER = """
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT user_id, event_id, event_type, k, 'ROOT' AS prev, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","previous_event_sha256":"ROOT","user_id":' || user_id || '}') AS own FROM e WHERE k = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.event_type, e.k, c.own, sha256('{"event_id":' || e.event_id || ',"event_type":"' || e.event_type || '","previous_event_sha256":"' || c.own || '","user_id":' || e.user_id || '}')
          FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)"""


@register("ledger_chain", f"{_LEDGER} SELECT user_id, event_id, event_type, prev AS previous_event_sha256, own AS event_sha256 FROM c")
def ledger_chain(spark, sf_dir):
    return ledger.opened(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["event_id"], ["user_id"])


@register("ledger_append", f"{_LEDGER}, n AS (SELECT user_id, count(*) AS n_events, arg_max(own, event_id) AS head_sha256 FROM c GROUP BY 1) SELECT * FROM n")
def ledger_append(spark, sf_dir):
    """The ledgers of even events, and the odd ones that come later appended to them, end like the ledgers of all."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    cut = e.agg((F.max("event_id") / 2).alias("cut"))
    e = e.join(F.broadcast(cut))
    first = ledger.opened(e.filter("event_id <= cut").drop("cut"), ["event_id"], ["user_id"])
    first = records.scratch_table(first)
    more = ledger.appended(first, e.filter("event_id > cut").drop("cut"), ["event_id"], ["user_id"])
    return ledger.heads(first.unionByName(more), ["event_id"], ["user_id"])


@register("family_motifs", with_sequences("""
    , m AS (SELECT sequence[i:i + 4] AS motif FROM s, unnest(range(1, greatest(length(sequence) - 3, 1))) AS u(i) WHERE regexp_full_match(sequence[i:i + 4], 'G[A-Z]S[A-Z]G')),
    t AS (SELECT motif, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, motif LIMIT 12),
    p AS (SELECT sequence, length(sequence) AS n, strpos(sequence, 'S') AS a FROM s), q AS (SELECT *, a + strpos(sequence[a + 1:], 'D') AS b FROM p WHERE a > 0), r AS (SELECT *, b + strpos(sequence[b + 1:], 'H') AS c FROM q WHERE b > a),
    f AS (SELECT a / n AS x, b / n AS y, c / n AS z FROM r WHERE c > b),
    o AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS i, row_number() OVER (ORDER BY y) - 1 AS j, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS m FROM f),
    bounds AS (SELECT max(CASE WHEN i = floor((m - 1) * 0.05::DOUBLE) THEN x END) AS serine_low, max(CASE WHEN i = floor((m - 1) * 0.95::DOUBLE) THEN x END) AS serine_high, max(CASE WHEN j = floor((m - 1) * 0.05::DOUBLE) THEN y END) AS aspartate_low,
                  max(CASE WHEN j = floor((m - 1) * 0.95::DOUBLE) THEN y END) AS aspartate_high, max(CASE WHEN k = floor((m - 1) * 0.05::DOUBLE) THEN z END) AS histidine_low, max(CASE WHEN k = floor((m - 1) * 0.95::DOUBLE) THEN z END) AS histidine_high FROM o),
    len AS (SELECT length(sequence) AS n, row_number() OVER (ORDER BY length(sequence)) - 1 AS i, count(*) OVER () AS m FROM s)
    SELECT (SELECT string_agg(motif, ',' ORDER BY n DESC, motif) FROM t) AS motifs, max(CASE WHEN i = floor((m - 1) * 0.05::DOUBLE) THEN n END)::DOUBLE AS low, max(CASE WHEN i = floor((m - 1) * 0.5::DOUBLE) THEN n END)::DOUBLE AS middle,
           max(CASE WHEN i = floor((m - 1) * 0.95::DOUBLE) THEN n END)::DOUBLE AS high, (SELECT round(serine_low, 9) FROM bounds) AS serine_low, (SELECT round(serine_high, 9) FROM bounds) AS serine_high, (SELECT round(aspartate_low, 9) FROM bounds) AS aspartate_low,
           (SELECT round(aspartate_high, 9) FROM bounds) AS aspartate_high, (SELECT round(histidine_low, 9) FROM bounds) AS histidine_low, (SELECT round(histidine_high, 9) FROM bounds) AS histidine_high FROM len"""))
def family_motifs(spark, sf_dir):
    """Family statistics of the documents' sequences, with the first S, the D behind it and the H behind that as sites."""
    s = sequences(spark, sf_dir).select("sequence")
    s = s.withColumn("a", F.instr("sequence", "S")).withColumn("b", F.expr("locate('D', sequence, a + 1)")).withColumn("c", F.expr("locate('H', sequence, b + 1)"))
    sites = F.when((F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0), F.array("a", "b", "c")).otherwise(F.array().cast("array<int>"))
    out = stats.family_stats(s, "sequence", tx.motifs("sequence"), sites, records.scratch_table)
    ranges = [F.round(f"{name}_{end}", 9).alias(f"{name}_{end}") for name in stats.POSITION_RANGES for end in ("low", "high")]
    return out.select(F.when(F.size("motifs") > 0, F.array_join("motifs", ",")).alias("motifs"), "low", "middle", "high", *ranges)


@register("hash_chain_audit", f"""{_LEDGER},
    t AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN sha256(event_id::VARCHAR) ELSE prev END AS prev, CASE WHEN event_id % 89 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
                 CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) AND user_id % 3 = 0 THEN sha256('x' || event_id) ELSE own END AS own FROM c),
    u AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), 'ROOT') AS before FROM t WHERE event_id % 83 > 0),
    v AS (SELECT event_id, prev = before AS link_ok, own = sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '","previous_event_sha256":"' || prev || '","user_id":' || user_id || '}}') AS hash_ok FROM u)
    SELECT event_id, CASE WHEN NOT link_ok AND NOT hash_ok THEN 'both' WHEN NOT link_ok THEN 'broken_link' ELSE 'event_hash' END AS problem FROM v WHERE NOT (link_ok AND hash_ok)""")
def hash_chain_audit(spark, sf_dir):
    """Every row that shows one of four kinds of tampering: a forged link, a payload changed under its hash, a rewritten last hash, an event taken out."""
    k = F.col("event_id")
    chain = ledger_chain(spark, sf_dir)
    last = F.max("event_id").over(Window.partitionBy("user_id"))
    chain = chain.withColumns({
        ledger.PREVIOUS: F.when(k % 97 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.col(ledger.PREVIOUS)), "event_type": F.when(k % 89 == 0, F.upper("event_type")).otherwise(F.col("event_type")),
        ledger.EVENT: F.when((k == last) & (F.col("user_id") % 3 == 0), F.sha2(F.concat(F.lit("x"), k), 256)).otherwise(F.col(ledger.EVENT)),
    })
    return ledger.problems(chain.filter(k % 83 > 0), ["event_id"], ["user_id"]).select("event_id", "problem")


@register("illegal_transitions", """
    WITH t AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id, event_id, event_type, before FROM t WHERE NOT ((before IS NULL) OR (before = event_type) OR (before = 'click' AND event_type IN ('purchase', 'view')))""")
def illegal_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return datasets.illegal_steps(e, ["event_id"], ["user_id"], "event_type", {"click": ["purchase", "view"]}, any_start=True, may_stay=True)


@register("gap_free_prefix", """
    WITH s AS (SELECT o_custkey, o_orderkey % 7 AS step, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY step) - 1 AS k FROM s)
    SELECT o_custkey, step, o_orderkey FROM p WHERE step = k""")
def gap_free_prefix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 7).alias("step"), "o_orderkey")
    return datasets.gap_free_prefix(o, "step", ["o_custkey"], [F.desc("o_orderkey")])


@register("budgeted_authorization", "SELECT * FROM (SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS spent FROM orders) WHERE spent <= 500000")
def budgeted_authorization(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return datasets.within_budget(o, ["o_orderkey"], ["o_custkey"], "o_totalprice", 500000.0).select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"))


@register("priority_slots", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k <= 3")
def priority_slots(spark, sf_dir):
    p = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return selection.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [p, F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@register("completeness_audit", "SELECT c_custkey, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') UNION ALL SELECT o_custkey, 'duplicate' FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def completeness_audit(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return datasets.completeness(table(spark, sf_dir, "customer"), seen, ["c_custkey"])


@register("row_violations", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' ELSE 'tax' END AS violation FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08 OR l_tax > 0.07")
def row_violations(spark, sf_dir):
    checks = [(F.col("l_quantity") > 45, "quantity"), (F.col("l_discount") > 0.08, "discount"), (F.col("l_tax") > 0.07, "tax")]
    return datasets.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], checks)


@register("length_matched_pairs")
def length_matched_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("size"))
    return datasets.length_matched(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), "p_partkey", "p_partkey", "size", "m")


@register("keyed_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT c_custkey, round(c_acctbal + 1, 2) FROM customer WHERE c_custkey % 10 = 0")
def keyed_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return datasets.upsert(c, c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2)), ["c_custkey"])


@register("design_matrix", """
    SELECT r_name, p.o AS arm, s::INTEGER AS seed, sha256('x|' || r_name || '|' || p.o || '|' || s) AS run_id, row_number() OVER (PARTITION BY r_name ORDER BY sha256('x|' || r_name || '|' || p.o || '|' || s))::INTEGER AS place
    FROM region, (SELECT DISTINCT o_orderstatus AS o FROM orders) p, unnest(range(0, 3)) u(s)""")
def design_matrix(spark, sf_dir):
    arms = table(spark, sf_dir, "orders").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("arms"))
    m = table(spark, sf_dir, "region").select("r_name").join(arms).select("r_name", F.explode("arms").alias("arm")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    m = m.withColumn("run_id", selection.hash_order("x", "r_name", "arm", "seed"))
    return selection.ranked(m, ["r_name"], [F.col("run_id")], "place")


@register("latest_decision", """
    WITH l AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN k IS NULL THEN 'dispatch' WHEN o_orderstatus = 'F' THEN 'stop' WHEN o_orderstatus = 'O' THEN 'wait' ELSE 'dispatch' END AS decision FROM customer LEFT JOIN l ON c_custkey = l.o_custkey LEFT JOIN orders ON o_orderkey = k""")
def latest_decision(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    d = table(spark, sf_dir, "customer").join(last, "c_custkey", "left")
    return d.select("c_custkey", F.when(F.col("s").isNull(), "dispatch").when(F.col("s") == "F", "stop").when(F.col("s") == "O", "wait").otherwise("dispatch").alias("decision"))


@register("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    path = records.scratch_path(spark)
    records.write_jsonl(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path, canonical=True)
    return records.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@register("jsonl_lenient", "SELECT CASE WHEN conv_id % 5 > 0 THEN conv_id END AS conv_id, CASE WHEN conv_id % 5 > 0 THEN turn END AS turn FROM conversations")
def jsonl_lenient(spark, sf_dir):
    path = records.scratch_path(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    c.select(F.when(F.col("conv_id") % 5 == 0, F.format_string("{bad %d", "conv_id")).otherwise(F.to_json(F.struct("conv_id", "turn"))).alias("value")).write.text(path)
    none = records.read_jsonl_lenient(spark, f"{path}-missing", "conv_id long, turn long")
    return records.read_jsonl_lenient(spark, path, "conv_id long, turn long").select("conv_id", "turn").union(none.select("conv_id", "turn"))


@register("cell_reports", "SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL")
def cell_reports(spark, sf_dir):
    path = records.scratch_path(spark)
    records.write_jsonl(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")), path)
    return records.unique_by(records.read_jsonl(spark, path, "l_orderkey long, l_linenumber int, l_quantity double"), ["l_orderkey", "l_linenumber"])


@register("fill_rates", "SELECT o_orderpriority, round(CASE WHEN count_if(o_orderstatus = 'P') > 0 THEN count_if(o_orderstatus = 'F') / count_if(o_orderstatus = 'P') ELSE 0 END, 6) AS rate FROM orders GROUP BY 1")
def fill_rates(spark, sf_dir):
    from corvane.functions import text as tx

    done = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(tx.safe_fraction(done("F"), done("P")), 6).alias("rate"))


@register("jsonl_quarantine", "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'bad' ELSE 'good' END AS kind FROM conversations")
def jsonl_quarantine(spark, sf_dir):
    path = records.scratch_path(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    c.select(F.when(F.col("conv_id") % 5 == 0, F.format_string("{bad %d %d", "conv_id", "turn")).otherwise(F.to_json(F.struct("conv_id", "turn"))).alias("value")).write.text(path)
    good, bad = records.read_jsonl_quarantine(spark, path, "conv_id long, turn long")
    parts = F.split("value", " ")
    return good.withColumn("kind", F.lit("good")).union(bad.select(parts[1].cast("long"), parts[2].cast("long"), F.lit("bad")))


@register("audit_unnest", "SELECT o_custkey AS run, printf('step-%05d-rank-%04d', s, r) AS candidate_id, l_partkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS s FROM orders) JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS r FROM lineitem) ON l_orderkey = o_orderkey")
def audit_unnest(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("candidates"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_custkey").alias("run")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "candidates"))).alias("records"))
    path = records.scratch_path(spark)
    records.write_jsonl(o, path)
    doc = records.read_jsonl(spark, path, "run long, records array<struct<o_orderkey: long, candidates: array<struct<l_linenumber: int, l_partkey: long>>>>")
    assert records.record_kind(doc) == "candidate_audit"
    return records.unnest_audit(doc, "records", "candidates", [F.col("run")]).select("run", "candidate_id", F.col("candidate.l_partkey").alias("l_partkey"))


@register("tsv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def tsv_round_trip(spark, sf_dir):
    path = records.scratch_path(spark)
    records.write_tsv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return records.read_tsv(spark, path, "p_partkey long, p_name string, p_size int")


@register("fasta_round_trip", "SELECT p_partkey::VARCHAR AS id, p_brand AS sequence FROM part")
def fasta_round_trip(spark, sf_dir):
    path = records.scratch_path(spark)
    records.write_fasta(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), path, "p_partkey", "p_brand")
    return records.read_fasta(spark, path)


@register("resume_pending", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def resume_pending(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.pending(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_orderkey")


@register("settings_diff", "SELECT p_partkey, 'p_brand' AS setting FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 'p_retailprice' FROM part WHERE p_partkey % 6 = 0")
def settings_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    k = F.col("p_partkey")
    q = p.select("p_partkey", F.when(k % 9 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 6 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice") * (1 + 1e-12)).alias("p_retailprice"))
    return records.same_settings(p, q, ["p_partkey"], ["p_brand"], ["p_retailprice"])


@register("natural_references", "SELECT lower(text) AS sequence, min(doc_id) AS accession FROM documents WHERE length(text) BETWEEN 120 AND 3600 GROUP BY lower(text)")
def natural_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length("text").between(120, 3600))
    return d.groupBy(F.lower("text").alias("sequence")).agg(F.min("doc_id").alias("accession"))


@register("structure_scan", "SELECT p_partkey, 'SDH' AS sequence, true AS contiguous, 80.0::DOUBLE AS confidence FROM part")
def structure_scan(spark, sf_dir):
    found = _atoms(spark, sf_dir)
    return records.residue_sequence(found, "p_partkey").join(records.mean_confidence(found, "p_partkey"), "p_partkey").select("p_partkey", "sequence", "contiguous", F.round("confidence", 6).alias("confidence"))


def _atoms(spark, sf_dir):
    """One tiny made structure for each part, as fixed-width text: Ser, Asp and His with the atoms of their bond."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("d"))
    line = lambda n, atom, res, num, x: F.format_string("ATOM  %5d %-4s %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.lit(n), F.lit(atom), F.lit(res), F.lit(num), x, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.8))
    x0 = F.lit(0.0)
    lines = F.array(line(1, "CA", "SER", 1, x0), line(2, "OG", "SER", 1, x0), line(3, "CA", "ASP", 2, F.lit(9.0)), line(4, "OD1", "ASP", 2, F.col("d") + 2.5), line(5, "CA", "HIS", 3, F.lit(5.0)), line(6, "ND1", "HIS", 3, F.col("d")), F.lit("TER"))
    return records.atoms(p.select("p_partkey", F.explode(lines).alias("value")), "p_partkey")


@register("triad_search", "SELECT p_partkey, round(p_size / 10.0, 3)::DOUBLE AS ser_his, 2.5::DOUBLE AS his_asp, p_size / 10.0 <= 3.5 AS passes FROM part")
def triad_search(spark, sf_dir):
    from corvane.operators.structure import triads

    t = triads(_atoms(spark, sf_dir), "p_partkey", 3.5)
    return t.select("p_partkey", F.round("ser_his", 3).alias("ser_his"), F.round("his_asp", 3).alias("his_asp"), "passes")


@register("structural_grades", """
    WITH p AS (SELECT p_retailprice AS v, count(*) AS k FROM part GROUP BY 1), n AS (SELECT count(*) AS n FROM part), u AS (SELECT v, sum(k) OVER (ORDER BY v) / n AS below, sum(k) OVER (ORDER BY v DESC) / n AS above FROM p, n)
    SELECT p_partkey, round((below + above) / 2, 6) AS grade FROM part JOIN u ON p_retailprice = v""")
def structural_grades(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("distance", F.col("p_retailprice"))
    g = stats.structural_grades(p, p, [("p_retailprice", True), ("distance", False)])
    return g.select("p_partkey", F.round("grade", 6).alias("grade"))
