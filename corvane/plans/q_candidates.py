"""Queries that normalise raw candidates and audit training pairs and artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import candidates as cand
from corvane.operators import curation, datasets, selection
from corvane.sources import records

from .catalog import register
from .views import sequences, spread, table, with_sequences


def _raw(spark, sf_dir):
    """Parts as raw candidate rows with aliased, partly nested fields."""
    k = F.col("p_partkey")
    seq = F.substring(F.repeat(F.lit(tx.ALPHABET), 20), 1, (100 + k % 300).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        "p_partkey", F.when(k % 4 > 0, F.concat(F.lit("id-"), k)).alias("candidate_id"), F.lit("Make 180 aa").alias("prompt"), seq.alias("sequence"), (k % 3).alias("motif_count"),
        F.struct((k % 101).cast("double").alias("mean_plddt"), (k % 100 / 100.0).alias("closest_edit_identity"), F.when(k % 2 == 0, "pass").otherwise("no").alias("catalytic_geometry_passes")).alias("metrics"),
        F.when(k % 5 == 0, "true").otherwise("").alias("strict_family"), F.when(k % 7 == 0, k % 100 / 100.0).alias("aggregation_risk"), (k % 6 > 0).alias("solubility_pass"), F.when(k % 9 == 0, k / 10.0).alias("stage2_score"),
    )


_RAW = """
    WITH r AS (SELECT p_partkey AS k, 100 + p_partkey % 300 AS n FROM part),
    g AS (SELECT k, n, n BETWEEN 120 AND 360 AS valid, k % 3 > 1 AS spam, k % 5 = 0 AS faithful, k % 2 = 0 AS context, (k % 100) / 100.0::DOUBLE AS identity, (k % 101)::DOUBLE AS fold, k % 6 > 0 AS soluble FROM r),
    h AS (SELECT *, NOT spam AS free, identity BETWEEN 0 AND 0.9 AS novel, fold >= 85 AS folded FROM g),
    s AS (SELECT *, valid AND free AND faithful AND context AND novel AND folded AND soluble AS gate, CASE WHEN k % 9 = 0 THEN k / 10.0::DOUBLE ELSE round((free::INT + faithful::INT + context::INT + folded::INT + novel::INT + fold / 100) / 6, 6) END AS score FROM h)"""


@register("candidate_normalisation", f"""{_RAW}
    SELECT CASE WHEN k % 4 > 0 THEN 'id-' || k ELSE printf('candidate-%06d', k) END AS candidate_id, 'make <n> aa' AS prompt_family, n::INTEGER AS length, gate AS hard_gate_pass, free AS artifact_free, round(score, 6)::DOUBLE AS scalar_score,
           CASE WHEN gate THEN '' ELSE array_to_string(list_filter([CASE WHEN NOT valid THEN 'invalid_sequence_or_length' END, CASE WHEN NOT free THEN 'artifact_gate_failed' END, CASE WHEN spam THEN 'motif_spam' END,
               CASE WHEN NOT faithful THEN 'family_plausibility_failed' END, CASE WHEN NOT context THEN 'catalytic_context_failed' END, CASE WHEN NOT novel THEN 'novelty_window_failed' END, CASE WHEN NOT folded THEN 'fold_confidence_failed' END,
               CASE WHEN NOT soluble THEN 'solubility_failed' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM s""")
def candidate_normalisation(spark, sf_dir):
    n = cand.normalise(_raw(spark, sf_dir), F.col("p_partkey"))
    return n.select("candidate_id", "prompt_family", "length", "hard_gate_pass", "artifact_free", F.round("scalar_score", 6).alias("scalar_score"), F.array_join("rejection_reasons", ",").alias("reasons"))


@register("objective_scores", f"""{_RAW}
    , o AS (SELECT k, unnest([('active_site_geometry', context::INT::DOUBLE), ('aggregation', CASE WHEN k % 7 = 0 THEN 1 - (k % 100) / 100.0::DOUBLE END), ('anti_hallucination', free::INT::DOUBLE), ('family_plausibility', faithful::INT::DOUBLE),
        ('foldability', CASE WHEN fold <= 1 THEN fold ELSE fold / 100 END), ('functional_proxy', CASE WHEN score <= 1 THEN score ELSE least(1, score / 100) END), ('novelty', 1 - identity)]) AS p FROM s)
    SELECT CASE WHEN k % 4 > 0 THEN 'id-' || k ELSE printf('candidate-%06d', k) END AS candidate_id, p[1] AS axis, round(p[2], 6) AS value FROM o WHERE p[2] IS NOT NULL""")
def objective_scores(spark, sf_dir):
    n = cand.normalise(_raw(spark, sf_dir), F.col("p_partkey"))
    return n.select("candidate_id", F.explode("objective_scores").alias("axis", "value"))


@register("candidate_summary", f"{_RAW} SELECT count(*) AS candidates, count_if(gate)::BIGINT AS passing FROM s")
def candidate_summary(spark, sf_dir):
    n = cand.normalise(_raw(spark, sf_dir), F.col("p_partkey")).withColumn("batch", F.lit(1))
    return cand.summary(n, ["batch"]).select("candidates", "passing")


_Q = """
    , n AS (SELECT doc_id, ch, count(*) AS k FROM s, unnest(string_split(sequence, '')) AS u(ch) WHERE ch <> '' GROUP BY ALL), t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY doc_id),
    e AS (SELECT doc_id, -sum(k / total * log2(k / total)) AS h, count(*) AS kinds, max(k) / max(total) AS top FROM n JOIN t USING (doc_id) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS motifs FROM s, unnest(range(1, greatest(length(sequence) - 3, 1))) AS u(i) WHERE regexp_full_match(sequence[i:i + 4], 'G[A-Z]S[A-Z]G') GROUP BY doc_id),
    q AS (SELECT s.doc_id, length(sequence) AS n, length(sequence) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS ratio, h, kinds, top, coalesce(motifs, 0) AS motifs, regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+') AS valid FROM s JOIN e USING (doc_id) LEFT JOIN m USING (doc_id)),
    g AS (SELECT *, n BETWEEN 120 AND 360 AND ratio >= 0.98 AS hard, kinds >= 11 AND h >= 3.05 AND top <= 0.26 AS floor, greatest(0, least(100, 100 - greatest(0, 3.4 - h) * 35 - greatest(0, 16 - kinds) * 6 - greatest(0, top - 0.3) * 180)) AS soft FROM q)"""


@register("quality_gate", with_sequences(f"{_Q} SELECT doc_id, hard, floor, round(soft, 6)::DOUBLE AS soft, round(n + ratio * 100 + h * 10 + kinds * 2 - top * 50 - abs(n - 200) - CASE WHEN hard AND floor THEN 0 ELSE 250 END, 6)::DOUBLE AS score FROM g"))
def quality_gate(spark, sf_dir):
    q = cand.quality(F.col("sequence"), F.col("text"), F.lit(False), F.lit(False))
    return sequences(spark, sf_dir).select("doc_id", q["hard_gate_pass"].alias("hard"), q["soft_floor_pass"].alias("floor"), F.round(q["soft_score"], 6).alias("soft"), F.round(q["quality_score"], 6).alias("score"))


@register("trainability_cascade", with_sequences(f"""{_Q}
    SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'formatting_xml_tag' WHEN motifs = 0 THEN 'missing_catalytic_motif' WHEN motifs > 1 THEN 'motif_spam_rejected' WHEN NOT hard THEN 'hard_gate' WHEN NOT floor THEN 'soft_floor' WHEN NOT valid THEN 'invalid_amino_acids'
           WHEN soft < greatest(60, 88 - 12 * 0.45) THEN 'soft_threshold' ELSE 'ok' END AS reason FROM g"""))
def trainability_cascade(spark, sf_dir):
    markup = F.col("doc_id") % 17 == 0
    q = cand.quality(F.col("sequence"), F.col("text"), F.lit(False), F.lit(False))
    motifs = F.size(tx.motifs("sequence"))
    threshold = cand.soft_threshold(F.lit(0.45), F.lit(0.0))
    return sequences(spark, sf_dir).select("doc_id", cand.trainability(markup, F.lit(False), motifs, q["hard_gate_pass"], q["soft_floor_pass"], tx.valid_alphabet("sequence"), q["soft_score"], threshold).alias("reason"))


@register("bridge_flags", "SELECT p_partkey, coalesce(p >= 0.05, false) AS gate_pass, coalesce(p >= 0.05, false) AND m = 1 AND g AS functional, coalesce(p >= 0.05, false) AND m = 1 AND g AND f AS faithful FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 50) / 100.0 END AS p, p_partkey % 3 AS m, p_partkey % 2 = 0 AS g, p_partkey % 5 = 0 AS f FROM part)")
def bridge_flags(spark, sf_dir):
    k = F.col("p_partkey")
    flags = cand.bridge_flags(k % 3, k % 2 == 0, F.when(k % 4 > 0, k % 50 / 100.0), k % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in flags.items()))


@register("positive_admission")
def positive_admission(spark, sf_dir):
    k = F.col("p_partkey")
    hexes = F.concat(*(F.sha2(F.concat_ws("-", k, F.lit(i)), 256) for i in range(3)))
    base = F.translate(hexes, "0123456789abcdef", tx.ALPHABET[:16])
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", base.alias("sequence"), F.when(k % 2 == 0, "a cutinase").otherwise("other").alias("about"), (k % 3 > 0).alias("reviewed"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("sites"))
    return curation.admitted_positives(rows, "sequence", F.col("about"), ["petase", "cutinase"], F.col("reviewed"), F.col("sites"), (120, 360), 8, "p_partkey").select("p_partkey")


@register("negative_admission")
def negative_admission(spark, sf_dir):
    k = F.col("p_partkey")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.concat(F.substring(F.lit(tx.ALPHABET), 1, (k % 20 + 1).cast("int")), F.substring(F.lit(tx.ALPHABET), 1, (k % 15 + 1).cast("int"))).alias("sequence"))
    return curation.admitted_negatives(rows, "sequence", 7, "p_partkey").select("p_partkey", "repeat_length")


@register("positive_audit", """
    SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'missing_field' WHEN p_partkey % 5 = 0 THEN 'wrong_source' WHEN p_partkey % 7 = 0 THEN 'not_reviewed' WHEN p_partkey % 6 < 3 THEN 'too_few_sites' WHEN p_partkey % 3 = 0 THEN 'undocumented_basis' END AS failure FROM part""")
def positive_audit(spark, sf_dir):
    k = F.col("p_partkey")
    failure = curation.positive_audit(F.when(k % 5 == 0, "made").otherwise("natural_reference_record"), F.when(k % 8 > 0, k.cast("string")), k % 7 > 0, k % 6, F.when(k % 3 == 0, "natural").otherwise("natural_with_active_site"))
    return table(spark, sf_dir, "part").select("p_partkey", failure.alias("failure"))


@register("edit_audit", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'piece_length' WHEN p_partkey % 5 = 2 THEN 'out_of_bounds' WHEN p_partkey % 5 = 3 AND p_name[3:6] <> 'zzzz' THEN 'piece_missing' WHEN p_partkey % 5 = 4 THEN 'differs_outside' END AS failure FROM part WHERE length(p_name) >= 8""")
def edit_audit(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_name")
    p = table(spark, sf_dir, "part").filter(F.length("p_name") >= 8)
    bad = tx.splice(s, F.lit(3), F.lit("zzzz"))
    rejected = F.when(k % 5 == 3, s).when(k % 5 == 4, F.concat(bad, F.lit("!"))).otherwise(bad)
    failure = curation.edit_audit(s, rejected, F.when(k % 5 == 1, "zzz").otherwise("zzzz"), F.substring(s, 3, 4), F.when(k % 5 == 2, F.length(s)).otherwise(2), F.lit(4))
    return p.select("p_partkey", failure.alias("failure"))


@register("active_site_validation", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '3,8,10' END AS sites FROM part")
def active_site_validation(spark, sf_dir):
    k = F.col("p_partkey")
    seq = F.when(k % 3 == 1, "GASAAGADAH").when(k % 3 == 2, "GASAGGAHAD").otherwise("GASAGGADAH")
    s = curation.active_sites(seq, F.array(F.lit(10), F.lit(3), F.lit(8), F.lit(99)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(s.cast("array<string>"), ",").alias("sites"))


@register("pair_report", """
    WITH p AS (SELECT o_orderpriority AS prompt, o_orderstatus AS chosen, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE (o_custkey % 4)::VARCHAR END AS rejected FROM orders)
    SELECT count(*) AS pairs, count_if(rejected = '')::BIGINT AS blank, count_if(chosen = rejected)::BIGINT AS identical, count(DISTINCT prompt) AS prompts, min(length(chosen))::BIGINT AS shortest, max(length(chosen))::BIGINT AS longest,
           count_if(length(chosen) = length(rejected))::BIGINT AS length_matched, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)))::BIGINT AS repeated, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY chosen)) AS most_uses FROM p""")
def pair_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prompt"), F.col("o_orderstatus").alias("chosen"), F.when(F.col("o_custkey") % 9 == 0, "").otherwise((F.col("o_custkey") % 4).cast("string")).alias("rejected"))
    return curation.pair_report(o, "prompt", "chosen", "rejected")


@register("sparse_target_audit", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'position_count' WHEN 1 THEN 'set_size' WHEN 2 THEN 'empty_set' WHEN 3 THEN 'weight_sum' END AS problem FROM part")
def sparse_target_audit(spark, sf_dir):
    k = F.col("p_partkey")
    one, half = F.array(F.lit(7)), F.array(F.lit(0.5))
    empty_t, empty_w = F.array().cast("array<int>"), F.array().cast("array<double>")
    t = F.when(k % 5 == 0, F.array(one)).when(k % 5 == 2, F.array(one, empty_t)).otherwise(F.array(one, one))
    w = F.when(k % 5 == 1, F.array(F.array(F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.5)))).when(k % 5 == 2, F.array(F.array(F.lit(1.0)), empty_w)).when(k % 5 == 3, F.array(half, half)).otherwise(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0))))
    return table(spark, sf_dir, "part").select("p_partkey", curation.sparse_target_problem(t, w).alias("problem"))


@register("capacity_match")
def capacity_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("size"))
    return curation.capacity_match(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 3 = 1"), "p_partkey", "p_partkey", "size", 2, "m")


@register("membership_overlaps", """
    SELECT count_if(h AND t)::BIGINT AS train_holdout, count_if(h AND c)::BIGINT AS holdout_challenge, count_if(t AND c)::BIGINT AS train_challenge FROM (SELECT text, bool_or(doc_id % 5 = 0) AS h, bool_or(doc_id % 5 IN (1, 2)) AS t, bool_or(doc_id % 5 = 3) AS c FROM documents GROUP BY text)""")
def membership_overlaps(spark, sf_dir):
    k = F.col("doc_id") % 5
    g = table(spark, sf_dir, "documents").groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg(F.bool_or(k == 0).alias("h"), F.bool_or(k.isin(1, 2)).alias("t"), F.bool_or(k == 3).alias("c"))
    n = lambda a, b, name: F.count_if(F.col(a) & F.col(b)).alias(name)
    return g.agg(n("h", "t", "train_holdout"), n("h", "c", "holdout_challenge"), n("t", "c", "train_challenge"))


@register("baseline_lookup", "SELECT o.o_orderpriority AS grp, o.y, o.n, b.n AS baseline, CASE WHEN b.n IS NULL THEN 'baseline_group_missing' WHEN o.n >= b.n THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) o LEFT JOIN (SELECT o_orderpriority, year(o_orderdate) + 1 AS y, count(*) AS n FROM orders GROUP BY ALL) b ON o.o_orderpriority = b.o_orderpriority AND o.y = b.y")
def baseline_lookup(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    b = g.select("grp", (F.col("y") + 1).alias("y"), F.col("n").alias("baseline"))
    verdict = F.when(F.col("baseline").isNull(), "baseline_group_missing").when(F.col("n") >= F.col("baseline"), "pass").otherwise("fail")
    return g.join(b, ["grp", "y"], "left").withColumn("verdict", verdict)


@register("best_match_resolution", "SELECT c_custkey, o_orderkey, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, o_orderkey) AS k FROM (SELECT c_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END + CASE WHEN o_totalprice > c_acctbal * 20 THEN 8 ELSE 0 END AS score FROM customer JOIN orders ON c_custkey = o_custkey)) WHERE k = 1")
def best_match_resolution(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    s = F.when(F.col("o_orderstatus") == "F", 4).otherwise(0) + F.when(F.col("o_orderpriority").startswith("1"), 2).otherwise(0) + F.when(F.col("o_totalprice") > F.col("c_acctbal") * 20, 8).otherwise(0)
    return j.withColumn("score", s).groupBy("c_custkey").agg(F.max_by(F.struct("o_orderkey", "score"), F.struct("score", -F.col("o_orderkey"))).alias("x")).select("c_custkey", "x.*")


@register("distinct_rescoring", "SELECT doc_id, (len(list_distinct(string_split(text, ' '))) * 1000 + length(regexp_replace(text, '[^aeiou]', '', 'g')))::BIGINT AS score FROM documents")
def distinct_rescoring(spark, sf_dir):
    """Score each distinct text once and bring the score back to every row."""
    score = F.size(F.array_distinct(F.split("text", " "))) * 1000 + F.length(F.regexp_replace("text", "[^aeiou]", ""))
    return curation.scored_once(table(spark, sf_dir, "documents"), "text", F.when(F.col("text").isNotNull(), score.cast("long")), "score").select("doc_id", "score")


@register("job_waves", "SELECT p_brand, p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY sha256('wave|' || p_partkey)) - 1) // 6)::BIGINT AS wave FROM part")
def job_waves(spark, sf_dir):
    return selection.batches(table(spark, sf_dir, "part"), [selection.hash_order("wave", "p_partkey")], 6, ["p_brand"]).select("p_brand", "p_partkey", F.col("batch").alias("wave"))


@register("title_inventory", "SELECT regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS run_key, count(*) AS n, count(o_orderkey) AS planned FROM customer LEFT JOIN orders ON o_custkey = regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AND o_orderpriority LIKE '1%' GROUP BY 1")
def title_inventory(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long").alias("run_key"))
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("run_key"), "o_orderkey")
    return c.join(o, "run_key", "left").groupBy("run_key").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("planned"))


@register("recomputation_audit", "SELECT o_orderkey, 'total' AS problem FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - s) > 0.05 * o_totalprice UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def recomputation_audit(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "left")
    problem = F.when(F.col("s").isNull(), "missing").when(F.abs(F.col("o_totalprice") - F.col("s")) > 0.05 * F.col("o_totalprice"), "total")
    return j.select("o_orderkey", problem.alias("problem")).filter("problem IS NOT NULL")


@register("cell_yields", "SELECT source, count(*) AS attempts, count_if(q = 1)::BIGINT AS passes, round(avg((q IS NOT DISTINCT FROM 1)::INT), 6) AS yield, count_if(q IS NULL)::BIGINT AS invalid, count_if(k > 1)::BIGINT AS duplicate FROM (SELECT source, quality AS q, row_number() OVER (PARTITION BY text ORDER BY d.doc_id) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source")
def cell_yields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id", "left")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")))
    ok = F.coalesce(F.col("q") == 1, F.lit(False))
    return d.groupBy("source").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("passes"), F.round(F.avg(ok.cast("int")), 6).alias("yield"), F.count_if(F.col("q").isNull()).alias("invalid"), F.count_if(F.col("k") > 1).alias("duplicate"))


@register("lineage_order", "SELECT user_id, count_if(event_id <= p)::BIGINT AS out_of_order, max(event_id) AS terminal FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def lineage_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("event_id") <= F.col("p")).alias("out_of_order"), F.max("event_id").alias("terminal"))


@register("ordered_prefix", "SELECT o_custkey, max(CASE WHEN o_orderstatus <> 'O' THEN k END) IS NOT DISTINCT FROM nullif(count_if(o_orderstatus <> 'O'), 0) AS is_prefix FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_custkey")
def ordered_prefix(spark, sf_dir):
    o = selection.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], "k")
    begun = F.col("o_orderstatus") != "O"
    return o.groupBy("o_custkey").agg(F.max(F.when(begun, F.col("k"))).cast("long").eqNullSafe(F.nullif(F.count_if(begun), F.lit(0))).alias("is_prefix"))


@register("segment_ends", "SELECT o_custkey, least(30, count(*) + 10)::BIGINT AS segment_end FROM orders GROUP BY 1")
def segment_ends(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.least(F.lit(30).cast("long"), F.count("*") + 10).alias("segment_end"))


@register("lineage_upsert", "SELECT c_custkey AS step, c_name AS path FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_custkey % 1000 > 0 UNION ALL SELECT s_suppkey, s_name FROM supplier")
def lineage_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").filter("c_custkey % 1000 > 0").select(F.col("c_custkey").alias("step"), F.col("c_name").alias("path"))
    news = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("step"), F.col("s_name").alias("path"))
    # a new row replaces those with its step or its path: two equality joins instead of one with OR
    return datasets.upsert(base.join(news.select("path"), "path", "left_anti").select("step", "path"), news, ["step"])


@register("named_sequences", "SELECT 'step' || o_orderkey || CASE WHEN l_returnflag = 'A' THEN '-sel' ELSE '-cand' END || l_linenumber AS label, l_shipmode AS sequence FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'")
def named_sequences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(F.collect_list(F.struct("l_linenumber", F.col("l_linestatus").alias("sequence"), (F.col("l_returnflag") == "A").alias("selected"), (F.col("l_returnflag") == "N").alias("is_trainable"))).alias("candidates"))
    c = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step")), "step").select("step", F.explode("candidates").alias("c")).filter("c.selected OR c.is_trainable")
    return c.select(F.concat(F.lit("step"), "step", F.when(F.col("c.selected"), "-sel").otherwise("-cand"), "c.l_linenumber").alias("label"), F.col("c.sequence").alias("sequence"))


@register("prompt_subset", "SELECT conv_id, turn FROM conversations ORDER BY sha256('p|' || conv_id || '|' || turn) LIMIT 40")
def prompt_subset(spark, sf_dir):
    return table(spark, sf_dir, "conversations").orderBy(selection.hash_order("p", "conv_id", "turn")).limit(40).select("conv_id", "turn")


@register("topk_after_prompt", "SELECT vec_id, i - 16 AS position, round(embedding[i]::DOUBLE, 6) AS logprob FROM embeddings, unnest(range(17, 25)) u(i)")
def topk_after_prompt(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 17, 8)).alias("p", "x"))
    return e.select("vec_id", (F.col("p") + 1).cast("long").alias("position"), F.round(F.col("x").cast("double"), 6).alias("logprob"))


@register("file_discovery", """
    SELECT n_name AS name, c.n AS customers FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey WHERE n_regionkey <> 2""")
def file_discovery(spark, sf_dir):
    """Customers written as files of runs under a tree, one folder a region and nation; those of one region are old. What discovery finds is read back and counted."""
    root = records.scratch_path(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 2, "old").otherwise(F.concat(F.lit("region-"), "n_regionkey")).alias("area"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    c.select("c_custkey", "n_name", "area", F.concat(F.lit("run-"), "n_nationkey").alias("run")).write.partitionBy("area", "run").json(root)
    found = records.discover(spark, root, r"/run=run-[0-9]+/part-.*\.json$", r"/area=old/").select("path")
    # each file is read where it was found: its rows carry its path
    rows = spark.read.schema("c_custkey long, n_name string").option("recursiveFileLookup", "true").json(root).withColumn("path", F.input_file_name())
    plain = lambda p: F.regexp_replace(F.col(p), "^file:/+", "/")
    kept = rows.withColumn("at", plain("path")).join(found.select(plain("path").alias("at")), "at", "left_semi")
    return kept.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("customers"))


@register("tolerant_documents", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE role END AS role FROM conversations")
def tolerant_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "[1, 2").otherwise(F.to_json(F.struct("role"))).alias("t"))
    return records.json_documents(t, "t", "role string").select("conv_id", "turn", "document.role")
