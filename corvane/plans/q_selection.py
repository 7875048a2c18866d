"""Queries that screen, rank, select, deduplicate, split and pair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import pairs, selection, similarity
from corvane.operators.candidates import confidence_weight
from corvane.sources.records import scratch_table

from .catalog import register
from .views import candidates, sequences, spread, table, with_candidates

C = with_candidates


@register("safe_casts", """
    SELECT c_custkey, CASE WHEN m IN ('yes', 'pass', '1') THEN true WHEN m IN ('no', 'fail') THEN false END AS flag,
           CASE WHEN isfinite(coalesce(try_cast(x AS DOUBLE), 'nan'::DOUBLE)) THEN try_cast(x AS DOUBLE) ELSE -1.0 END AS number
    FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'pass' WHEN 3 THEN 'fail' WHEN 4 THEN '1' ELSE 'maybe' END AS m,
                 CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' WHEN 2 THEN '1.5' ELSE '2' END AS x FROM customer)""")
def safe_casts(spark, sf_dir):
    k = F.col("c_custkey")
    m = F.element_at(F.array(*map(F.lit, (" YES ", "no", "Pass", "fail", "1", "maybe"))), (k % 6 + 1).cast("int"))
    x = F.element_at(F.array(*map(F.lit, ("x", "NaN", "1.5", "2"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", pairs.as_flag(m).alias("flag"), pairs.as_number(x, -1.0).alias("number"))


@register("alias_coalesce", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name ELSE 'none' END AS value FROM customer")
def alias_coalesce(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, "").alias("prompt"), F.struct(F.when(k % 3 == 1, F.col("c_name")).alias("source_prompt")).alias("metrics"))
    return df.select("c_custkey", pairs.first_present(df, ("prompt", "source_prompt"), ("metrics", "quality"), F.lit("none")).alias("value"))


@register("gate_reasons", C("""
    SELECT doc_id, hard_gate_pass AND artifact_free AND context_pass AND novelty_pass AND fold_pass AS gate,
           array_to_string(list_filter([CASE WHEN NOT artifact_free THEN 'artifact_gate_failed' END, CASE WHEN NOT family_pass THEN 'family_plausibility_failed' END, CASE WHEN NOT context_pass THEN 'catalytic_context_failed' END,
               CASE WHEN NOT novelty_pass THEN 'novelty_window_failed' END, CASE WHEN NOT fold_pass THEN 'fold_confidence_failed' END], lambda x: x IS NOT NULL), ',') AS reasons,
           CASE WHEN NOT artifact_free THEN 'artifact' WHEN NOT hard_gate_pass THEN 'hard_gate' WHEN NOT fold_pass THEN 'soft_floor' WHEN score < 0.4 THEN 'soft_threshold' ELSE 'ok' END AS first_reason FROM c"""))
def gate_reasons(spark, sf_dir):
    c = candidates(spark, sf_dir)
    no = lambda n: ~F.col(n)
    failed = [(no("artifact_free"), "artifact_gate_failed"), (no("family_pass"), "family_plausibility_failed"), (no("context_pass"), "catalytic_context_failed"), (no("novelty_pass"), "novelty_window_failed"), (no("fold_pass"), "fold_confidence_failed")]
    cascade = [(no("artifact_free"), "artifact"), (no("hard_gate_pass"), "hard_gate"), (no("fold_pass"), "soft_floor"), (F.col("score") < 0.4, "soft_threshold")]
    gate = F.col("hard_gate_pass") & F.col("artifact_free") & F.col("context_pass") & F.col("novelty_pass") & F.col("fold_pass")
    return c.select("doc_id", gate.alias("gate"), F.array_join(pairs.reasons(failed), ",").alias("reasons"), pairs.first_reason(cascade).alias("first_reason"))


@register("screening_modes", C("""
    SELECT mode, doc_id FROM c, (VALUES ('hard_motif'), ('hard_motif_core_or_geom'), ('hard_motif_core_or_geom_or_esm'), ('hard_core_or_geom_or_esm')) m(mode)
    WHERE hard_gate_pass AND CASE mode WHEN 'hard_motif' THEN family_pass WHEN 'hard_motif_core_or_geom' THEN family_pass AND (context_pass OR fold_pass)
          WHEN 'hard_motif_core_or_geom_or_esm' THEN family_pass AND (context_pass OR fold_pass OR audit_pass) ELSE context_pass OR fold_pass OR audit_pass END"""))
def screening_modes(spark, sf_dir):
    c = candidates(spark, sf_dir)
    on = [F.col(n) for n in ("hard_gate_pass", "family_pass", "context_pass", "fold_pass", "audit_pass")]
    modes = ("hard_motif", "hard_motif_core_or_geom", "hard_motif_core_or_geom_or_esm", "hard_core_or_geom_or_esm")
    kept = F.filter(F.array(*(F.when(pairs.screen(m, *on), F.lit(m)) for m in modes)), lambda x: x.isNotNull())
    return c.select(F.explode(kept).alias("mode"), "doc_id")


_PAIRS = """
    , b AS (SELECT *, (length // 500 * 500) AS bucket FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY score DESC, doc_id) AS place FROM b),
    p AS (SELECT l.lang, l.bucket, l.place AS lp, r.place AS rp, l.doc_id AS ld, r.doc_id AS rd, l.score - r.score AS delta,
            (l.score >= r.score AND l.novelty >= r.novelty AND l.fold >= r.fold AND (l.score > r.score OR l.novelty > r.novelty OR l.fold > r.fold)) AS ldom,
            (r.score >= l.score AND r.novelty >= l.novelty AND r.fold >= l.fold AND (r.score > l.score OR r.novelty > l.novelty OR r.fold > l.fold)) AS rdom,
            l.hard_gate_pass AS lh, r.hard_gate_pass AS rh, l.artifact_free AS la, r.artifact_free AS ra, l.context_pass AS lc, r.context_pass AS rc
          FROM o l JOIN o r ON l.lang = r.lang AND l.bucket = r.bucket AND l.place < r.place AND l.text_hash <> r.text_hash),
    d AS (SELECT *, CASE WHEN lh <> rh THEN 'hard_gate_pass' WHEN la <> ra THEN 'artifact_free' WHEN lc <> rc THEN 'context_pass' WHEN ldom <> rdom THEN 'pareto_dominance' WHEN abs(delta) >= 0.05 THEN 'scalar_score_margin' END AS rule,
                 CASE WHEN lh <> rh THEN lh WHEN la <> ra THEN la WHEN lc <> rc THEN lc WHEN ldom <> rdom THEN ldom ELSE delta > 0 END AS lw FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY lp, rp) AS pair FROM d WHERE rule IS NOT NULL)"""


@register("preference_pairs", C(f"""{_PAIRS}
    SELECT lang, bucket, pair::INTEGER AS pair, CASE WHEN lw THEN ld ELSE rd END AS chosen, CASE WHEN lw THEN rd ELSE ld END AS rejected, rule FROM n WHERE pair <= 128"""))
def preference_pairs(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("bucket", (F.floor(F.col("length") / 500) * 500).cast("long"))
    return pairs.preference_pairs(c, "doc_id", "text_hash", ["lang", "bucket"], ["hard_gate_pass", "artifact_free", "context_pass"], ["score", "novelty", "fold"], "score")


@register("pareto_winners", C("""
    , e AS (SELECT *, round(CASE WHEN doc_id % 4 = 0 THEN (artifact_free::INT + family_pass::INT + context_pass::INT + novelty_pass::INT + fold_pass::INT + score + audit_pass::INT) / (6.0::DOUBLE + audit_pass::INT)
                            ELSE (score + novelty + fold / 100 + audit_pass::INT) / (3.0::DOUBLE + audit_pass::INT) END, 4) AS weight FROM c WHERE hard_gate_pass AND artifact_free)
    SELECT doc_id, score, weight FROM e a WHERE weight >= 0.3 AND NOT EXISTS (
        SELECT 1 FROM e b WHERE b.score >= a.score AND b.novelty >= a.novelty AND b.fold >= a.fold AND (b.score > a.score OR b.novelty > a.novelty OR b.fold > a.fold))"""))
def pareto_winners(spark, sf_dir):
    c = candidates(spark, sf_dir)
    axes = F.create_map(F.lit("score"), F.col("score"), F.lit("novelty"), F.col("novelty"), F.lit("fold"), F.col("fold") / 100)
    scores = F.when(F.col("doc_id") % 4 != 0, axes).otherwise(F.create_map().cast("map<string,double>"))
    weight = confidence_weight(scores, F.col("audit_pass"), [F.col(g) for g in ("artifact_free", "family_pass", "context_pass", "novelty_pass", "fold_pass")], F.col("score"))
    return pairs.winners(c, "doc_id", F.col("hard_gate_pass") & F.col("artifact_free"), ["score", "novelty", "fold"], weight, 0.3, "score").select("doc_id", "score", "weight")


_PRIORITY = "family_pass DESC, context_pass DESC, fold_pass DESC, score DESC, (CASE WHEN gap_error IS NULL THEN 0 ELSE 1.0 / (1 + gap_error) END) DESC, 1 - novelty DESC, length, doc_id"


def priority():
    """Order of hits: gates first, then scores, then small gaps, novelty and short length; ids settle ties."""
    return [F.desc("family_pass"), F.desc("context_pass"), F.desc("fold_pass"), F.desc("score"), F.desc(F.coalesce(1.0 / (1 + F.col("gap_error")), F.lit(0.0))), F.desc(1 - F.col("novelty")), F.asc("length"), F.asc("doc_id")]


@register("dedup_keep_best", C(f"SELECT doc_id, text_hash FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY {_PRIORITY}) AS r FROM c) WHERE r = 1"))
def dedup_keep_best(spark, sf_dir):
    return selection.keep_first(candidates(spark, sf_dir), ["text_hash"], priority()).select("doc_id", "text_hash")


@register("dedup_keep_first", C("SELECT min(doc_id) AS doc_id, text_hash FROM c GROUP BY text_hash"))
def dedup_keep_first(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_hash")


@register("duplicate_flags", C("SELECT doc_id, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) > 1 AS duplicate FROM c"))
def duplicate_flags(spark, sf_dir):
    return selection.ranked(candidates(spark, sf_dir), ["text_hash"], [F.col("doc_id")]).select("doc_id", (F.col("rank") > 1).alias("duplicate"))


@register("duplicate_triples", C("SELECT lang, source, text_hash, count(*) AS copies FROM c GROUP BY ALL HAVING count(*) > 1"))
def duplicate_triples(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("lang", "source", "text_hash").agg(F.count("*").alias("copies")).filter("copies > 1")


@register("stage_1_rank", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders")
def stage_1_rank(spark, sf_dir):
    return selection.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "rank")


@register("stage_2_pool", """
    WITH r AS (SELECT *, o_orderstatus = 'F' AS ok, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS has, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, o_orderkey FROM r WHERE CASE WHEN has THEN ok AND k <= 4 ELSE k = 1 END""")
def stage_2_pool(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return selection.pool_or_first(o, ["o_custkey"], F.col("o_orderstatus") == "F", [F.desc("o_totalprice"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey")


@register("best_by_level", """
    WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS level FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY level, o_totalprice DESC, o_orderkey) AS k FROM r)
    SELECT o_custkey, o_orderkey, level::INTEGER AS level FROM k WHERE k = 1""")
def best_by_level(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    return selection.best_by_level(table(spark, sf_dir, "orders"), ["o_custkey"], [done & F.col("o_orderpriority").startswith("1"), done], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "level")


@register("global_top_k", C(f"SELECT doc_id, score FROM c ORDER BY {_PRIORITY} LIMIT 50"))
def global_top_k(spark, sf_dir):
    return candidates(spark, sf_dir).orderBy(*priority()).limit(50).select("doc_id", "score")


@register("anchor_lists", C("""
    SELECT CASE WHEN family_pass THEN 'strict' ELSE 'bridge_only' END AS role, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY family_pass ORDER BY score DESC, doc_id) AS k FROM c WHERE hard_gate_pass) WHERE k <= 10"""))
def anchor_lists(spark, sf_dir):
    c = candidates(spark, sf_dir).filter("hard_gate_pass").withColumn("role", F.when(F.col("family_pass"), "strict").otherwise("bridge_only"))
    return selection.top_per_group(c, ["role"], [F.desc("score"), F.col("doc_id")], 10).select("role", "doc_id")


@register("capped_selection", C("SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM c) WHERE k <= 5 ORDER BY score DESC, doc_id LIMIT 60"))
def capped_selection(spark, sf_dir):
    return selection.capped(candidates(spark, sf_dir), "source", [F.desc("score"), F.col("doc_id")], 5, 60).select("doc_id", "source", "score")


@register("round_robin_selection", C("SELECT doc_id, source, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS turn FROM c) WHERE turn <= 8 ORDER BY turn, source LIMIT 70"))
def round_robin_selection(spark, sf_dir):
    return selection.round_robin(candidates(spark, sf_dir), "source", [F.desc("score"), F.col("doc_id")], 8, 70).select("doc_id", "source", "turn")


@register("multi_capped_selection")
def multi_capped_selection(spark, sf_dir):
    c = candidates(spark, sf_dir).select("doc_id", "lang", "source", "score")
    return selection.multi_capped(c, {"lang": 20, "source": 4}, [F.desc("score"), F.col("doc_id")], 40)


@register("spread_panel")
def spread_panel(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return selection.spread_panel(p, "p_name", [F.col("p_partkey")], 3, 96)


@register("leader_clusters")
def leader_clusters(spark, sf_dir):
    return selection.leaders(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", [F.col("p_partkey")], 3)


@register("farthest_first")
def farthest_first(spark, sf_dir):
    from corvane.functions import text as tx

    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return selection.farthest_first(p.select("p_partkey", tx.kmers("p_name", 3).alias("grams")), "grams", [F.col("p_partkey")], 12).select("p_partkey")


@register("balanced_picks")
def balanced_picks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return selection.least_used(p, "p_brand", "p_type", [selection.hash_order("b", "p_brand"), F.col("p_partkey")], 20)


@register("stratified_sample", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY sha256('panel|' || p_partkey)) AS k FROM part) WHERE k <= 7")
def stratified_sample(spark, sf_dir):
    return selection.top_per_group(table(spark, sf_dir, "part"), ["p_type"], [selection.hash_order("panel", "p_partkey")], 7).select("p_type", "p_partkey")


@register("hash_group_sample", """
    WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 10) SELECT o_custkey, n FROM g ORDER BY sha256('hold|' || o_custkey) LIMIT 20""")
def hash_group_sample(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n = 10")
    return g.orderBy(selection.hash_order("hold", "o_custkey")).limit(20)


@register("oversampled_union", C("SELECT doc_id, k::INTEGER AS copy, 'strict' AS role FROM c, unnest(range(0, 3)) u(k) WHERE family_pass AND audit_pass UNION ALL SELECT doc_id, 0::INTEGER, 'bridge' FROM c WHERE NOT family_pass"))
def oversampled_union(spark, sf_dir):
    c = candidates(spark, sf_dir)
    strict = selection.repeated(c.filter("family_pass AND audit_pass").select("doc_id"), 3).withColumn("role", F.lit("strict"))
    return strict.unionByName(c.filter("NOT family_pass").select("doc_id", F.lit(0).alias("copy"), F.lit("bridge").alias("role")))


@register("fixed_batches", "SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::BIGINT AS batch FROM orders")
def fixed_batches(spark, sf_dir):
    return selection.batches(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], 4, ["o_custkey"]).select("o_orderkey", "o_custkey", "batch")


@register("label_shuffle", """
    WITH r AS (SELECT s.*, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('swap|' || s_suppkey)) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier s)
    SELECT s_suppkey, CASE WHEN k <= n // 2 THEN 'rejected' ELSE 'chosen' END AS chosen, k <= n // 2 AS swapped FROM r""")
def label_shuffle(spark, sf_dir):
    w = Window.partitionBy("s_nationkey")
    r = selection.ranked(table(spark, sf_dir, "supplier"), ["s_nationkey"], [selection.hash_order("swap", "s_suppkey")], "k").withColumn("swapped", F.col("k") <= F.floor(F.count("*").over(w) / 2))
    return r.select("s_suppkey", F.when(F.col("swapped"), "rejected").otherwise("chosen").alias("chosen"), "swapped")


@register("grouped_holdout", """
    WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY sha256('s|' || source)) AS upto, sum(n) OVER () AS total FROM g)
    SELECT doc_id, CASE WHEN upto <= total * 0.2 THEN 'holdout' ELSE 'train' END AS part FROM documents JOIN r USING (source)""")
def grouped_holdout(spark, sf_dir):
    from corvane.operators.datasets import grouped_split

    return grouped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.2, "s").select("doc_id", "part")


@register("role_unpivot", "SELECT o_orderkey, role, value FROM (SELECT o_orderkey, 'chosen' AS role, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'rejected', o_orderpriority FROM orders)")
def role_unpivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chosen"), F.col("o_orderpriority").alias("rejected")).unpivot("o_orderkey", ["chosen", "rejected"], "role", "value")


@register("leakage_checks", """
    WITH t AS (SELECT DISTINCT text FROM documents WHERE doc_id % 5 > 0), h AS (SELECT DISTINCT text FROM documents WHERE doc_id % 5 = 0)
    SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM h)) AS overlap, (SELECT count(*) FROM (SELECT * FROM h EXCEPT SELECT * FROM t)) AS holdout_only, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM h)) AS train_only""")
def leakage_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.bool_or(F.col("doc_id") % 5 == 0).alias("holdout"), F.bool_or(F.col("doc_id") % 5 > 0).alias("train"))
    return d.agg(F.count_if(F.col("holdout") & F.col("train")).alias("overlap"), F.count_if(F.col("holdout") & ~F.col("train")).alias("holdout_only"), F.count_if(~F.col("holdout") & F.col("train")).alias("train_only"))


@register("novelty_by_kmers", """
    WITH q AS (SELECT p_partkey, p_name AS s FROM part), r AS (SELECT p_partkey AS r, p_name AS t FROM part),
    g AS (SELECT DISTINCT p_partkey, s[i:i + 2] AS gram FROM q, unnest(range(1, greatest(length(s) - 1, 2))) u(i)), k AS (SELECT DISTINCT r, t[i:i + 2] AS gram FROM r, unnest(range(1, greatest(length(t) - 1, 2))) u(i)),
    gn AS (SELECT p_partkey, count(*) AS n FROM g GROUP BY 1), kn AS (SELECT r, count(*) AS n FROM k GROUP BY 1),
    j AS (SELECT p_partkey, r, count(*) AS b FROM g JOIN k USING (gram) GROUP BY ALL), m AS (SELECT q.p_partkey, r.r, coalesce(b / (gn.n + kn.n - b), 0) AS jaccard FROM q JOIN r ON r.r <> q.p_partkey LEFT JOIN j ON j.p_partkey = q.p_partkey AND j.r = r.r JOIN gn ON gn.p_partkey = q.p_partkey JOIN kn ON kn.r = r.r),
    x AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY jaccard DESC, r) AS k FROM m), f AS (SELECT x.*, 1 - levenshtein(s, t) / greatest(length(s), length(t)) AS identity FROM x JOIN q USING (p_partkey) JOIN r USING (r) WHERE k <= 32),
    z AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY identity DESC, k) AS o FROM f WHERE identity > 0)
    SELECT q.p_partkey, z.r AS nearest, round(coalesce(identity, 0), 6) AS identity, round(coalesce(jaccard, 0), 6) AS jaccard FROM q LEFT JOIN (SELECT * FROM z WHERE o = 1) z USING (p_partkey)""")
def novelty_by_kmers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    refs = p.select(F.col("p_partkey").alias("nearest"), "p_name")
    found = similarity.nearest_by_kmers(p, refs, "p_partkey", "nearest", "p_name", other=True)
    return found.select("p_partkey", "nearest", F.round("identity", 6).alias("identity"), F.round("jaccard", 6).alias("jaccard"))


@register("edit_pairs", "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 2")
def edit_pairs(spark, sf_dir):
    return similarity.edit_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", 2, F.col("p_brand"))


@register("edit_clusters", """
    WITH RECURSIVE e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 2),
    r AS (SELECT p_partkey AS x, p_partkey AS y FROM part UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS p_partkey, min(y) AS component FROM r GROUP BY x""")
def edit_clusters(spark, sf_dir):
    return similarity.edit_clusters(table(spark, sf_dir, "part"), "p_partkey", "p_name", 2, scratch_table, F.col("p_brand"))


@register("nearest_neighbour", """
    WITH e AS (SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 2)
    SELECT a AS p_partkey, b AS nearest, d::INTEGER AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM e) WHERE k = 1""")
def nearest_neighbour(spark, sf_dir):
    return similarity.nearest_by_edits(table(spark, sf_dir, "part"), "p_partkey", "p_name", 2, scratch_table, F.col("p_brand"))


@register("anchor_neighbourhoods", """
    WITH a AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20), n AS (SELECT a.p_partkey AS anchor, b.p_size > 25 AS flag, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS identity
      FROM a JOIN part b ON a.p_name <> b.p_name AND abs(length(a.p_name) - length(b.p_name)) / greatest(length(a.p_name), length(b.p_name), 1) <= 1 - 0.5)
    SELECT anchor, threshold, count(*) AS neighbours, count_if(flag)::BIGINT AS flagged, count_if(NOT flag)::BIGINT AS unflagged FROM n JOIN (VALUES (0.9::DOUBLE), (0.7), (0.5)) t(threshold) ON identity >= threshold GROUP BY ALL""")
def anchor_neighbourhoods(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return similarity.neighbourhood(p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20), p, "p_partkey", "p_name", [0.9, 0.7, 0.5], F.col("p_size") > 25)


@register("neighbourhood_reports", """
    WITH a AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20), n AS (SELECT a.p_partkey AS anchor, b.*, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS identity
      FROM a JOIN part b ON a.p_name <> b.p_name AND abs(length(a.p_name) - length(b.p_name)) / greatest(length(a.p_name), length(b.p_name), 1) <= 1 - 0.5)
    SELECT a.p_partkey AS anchor, CASE WHEN a.p_size > 25 THEN 'strict' ELSE 'bridge_only' END AS role, threshold, count(n.anchor) AS neighbours, count(CASE WHEN n.p_size > 25 THEN 1 END) AS strict, count(CASE WHEN n.p_size <= 25 AND n.p_partkey % 3 > 0 THEN 1 END) AS bridge_only,
           count(DISTINCT n.p_brand) AS buckets, count(DISTINCT n.p_size) AS clusters, coalesce(array_to_string((list(n.p_partkey ORDER BY identity DESC, n.p_size DESC, n.p_retailprice DESC, n.p_partkey) FILTER (n.p_partkey IS NOT NULL))[1:5], ','), '') AS examples
    FROM a CROSS JOIN (VALUES (0.9::DOUBLE), (0.7), (0.5)) t(threshold) LEFT JOIN n ON n.anchor = a.p_partkey AND identity >= threshold GROUP BY a.p_partkey, a.p_size, threshold""")
def neighbourhood_reports(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    anchors = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
    r = similarity.neighbourhood_reports(anchors, spread(p, "p_partkey"), "p_partkey", "p_name", [0.9, 0.7, 0.5], F.col("p_size") > 25, F.col("p_partkey") % 3 > 0, F.col("p_brand"), F.col("p_size"), [-F.col("p_size"), -F.col("p_retailprice")], 5)
    return r.withColumn("examples", F.array_join("examples", ","))


@register("anchor_classes", """
    WITH a AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40), n AS (SELECT a.p_partkey, b.p_size > 25 AS flag, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS identity
      FROM a JOIN part b ON a.p_name <> b.p_name AND abs(length(a.p_name) - length(b.p_name)) / greatest(length(a.p_name), length(b.p_name), 1) <= 1 - 0.5),
    c AS (SELECT p_partkey, count_if(identity >= 0.65) AS near, count_if(identity >= 0.65 AND flag) AS strict, count_if(identity >= 0.65 AND NOT flag) AS bridge, count_if(identity >= 0.5) AS wide FROM n GROUP BY 1)
    SELECT p_partkey, coalesce(near, 0)::BIGINT AS near, coalesce(wide, 0)::BIGINT AS wide, CASE WHEN near >= 3 AND strict > 0 AND bridge > 0 THEN 'green' WHEN near >= 3 OR wide >= 5 THEN 'yellow' ELSE 'red' END AS class FROM a LEFT JOIN c USING (p_partkey)""")
def anchor_classes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return similarity.anchor_classes(p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(40), p, "p_partkey", "p_name", F.col("p_size") > 25, 0.65, 0.5).select("p_partkey", "near", "wide", "class")


@register("prefilter_tiers", C("""
    , p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) / count(*) OVER (PARTITION BY lang) AS share FROM c WHERE hard_gate_pass AND artifact_free)
    SELECT doc_id, CASE WHEN share <= 0.2 THEN 'A' WHEN share <= 0.5 THEN 'B' ELSE 'C' END AS tier, substr(sha256('explore|' || doc_id), 1, 2) < '14' AS explore FROM p"""))
def prefilter_tiers(spark, sf_dir):
    w = Window.partitionBy("lang")
    c = candidates(spark, sf_dir).filter("hard_gate_pass AND artifact_free")
    share = F.row_number().over(w.orderBy(F.desc("score"), "doc_id")) / F.count("*").over(w)
    return c.select("doc_id", F.when(share <= 0.2, "A").when(share <= 0.5, "B").otherwise("C").alias("tier"), (F.substring(selection.hash_order("explore", "doc_id"), 1, 2) < "14").alias("explore"))


@register("blocking_keys", "SELECT (length(text) // 16)::BIGINT AS band, text[1:24] AS head, text[-24:] AS tail, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def blocking_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    g = d.groupBy(F.floor(F.length("text") / 16).alias("band"), F.substring("text", 1, 24).alias("head"), F.right("text", F.lit(24)).alias("tail"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
