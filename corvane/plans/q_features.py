"""Queries over feature expressions, penalties and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import kernels, scores
from corvane.functions import text as tx
from corvane.operators import evaluation

from .catalog import register
from .views import SEQUENCES, sequences, table, with_sequences

_COUNTS = "n AS (SELECT doc_id, ch, count(*) AS k FROM s, unnest(string_split(sequence, '')) AS u(ch) WHERE ch <> '' GROUP BY ALL)"


@register("composition_features", with_sequences(f"""
    , {_COUNTS}, t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY doc_id),
    e AS (SELECT doc_id, -sum(k / total * log2(k / total)) AS entropy, count(*) AS kinds, max(k) / max(total) AS top FROM n JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(sequence)::BIGINT AS length, round(coalesce(entropy, 0), 6) AS entropy, coalesce(kinds, 0)::BIGINT AS unique_residues,
           round(coalesce(top, 0), 6) AS dominant_fraction,
           round(coalesce(length(sequence) / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), 0), 6) AS letter_ratio,
           regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+') AS valid_alphabet
    FROM s LEFT JOIN e USING (doc_id)"""))
def composition_features(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("c", kernels.composition("sequence"))
    return s.select(
        "doc_id", F.length("sequence").cast("long").alias("length"), F.round("c.entropy", 6).alias("entropy"), F.col("c.kinds").alias("unique_residues"),
        F.round("c.top", 6).alias("dominant_fraction"), F.round(tx.letter_ratio("sequence", "text"), 6).alias("letter_ratio"), tx.valid_alphabet("sequence").alias("valid_alphabet"),
    )


@register("cheap_screens", with_sequences(f"""
    , {_COUNTS}, t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY doc_id),
    e AS (SELECT doc_id, -sum(k / total * log2(k / total)) AS entropy, count(*) AS kinds, max(k) / max(total) AS top FROM n JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT s.doc_id, length(sequence)::BIGINT AS length FROM s JOIN e USING (doc_id)
    WHERE length(sequence) BETWEEN 120 AND 3600 AND kinds >= 14 AND entropy >= 3.2 AND top <= 0.34"""))
def cheap_screens(spark, sf_dir):
    s = sequences(spark, sf_dir).filter(F.length("sequence").between(120, 3600))
    s = s.withColumn("c", kernels.composition("sequence"))
    return s.filter("c.kinds >= 14 AND c.entropy >= 3.2 AND c.top <= 0.34").select("doc_id", F.length("sequence").cast("long").alias("length"))


@register("kmer_features", with_sequences("""
    , k AS (SELECT doc_id, count(DISTINCT sequence[i:i + 3]) AS kinds, count(*) AS total FROM s, unnest(range(1, greatest(length(sequence) - 2, 1))) AS u(i) WHERE length(sequence) >= 4 GROUP BY doc_id)
    SELECT s.doc_id, round(CASE WHEN length(sequence) >= 4 THEN kinds / total WHEN length(sequence) > 0 THEN 1.0 ELSE 0.0 END, 6) AS kmer_uniqueness,
           coalesce(kinds, CASE WHEN length(sequence) > 0 THEN 1 ELSE 0 END)::BIGINT AS kmer_count FROM s LEFT JOIN k USING (doc_id)"""))
def kmer_features(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("kmer_count", kernels.kmer_count("sequence", 4))
    all_ = F.greatest(F.length("sequence") - 3, F.lit(1))
    return s.select("doc_id", F.round(F.coalesce(F.col("kmer_count") / all_, F.lit(0.0)), 6).alias("kmer_uniqueness"), "kmer_count")


_MOTIF = "h AS (SELECT doc_id, i, sequence[i:i + 4] AS motif, length(sequence) AS n FROM s, unnest(range(1, greatest(length(sequence) - 3, 1))) AS u(i) WHERE regexp_full_match(sequence[i:i + 4], 'G[A-Z]S[A-Z]G'))"


@register("motif_scan", with_sequences(f"""
    , {_MOTIF}, a AS (SELECT doc_id, count(*) AS motif_count, string_agg(motif, ',' ORDER BY i) AS motifs, string_agg((i + 2)::VARCHAR, ',' ORDER BY i) AS positions FROM h GROUP BY doc_id)
    SELECT s.doc_id, coalesce(motif_count, 0)::BIGINT AS motif_count, coalesce(motifs, '') AS motifs, coalesce(positions, '') AS positions FROM s LEFT JOIN a USING (doc_id)"""))
def motif_scan(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("m", tx.motifs("sequence"))
    return s.select("doc_id", F.size("m").cast("long").alias("motif_count"), F.array_join("m", ",").alias("motifs"), F.array_join(tx.motif_positions("sequence").cast("array<string>"), ",").alias("positions"))


_GAPS = f"""
    , {_MOTIF}, p AS (SELECT doc_id, i, sequence[i] AS ch, length(sequence) AS n FROM s, unnest(range(1, length(sequence) + 1)) AS u(i) WHERE sequence[i] IN ('D', 'H')),
    ser AS (SELECT doc_id, i + 2 AS at FROM h WHERE (i + 2) / n BETWEEN 0.45 AND 0.75),
    asp AS (SELECT doc_id, i AS at FROM p WHERE ch = 'D' AND i / n BETWEEN 0.72 AND 0.92),
    his AS (SELECT doc_id, i AS at FROM p WHERE ch = 'H' AND i / n BETWEEN 0.82 AND 0.98),
    sa AS (SELECT ser.doc_id, asp.at, min(abs(asp.at - ser.at - 55)) AS e FROM ser JOIN asp ON ser.doc_id = asp.doc_id AND asp.at > ser.at GROUP BY ALL),
    ah AS (SELECT asp.doc_id, asp.at, min(abs(his.at - asp.at - 13)) AS e FROM asp JOIN his ON his.doc_id = asp.doc_id AND his.at > asp.at GROUP BY ALL),
    sh AS (SELECT ser.doc_id, min(abs(his.at - ser.at - 68)) AS e FROM ser JOIN his ON ser.doc_id = his.doc_id AND his.at > ser.at GROUP BY ALL),
    sa1 AS (SELECT doc_id, min(e) AS e FROM sa GROUP BY ALL), ah1 AS (SELECT doc_id, min(e) AS e FROM ah GROUP BY ALL),
    tri AS (SELECT sa.doc_id, min(sa.e + ah.e) AS e FROM sa JOIN ah ON sa.doc_id = ah.doc_id AND sa.at = ah.at GROUP BY ALL)"""


def _gaps(s):
    return evaluation.geometry(s.select("doc_id", "sequence"))


@register("catalytic_geometry", with_sequences(f"""{_GAPS}
    SELECT s.doc_id, sa1.e::BIGINT AS ser_asp, ah1.e::BIGINT AS asp_his, sh.e::BIGINT AS ser_his, tri.e::BIGINT AS best, coalesce(tri.e <= 20, false) AS passes
    FROM s LEFT JOIN sa1 USING (doc_id) LEFT JOIN ah1 USING (doc_id) LEFT JOIN sh USING (doc_id) LEFT JOIN tri USING (doc_id)"""))
def catalytic_geometry(spark, sf_dir):
    return _gaps(sequences(spark, sf_dir)).select("doc_id", "ser_asp", "asp_his", "ser_his", "best", F.coalesce(F.col("best") <= 20, F.lit(False)).alias("passes"))


_EVALUATED = SEQUENCES.replace("upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))", "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'ACDEFG')")


@register("candidate_evaluation", f"""
    WITH every AS ({_EVALUATED}), s AS (SELECT * FROM every WHERE doc_id % 100 = 0){_GAPS}, {_COUNTS}, t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY doc_id),
    e AS (SELECT doc_id, -sum(k / total * log2(k / total)) AS entropy, count(*) AS kinds, max(k) / max(total) AS top FROM n JOIN t USING (doc_id) GROUP BY doc_id),
    c AS (SELECT s.doc_id, sequence, length(sequence) AS len, length(sequence) BETWEEN 120 AND 3600 AS band, coalesce(kinds, 0) >= 14 AND coalesce(entropy, 0) >= 3.2 AND coalesce(top, 0) <= 0.34 AS varied, len_ok FROM (SELECT *, length(sequence) > 0 AS len_ok FROM s) s LEFT JOIN e USING (doc_id)),
    q AS (SELECT doc_id, sequence FROM c WHERE band AND varied), g AS (SELECT DISTINCT doc_id, sequence[i:i + 2] AS gram FROM q, unnest(range(1, length(sequence) - 1)) u(i)),
    k AS (SELECT DISTINCT doc_id AS r, sequence[i:i + 2] AS gram FROM every, unnest(range(1, greatest(length(sequence) - 1, 2))) u(i) WHERE length(sequence) > 0), gn AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), kn AS (SELECT r, count(*) AS n FROM k GROUP BY 1),
    j AS (SELECT doc_id, r, count(*) AS b FROM g JOIN k USING (gram) GROUP BY ALL), m AS (SELECT q.doc_id, v.doc_id AS r, coalesce(b / (gn.n + kn.n - b), 0) AS jaccard FROM q JOIN every v ON v.doc_id <> q.doc_id LEFT JOIN j ON j.doc_id = q.doc_id AND j.r = v.doc_id LEFT JOIN gn ON gn.doc_id = q.doc_id LEFT JOIN kn ON kn.r = v.doc_id),
    x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, r) AS k FROM m),
    z AS (SELECT x.doc_id, max(1 - levenshtein(q.sequence, v.sequence) / greatest(length(q.sequence), length(v.sequence))) AS identity FROM x JOIN q ON q.doc_id = x.doc_id JOIN every v ON v.doc_id = x.r WHERE x.k <= 32 GROUP BY 1),
    f AS (SELECT c.doc_id, len::BIGINT AS length, round(CASE WHEN band AND varied THEN coalesce(greatest(identity, 0), 0) ELSE 1 END, 6)::DOUBLE AS identity, tri.e AS gap, band, varied, len_ok, (SELECT count(*) FROM h WHERE h.doc_id = c.doc_id) AS motifs FROM c LEFT JOIN z USING (doc_id) LEFT JOIN tri USING (doc_id))
    SELECT doc_id, length, identity, motifs > 0 AND coalesce(gap <= 20, false) AND band AND varied AND identity < 0.7 AS passes,
           concat_ws(',', CASE WHEN NOT len_ok THEN 'alphabet' END, CASE WHEN NOT band THEN 'length' END, CASE WHEN NOT varied THEN 'composition' END, CASE WHEN motifs = 0 THEN 'motif' END, CASE WHEN NOT coalesce(gap <= 20, false) THEN 'geometry' END, CASE WHEN identity >= 0.7 THEN 'novelty' END) AS reasons FROM f""")
def candidate_evaluation(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", kernels.letters("text", "BJOUXZ", "ACDEFG").alias("sequence"))
    found = evaluation.evaluate(s.filter("doc_id % 100 = 0"), s, "doc_id", "sequence", evaluation.Limits((120, 3600)), other=True)
    return found.select("doc_id", "length", F.round("identity", 6).alias("identity"), "passes", F.array_join("reasons", ",").alias("reasons"))


@register("strength_scores", with_sequences(f"""{_GAPS}
    , m AS (SELECT doc_id, count(*) AS k FROM h GROUP BY doc_id),
    g AS (SELECT s.doc_id, coalesce(m.k, 0) AS k, coalesce(exp(-sa1.e / 18.0), 0) AS a, coalesce(exp(-sh.e / 18.0), 0) AS h, coalesce(exp(-tri.e / 12.0), 0) AS t,
                 (EXISTS (SELECT 1 FROM ser x WHERE x.doc_id = s.doc_id))::INT + (EXISTS (SELECT 1 FROM asp x WHERE x.doc_id = s.doc_id))::INT + (EXISTS (SELECT 1 FROM his x WHERE x.doc_id = s.doc_id))::INT AS w
          FROM s LEFT JOIN m USING (doc_id) LEFT JOIN sa1 USING (doc_id) LEFT JOIN sh USING (doc_id) LEFT JOIN tri USING (doc_id))
    SELECT doc_id, round(CASE WHEN k > 0 THEN 0.45 / (1 + 0.75 * (k - 1)) ELSE 0 END, 6) AS motif_strength, round(least(1, 0.75 * a + 0.25 * h), 6) AS dyad_strength,
           round(least(1, 0.05 * w / 3.0 + 0.4 * a + 0.1 * h + 0.45 * t), 6) AS geometry_score FROM g"""))
def strength_scores(spark, sf_dir):
    g = _gaps(sequences(spark, sf_dir)).withColumn("k", F.size(tx.motifs("sequence")))
    hit = lambda c: (F.col(c) > 0).cast("int")
    return g.select(
        "doc_id", F.round(scores.motif_strength(F.col("k"), F.lit(False)), 6).alias("motif_strength"), F.round(scores.dyad_strength(F.col("ser_asp"), F.col("ser_his")), 6).alias("dyad_strength"),
        F.round(scores.geometry_score(hit("n_ser") + hit("n_asp") + hit("n_his"), F.col("ser_asp"), F.col("ser_his"), F.col("best")), 6).alias("geometry_score"),
    )


@register("penalties", """
    SELECT doc_id, round(CASE WHEN k <= 1 THEN 1 ELSE greatest(0.05, 1 / pow(k, 1.35)) END, 6) AS spam, round(CASE WHEN t <= 0.85 THEN 1 ELSE greatest(0.05, 1 - 0.95 * ((t - 0.85) / (1.0 - 0.85))) END, 6) AS tandem,
           round(CASE WHEN e >= 2.7 THEN 1 ELSE greatest(0.2, e / 2.7) END, 6) AS local_entropy
    FROM (SELECT doc_id, doc_id % 6 AS k, (doc_id % 101) / 100.0::DOUBLE AS t, (doc_id % 41) / 10.0::DOUBLE AS e FROM documents)""")
def penalties(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(scores.spam_penalty(d % 6), 6).alias("spam"), F.round(scores.tandem_penalty(d % 101 / 100.0), 6).alias("tandem"), F.round(scores.local_entropy_penalty(d % 41 / 10.0), 6).alias("local_entropy")
    )


@register("second_stage_score", """
    SELECT doc_id, round(0.2 * greatest(0, least(1, coalesce(p, 0))) + 0.2 * m + 0.6 * g + 0.15 * t, 6) AS stage2_score
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 120) / 100.0::DOUBLE END AS p, (doc_id % 10) / 10.0::DOUBLE AS m, (doc_id % 7) / 7.0::DOUBLE AS g, (doc_id % 3) / 3.0::DOUBLE AS t FROM documents)""")
def second_stage_score(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scores.second_stage(F.when(d % 4 > 0, d % 120 / 100.0), d % 10 / 10.0, d % 7 / 7.0, d % 3 / 3.0), 6).alias("stage2_score"))


@register("family_reward", with_sequences(f"""{_GAPS}
    , m AS (SELECT doc_id, count(*) AS k FROM h GROUP BY doc_id), w AS (SELECT 'ser' AS what, doc_id FROM ser UNION SELECT 'asp', doc_id FROM asp UNION SELECT 'his', doc_id FROM his), hits AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
    SELECT s.doc_id, round(greatest(0, least(100, CASE WHEN regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+') THEN 5 ELSE 0 END + CASE WHEN length(sequence) BETWEEN 120 AND 3600 THEN 10 ELSE 0 END
        + CASE WHEN m.k > 0 THEN 10 ELSE 0 END + 10 * coalesce(hits.n, 0) + CASE WHEN sa1.e <= 25 THEN 12 ELSE 0 END + CASE WHEN sh.e <= 25 THEN 10 ELSE 0 END
        + coalesce(greatest(0, 20 - least(tri.e, 20)), 0) + CASE WHEN tri.e <= 20 THEN 15 ELSE 0 END
        + CASE WHEN s.doc_id % 100 >= 90 THEN -30 WHEN s.doc_id % 100 >= 70 THEN -15.0 * (((s.doc_id % 100) / 100.0::DOUBLE - 0.7) / (0.9 - 0.7)) ELSE 0 END)), 6)::DOUBLE AS family_reward
    FROM s LEFT JOIN m USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN sa1 USING (doc_id) LEFT JOIN sh USING (doc_id) LEFT JOIN tri USING (doc_id)"""))
def family_reward(spark, sf_dir):
    g = _gaps(sequences(spark, sf_dir))
    return g.select("doc_id", F.round(scores.family_reward(
        tx.valid_alphabet("sequence"), F.length("sequence").between(120, 3600), F.size(tx.motifs("sequence")), F.lit(False), F.col("n_ser"), F.col("n_asp"), F.col("n_his"),
        F.col("ser_asp"), F.col("ser_his"), F.col("best"), F.col("doc_id") % 100 / 100.0), 6).alias("family_reward"))


@register("normalized_scores", """
    SELECT vec_id, i::BIGINT AS i, round(CASE WHEN x < 0 THEN 1 / (1 + exp(-x)) WHEN x <= 1 THEN x ELSE least(1, x / 100) END, 6) AS score
    FROM (SELECT vec_id, i, embedding[i]::DOUBLE * 300 AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))""")
def normalized_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return e.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.round(scores.normalized_score(F.col("x").cast("double") * 300), 6).alias("score"))


@register("log_sum_exp", """
    SELECT vec_id, round(m + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m)))), 6) AS lse, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN -ln(1 + exp(-x::DOUBLE)) ELSE x::DOUBLE - ln(1 + exp(x::DOUBLE)) END)), 6) AS log_sigmoid_sum
    FROM (SELECT vec_id, embedding, list_max(embedding)::DOUBLE AS m FROM embeddings)""")
def log_sum_exp(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(scores.log_sum_exp(F.col("v")), 6).alias("lse"), F.round(F.aggregate(F.transform("v", scores.log_sigmoid), F.lit(0.0), lambda a, x: a + x), 6).alias("log_sigmoid_sum"))


@register("edit_identity", """
    WITH p AS (SELECT p_partkey, p_name AS s, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM part)
    SELECT p_partkey, levenshtein(s, t)::BIGINT AS distance, round(1 - levenshtein(s, t) / greatest(length(s), length(t)), 6) AS identity,
           levenshtein(s, t) <= floor(0.3 * greatest(length(s), length(t)) + 1e-9) AS passes FROM p WHERE t IS NOT NULL""")
def edit_identity(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("s"), F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("t")).filter("t IS NOT NULL")
    return p.select("p_partkey", F.levenshtein("s", "t").cast("long").alias("distance"), F.round(tx.identity("s", "t"), 6).alias("identity"), tx.passes_identity("s", "t", 0.7).alias("passes"))


@register("prompt_templates", r"""
    SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(trim(lower(text)), '[0-9]+', '<n>', 'g'), '\s+', ' ', 'g'), ''), 'unknown_prompt') AS template,
           trim(regexp_replace(regexp_replace(lower(text), '[0-9]', ' <n> ', 'g'), '\s+', ' ', 'g')) AS template_by_digit FROM conversations""")
def prompt_templates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.prompt_template("text").alias("template"), tx.prompt_template_by_digit("text").alias("template_by_digit"))


@register("value_buckets", """
    SELECT l_orderkey, l_linenumber, (l_partkey // 50 * 50)::VARCHAR || '-' || (l_partkey // 50 * 50 + 49)::VARCHAR AS part_bucket,
           printf('%.2f-%.2f', floor(l_discount / 0.05) * 0.05, floor(l_discount / 0.05) * 0.05 + 0.05) AS discount_bucket FROM lineitem""")
def value_buckets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", tx.bucket_label("l_partkey", 50).alias("part_bucket"), tx.bucket_label_float("l_discount", 0.05).alias("discount_bucket"))


@register("slugs_and_hashes", """
    SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256(html) AS html_sha256, ceil(length(html) / 4)::BIGINT AS tokens FROM pages""")
def slugs_and_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slug("url").alias("slug"), F.sha2("html", 256).alias("html_sha256"), tx.estimated_tokens("html").cast("long").alias("tokens"))


@register("name_parses", """
    SELECT p_partkey, coalesce(CASE WHEN regexp_matches(n, 't[0-9]+p[0-9]+') THEN (regexp_extract(n, 't([0-9]+)p([0-9]+)', 1) || '.' || regexp_extract(n, 't([0-9]+)p([0-9]+)', 2))::DOUBLE
           WHEN regexp_matches(n, 't0[0-9]+') THEN ('0.' || regexp_extract(n, 't0([0-9]+)', 1))::DOUBLE END, -1) AS temperature, (try_cast(nullif(regexp_extract(h, '([0-9]+)\\s*(?:aa|amino acids|residues)', 1), '') AS INTEGER))::INTEGER AS hint
    FROM (SELECT p_partkey, 'run-' || CASE p_partkey % 3 WHEN 0 THEN 't0p' || (p_partkey % 9 + 1) WHEN 1 THEN 't0' || (p_partkey % 9 + 1) ELSE 'x' END AS n,
                 CASE WHEN p_partkey % 2 = 0 THEN 'make about ' || p_size || ' aa' ELSE 'make any' END AS h FROM part)""".replace("\\\\", "\\"))
def name_parses(spark, sf_dir):
    k = F.col("p_partkey")
    n = F.concat(F.lit("run-"), F.when(k % 3 == 0, F.concat(F.lit("t0p"), k % 9 + 1)).when(k % 3 == 1, F.concat(F.lit("t0"), k % 9 + 1)).otherwise("x"))
    p = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), F.when(k % 2 == 0, F.concat(F.lit("make about "), F.col("p_size"), F.lit(" aa"))).otherwise("make any").alias("h"))
    return p.select("p_partkey", F.coalesce(tx.temperature_token("n"), F.lit(-1.0)).alias("temperature"), tx.length_hint("h").alias("hint"))


@register("point_mutations", """
    WITH p AS (SELECT p_partkey, p_name AS s, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM part)
    SELECT p_partkey, coalesce((SELECT string_agg(t[i] || i || s[i], ',' ORDER BY i) FROM unnest(range(1, least(length(s), length(t)) + 1)) AS u(i) WHERE t[i] <> s[i]), '') AS mutations FROM p WHERE t IS NOT NULL""")
def point_mutations(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("s"), F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("t")).filter("t IS NOT NULL")
    return p.select("p_partkey", tx.mutations("t", "s").alias("mutations"))


@register("spliced_corruption", "SELECT p_partkey, p_name[1:3] || reverse(p_name[4:7]) || p_name[8:] AS corrupted FROM part WHERE length(p_name) >= 7")
def spliced_corruption(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(F.length("p_name") >= 7)
    return p.select("p_partkey", tx.splice("p_name", F.lit(4), F.reverse(F.substring("p_name", 4, 4))).alias("corrupted"))


@register("frozen_shuffle", """
    WITH c AS (SELECT p_partkey, p_name, i, p_name[i] AS ch, i IN (1, 3) AS frozen, row_number() OVER (PARTITION BY p_partkey, i IN (1, 3) ORDER BY i) AS k,
                      row_number() OVER (PARTITION BY p_partkey, i IN (1, 3) ORDER BY sha256('neg|' || p_name || '|' || i), i) AS r
               FROM part, unnest(range(1, length(p_name) + 1)) AS u(i))
    SELECT a.p_partkey, string_agg(CASE WHEN a.frozen THEN a.ch ELSE b.ch END, '' ORDER BY a.i) AS shuffled FROM c a JOIN c b ON a.p_partkey = b.p_partkey AND a.frozen = b.frozen AND a.k = b.r GROUP BY a.p_partkey""")
def frozen_shuffle(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.shuffled_with_frozen("p_name", F.array(F.lit(1), F.lit(3)), "neg").alias("shuffled"))


@register("rendered_prompts", "SELECT p_partkey, 'Design ' || p_type || ' of size ' || p_size || ' by ' || p_brand || chr(10) || 'SEQUENCE=' AS prompt FROM part")
def rendered_prompts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("Design %s of size %d by %s\nSEQUENCE=", "p_type", "p_size", "p_brand").alias("prompt"))


@register("reply_sequences", r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<think>x y</think>SEQUENCE=' || upper(p_brand) WHEN 1 THEN 'SEQUENCE= ac de ' WHEN 2 THEN 'see <b>ACD</b>' ELSE 'ACDB' END AS text FROM part),
    t AS (SELECT p_partkey, regexp_replace(text, '<think>.*?</think>', '', 'g') AS p FROM r),
    x AS (SELECT p_partkey, CASE WHEN contains(p, 'SEQUENCE=') THEN string_split(p, 'SEQUENCE=')[-1] ELSE p END AS tail FROM t)
    SELECT p_partkey, CASE WHEN NOT contains(tail, '<') AND regexp_full_match(upper(regexp_replace(tail, '\s+', '', 'g')), '[ACDEFGHIKLMNPQRSTVWY]+') THEN upper(regexp_replace(tail, '\s+', '', 'g')) END AS sequence FROM x""")
def reply_sequences(spark, sf_dir):
    k = F.col("p_partkey")
    r = F.when(k % 4 == 0, F.concat(F.lit("<think>x y</think>SEQUENCE="), F.upper("p_brand"))).when(k % 4 == 1, "SEQUENCE= ac de ").when(k % 4 == 2, "see <b>ACD</b>").otherwise("ACDB")
    return table(spark, sf_dir, "part").select("p_partkey", tx.sequence_from_reply(r).alias("sequence"))


@register("relevance_scores", """
    WITH t(term, w) AS (VALUES ('petase', 8), ('cutinase', 6), ('cutin', 4), ('polyester', 3), ('polyesterase', 6)),
    b AS (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'PETase' WHEN 1 THEN 'Cutinase and polyesterase' WHEN 2 THEN 'polyester' ELSE '' END) AS blob, p_partkey % 5 = 0 AS ec, p_partkey % 7 = 0 AS hot FROM part)
    SELECT p_partkey, (coalesce((SELECT sum(w) FROM t WHERE contains(blob, term)), 0) + CASE WHEN ec THEN 6 ELSE 0 END + hot::INT
        + CASE WHEN (SELECT count(*) FROM t WHERE contains(blob, term) AND term IN ('petase', 'cutinase', 'polyesterase')) >= 2 THEN 3 ELSE 0 END)::BIGINT AS relevance FROM b""")
def relevance_scores(spark, sf_dir):
    k = F.col("p_partkey")
    extra = F.when(k % 4 == 0, "PETase").when(k % 4 == 1, "Cutinase and polyesterase").when(k % 4 == 2, "polyester").otherwise("")
    b = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", extra)).alias("blob"), F.when(k % 5 == 0, F.array(F.lit("3.1.1.74"))).otherwise(F.array().cast("array<string>")).alias("ec"), (k % 7 == 0).alias("hot"))
    return b.select("p_partkey", scores.relevance(F.col("blob"), F.col("ec"), F.col("hot")).cast("long").alias("relevance"))


@register("local_window_entropy")
def local_window_entropy(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.round(kernels.min_window_entropy(20)("sequence"), 6).alias("min_local_entropy"))


@register("tandem_repeats")
def tandem_repeats(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.round(kernels.tandem_similarity("sequence"), 6).alias("similarity"))


@register("exact_repeats")
def exact_repeats(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("doc_id", kernels.longest_repeat("sequence").alias("longest_repeat"), kernels.masked_repeats(8)("sequence").alias("masked"))


@register("binomial_intervals")
def binomial_intervals(spark, sf_dir):
    g = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.sum("quality").alias("successes"), F.count("*").alias("total"))
    return g.select("toxic", F.round(kernels.clopper_pearson("successes", "total")["low"], 6).alias("low"), F.round(kernels.clopper_pearson("successes", "total")["high"], 6).alias("high"))
