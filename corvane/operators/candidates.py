"""Raw candidate rows to typed candidates: aliases, gates, objective scores, quality and trainability.

Aliases are resolved against the schema when the plan is built, so a plan reads only the
columns that exist. Null means missing everywhere; 0 is a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import scores
from corvane.functions import text as tx

from .pairs import as_flag, as_number, first_present, first_reason, reasons

# fixed values: nested structs that are searched after the top level, and the aliases of each field
NESTED = (
    "metrics", "quality", "sequence_quality", "reward_components", "family_evaluation", "physical_metrics", "fold_metrics", "structure_metrics", "stability_metrics",
    "developability", "manufacturability", "biosafety", "functional_metrics", "docking_metrics", "diversity_metrics",
)
SCORE_ALIASES = {
    "anti_hallucination": ("anti_hallucination_score", "artifact_free_score", "topology_score"),
    "foldability": ("foldability_score", "fold_score", "structure_score", "structural_confidence", "fold_confidence", "mean_plddt", "plddt", "ptm", "pTM"),
    "family_plausibility": ("family_plausibility_score", "family_identity_score", "family_hmm_score", "hmm_score", "family_score"),
    "active_site_geometry": ("active_site_geometry_score", "active_site_score", "catalytic_geometry_score", "catalytic_context_score", "geometry_score", "substrate_facing_geometry_score"),
    "thermodynamic_stability": ("thermodynamic_stability_score", "stability_score", "esm_pll", "esm_score", "raw_esm_score", "esm_plddt", "tm_stability_score"),
    "solubility": ("solubility_score", "soluble_score"),
    "aggregation": ("aggregation_score", "anti_aggregation_score"),
    "expression_likelihood": ("expression_likelihood", "expression_score", "expression_likelihood_score", "secretion_score"),
    "novelty": ("novelty_score", "divergence_score"),
    "diversity": ("diversity_score", "cluster_diversity_score", "scaffold_diversity_score"),
    "functional_proxy": ("functional_proxy_score", "catalytic_proxy_score", "physical_score", "stage2_score", "reward", "docking_affinity_score"),
    "manufacturability": ("manufacturability_score", "developability_score", "synthesis_feasibility_score", "synthesis_score"),
    "biosafety": ("biosafety_score", "safety_score", "nonpathogenicity_score"),
}
INVERTED_ALIASES = {
    "aggregation": ("aggregation_risk", "aggregation_propensity", "amyloid_risk"),
    "functional_proxy": ("docking_energy", "binding_energy"),
    "manufacturability": ("synthesis_difficulty", "manufacturing_risk"),
    "biosafety": ("biosafety_risk", "toxicity_risk", "pathogenicity_risk", "host_homology_risk"),
}
PASS_ALIASES = {
    "thermodynamic_stability": ("thermodynamic_stability_pass", "stability_pass", "esm_gate_pass"),
    "solubility": ("solubility_pass", "soluble_pass"),
    "aggregation": ("aggregation_pass", "anti_aggregation_pass"),
    "expression_likelihood": ("expression_pass", "expression_likelihood_pass"),
    "functional_proxy": ("functional_proxy_pass", "docking_pass", "substrate_geometry_pass"),
    "manufacturability": ("manufacturability_pass", "developability_pass", "synthesis_feasibility_pass"),
    "biosafety": ("biosafety_pass", "safety_pass"),
}
LENGTHS, LEAST_ENTROPY, MOST_TANDEM, MOST_MOTIFS, LEAST_FOLD, NOVELTY = (120, 360), 2.7, 0.85, 1, 85.0, (0.0, 0.9)


class Aliases:
    """Lookups of aliased fields of one DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def any(self, *names: str) -> Column:
        return first_present(self.df, names, NESTED).cast("string")

    def number(self, *names: str) -> Column:
        return as_number(self.any(*names))

    def flag(self, *names: str) -> Column:
        return as_flag(self.any(*names))

    def true_in_any(self, *names: str) -> Column:
        """Whether any single alias says yes; a no does not hide a later yes."""
        return F.coalesce(F.greatest(*(F.coalesce(self.flag(n), F.lit(False)) for n in names), F.lit(False)), F.lit(False))


def objective_scores(df: DataFrame, base: dict[str, Column]) -> Column:
    """Map axis -> score: what the gates imply, replaced by explicit scores; risks count inverted, both are averaged."""
    a = Aliases(df)
    found = {}
    for axis, names in SCORE_ALIASES.items():
        direct = scores.normalized_score(a.number(*names))
        risk = 1 - scores.normalized_score(a.number(*INVERTED_ALIASES[axis])) if axis in INVERTED_ALIASES else F.lit(None).cast("double")
        explicit = F.when(direct.isNotNull() & risk.isNotNull(), (direct + risk) / 2).otherwise(F.coalesce(direct, risk))
        found[axis] = F.coalesce(explicit, base[axis]) if axis in base else explicit
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.round(v, 6).alias("value")) for k, v in found.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def normalise(df: DataFrame, index: Column, version: str = "unversioned") -> DataFrame:
    """Typed candidates: ids and buckets, gates, reasons, scalar score, objective scores. `index` names rows without an id."""
    a = Aliases(df)
    prompt = F.coalesce(F.nullif(F.trim(a.any("prompt", "source_prompt", "sequence_prompt")), F.lit("")), F.lit("Design a PETase/cutinase-like hydrolase sequence."))
    sequence = F.upper(F.trim(F.coalesce(a.any("sequence", "extracted_sequence", "chosen"), F.lit(""))))
    out = df.select(
        F.coalesce(a.any("candidate_id", "id", "name"), F.format_string("candidate-%06d", index)).alias("candidate_id"), prompt.alias("prompt"), sequence.alias("sequence"),
        F.coalesce(a.any("prompt_family", "prompt_bucket", "task_family"), tx.prompt_template(prompt)).alias("prompt_family"),
        F.coalesce(a.any("generation_checkpoint", "checkpoint_name", "checkpoint_path", "source_checkpoint"), F.lit("unknown")).alias("generation_checkpoint"),
        F.coalesce(a.any("evaluator_version", "validator_version"), F.lit(version)).alias("evaluator_version"),
        F.coalesce(a.number("length", "sequence_length").cast("int"), F.length(sequence)).alias("length"),
        F.coalesce(a.number("motif_count", "serine_motif_count").cast("int"), F.lit(0)).alias("motif_count"), a.flag("motif_spam", "motif_spam_rejected").alias("x_spam"),
        a.flag("repeat_artifact", "domain_duplication", "duplicated_region").alias("x_repeat"), a.number("max_tandem_repeat_similarity", "tandem_repeat_similarity").alias("x_tandem"),
        a.flag("low_complexity", "low_entropy_artifact").alias("x_low"), a.number("min_local_window_entropy", "local_entropy").alias("x_entropy"), a.flag("artifact_free", "artifact_gate_passes").alias("x_free"),
        a.true_in_any("family_faithful_pass", "family_faithful_bridge_passes", "strict_family", "family_gate_passes").alias("family_faithful_pass"),
        (a.true_in_any("has_family_serine_motif", "validated_family_motif", "family_motif_passes") & a.true_in_any("passes_core_screen", "validated_passes_core_screen", "family_core_passes")).alias("x_family"),
        a.flag("family_plausible", "family_plausibility_passes").alias("x_plausible"),
        F.coalesce(a.flag("catalytic_context_pass", "catalytic_geometry_passes", "validated_geometry_passes", "active_site_context_passes"), F.lit(False)).alias("catalytic_context_pass"),
        a.number("novelty_identity", "closest_edit_identity", "template_identity").alias("novelty_identity"), a.flag("novelty_pass", "novelty_window_pass", "passes_novelty_threshold").alias("x_novel"),
        a.number("fold_confidence", "mean_plddt", "plddt", "structural_confidence").alias("fold_confidence"), a.flag("fold_confidence_pass", "structure_confident", "structural_gate_passes").alias("x_fold"),
        F.coalesce(a.flag("independent_audit_pass", "heldout_audit_pass", "structural_gate_passes"), F.lit(False)).alias("independent_audit_pass"),
        a.flag("hard_gate_pass", "hard_gate_passes").alias("x_gate"), a.number("physical_score", "pareto_score", "scalar_score", "combined_score", "stage2_score", "reward").alias("x_score"),
        F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), a.flag(*v).alias("value")) for k, v in sorted(PASS_ALIASES.items()))), lambda e: e["value"].isNotNull())).alias("objective_passes"),
        objective_scores(df, {}).alias("x_objectives"),
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({
        "sequence_valid": tx.valid_alphabet("sequence") & F.col("length").between(*LENGTHS),
        "motif_spam": F.coalesce("x_spam", F.col("motif_count") > MOST_MOTIFS),
        "repeat_artifact": F.coalesce("x_repeat", no(F.col("x_tandem") > MOST_TANDEM)),
        "low_complexity": F.coalesce("x_low", no(F.col("x_entropy") < LEAST_ENTROPY)),
        "novelty_pass": F.coalesce("x_novel", F.col("novelty_identity").between(*NOVELTY), F.lit(True)),
        "fold_confidence_pass": F.coalesce("x_fold", F.col("fold_confidence") >= LEAST_FOLD, F.lit(True)),
        "family_plausible": F.coalesce("x_plausible", F.col("family_faithful_pass") | F.col("x_family")),
    })
    out = out.withColumn("artifact_free", F.coalesce("x_free", ~(F.col("repeat_artifact") | F.col("motif_spam") | F.col("low_complexity"))))
    failed_axes = F.transform(F.map_keys(F.map_filter("objective_passes", lambda k, v: ~v)), lambda k: F.concat(k, F.lit("_failed")))
    computed = F.col("sequence_valid") & F.col("artifact_free") & F.col("family_plausible") & F.col("catalytic_context_pass") & F.col("novelty_pass") & F.col("fold_confidence_pass") & (F.size(failed_axes) == 0)
    out = out.withColumn("hard_gate_pass", F.coalesce("x_gate", F.lit(True)) & computed)
    parts = [F.col(c).cast("double") for c in ("artifact_free", "family_faithful_pass", "catalytic_context_pass", "fold_confidence_pass", "novelty_pass")]
    fold = scores.clip(F.col("fold_confidence") / 100)
    mean = F.when(fold.isNotNull(), (sum(parts[1:], parts[0]) + fold) / 6).otherwise(sum(parts[1:], parts[0]) / 5)
    out = out.withColumn("scalar_score", F.coalesce("x_score", F.round(mean, 6)))
    implied = {
        "anti_hallucination": F.col("artifact_free").cast("double"), "foldability": F.coalesce(fold, F.col("fold_confidence_pass").cast("double")),
        "family_plausibility": (F.col("family_faithful_pass") | F.col("family_plausible")).cast("double"), "active_site_geometry": F.col("catalytic_context_pass").cast("double"),
        "novelty": F.coalesce(scores.clip(1 - F.col("novelty_identity")), F.col("novelty_pass").cast("double")), "functional_proxy": scores.normalized_score(F.col("scalar_score")),
    }
    base = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), F.round(v, 6).alias("value")) for k, v in implied.items())))
    # explicit scores win over what the gates imply
    out = out.withColumn("objective_scores", F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key("x_objectives", k)), F.col("x_objectives")))
    fails = [
        (~F.col("sequence_valid"), "invalid_sequence_or_length"), (~F.col("artifact_free"), "artifact_gate_failed"), (F.col("repeat_artifact"), "repeat_or_domain_artifact"), (F.col("motif_spam"), "motif_spam"),
        (F.col("low_complexity"), "low_complexity"), (~F.col("family_plausible"), "family_plausibility_failed"), (~F.col("catalytic_context_pass"), "catalytic_context_failed"), (~F.col("novelty_pass"), "novelty_window_failed"),
        ((F.col("fold_confidence").isNotNull() | F.col("x_fold").isNotNull()) & ~F.col("fold_confidence_pass"), "fold_confidence_failed"),
    ]
    why = F.concat(reasons(fails), F.array_sort(failed_axes))
    out = out.withColumn("rejection_reasons", F.when(F.col("hard_gate_pass"), F.array().cast("array<string>")).when(F.size(why) > 0, why).otherwise(F.array(F.lit("hard_gate_failed"))))
    return out.drop(*(c for c in out.columns if c.startswith("x_")))


# fixed values: limits and weights of the quality score
ENTROPY_GOAL, UNIQUE_GOAL, DOMINANT_GOAL = 3.4, 16, 0.3
SOFT_UNIQUE, SOFT_ENTROPY, SOFT_DOMINANT = 11, 3.05, 0.26
SOFT_BASE, SOFT_FLOOR = 88.0, 60.0


def quality(sequence: Column, raw: Column, markup: Column, invalid: Column) -> dict[str, Column]:
    """Hard gate, soft floor, soft score (0..100) and quality score of a sequence and the text it came from."""
    n = F.length(sequence)

    def shares(counts: Column) -> Column:
        """Entropy, kinds and share of the most frequent of a sequence's letters, counted once."""
        bits = tx.let(n.cast("double"), lambda size: F.aggregate(counts, F.lit(0.0), lambda total, k: total + (k / size) * F.log2(k / size)))
        return F.struct(
            F.coalesce(F.when(n > 0, -bits), F.lit(0.0)).alias("h"), F.coalesce(F.size(counts), F.lit(0)).alias("kinds"), F.when(n > 0, F.coalesce(F.array_max(counts) / n, F.lit(0.0))).otherwise(1.0).alias("top"),
            tx.letter_ratio(sequence, raw).alias("ratio"),
        )

    def judged(m: Column) -> Column:
        h, kinds, top, ratio = (m[c] for c in ("h", "kinds", "top", "ratio"))
        hard = n.between(*LENGTHS) & (ratio >= 0.98) & ~markup & ~invalid
        floor = (kinds >= SOFT_UNIQUE) & (h >= SOFT_ENTROPY) & (top <= SOFT_DOMINANT)
        soft = scores.clip(100.0 - F.greatest(F.lit(0.0), ENTROPY_GOAL - h) * 35.0 - F.greatest(F.lit(0), UNIQUE_GOAL - kinds) * 6.0 - F.greatest(F.lit(0.0), top - DOMINANT_GOAL) * 180.0, 0.0, 100.0)
        score = n + ratio * 100.0 + h * 10.0 + kinds * 2.0 - top * 50.0 - F.abs(n - 200) - F.when(hard & floor, 0.0).otherwise(250.0)
        return F.struct(hard.alias("hard_gate_pass"), floor.alias("soft_floor_pass"), soft.alias("soft_score"), score.alias("quality_score"))

    found = tx.let(tx.let(tx.char_counts(sequence), shares), judged)
    return {c: found[c] for c in ("hard_gate_pass", "soft_floor_pass", "soft_score", "quality_score")}


def soft_threshold(motif_strength: Column, geometry: Column) -> Column:
    return F.greatest(F.lit(SOFT_FLOOR), SOFT_BASE - 12.0 * motif_strength - 20.0 * geometry)


def trainability(markup: Column, invalid: Column, motif_count: Column, hard: Column, floor: Column, valid: Column, soft: Column, threshold: Column) -> Column:
    """`ok` or the code of the first failed check."""
    return first_reason([
        (markup, "formatting_xml_tag"), (invalid, "invalid_alphabet"), (motif_count == 0, "missing_catalytic_motif"), (motif_count > 1, "motif_spam_rejected"), (~hard, "hard_gate"), (~floor, "soft_floor"),
        (~valid, "invalid_amino_acids"), (soft < threshold, "soft_threshold"),
    ])


def bridge_flags(motif_count: Column, geometry: Column, percentile: Column, family_motif: Column, least: float = 0.05) -> dict[str, Column]:
    """Model gate, functional and family-faithful flags; an unscored candidate fails the gate."""
    gate = F.coalesce(percentile >= least, F.lit(False))
    functional = (motif_count == 1) & geometry & gate
    return {"gate_pass": gate, "functional": functional, "faithful": functional & family_motif}


def confidence_weight(objectives: Column, audited: Column, gates: Sequence[Column], score: Column) -> Column:
    """Mean of the objective scores, or without any of the gates (0 or 1) and the score (over 1: of 100); with 1 more for an audit."""
    fallback = F.array(*(F.when(F.coalesce(g, F.lit(False)), 1.0).otherwise(0.0) for g in gates), scores.clip(F.when(score <= 1, score).otherwise(score / 100.0)))
    values = F.when(F.coalesce(F.size(objectives), F.lit(0)) > 0, F.map_values(objectives)).otherwise(fallback)
    extra = F.when(F.coalesce(audited, F.lit(False)), 1.0).otherwise(0.0)
    return F.round((F.aggregate(values, F.lit(0.0), lambda a, x: a + x) + extra) / (F.size(values) + extra), 4)


def summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of a batch of candidates: all, passing, and each rejection reason."""
    # candidates are judged once: both counts come from the few ways in which they pass and fail
    ways = df.groupBy(*keys, "hard_gate_pass", "rejection_reasons").agg(F.count("*").alias("n"))
    total = ways.groupBy(*keys).agg(F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(F.col("hard_gate_pass"), F.col("n"))), F.lit(0)).cast("long").alias("passing"))
    why = ways.select(*keys, "n", F.explode("rejection_reasons").alias("reason")).groupBy(*keys, "reason").agg(F.sum("n").alias("n"))
    return total.join(why.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons")), list(keys), "left")
