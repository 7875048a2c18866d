"""Trees of run reports: one JSON document a run, in a folder named after the run, with summaries beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = (
    "run string, records array<struct<step: long, prompt: string, extracted_sequence: string, reward: double, "
    "reward_components: struct<esm_reward: double, functional_bridge_passes: boolean, family_faithful_bridge_passes: boolean, motif_count: int, esm_gate_pass: boolean>, "
    "family_evaluation: struct<length: int, passes_core_screen: boolean, has_family_serine_motif: boolean, catalytic_geometry: struct<best_gap_error: int, passes: boolean>, novelty: struct<closest_edit_identity: double>>, "
    "selection_metadata: struct<stage1_rank: int, stage2_rank: int, stage2_score: double>, sequence_quality: struct<is_valid: boolean, hard_gate_pass: boolean, soft_floor_pass: boolean, is_trainable: boolean>>>"
)
SUMMARY = "run string, name string, results array<struct<report_path: string, functional_bridge_steps: array<long>, family_faithful_bridge_steps: array<long>>>"


def run_of(path: Column) -> Column:
    """Name of the folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def read_documents(spark: SparkSession, root: str, name: str, schema: str, lines: bool = False) -> DataFrame:
    """All documents of one file name pattern below a root, each with its run: the one it names, or the folder it lies in.

    A file holds one document, or with `lines` one a line. Documents that do not parse have null fields.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", str(not lines).lower()).text(root)
    parsed = files.select(run_of(F.col("_metadata.file_path")).alias("folder"), F.from_json("value", schema).alias("d")).select("folder", "d.*")
    return parsed.withColumn("run", F.coalesce("run", "folder")).drop("folder")


def inventory(summaries: DataFrame) -> DataFrame:
    """One row a summary: results, and steps of either kind."""
    steps = lambda name: F.aggregate(F.transform("results", lambda r: F.coalesce(F.size(r[name]), F.lit(0))), F.lit(0), lambda a, x: a + x).cast("long")
    return summaries.select(
        F.coalesce(F.nullif("name", F.lit("")), "run").alias("name"), F.coalesce(F.size("results"), F.lit(0)).cast("long").alias("results"),
        F.coalesce(steps("functional_bridge_steps"), F.lit(0).cast("long")).alias("functional"), F.coalesce(steps("family_faithful_bridge_steps"), F.lit(0).cast("long")).alias("faithful"),
    )


def hits(summaries: DataFrame, reports: DataFrame) -> DataFrame:
    """Records at the steps that a summary names, of either kind, once each. Steps without a record are left out."""
    named = summaries.select(F.coalesce(F.nullif("name", F.lit("")), "run").alias("wave"), F.explode("results").alias("r"))
    steps = named.select(
        "wave", run_of(F.col("r.report_path")).alias("run"), F.explode(F.array_union(F.coalesce("r.functional_bridge_steps", F.array().cast("array<long>")), F.coalesce("r.family_faithful_bridge_steps", F.array().cast("array<long>")))).alias("step")
    )
    records = reports.select("run", F.explode("records").alias("record")).withColumn("step", F.col("record.step"))
    return steps.join(records, ["run", "step"])


def hit_columns(record: str = "record") -> list[Column]:
    """Typed columns of a hit from its nested record. Missing flags are false, missing scores stay null."""
    r = F.col(record)
    yes = lambda c: F.coalesce(c, F.lit(False))
    rc, fe, sm, sq = (r[n] for n in ("reward_components", "family_evaluation", "selection_metadata", "sequence_quality"))
    sequence = F.trim(F.coalesce(r["extracted_sequence"], F.lit("")))
    return [
        F.trim(F.coalesce(r["prompt"], F.lit(""))).alias("prompt"), sequence.alias("sequence"), F.coalesce(fe["length"], F.length(sequence)).alias("length"), r["reward"].alias("reward"), rc["esm_reward"].alias("esm_reward"),
        yes(rc["functional_bridge_passes"]).alias("functional"), yes(rc["family_faithful_bridge_passes"]).alias("faithful"), yes(fe["passes_core_screen"]).alias("core"), yes(fe["has_family_serine_motif"]).alias("family_motif"),
        rc["motif_count"].alias("motif_count"), fe["catalytic_geometry"]["best_gap_error"].alias("best_gap_error"), yes(fe["catalytic_geometry"]["passes"]).alias("geometry"), fe["novelty"]["closest_edit_identity"].alias("closest_identity"),
        sm["stage1_rank"].alias("stage1_rank"), sm["stage2_rank"].alias("stage2_rank"), sm["stage2_score"].alias("stage2_score"), yes(rc["esm_gate_pass"]).alias("model_gate"),
        yes(sq["is_valid"]).alias("valid"), yes(sq["hard_gate_pass"]).alias("hard_gate"), yes(sq["soft_floor_pass"]).alias("soft_floor"), yes(sq["is_trainable"]).alias("trainable"),
    ]
