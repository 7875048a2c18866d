"""Whole-candidate evaluation: features, screens, geometry, novelty and reasons from a sequence and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import kernels
from corvane.functions import text as tx

from .pairs import reasons
from .similarity import nearest_by_kmers

# fixed values: shares of the length in which each residue is looked for, and the gaps between them
SERINE, ASPARTATE, HISTIDINE = (0.45, 0.75), (0.72, 0.92), (0.82, 0.98)
SER_ASP, ASP_HIS, SER_HIS = 55, 13, 68


@dataclass(frozen=True)
class Limits:
    """What a candidate must meet. fixed values: the surveyed project's defaults; lengths come from the family."""

    lengths: tuple[int, int]
    kinds: int = 14
    entropy: float = 3.2
    top: float = 0.34
    gap_error: int = 20
    identity: float = 0.7


def geometry(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """df with the numbers of residues in their windows (n_ser, n_asp, n_his) and the least gap errors (ser_asp, asp_his, ser_his, best)."""
    place = tx.let(
        F.col(sequence),
        lambda x: F.struct(
            tx.in_window(tx.motif_positions(x), x, *SERINE).alias("ser"), tx.in_window(tx.letter_positions(x, "D"), x, *ASPARTATE).alias("asp"), tx.in_window(tx.letter_positions(x, "H"), x, *HISTIDINE).alias("his")
        ),
    )
    err = tx.downstream_gap_error
    found = tx.let(
        place,
        lambda p: F.struct(
            F.size(p["ser"]).alias("n_ser"), F.size(p["asp"]).alias("n_asp"), F.size(p["his"]).alias("n_his"),
            err(p["ser"], p["asp"], SER_ASP).cast("long").alias("ser_asp"), err(p["asp"], p["his"], ASP_HIS).cast("long").alias("asp_his"), err(p["ser"], p["his"], SER_HIS).cast("long").alias("ser_his"),
            tx.triple_gap_error(p["ser"], p["asp"], p["his"], SER_ASP, ASP_HIS).cast("long").alias("best"),
        ),
    )
    return df.select(*df.columns, F.inline(F.array(found)))


def evaluate(df: DataFrame, references: DataFrame, id_col: str, sequence: str, limits: Limits, family_motifs: Column | None = None, other: bool = False) -> DataFrame:
    """Each candidate with its features, screens, geometry, novelty, `passes` (all of them) and `reasons` (codes of what fails).

    Sequences count in capitals; null ones as empty. Only candidates that pass the cheap
    screens (alphabet, length, composition) are compared with the references, which have
    the same two columns; the others have identity 1. family_motifs: the family's most
    frequent motifs as an array. With `other` a candidate's own id is no reference of its.
    """
    rows = df.select(id_col, F.upper(F.coalesce(F.col(sequence), F.lit(""))).alias(sequence))
    rows = rows.withColumn("c", kernels.composition(sequence))
    valid, length = tx.valid_alphabet(sequence), F.length(sequence)
    band = length.between(*limits.lengths)
    varied = (F.col("c.kinds") >= limits.kinds) & (F.col("c.entropy") >= limits.entropy) & (F.col("c.top") <= limits.top)
    rows = rows.select(
        id_col, sequence, valid.alias("valid"), length.cast("long").alias("length"), band.alias("in_band"), F.col("c.kinds").alias("kinds"), F.col("c.entropy").alias("entropy"), F.col("c.top").alias("top"),
        varied.alias("varied"), (valid & band & varied).alias("cheap"), tx.motifs(sequence).alias("motifs"),
    )
    rows = geometry(rows, sequence)
    known = references.select(F.col(id_col).alias("nearest"), F.upper(F.col(sequence)).alias(sequence))
    near = nearest_by_kmers(rows.filter("cheap"), known, id_col, "nearest", sequence, other=other).select(id_col, "nearest", "identity")
    rows = rows.join(near, id_col, "left").withColumn("identity", F.coalesce("identity", F.lit(1.0)))
    found, fits, novel = F.size("motifs") > 0, F.coalesce(F.col("best") <= limits.gap_error, F.lit(False)), F.col("identity") < limits.identity
    family = F.arrays_overlap("motifs", family_motifs) if family_motifs is not None else F.lit(False)
    failed = [(~F.col("valid"), "alphabet"), (~F.col("in_band"), "length"), (~F.col("varied"), "composition"), (~found, "motif"), (~fits, "geometry"), (~novel, "novelty")]
    return rows.withColumns({"family_motif": F.coalesce(family, F.lit(False)), "geometry": fits, "novel": novel, "passes": F.col("cheap") & found & fits & novel, "reasons": reasons(failed)})
