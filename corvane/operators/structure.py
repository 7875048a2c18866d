"""Catalytic triads in protein structures given as atom rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the atoms of the two hydrogen bonds
HYDROXYL = ("OG",)
IMIDAZOLE = ("ND1", "NE2")
CARBOXYL = ("OD1", "OD2")


def _is(residue: str, names: tuple[str, ...]) -> Column:
    return (F.col("residue") == residue) & F.col("atom").isin(list(names))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))


def _nearest(atom: str, others: str) -> Column:
    """Distance and number of the atom of an array that is nearest to an atom; ties to the smaller number."""
    return F.array_min(F.transform(others, lambda o: F.struct(_apart(o, F.col(atom)).alias("d"), o["number"].alias("number"))))


def triads(atoms: DataFrame, key: str, longest: float, nucleophiles: DataFrame | None = None, side_chain: bool = True) -> DataFrame:
    """For each structure the Ser-His-Asp triple with the smallest sum of both bond lengths.

    Both bonds share only the histidine, so each of its atoms is given its nearest serine
    and its nearest aspartate: the three-way product is never formed. The atoms that count
    meet as arrays of their structure, so atoms are read once and moved once. Without side
    chains, CA distances are used and must lie in 4 to 20. nucleophiles (key, number)
    limits the serines. Structures without a triple give no row.
    """
    names = (HYDROXYL, IMIDAZOLE, CARBOXYL) if side_chain else (("CA",),) * 3
    kinds = {side: _is(r, n) for side, r, n in zip(("ser", "his", "asp"), ("SER", "HIS", "ASP"), names, strict=True)}
    rows = atoms.filter((kinds["ser"] | kinds["his"] | kinds["asp"]) & F.col(key).isNotNull())
    if nucleophiles is not None:
        allowed = nucleophiles.select(key, "number", F.lit(True).alias("allowed")).distinct()
        rows = rows.join(allowed, [key, "number"], "left").filter(~kinds["ser"] | F.col("allowed"))
    atom = F.struct("number", "x", "y", "z")
    met = rows.groupBy(key).agg(*(F.collect_list(F.when(kind, atom)).alias(side) for side, kind in kinds.items()))
    near = met.select(key, "ser", "asp", F.explode("his").alias("at")).select(key, F.col("at.number").alias("his"), _nearest("at", "ser").alias("a"), _nearest("at", "asp").alias("b"))
    # a histidine is as near as the nearer of its atoms, to each side by itself
    both = near.groupBy(key, "his").agg(F.min("a").alias("a"), F.min("b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = both.select(key, F.struct((F.col("a.d") + F.col("b.d")).alias("total"), F.col("a.number").alias("ser"), "his", F.col("b.number").alias("asp"), F.col("a.d").alias("ser_his"), F.col("b.d").alias("his_asp")).alias("t"))
    best = both.groupBy(key).agg(F.min("t").alias("t")).select(key, "t.*")
    low, high = (0.0, longest) if side_chain else (4.0, 20.0)
    return best.withColumn("passes", F.col("ser_his").between(low, high) & F.col("his_asp").between(low, high))
