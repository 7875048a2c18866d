"""Gates with reasons, preference pairs and distillation winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import pareto_front


def reasons(failed: Sequence[tuple[Column, str]]) -> Column:
    """Codes of the checks that failed, in the given order; a null check does not count."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in failed)), lambda x: x.isNotNull())


def first_reason(failed: Sequence[tuple[Column, str]], otherwise: str = "ok") -> Column:
    """Code of the first check that failed."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in failed), F.lit(otherwise))


def screen(mode: str, hard: Column, motif: Column, core: Column, geometry: Column, model: Column) -> Column:
    """The four screening modes."""
    modes = {
        "hard_motif": hard & motif,
        "hard_motif_core_or_geom": hard & motif & (core | geometry),
        "hard_motif_core_or_geom_or_esm": hard & motif & (core | geometry | model),
        "hard_core_or_geom_or_esm": hard & (core | geometry | model),
    }
    if mode not in modes:
        raise ValueError(f"unknown screening mode: {mode}")
    return F.coalesce(modes[mode], F.lit(False))


def first_present(df: DataFrame, names: Sequence[str], nested: Sequence[str] = (), default: Column | None = None) -> Column:
    """First value that is neither null nor empty, of top-level columns and then of fields of nested structs.

    Resolved against the schema when the plan is built, so only columns that exist are read.
    """
    found = [df[n] for n in names if n in df.columns]
    for outer in nested:
        if outer in df.columns:
            kind = df.schema[outer].dataType
            found += [F.col(outer)[n] for n in names if hasattr(kind, "fieldNames") and n in kind.fieldNames()]
    values = [F.when(c.isNotNull() & (c.cast("string") != ""), c) for c in found]
    return F.coalesce(*values, *([default] if default is not None else []), F.lit(None))


def as_flag(value: Column) -> Column:
    """Tri-state boolean of text: words for yes and no, else null."""
    t = F.lower(F.trim(value.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "pass", "passed"), True).when(t.isin("0", "false", "no", "n", "fail", "failed"), False)


def as_number(value: Column, default: float | None = None) -> Column:
    """Double of text; what does not parse, NaN and infinities become the default."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x).otherwise(F.lit(default).cast("double"))


def preference_pairs(
    rows: DataFrame, id_col: str, text: str, bucket: Sequence[str], flags: Sequence[str], axes: Sequence[str], score: str, margin: float = 0.05, cap: int = 128
) -> DataFrame:
    """Decided pairs within buckets: chosen, rejected, rule.

    Rows of a bucket are ordered by score and id; pairs are taken in that order, the
    earlier row first. The first flag on which the two differ decides, then Pareto
    dominance on the axes, then the score margin. Pairs of equal texts and undecided
    pairs are left out; of the rest, each bucket gives its first `cap`.

    What decides a pair depends only on the classes of the two rows (score, flags and
    axes), so classes are compared first and rows of undecided classes never meet: a
    bucket of equal rows makes no pair. A pair whose scores differ by the margin is
    always decided, so a row adds at least as many pairs as rows behind it lie a margin
    lower (less those of the same text); rows behind which the cap is full already
    cannot lead a pair that counts. Classes that all lie within the margin and that
    neither flags nor axes decide are still compared with each other.
    """
    keep = list(dict.fromkeys([id_col, text, *flags, *axes, score]))
    by_score = Window.partitionBy(*bucket).orderBy(F.desc(score), id_col)
    groups = ", ".join(f"`{c}`" for c in bucket)
    below = f"count(*) OVER (PARTITION BY {groups} ORDER BY _down RANGE BETWEEN {margin * (1 + 1e-9) + 1e-12!r}D FOLLOWING AND UNBOUNDED FOLLOWING)"
    placed = rows.select(*bucket, *keep, F.row_number().over(by_score).alias("place"), (-F.col(score)).alias("_down"))
    sure = F.greatest(F.lit(0), F.expr(below) - (F.count("*").over(Window.partitionBy(*bucket, text)) - 1))
    placed = placed.withColumn("_sure", sure).withColumn("class", F.dense_rank().over(Window.partitionBy(*bucket).orderBy(F.desc(score), *flags, *axes)))
    full = F.coalesce(F.sum("_sure").over(Window.partitionBy(*bucket).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leading = placed.withColumn("_full", full).filter(F.col("_full") < cap)
    traits = list(dict.fromkeys([*flags, *axes, score]))
    classes = lambda rows, side: rows.groupBy(*bucket, F.col("class").alias(f"{side}_class")).agg(*(F.first(c).alias(f"{side}_{c}") for c in traits))
    near = classes(leading, "l").join(classes(placed, "r"), list(bucket)).filter(F.coalesce(F.col(f"l_{score}") >= F.col(f"r_{score}"), F.lit(True)))
    cases = [(F.col(f"l_{f}") != F.col(f"r_{f}"), F.col(f"l_{f}"), f) for f in flags]
    up = lambda a, b: _dominates(axes, a, b)
    cases.append((up("l_", "r_") != up("r_", "l_"), up("l_", "r_"), "pareto_dominance"))
    delta = F.col(f"l_{score}") - F.col(f"r_{score}")
    cases.append((F.abs(delta) >= margin, delta > 0, "scalar_score_margin"))
    near = near.select(*bucket, "l_class", "r_class", F.coalesce(*(F.when(c, F.struct(F.lit(rule).alias("rule"), won.alias("left_wins"))) for c, won, rule in cases)).alias("d")).filter("d IS NOT NULL")
    side = lambda rows, s: rows.select(*bucket, F.col("class").alias(f"{s}_class"), F.col(id_col).alias(s), F.col(text).alias(f"{s}_text"), F.col("place").alias(f"{s}_place"))
    decided = side(leading, "l").join(near, [*bucket, "l_class"]).join(side(placed, "r"), [*bucket, "r_class"]).filter("l_place < r_place AND l_text <> r_text")
    order = Window.partitionBy(*bucket).orderBy("l_place", "r_place")
    decided = decided.withColumn("pair", F.row_number().over(order)).filter(F.col("pair") <= cap)
    return decided.select(
        *bucket, "pair", F.when(F.col("d.left_wins"), F.col("l")).otherwise(F.col("r")).alias("chosen"), F.when(F.col("d.left_wins"), F.col("r")).otherwise(F.col("l")).alias("rejected"), F.col("d.rule").alias("rule")
    )


def _dominates(axes: Sequence[str], a: str, b: str) -> Column:
    no_worse, better = F.lit(True), F.lit(False)
    for x in axes:
        no_worse = no_worse & F.coalesce(F.col(a + x) >= F.col(b + x), F.lit(True))
        better = better | F.coalesce(F.col(a + x) > F.col(b + x), F.lit(False))
    return no_worse & better


def winners(rows: DataFrame, id_col: str, eligible: Column, axes: Sequence[str], weight: Column, least: float, score: str, top: int | None = None) -> DataFrame:
    """Eligible rows on the Pareto front with at least a weight, best score first."""
    front = pareto_front(rows.filter(eligible), id_col, axes).withColumn("weight", weight).filter(F.col("weight") >= least).orderBy(F.desc(score), id_col)
    return front.limit(top) if top else front
