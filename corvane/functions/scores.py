"""Penalties, strengths, rewards and normalised scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of the scoring formulas
SPAM_ALLOWED, SPAM_FLOOR, SPAM_EXPONENT = 1, 0.05, 1.35
TANDEM_THRESHOLD, TANDEM_FLOOR, TANDEM_SLOPE = 0.85, 0.05, 0.95
ENTROPY_MINIMUM, ENTROPY_FLOOR = 2.7, 0.2
DYAD_SCALE, TRIAD_SCALE = 18.0, 12.0
NON_FAMILY_BASE, REPEAT_DECAY = 0.45, 0.75
GEOMETRY_WEIGHTS = (0.05, 0.4, 0.1, 0.45)
DYAD_WEIGHTS = (0.75, 0.25)
STAGE_2_WEIGHTS = (0.2, 0.2, 0.6, 0.15)
TERM_WEIGHTS = {
    "petase": 8, "pet hydrolase": 8, "poly(ethylene terephthalate) hydrolase": 8, "polyethylene terephthalate": 7, "polyester hydrolase": 7,
    "polyesterase": 6, "cutinase": 6, "cutinase-like": 5, "leaf-branch compost cutinase": 7, "suberinase": 5, "mhetase": 5,
    "polycaprolactone hydrolase": 6, "polycaprolactone": 4, "poly(lactic acid) depolymerase": 6, "polylactic acid": 4, "depolymerase": 3,
    "polyester": 3, "terephthalate": 3, "cutin": 4, "suberin": 4,
}
STRONG_TERMS = (
    "petase", "pet hydrolase", "poly(ethylene terephthalate) hydrolase", "polyethylene terephthalate", "polyester hydrolase", "polyesterase", "cutinase",
    "cutinase-like", "leaf-branch compost cutinase", "suberinase", "mhetase", "polycaprolactone hydrolase", "poly(lactic acid) depolymerase",
)
EC_WEIGHTS = {"3.1.1.74": 6, "3.1.1.101": 6}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalized_score(x: Column) -> Column:
    """Negative numbers by the logistic function, up to 1 as they are, larger ones as percent; always in 0..1."""
    return F.when(x < 0, 1 / (1 + F.exp(-x))).when(x <= 1, x).when(x > 1, clip(x / 100))


def spam_penalty(count: Column) -> Column:
    return F.when(count <= SPAM_ALLOWED, 1.0).otherwise(F.greatest(F.lit(SPAM_FLOOR), 1.0 / F.pow(1.0 + (count - SPAM_ALLOWED), F.lit(SPAM_EXPONENT))))


def tandem_penalty(similarity: Column) -> Column:
    excess = (similarity - TANDEM_THRESHOLD) / (1.0 - TANDEM_THRESHOLD)
    return F.when(similarity <= TANDEM_THRESHOLD, 1.0).otherwise(F.greatest(F.lit(TANDEM_FLOOR), 1.0 - TANDEM_SLOPE * excess))


def local_entropy_penalty(least: Column) -> Column:
    return F.when(least >= ENTROPY_MINIMUM, 1.0).otherwise(F.greatest(F.lit(ENTROPY_FLOOR), least / ENTROPY_MINIMUM))


def template_penalty(count: Column, similarity: Column, least: Column) -> Column:
    return F.least(spam_penalty(count), tandem_penalty(similarity), local_entropy_penalty(least))


def gap_strength(error: Column, scale: float) -> Column:
    """exp(-error / scale), 0 where there is no such pair."""
    return F.coalesce(F.exp(-error / F.lit(scale)), F.lit(0.0))


def motif_strength(count: Column, in_family: Column) -> Column:
    base = F.when(in_family, 1.0).otherwise(NON_FAMILY_BASE)
    return F.when(count > 0, base / (1.0 + REPEAT_DECAY * (count - 1))).otherwise(0.0)


def dyad_strength(ser_asp: Column, ser_his: Column) -> Column:
    a, h = DYAD_WEIGHTS
    return F.least(F.lit(1.0), a * gap_strength(ser_asp, DYAD_SCALE) + h * gap_strength(ser_his, DYAD_SCALE))


def geometry_score(windows_hit: Column, ser_asp: Column, ser_his: Column, triad: Column) -> Column:
    w, a, h, t = GEOMETRY_WEIGHTS
    return F.least(F.lit(1.0), w * windows_hit / 3.0 + a * gap_strength(ser_asp, DYAD_SCALE) + h * gap_strength(ser_his, DYAD_SCALE) + t * gap_strength(triad, TRIAD_SCALE))


def second_stage(percentile: Column, motif: Column, geometry: Column, template: Column) -> Column:
    """Weighted sum; an unscored candidate (null percentile) counts as 0."""
    e, m, g, t = STAGE_2_WEIGHTS
    return e * clip(F.coalesce(percentile, F.lit(0.0))) + m * motif + g * geometry + t * template


def family_reward(valid: Column, in_band: Column, motif_count: Column, family_motif: Column, ser: Column, asp: Column, his: Column, ser_asp: Column, ser_his: Column, triad: Column, closest: Column) -> Column:
    """Sum of the component rewards, clipped to 0..100."""
    yes = lambda c, x: F.when(c, x).otherwise(0.0)
    gap = F.coalesce(F.greatest(F.lit(0.0), 20.0 - F.least(triad.cast("double"), F.lit(20.0))), F.lit(0.0))
    novelty = F.when(closest >= 0.9, -30.0).when(closest >= 0.7, -15.0 * ((closest - 0.7) / (0.9 - 0.7))).otherwise(0.0)
    total = (
        yes(valid, 5.0) + yes(in_band, 10.0) + yes(motif_count > 0, 10.0) + yes(family_motif, 20.0) + yes(ser > 0, 10.0) + yes(asp > 0, 10.0) + yes(his > 0, 10.0)
        + yes(F.coalesce(ser_asp <= 25, F.lit(False)), 12.0) + yes(F.coalesce(ser_his <= 25, F.lit(False)), 10.0) + gap + yes(F.coalesce(triad <= 20, F.lit(False)), 15.0) + novelty
    )
    return clip(total, 0.0, 100.0)


def relevance(blob: Column, ec_numbers: Column, thermophile: Column) -> Column:
    """Weights of the terms found in a lower-cased text, of EC numbers, a hint, and a bonus for two strong terms."""
    found = lambda t: F.contains(blob, F.lit(t))
    score = sum((F.when(found(t), w).otherwise(0) for t, w in TERM_WEIGHTS.items()), F.lit(0))
    score = score + sum((F.when(F.array_contains(ec_numbers, e), w).otherwise(0) for e, w in EC_WEIGHTS.items()), F.lit(0))
    strong = sum((found(t).cast("int") for t in STRONG_TERMS), F.lit(0))
    return score + F.coalesce(thermophile.cast("int"), F.lit(0)) + F.when(strong >= 2, 3).otherwise(0)


def log_sigmoid(x: Column) -> Column:
    """Stable for large numbers of either sign."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def log_sum_exp(values: Column) -> Column:
    """Of an array; null if it is empty."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, between structs with x, y, z."""
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)) + F.pow(a["z"] - b["z"], F.lit(2)))


def share_at_or_below(ordered: Column, value: Column) -> Column:
    """Empirical distribution function over an array."""
    return F.coalesce(F.try_divide(F.size(F.filter(ordered, lambda x: x <= value)), F.size(ordered)), F.lit(0.0))


def share_at_or_above(ordered: Column, value: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(ordered, lambda x: x >= value)), F.size(ordered)), F.lit(0.0))


def structural_grade(plddt: Column, ser_his: Column, his_asp: Column, plddts: Column, ser_hiss: Column, his_asps: Column) -> Column:
    """Mean of the available percentiles."""
    parts = F.filter(
        F.array(
            share_at_or_below(plddts, plddt),
            F.when(ser_his.isNotNull() & (F.size(ser_hiss) > 0), share_at_or_above(ser_hiss, ser_his)),
            F.when(his_asp.isNotNull() & (F.size(his_asps) > 0), share_at_or_above(his_asps, his_asp)),
        ),
        lambda x: x.isNotNull(),
    )
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval."""
    p, zz = successes / total, z * z
    middle = (p + zz / (2 * total)) / (1 + zz / total)
    half = z * F.sqrt(p * (1 - p) / total + zz / (4 * total * total)) / (1 + zz / total)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial probability; ties are left out before."""
    n, k = wins + losses, F.least(wins, losses)
    # log C(n, i) from the term before it: log C(n, i - 1) + log((n - i + 1) / i)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("log"))

    def add(a: Column, i: Column) -> Column:
        log = F.when(i > 0, a["log"] + F.log((n - i + 1) / F.greatest(i, F.lit(1).cast("long")))).otherwise(0.0)
        return F.struct((a["sum"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("sum"), log.alias("log"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), zero, add, lambda a: a["sum"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)
