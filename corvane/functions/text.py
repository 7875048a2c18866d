"""Column expressions over sequences and prompts. All stay in the JVM.

Empty and null strings: features that are shares or entropies are 0, counts are 0,
unless the docstring says otherwise. Nothing is rounded here; round at output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the residue alphabet and the nucleophile motif
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
MOTIF = "G[A-Z]S[A-Z]G"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def letters(text: Column | str) -> Column:
    """The A-Z letters of a text, in capitals."""
    return F.upper(F.regexp_replace(_col(text), "[^A-Za-z]+", ""))


def char_counts(s: Column | str) -> Column:
    """How often each distinct character occurs, as array<int>."""
    return let(_col(s), lambda x: F.transform(F.array_distinct(_chars(x)), lambda c: F.length(x) - F.length(F.replace(x, c, F.lit("")))))


def entropy(s: Column | str) -> Column:
    """Shannon entropy in bits per character."""
    s = _col(s)
    share = let(F.length(s).cast("double"), lambda n: F.aggregate(char_counts(s), F.lit(0.0), lambda a, k: a + (k / n) * F.log2(k / n)))
    return F.coalesce(F.when(F.length(s) > 0, -share), F.lit(0.0))


def unique_residues(s: Column | str) -> Column:
    return F.coalesce(F.size(F.array_distinct(_chars(_col(s)))), F.lit(0))


def dominant_fraction(s: Column | str) -> Column:
    """Share of the most frequent character."""
    s = _col(s)
    return F.coalesce(F.array_max(char_counts(s)) / F.length(s), F.lit(0.0))


def letter_ratio(sequence: Column | str, text: Column | str) -> Column:
    """Length of the sequence over the number of letters in the text it came from."""
    return F.coalesce(F.try_divide(F.length(_col(sequence)), F.length(F.regexp_replace(_col(text), "[^\\p{L}]+", ""))), F.lit(0.0))


def valid_alphabet(s: Column | str) -> Column:
    return F.coalesce(_col(s).rlike(f"^[{ALPHABET}]+$"), F.lit(False))


def kmers(s: Column | str, k: int) -> Column:
    """Distinct k-mers; a shorter non-empty string is its own only one."""
    s = _col(s)
    windows = let(_chars(s), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - k, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, k), ""))))
    return F.when(F.length(s) > 0, windows).otherwise(F.array().cast("array<string>"))


def kmer_uniqueness(s: Column | str, k: int) -> Column:
    """Distinct over all k-mers; 1 for a non-empty string shorter than k."""
    s = _col(s)
    return F.when(F.length(s) >= k, F.size(kmers(s, k)) / (F.length(s) - k + 1)).when(F.length(s) > 0, 1.0).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def motifs(s: Column | str, pattern: str = MOTIF) -> Column:
    """All matches, overlapping ones too, in order."""
    return F.regexp_extract_all(_col(s), F.lit(f"(?=({pattern}))"), 1)


def motif_positions(s: Column | str) -> Column:
    """1-based places of the serine of each GxSxG motif."""
    capital = lambda x: (x >= "A") & (x <= "Z")
    places = let(
        _chars(_col(s)),
        lambda c: F.filter(
            F.sequence(F.lit(0), F.size(c)),
            lambda i: (F.get(c, i) == "G") & (F.get(c, i + 2) == "S") & (F.get(c, i + 4) == "G") & capital(F.get(c, i + 1)) & capital(F.get(c, i + 3)),
        ),
    )
    return F.coalesce(F.transform(places, lambda i: i + 3), F.array().cast("array<int>"))


def letter_positions(s: Column | str, letter: str) -> Column:
    """1-based places of one letter."""
    places = F.transform(_chars(_col(s)), lambda c, i: F.when(c == letter, i + 1))
    return F.filter(places, lambda i: i.isNotNull())


def in_window(places: Column, s: Column | str, low: float, high: float) -> Column:
    """Places whose share of the length lies in [low, high]."""
    return let(F.length(_col(s)), lambda n: F.filter(places, lambda i: (i / n >= low) & (i / n <= high)))


def downstream_gap_error(left: Column, right: Column, gap: int) -> Column:
    """Smallest |(r - l) - gap| over l < r; null without such a pair."""
    return let(right, lambda r: F.array_min(F.flatten(F.transform(left, lambda a: F.transform(F.filter(r, lambda b: b > a), lambda b: F.abs(b - a - gap))))))


def triple_gap_error(first: Column, second: Column, third: Column, gap_1: int, gap_2: int) -> Column:
    """Smallest sum of both gap errors over a < b < c. The two parts only share b, so each b needs its own best two."""
    best = let(
        F.struct(first.alias("x"), third.alias("z")),
        lambda o: F.transform(
            second,
            lambda b: F.array_min(F.transform(F.filter(o["x"], lambda a: a < b), lambda a: F.abs(b - a - gap_1)))
            + F.array_min(F.transform(F.filter(o["z"], lambda c: c > b), lambda c: F.abs(c - b - gap_2))),
        ),
    )
    return F.array_min(F.filter(best, lambda x: x.isNotNull()))


def identity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    a, b = _col(a), _col(b)
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def edit_limit(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Largest edit distance that still reaches an identity threshold."""
    return F.floor((1 - F.lit(threshold)) * F.greatest(F.length(_col(a)), F.length(_col(b))) + 1e-9).cast("int")


def passes_identity(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Whether the identity reaches the threshold; lengths are compared first."""
    a, b = _col(a), _col(b)
    limit = edit_limit(a, b, threshold)
    return (F.abs(F.length(a) - F.length(b)) <= limit) & (F.levenshtein(a, b) <= limit)


def prompt_template(p: Column | str) -> Column:
    """Lower case, each number as <n>, single spaces; unknown_prompt if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.lower(_col(p))), "[0-9]+", "<n>"), "\\s+", " ")
    return F.coalesce(F.when(text != "", text), F.lit("unknown_prompt"))


def prompt_template_by_digit(p: Column | str) -> Column:
    """Lower case, each digit a token <n> of its own, tokens joined by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(p)), "[0-9]", " <n> "), "\\s+", " "))


def slug(value: Column | str) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and dash become one dash."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(value)), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def bucket_label(value: Column | str, span: int) -> Column:
    """Label low-high of a whole-number bucket."""
    low = (F.floor(_col(value) / span) * span).cast("long")
    return F.concat_ws("-", low, low + span - 1)


def bucket_label_float(value: Column | str, span: float) -> Column:
    """Label low-high of a bucket on doubles; null is `missing`. Uses the doubles as they are: 0.15 / 0.05 floors to 2."""
    low = F.floor(_col(value) / F.lit(span)) * F.lit(span)
    return F.coalesce(F.when(_col(value).isNotNull(), F.format_string("%.2f-%.2f", low, low + F.lit(span))), F.lit("missing"))


def mutations(parent: Column | str, child: Column | str) -> Column:
    """Point differences as A12B, comma-joined; strings of different lengths are compared up to the shorter."""
    parent, child = _col(parent), _col(child)
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(parent), F.length(child)), F.lit(1)))
    at = lambda s, i: F.substring(s, i, F.lit(1))
    return F.array_join(F.transform(F.filter(places, lambda i: at(parent, i) != at(child, i)), lambda i: F.concat(at(parent, i), i.cast("string"), at(child, i))), ",")


def splice(s: Column | str, start: Column, piece: Column) -> Column:
    """The string with an equally long piece laid over it from a 1-based place on."""
    return F.overlay(_col(s), piece, start)


def shuffled_with_frozen(s: Column | str, frozen: Column, seed: str) -> Column:
    """The characters at places outside `frozen` in an order drawn from a hash; composition and frozen places stay."""
    s = _col(s)
    places = F.sequence(F.lit(1), F.length(s))
    movable = F.filter(places, lambda i: ~F.array_contains(frozen, i))
    drawn = F.transform(F.array_sort(F.transform(movable, lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), s, i), 256).alias("h"), i.alias("i")))), lambda x: x["i"])
    picked = F.transform(places, lambda i: F.when(F.array_contains(frozen, i), F.substring(s, i, F.lit(1))).otherwise(F.substring(s, F.element_at(drawn, F.array_position(movable, i).cast("int")), F.lit(1))))
    return F.array_join(picked, "")


def estimated_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(_col(text)) / 4)


def safe_fraction(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def sequence_from_reply(text: Column | str) -> Column:
    """What a model's reply says behind SEQUENCE=, without think tags; null if it holds markup or other characters."""
    plain = F.regexp_replace(_col(text), "(?s)<think>.*?</think>", "")
    tail = F.when(F.contains(plain, F.lit("SEQUENCE=")), F.substring_index(plain, "SEQUENCE=", -1)).otherwise(plain)
    compact = F.upper(F.regexp_replace(tail, "\\s+", ""))
    return F.when(~F.contains(tail, F.lit("<")) & compact.rlike(f"^[{ALPHABET}]+$"), compact)


def length_hint(prompt: Column | str) -> Column:
    """The number before `aa` or `residues` in a prompt."""
    return F.try_to_number(F.nullif(F.regexp_extract(_col(prompt), "([0-9]+)\\s*(?:aa|amino acids|residues)", 1), F.lit("")), F.lit("999999999")).cast("int")


def temperature_token(name: Column | str) -> Column:
    """t0p8 and t08 in a run name are 0.8."""
    name = _col(name)
    split = F.regexp_extract(name, "t([0-9]+)p([0-9]+)", 1)
    return (
        F.when(split != "", F.concat(split, F.lit("."), F.regexp_extract(name, "t([0-9]+)p([0-9]+)", 2)).cast("double"))
        .when(F.regexp_extract(name, "t0([0-9]+)", 1) != "", F.concat(F.lit("0."), F.regexp_extract(name, "t0([0-9]+)", 1)).cast("double"))
    )
