"""Kernels against plain versions."""

import random

import pandas as pd
import pytest

from corvane.functions import kernels


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_repeat(s: str) -> int:
    return max((k for k in range(1, len(s) // 2 + 1) if any(s[i : i + k] in s[i + k :] for i in range(len(s) - k))), default=0)


def plain_mask(s: str, k: int) -> str:
    hits = [i for i in range(len(s) - k + 1) if s.index(s[i : i + k]) + k <= i]
    return "".join("X" if any(i <= p < i + k for i in hits) else c for p, c in enumerate(s))


@pytest.mark.parametrize("letters", ["A", "AB", "ACDEé\U0001f600"])
def test_repeats_and_distances(letters):
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 24))) for _ in "ab")
        assert kernels.edit_distance(a, b) == plain_distance(a, b)
        assert kernels.repeat_length(a) == plain_repeat(a)
        assert kernels.mask_repeats(a, 3) == plain_mask(a, 3)


def test_shortlists_do_not_grow_with_batches():
    """A task gives `top` rows a query, ties to the smaller id, however many batches and copies it reads."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 9))) for _ in range(300)] * 4
    rows = pd.DataFrame({"r": range(len(texts)), "r_seq": texts}).sample(frac=1, random_state=1)
    queries = [(1, "ABCAB"), (2, ""), (3, "CC")]
    got = pd.concat(kernels.nearest_kmer_sets(queries, 3, 7)(iter([rows[a : a + 100] for a in range(0, len(rows), 100)])))
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
    assert len(got) == 21
    for q, s in queries:
        share = lambda t: len(grams(s) & grams(t)) / max(1, len(grams(s) | grams(t)))  # noqa: B023, E731
        want = sorted((-share(t), i) for i, t in enumerate(texts))[:7]
        assert [(-x.jaccard, x.r) for x in got[got["q"] == q].itertuples()] == want


@pytest.mark.parametrize("letters", ["AB", "ACDEé\U0001f600"])
def test_distances_of_many_pairs(letters, monkeypatch):
    monkeypatch.setattr(kernels, "LEAST_WORDS", 1)  # small groups too
    rng = random.Random(9)
    left, right = (["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(300)] for _ in "ab")
    assert kernels.edit_distances(left, right) == [plain_distance(a, b) for a, b in zip(left, right, strict=True)]


def test_bounds_leave_the_shortlist_whole(monkeypatch):
    """With the last place of a part's shortlist as bound the rows of the whole shortlist come, and none below it."""
    monkeypatch.setattr(kernels, "LEAST_REST", 1)  # rare k-mers apart in small sets too
    rng = random.Random(10)
    texts = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(0, 40))) for _ in range(900)]
    rows = pd.DataFrame({"r": range(900), "r_seq": texts})
    queries = [(i, texts[i]) for i in range(0, 900, 11)]
    first = lambda got: {q: sorted(zip(-x.jaccard, x.r, strict=True))[:7] for q, x in got.groupby("q")}
    run = lambda asked, df: pd.concat(kernels.nearest_kmer_sets(asked, 3, 7, "block")(iter([df[a : a + 200] for a in range(0, len(df), 200)])))
    bounds = {q: -x[-1][0] for q, x in first(run(queries, rows[::9])).items()}
    kernels._prepared.clear()
    got = run([(q, s, bounds[q]) for q, s in queries], rows)
    kernels._prepared.clear()
    assert first(got) == first(run(queries, rows)) and (got.jaccard >= got.q.map(bounds)).all()


def test_pairs_that_lengths_rule_out_are_nobodys_best():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ABC") for _ in range(rng.choice([0, 3, 9, 30, 90])))
    rows = pd.DataFrame([(q, r, r % 12 + 1, 0.5, s, rng.choice([s, word(), word()])) for q in range(40) for s in [word()] for r in range(12)], columns=["rep", "r", "rank", "jaccard", "q_seq", "r_seq"])
    got = next(kernels.shortlist_identities(11)(iter([rows])))
    rows["want"] = [1 - plain_distance(a, b) / max(len(a), len(b), 1) for a, b in zip(rows.q_seq, rows.r_seq, strict=True)]
    rows["got"] = got.identity.to_numpy()
    assert rows.got.isna().any() and (rows.got.isna() | (rows.got == rows.want)).all()
    for _, x in rows.groupby("rep"):
        for own in range(12):  # a query that is one of the twelve is no reference of its
            y = x[x.r != own][:11]
            assert (y.got.max(), y.got.idxmax()) == (y.want.max(), y.want.idxmax())


def test_letters_as_in_sql(spark):
    from pyspark.sql import functions as F

    from corvane.functions import text as tx

    df = spark.createDataFrame([("Ab é-z\U0001f600J o9\n[x]",), ("",), (None,), ("12",)], "t string")
    got = df.select(kernels.letters("t", "BJOUXZ", "ACDEFG").alias("a"), F.translate(tx.letters("t"), "BJOUXZ", "ACDEFG").alias("b"), kernels.letters("t").alias("c"), tx.letters("t").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


def test_copies_meet_no_repeat_kernel(spark):
    """The kernel stands above the choice of one row a sequence, and the first by id is kept."""
    from corvane.operators import curation

    rows = spark.createDataFrame([(i, "ACDEFGHIACDEFGHI") for i in (5, 3, 9)] + [(1, "ACDE")], "id long, sequence string")
    kept = curation.admitted_negatives(rows, "sequence", 7, "id")
    assert [tuple(r) for r in kept.collect()] == [(3, "ACDEFGHIACDEFGHI", 8)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("ArrowEvalPython") < plan.index("Aggregate")
