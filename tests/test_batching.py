"""Batches by length against the greedy loop."""

import hashlib
import random

import pandas as pd
import pytest

from corvane.operators import batching


def loop(rows, size, span, limit, overhead=2):
    """A row at a time, from long to short."""
    order = sorted(((k, len(t or "")) for k, t in rows), key=lambda r: (-r[1], hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    out, batch, held, longest, spent = [], -1, 0, 0, 0
    for k, n in order:
        cost = max(1, n - overhead)
        if batch < 0 or held >= size or longest - n > span or (limit > 0 and spent + cost > limit):
            batch, held, longest, spent = batch + 1, 0, n, 0
        out.append((k, n, batch, held))
        held, spent = held + 1, spent + cost
    return sorted(out)


def found(df):
    return sorted((r["k"], r["length"], r["batch"], r["slot"]) for r in df.collect())


@pytest.mark.parametrize(("size", "span", "limit"), [(16, 32, 0), (16, 32, 100), (3, 0, 40), (1, 5, 9), (1000, 1000, 50), (7, 2, 1)])
def test_same_batches_as_the_loop(spark, size, span, limit):
    rnd = random.Random(size)
    lengths = [rnd.choice([0, 1, 2, 3, 9, 9, 9, 9, 30, rnd.randrange(60)]) for _ in range(400)]
    rows = [(i, None if rnd.random() < 0.05 else "x" * n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "k long, t string")
    assert found(batching.length_batches(df, "k", "t", size, span, limit)) == loop(rows, size, span, limit)


def test_cuts_over_many_histograms():
    """The pass over counts alone, expanded to rows."""
    rnd = random.Random(5)
    for _ in range(400):
        size, span, limit = rnd.randrange(1, 20), rnd.randrange(0, 12), rnd.choice([0, rnd.randrange(1, 200)])
        counts = {rnd.randrange(40): rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 12))}
        frame = pd.DataFrame(sorted(counts.items(), reverse=True), columns=["length", "n"])
        cuts = pd.concat(batching._cuts(iter([frame.iloc[:3], frame.iloc[3:]]), size, span, limit, 2))
        got = []
        for r in cuts.itertuples():
            for rank in range(counts[r.length]):
                late = rank - r.taken
                got.append((r.length, r.batch, r.held + rank) if late < 0 else (r.length, r.batch + 1 + late // r.each, late % r.each))
        rows = [(i, "x" * n) for i, n in enumerate(n for n, c in sorted(counts.items()) for _ in range(c))]
        assert sorted(got) == sorted(x[1:] for x in loop(rows, size, span, limit))


def test_one_length_and_no_rows(spark):
    rows = [(i, "abcd") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string")
    assert found(batching.length_batches(df, "k", "t", 16, 32, 0)) == loop(rows, 16, 32, 0)
    assert batching.length_batches(df.limit(0), "k", "t").count() == 0
    with pytest.raises(ValueError):
        batching.length_batches(df, "k", "t", 0)


def test_equal_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab", 5), (1, "ab", 6), (2, "a", 7)], "k long, t string, rank long").withColumnRenamed("rank", "length")
    out = batching.length_batches(df, "k", "t", 2, 0, 0)
    assert sorted((r["k"], r["batch"], r["slot"]) for r in out.collect()) == [(1, 0, 0), (1, 0, 1), (2, 1, 0)]


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "ab"), (1, "ab"), (None, None)], "k long, t string")
    out = batching.length_batches(df, "k", "t", 2, 9, 0)
    assert sorted(((r["k"] is None, r["batch"], r["slot"]) for r in out.collect())) == [(False, 0, 1), (True, 0, 0), (True, 1, 0)]
