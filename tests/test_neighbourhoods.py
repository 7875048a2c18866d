"""Neighbourhood reports and scores of distinct texts against plain loops."""

import random

from pyspark.sql import functions as F

from corvane.operators import curation, similarity

SCHEMA = "id long, text string, strict boolean, bridge boolean, bucket string, cluster int, reward double"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rows_of(seed, n):
    rnd = random.Random(seed)
    base = "ACDEFGHIKL"
    out = []
    for i in range(n):
        text = "".join(rnd.choice("ACD") if rnd.random() < 0.15 else c for c in base)[: rnd.choice([10, 10, 9, 8])]
        out.append((i, text, rnd.choice([True, False, None]), rnd.choice([True, False, None]), rnd.choice(["p", "q", "", None]), rnd.choice([1, 2, None]), rnd.choice([0.5, 1.0, None])))
    return [*out, (n, None, True, True, "p", 1, 1.0), (n + 1, "", True, True, "p", 1, 1.0), (n + 2, "WWWWWWWWWWWWWWWWWWWWWWWW", None, None, None, None, None)]


def test_reports_are_the_plain_ones(spark):
    rows, thresholds = rows_of(3, 120), [0.9, 0.8, 0.6]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [0, 1, 2, 3, 120, 121, 122]
    out = similarity.neighbourhood_reports(df.filter(F.col("id").isin(asked)), df, "id", "text", thresholds, F.col("strict"), F.col("bridge"), F.col("bucket"), F.col("cluster"), [-F.coalesce("reward", F.lit(0.0))], 4)
    got = sorted((r["anchor"], r["threshold"], r["role"], r["neighbours"], r["strict"], r["bridge_only"], r["buckets"], r["clusters"], tuple(r["examples"])) for r in out.collect())
    wanted = []
    for a in (r for r in rows if r[0] in asked):
        near = [(1 - edits(a[1], r[1]) / max(len(a[1]), len(r[1]), 1), r) for r in rows if a[1] is not None and r[1] is not None and r[1] != a[1]]
        near.sort(key=lambda x: (-x[0], -(x[1][6] or 0), x[1][0]))
        for t in thresholds:
            met = [r for identity, r in near if identity >= t]
            wanted.append((a[0], t, "strict" if a[2] else "bridge_only", len(met), sum(r[2] is True for r in met), sum(r[3] is True and r[2] is not True for r in met), len({r[4] for r in met if r[4]}), len({r[5] for r in met if r[5] is not None}), tuple(r[0] for r in met[:4])))
    assert got == sorted(wanted)
    assert any(x[3] > 4 for x in got)


def test_scores_of_distinct_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, ""), (5, None)], "id long, text string")
    out = curation.scored_once(df, "text", F.coalesce(F.length("text"), F.lit(-1)), "score")
    assert out.columns == ["id", "text", "score"]
    assert sorted((r["id"], r["score"]) for r in out.collect()) == [(1, 2), (2, 2), (3, -1), (4, 0), (5, -1)]
    assert curation.scored_once(df.limit(0), "text", F.length("text"), "score").count() == 0
