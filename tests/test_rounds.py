"""Selections that are settled in rounds or components, against plain loops on tight and skewed cases."""

import random

import pytest
from pyspark.sql import functions as F
from test_selections import digest, edits

from corvane.operators import curation, selection, similarity
from corvane.sources.records import scratch_table


def greedy(rows, caps, top):
    used, out = {}, []
    for r in rows:
        keys = [(k, r[i + 1]) for i, k in enumerate(caps)]
        if len(out) < top and all(used.get(k, 0) < caps[k[0]] for k in keys):
            out.append(r[0])
            for k in keys:
                used[k] = used.get(k, 0) + 1
    return out


@pytest.mark.parametrize(("seed", "caps", "top"), [(1, {"a": 1, "b": 1}, 1000), (2, {"a": 2, "b": 3, "c": 1}, 1000), (3, {"a": 5, "b": 2, "c": 4}, 12), (4, {"a": 1, "b": 0, "c": 1}, 5), (5, {"a": 400, "b": 1, "c": 9}, 60)])
def test_several_caps(spark, seed, caps, top):
    rnd = random.Random(seed)
    # one value of a and of b holds most rows; some keys are null
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([0, 0, *range(20), None]), rnd.randrange(60)) for i in range(600)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, a long, b long, c long")
    got = [r["id"] for r in selection.multi_capped(df, caps, [F.col("id")], top).collect()]
    assert got == greedy([(r[0], *(r["abc".index(k) + 1] for k in caps)) for r in sorted(rows)], caps, top)


def test_a_chain_of_caps(spark):
    """Each row shares a key with the next: the worst case for rounds."""
    rows = [(i, i // 2, (i + 1) // 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    assert [r["id"] for r in selection.multi_capped(df, {"a": 1, "b": 1}, [F.col("id")], 99).collect()] == greedy(rows, {"a": 1, "b": 1}, 99)


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 200), (2, 2, 9), (3, 1, 50), (4, 0, 5)])
def test_spread_panels(spark, seed, least, top):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choices("ab", k=rnd.randint(0, 6)))) for i in range(120)] + [(500, None)]
    want = []
    for i, t in rows:
        if t is not None and len(want) < top and all(edits(t, u) >= least for _, u in want):
            want.append((i, t))
    df = spark.createDataFrame(rows, "id long, text string")
    assert [tuple(r) for r in selection.spread_panel(df, "text", [F.col("id")], least, top).collect()] == want


def test_least_used_kinds(spark):
    rnd = random.Random(7)
    rows = [(i, f"g{rnd.randrange(30)}", f"k{rnd.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, k string")
    order = sorted({r[1] for r in rows}, key=lambda g: min(r[0] for r in rows if r[1] == g))[:20]
    used, want = {}, []
    for g in order:
        best = {}
        for r in rows:
            if r[1] == g:
                best.setdefault(r[2], r[0])
        kind = min(best, key=lambda k: (used.get(k, 0), k))
        used[kind] = used.get(kind, 0) + 1
        want.append((best[kind], g, kind))
    assert [tuple(r) for r in selection.least_used(df, "g", "k", [F.col("id")], 20).collect()] == want


def matched(negatives, positives, uses, seed="m"):
    pool = sorted(([0, digest(seed, 1, i), str(i), s] for i, s in positives), key=lambda p: p[1])
    want = {}
    for i, size in sorted(negatives, key=lambda r: digest(seed, 0, r[0])):
        near = max(5, round(size * 0.05))
        free = [p for p in pool if p[0] < uses]
        fit = [p for p in free if p[3] == size] or [p for p in free if abs(p[3] - size) <= near]
        if fit:
            best = min(fit, key=lambda p: p[:2])
            best[0] += 1
            want[str(i)] = best[2]
    return want


@pytest.mark.parametrize(("seed", "uses", "span", "negatives"), [(1, 2, 400, 150), (2, 1, 60, 200), (3, 3, 2000, 100), (4, 1, 300, 40), (5, 0, 50, 20)])
def test_capacity(spark, seed, uses, span, negatives):
    rnd = random.Random(seed)
    size = lambda: rnd.choice([7, rnd.randint(0, span)])
    n, p = [(i, size()) for i in range(negatives)], [(i, size()) for i in range(120)]
    frames = [spark.createDataFrame([*rows, (9999, None)], "id long, size long") for rows in (n, p)]
    assert {r["negative"]: r["positive"] for r in curation.capacity_match(*frames, "id", "id", "size", uses, "m").collect()} == matched(n, p, uses)


def test_sizes_that_depend_on_each_other():
    assert curation.coupled({10: (5, 5), 100: (3, 9)}, 1) == {}
    # 10 lacks one, reaches 14, which then lacks one and reaches 18; 100 is out of reach
    assert curation.coupled({10: (6, 5), 14: (5, 5), 18: (5, 6), 100: (3, 9)}, 1) == {10: 10, 14: 10, 18: 10}
    assert curation.coupled({10: (6, 5), 14: (0, 5), 18: (5, 5)}, 1) == {10: 10, 14: 10}
    assert curation.coupled({10: (1, 0), 200: (1, 0)}, 1) == {10: 10, 200: 200}


def test_pareto_fronts_are_hash_joins(spark):
    df = spark.range(300).select("id", *((F.when(F.col("id") % (k + 3) > 0, F.hash("id", F.lit(k)) % 50)).alias(f"x{k}") for k in range(3)))
    front = selection.pareto_front(df, "id", ["x0", "x1", "x2"])
    plan = front._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = df.collect()

    def beats(a, b):
        both = [(a[f"x{k}"], b[f"x{k}"]) for k in range(3) if a[f"x{k}"] is not None and b[f"x{k}"] is not None]
        return all(x >= y for x, y in both) and any(x > y for x, y in both)

    assert {r["id"] for r in front.collect()} == {r["id"] for r in rows if not any(beats(o, r) for o in rows)}


def test_many_copies_of_a_text(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 > 0, "one text").when(F.col("id") % 30 == 0, "one test").otherwise(F.concat(F.lit("t"), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = similarity.edit_clusters(df, "id", "text", 2, scratch_table).groupBy("component").count().orderBy(F.desc("count")).limit(2).collect()
    assert tuple(got[0]) == (0, 42_000) and got[1]["count"] == 1
    near = {r["id"]: (r["nearest"], r["distance"]) for r in similarity.nearest_by_edits(df, "id", "text", 2, scratch_table).filter("id < 40").collect()}
    assert near[0] == (30, 0) and near[1] == (2, 0) and near[2] == (1, 0) and near[30] == (0, 0) and 3 not in near


def test_edit_joins_against_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices("abc", k=rnd.randint(0, 9))), rnd.choice("xy")) for i in range(150)] + [(900, None, "x"), (901, "abc", None)]
    df = spark.createDataFrame(rows, "id long, text string, part string")
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    for most in (0, 1, 2):
        want = {(a[0], b[0], edits(a[1], b[1])) for a in known for b in known if a[0] < b[0] and a[2] == b[2] and edits(a[1], b[1]) <= most}
        assert {tuple(r) for r in similarity.edit_pairs(df, "id", "text", most, F.col("part")).collect()} == want
        best = {}
        for a, b, d in want:
            best[a], best[b] = min(best.get(a, (99, 0)), (d, b)), min(best.get(b, (99, 0)), (d, a))
        assert {r["id"]: (r["distance"], r["nearest"]) for r in similarity.nearest_by_edits(df, "id", "text", most, scratch_table, F.col("part")).collect()} == best


def test_pairs_of_copies_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 64, raising=False)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 1 << 14, raising=False)
    df = spark.range(600).select("id", F.when(F.col("id") < 500, "one text").otherwise("one test").alias("text"))
    found = similarity.edit_pairs(df, "id", "text", 2)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 600 * 599 // 2
    assert max(r["count"] for r in tasks) < 30_000
    assert found.select("a", "b").distinct().count() == 600 * 599 // 2
    assert found.filter("(distance = 1) <> (a < 500 AND b >= 500)").isEmpty() and found.filter("a >= b").isEmpty()


def test_pairs_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "ab"), (None, "ab"), (3, "ac"), (None, "ac")], "id long, text string")
    got = sorted(tuple(r) for r in similarity.edit_pairs(df, "id", "text", 1).collect())
    assert got == [(1, 2, 0), (1, 2, 0), (1, 3, 1), (1, 3, 1), (2, 3, 1)]
