"""Hand-computed values and properties of single operators."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import kernels, scores
from corvane.functions import text as tx
from corvane.operators import curation, datasets, pairs, selection, stats
from corvane.operators.structure import triads
from corvane.plans import catalog
from corvane.sources import records
from corvane.streaming import telemetry


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(spark, column, **columns):
    return one(spark, **columns).select(column.alias("x")).first()["x"]


def test_distance_and_identity(spark):
    row = {"a": "ACDEFG", "b": "ACXEFG", "s": "AAAAAAAAAA", "t": "AAAAAAAAAC"}
    assert value(spark, F.levenshtein("a", "b"), **row) == 1
    assert value(spark, tx.identity("s", "t"), **row) == pytest.approx(0.9)
    assert value(spark, tx.passes_identity("s", "t", 0.90), **row)
    assert not value(spark, tx.passes_identity("s", "t", 0.91), **row)
    assert not value(spark, tx.passes_identity(F.lit("AAAA"), F.lit("AAAAAAAAAA"), 0.85), **row)


def test_overlapping_motifs(spark):
    assert value(spark, tx.motifs("s"), s="GASAGASAG") == ["GASAG", "GASAG"]
    assert value(spark, tx.motif_positions("s"), s="GASAGASAG") == [3, 7]
    assert value(spark, tx.motif_positions("s"), s="") == []


def test_two_prompt_templates_differ(spark):
    assert value(spark, tx.prompt_template("p"), p=" Make 120  AA ") == "make <n> aa"
    assert value(spark, tx.prompt_template_by_digit("p"), p=" Make 120  AA ") == "make <n> <n> <n> aa"
    assert value(spark, tx.prompt_template("p"), p="  ") == "unknown_prompt"


def test_double_buckets_floor_as_doubles(spark):
    assert value(spark, tx.bucket_label_float("v", 0.05), v=0.15) == "0.10-0.15"
    assert value(spark, tx.bucket_label_float(F.lit(None).cast("double"), 0.05), v=0.1) == "missing"
    assert value(spark, tx.bucket_label("v", 10), v=187) == "180-189"


def test_unscored_candidates_fail(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scores.second_stage(none, F.lit(0.0), F.lit(0.0), F.lit(0.0)), x=1) == 0.0
    assert value(spark, scores.share_at_or_below(F.array(), F.lit(1.0)), x=1) == 0.0


def test_log_sigmoid(spark):
    assert value(spark, scores.log_sigmoid(F.lit(0.0)), x=1) == pytest.approx(-math.log(2))
    for v in (1000.0, -1000.0):
        assert math.isfinite(value(spark, scores.log_sigmoid(F.lit(v)), x=1))


def test_structural_grade(spark):
    lists = [F.array(*map(F.lit, v)) for v in ([60.0, 70.0, 80.0, 90.0, 95.0], [2.0, 2.5, 3.0, 3.5, 4.0], [2.0, 2.2, 2.4, 3.0, 3.5])]
    got = value(spark, scores.structural_grade(F.lit(90.0), F.lit(3.0), F.lit(2.2), *lists), x=1)
    assert round(got, 4) == round((0.8 + 0.6 + 0.8) / 3, 4)


def test_reason_order(spark):
    got = value(spark, pairs.reasons([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(True), "c")]), x=1)
    assert got == ["a", "c"]


def test_pairs_decide_by_first_flag_and_stay_in_bucket(spark):
    rows = [("good", "t1", "ck", True, 0.5), ("repeat", "t2", "ck", False, 0.9), ("else", "t3", "other", False, 0.1)]
    df = spark.createDataFrame(rows, "id string, text string, ck string, gate boolean, score double")
    got = pairs.preference_pairs(df, "id", "text", ["ck"], ["gate"], ["score"], "score").collect()
    assert [(r["chosen"], r["rejected"], r["rule"]) for r in got] == [("good", "repeat", "gate")]


def test_pair_cap_is_the_first_pairs_in_order(spark):
    n = 60
    df = spark.createDataFrame([(i, f"t{i % 50}", "b", (i * 7 % n) / n) for i in range(n)], "id long, text string, b string, score double")
    got = {(r["chosen"], r["rejected"]) for r in pairs.preference_pairs(df, "id", "text", ["b"], [], ["score"], "score", cap=40).collect()}
    order = sorted(((i * 7 % n) / n, -i) for i in range(n))[::-1]
    want = []
    for a in range(n):
        for b in range(a + 1, n):
            (sa, ia), (sb, ib) = order[a], order[b]
            if (-ia) % 50 != (-ib) % 50 and sa > sb:
                want.append((-ia, -ib))
    assert got == set(want[:40])


def test_pareto_uses_shared_axes_only(spark):
    rows = [("a", 0.9, 0.1), ("b", 0.5, 0.5), ("c", 0.4, None), ("d", 0.95, 0.6)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    assert {r["id"] for r in selection.pareto_front(df, "id", ["x", "y"]).collect()} == {"d"}


def test_multi_cap_and_shortfall(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "id long, a long, b long")
    got = [r["id"] for r in selection.multi_capped(df, {"a": 2, "b": 2}, [F.col("id")], 4).collect()]
    assert sorted(got) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="needed 9"):
        selection.multi_capped(df, {"a": 2, "b": 2}, [F.col("id")], 9, strict=True).collect()


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}") for i in range(80)], "id long, g string")
    parts = datasets.grouped_split(df, "g", 0.2, "s").toPandas()
    assert parts.groupby("g").part.nunique().max() == 1
    assert (parts.part == "holdout").sum() == 16


def test_duplicate_keys_are_refused(spark):
    df = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(Exception, match="duplicate key"):
        records.unique_by(df, ["k"]).collect()


def test_intervals(spark):
    low, high = kernels.binomial_bounds(0, 10)
    assert low == 0.0 and high == pytest.approx(0.30850, abs=1e-4)
    df = spark.createDataFrame([("m", float(i)) for i in (1, 2, 3)], "m string, v double")
    r = stats.mean_interval(df, ["m"], "v").first()
    assert r["mean"] == 2.0 and r["high"] - 2.0 == pytest.approx(4.3026527297 / math.sqrt(3))
    flips = stats.sign_flip(spark.createDataFrame([("m", i, 1.0) for i in range(3)], "m string, i int, v double"), ["m"], "v", "i").first()
    assert (flips["permutations"], flips["p_value"]) == (8, 0.25)


def test_sign_test(spark):
    got = value(spark, scores.sign_test(F.lit(1).cast("long"), F.lit(5).cast("long")), x=1)
    assert got == pytest.approx(2 * (1 + 6) / 64)


def test_triad(spark):
    rows = [("s", 1, "SER", "OG", 0.0), ("s", 2, "HIS", "ND1", 2.8), ("s", 3, "ASP", "OD1", 5.5)]
    atoms = spark.createDataFrame([(s, n, r, a, x, 0.0, 0.0) for s, n, r, a, x in rows], "s string, number int, residue string, atom string, x double, y double, z double")
    t = triads(atoms, "s", 3.5).first()
    assert (round(t["ser_his"], 2), round(t["his_asp"], 2), t["passes"]) == (2.8, 2.7, True)


def test_flagging_a_failure_clears_it():
    m = telemetry.Metrics()
    m.step(0, True, [], "", None, None, False, True)
    m.step(1, True, ["collapsed"], "", None, None, False, True)
    m.step(2, False, [], "", True, None, True, True)
    assert (m.failures, m.detections, m.detection_steps, m.recoveries, m.interventions, m.viable) == (1, 1, 1, 0, 1, 1)


def test_fold_and_stream_agree_on_no_flags(spark):
    rows = [("r", i, i in (2, 3), [], "", None, None, True, True) for i in range(6)]
    got = telemetry.run_metrics(spark.createDataFrame(rows, telemetry.EVENTS)).first()
    assert (got["failures"], got["recoveries"], got["recovery_time"]) == (1, 1, 2.0)


@given(st.text(alphabet="ACD", max_size=30))
def test_repeat_kernels(s):
    n = kernels.repeat_length(s)
    brute = max((k for k in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * k + 1) if s[i : i + k] in s[i + k :]), default=0)
    assert n == brute
    assert len(kernels.mask_repeats(s, 3)) == len(s)


@given(st.text(alphabet="ABCDEFG", max_size=60))
def test_window_entropy(s):
    def h(x):
        return -sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x)) if x else 0.0

    want = h(s) if len(s) <= 20 else min(h(s[i : i + 20]) for i in range(len(s) - 19))
    assert kernels.window_entropy(s, 20) == pytest.approx(want, abs=1e-9)


@given(st.text(alphabet="AB", max_size=70))
def test_tandem(s):
    best = 0.0
    for block in kernels.BLOCKS:
        for start in range(len(s)):
            for gap in range(kernels.MAX_GAP + 1):
                a, b = s[start : start + block], s[start + block + gap : start + 2 * block + gap]
                if len(b) == block:
                    best = max(best, sum(x == y for x, y in zip(a, b, strict=True)) / block)
    assert kernels.tandem(s) == pytest.approx(best)


@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_edit_distance_is_symmetric(a, b):
    assert selection.edit_distance(a, b, 9) == selection.edit_distance(b, a, 9)


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "id long, a long, b long, text string, score double")
    assert selection.multi_capped(empty, {"a": 1}, [F.col("id")], 3).count() == 0
    assert selection.pareto_front(empty, "id", ["a", "b"]).count() == 0
    assert pairs.preference_pairs(empty, "id", "text", ["a"], [], ["score"], "score").count() == 0


def test_step_by_step_selections_take_more_than_200_000_rows(spark):
    n = 250_000
    late = F.col("id") >= n - 2  # what is picked last stands last
    df = spark.range(n).withColumn("a", F.when(late, F.col("id")).otherwise(0)).withColumn("text", F.when(late, F.concat(F.lit("zzzzzzzz"), F.col("id"))).otherwise("aa"))
    ends = [0, n - 2, n - 1]
    assert [r["id"] for r in selection.multi_capped(df, {"a": 1}, [F.col("id")], 3).collect()] == ends
    assert [r["id"] for r in selection.spread_panel(df, "text", [F.col("id")], 1, 3).collect()] == ends
    lead = {(r["leader"], r["n"]) for r in selection.leaders(df, "text", [F.col("id")], 0).groupBy("leader").agg(F.count("*").alias("n")).collect()}
    assert lead == {(0, n - 2), (1, 1), (2, 1)}
    grams = df.withColumn("grams", F.split("text", ""))
    assert [r["id"] for r in selection.farthest_first(grams, "grams", [F.col("id")], 3).collect()] == [0, n - 2, n - 1]
    assert [r["id"] for r in selection.least_used(df, "a", "text", [F.col("id")], 3).collect()] == ends
    sizes = df.select("id", F.lit(50).alias("size"))
    got = curation.capacity_match(sizes.limit(130_000), sizes.limit(100_000), "id", "id", "size", 2, "m").groupBy("positive").count().agg(F.sum("count"), F.max("count")).first()
    assert tuple(got) == (130_000, 2)


def test_bootstrap_query_draws_as_many_samples_as_the_reference(spark):
    assert catalog.queries()["hierarchical_bootstrap"](spark, "/root/testdata/sf0.001").first()["samples"] == 10_000
