"""Sequential selections, admissions and kernels against plain loops over the smallest tables."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.functions import kernels
from corvane.functions import text as tx
from corvane.operators import pairs, selection, similarity, stats
from corvane.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: catalog.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def part(spark):
    return sorted(spark.read.parquet(f"{SF}/part.parquet").collect(), key=lambda r: r["p_partkey"])


def digest(*values):
    return hashlib.sha256("|".join(map(str, values)).encode()).hexdigest()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_multi_capped(spark, run):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source").collect()
    rows = sorted(docs, key=lambda r: (-(r["doc_id"] * 7919 % 1000), r["doc_id"]))
    used, want = {}, []
    for r in rows:
        keys = ("lang", r["lang"], 20), ("source", r["source"], 4)
        if len(want) < 40 and all(used.get(k[:2], 0) < k[2] for k in keys):
            want.append(r["doc_id"])
            for k in keys:
                used[k[:2]] = used.get(k[:2], 0) + 1
    assert [r["doc_id"] for r in run("multi_capped_selection")] == want


def test_spread_panel(run, part):
    first = {}
    for r in part:
        first.setdefault(r["p_name"], r["p_partkey"])
    want = []
    for name, key in sorted(first.items(), key=lambda x: x[1]):
        if len(want) < 96 and all(edits(name, n) >= 3 for n, _ in want):
            want.append((name, key))
    assert [(r["p_name"], r["p_partkey"]) for r in run("spread_panel")] == want


def test_leader_clusters(run, part):
    heads, want = [], {}
    for r in part:
        found = next((k for k, h in enumerate(heads) if edits(r["p_name"], h) <= 3), None)
        if found is None:
            found = len(heads)
            heads.append(r["p_name"])
        want[r["p_partkey"]] = found
    assert {r["p_partkey"]: r["leader"] for r in run("leader_clusters")} == want


def test_farthest_first(run, part):
    sets = {r["p_partkey"]: {r["p_name"][i : i + 3] for i in range(max(1, len(r["p_name"]) - 2))} for r in part}
    taken = []
    while len(taken) < 12:
        near = lambda k: max((len(sets[k] & sets[t]) / max(1, len(sets[k] | sets[t])) for t in taken), default=0.0)
        taken.append(min((k for k in sets if k not in taken), key=lambda k: (near(k), k)))
    assert [r["p_partkey"] for r in run("farthest_first")] == taken


def test_farthest_first_reads_the_first_rows_of_a_set(spark, monkeypatch):
    """Copies beyond `top` rows are not kept, and a row without grams does not end the picks."""
    name = F.when(F.col("id") == 777, None).otherwise(F.array(F.concat(F.lit("g"), F.col("id") % 3), F.lit("x")))
    df = spark.range(3000).select("id", name.alias("grams"))
    kept = []
    persist = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self: kept.append(persist(self)) or kept[-1])
    out = selection.farthest_first(df, "grams", [F.col("id")], 5)
    assert [r["id"] for r in out.collect()] == [0, 777, 1, 2, 3]
    assert kept[0].count() == 3 * 5 + 1


def test_balanced_picks(run, part):
    brands = sorted({r["p_brand"] for r in part}, key=lambda b: digest("b", b))[:20]
    used, want = {}, []
    for brand in brands:
        best = {}
        for r in part:
            if r["p_brand"] == brand:
                best.setdefault(r["p_type"], r["p_partkey"])
        kind = min(best, key=lambda t: (used.get(t, 0), t))
        used[kind] = used.get(kind, 0) + 1
        want.append((best[kind], brand, kind))
    assert [(r["p_partkey"], r["p_brand"], r["p_type"]) for r in run("balanced_picks")] == want


def test_capacity_match(run, part):
    pool = sorted(([0, digest("m", 1, r["p_partkey"]), r["p_partkey"], len(r["p_name"])] for r in part if r["p_partkey"] % 3 == 1), key=lambda p: p[1])
    want = {}
    for r in sorted((r for r in part if r["p_partkey"] % 2 == 0), key=lambda r: digest("m", 0, r["p_partkey"])):
        size = len(r["p_name"])
        near = max(5, round(size * 0.05))
        free = [p for p in pool if p[0] < 2]
        fit = [p for p in free if p[3] == size] or [p for p in free if abs(p[3] - size) <= near]
        if fit:
            best = min(fit, key=lambda p: p[:2])
            best[0] += 1
            want[str(r["p_partkey"])] = str(best[2])
    assert {r["negative"]: r["positive"] for r in run("capacity_match")} == want


def test_length_matched_pairs(run, part):
    positives = {}
    for r in sorted((r for r in part if r["p_partkey"] % 2), key=lambda r: digest("m", r["p_partkey"])):
        positives.setdefault(len(r["p_name"]), []).append(r["p_partkey"])
    want = {}
    for r in part:
        own = positives.get(len(r["p_name"]))
        if r["p_partkey"] % 2 == 0 and own:
            want[r["p_partkey"]] = own[int(digest("m", r["p_partkey"])[:8], 16) % len(own)]
    assert {r["negative"]: r["positive"] for r in run("length_matched_pairs")} == want


def longest_repeat(s):
    return max((k for k in range(len(s) // 2 + 1) if any(s[i : i + k] == s[j : j + k] for i in range(len(s) - k + 1) for j in range(i + k, len(s) - k + 1))), default=0)


def test_admissions(run, part):
    letters = str.maketrans("0123456789abcdef", tx.ALPHABET[:16])
    want, seen = [], set()
    for r in part:
        k = r["p_partkey"]
        s = "".join(hashlib.sha256(f"{k}-{i}".encode()).hexdigest() for i in range(3)).translate(letters)
        if k % 2 == 0 and k % 3 and 120 <= len(s) <= 360 and s not in seen and kernels.repeat_length(s) <= 8:
            want.append(k)
        seen.add(s)
    assert sorted(r["p_partkey"] for r in run("positive_admission")) == want
    first = {}
    for r in part:
        k = r["p_partkey"]
        first.setdefault(tx.ALPHABET[: k % 20 + 1] + tx.ALPHABET[: k % 15 + 1], k)
    assert {r["p_partkey"]: r["repeat_length"] for r in run("negative_admission")} == {k: n for s, k in first.items() if (n := longest_repeat(s)) > 7}


def test_repeat_length_is_the_longest():
    rnd = random.Random(1)
    for _ in range(200):
        s = "".join(rnd.choices("AB", k=rnd.randint(0, 14)))
        assert kernels.repeat_length(s) == longest_repeat(s)


def test_bootstrap(spark, run):
    deltas = pd.DataFrame([r.asDict() for r in stats.contrasts(
        spark.read.parquet(f"{SF}/lineitem.parquet").groupBy(F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("v")), ["model", "seed"], "arm", "A", "N", "v"
    ).collect()])
    values = {m: g.sort_values("seed")["delta"].tolist() for m, g in deltas.groupby("model")}
    wide = spark.range(10_000).select(*(F.pmod(F.xxhash64(F.lit("b"), F.col("id").cast("int"), F.lit(m), F.lit(k)), F.lit(len(v)).cast("long")).alias(f"{m}_{k}") for m, v in values.items() for k in range(len(v)))).toPandas()
    draws = np.mean([np.mean([np.array(v)[wide[f"{m}_{k}"]] for k in range(len(v))], axis=0) for m, v in values.items()], axis=0)
    (got,) = run("hierarchical_bootstrap")
    assert got["samples"] == 10_000
    assert np.allclose([got["low"], got["high"]], np.percentile(draws, [2.5, 97.5]))


def test_sign_test_probability(spark, run):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority").toPandas()
    for r in run("sign_test_probability"):
        keys = orders[orders.o_orderpriority == r["o_orderpriority"]].o_orderkey
        wins, losses = int((keys % 3 == 0).sum()), int((keys % 3 == 1).sum())
        n = wins + losses
        tail = sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n
        assert abs(r["p_value"] - min(1.0, 2 * tail)) < 1e-6


def test_binomial_intervals(spark, run):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()

    def upto(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for r in run("binomial_intervals"):
        own = labels[labels.toxic == r["toxic"]].quality
        k, n = int(own.sum()), len(own)
        assert r["low"] == 0.0 if k == 0 else abs(1 - upto(k - 1, n, r["low"]) - 0.025) < 1e-3
        assert r["high"] == 1.0 if k == n else abs(upto(k, n, r["high"]) - 0.025) < 1e-3


def test_window_kernels():
    rnd = random.Random(2)

    def entropy(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0

    for _ in range(60):
        s = "".join(rnd.choices("ABCD", k=rnd.randint(0, 60)))
        want = min((entropy(s[i : i + 20]) for i in range(max(1, len(s) - 19))), default=0.0)
        assert abs(kernels.window_entropy(s, 20) - max(0.0, want)) < 1e-9
        best = 0.0
        for block, gap in itertools.product(kernels.BLOCKS, range(kernels.MAX_GAP + 1)):
            for i in range(len(s) - 2 * block - gap + 1):
                a, b = s[i : i + block], s[i + block + gap : i + 2 * block + gap]
                best = max(best, sum(x == y for x, y in zip(a, b, strict=True)) / block)
        assert abs(kernels.tandem(s) - best) < 1e-9
        assert kernels.distinct_kmers(s, 4) == (len({s[i : i + 4] for i in range(len(s) - 3)}) if len(s) >= 4 else min(1, len(s)))
    assert kernels.distinct_kmers("äöüäöü", 3) == 3 and kernels.letter_counts("ääö").tolist() == [2, 1]


@pytest.mark.parametrize("nulls", [0.0, 0.2])
def test_pareto_front(spark, nulls):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), *(None if rnd.random() < nulls else float(rnd.randint(0, 6)) for _ in range(3))) for i in range(300)]

    def beats(a, b):
        both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
        return all(x >= y for x, y in both) and any(x > y for x, y in both)

    df = spark.createDataFrame(rows, "id int, g string, x double, y double, z double").repartition(5)
    for within in ([], ["g"]):
        want = {r[0] for r in rows if not any(beats(o[2:], r[2:]) for o in rows if o[0] != r[0] and (not within or o[1] == r[1]))}
        assert {r["id"] for r in selection.pareto_front(df, "id", ["x", "y", "z"], within).collect()} == want


def test_preference_pairs_of_equal_rows(spark):
    rows = [(i, f"t{i}", "b", True, 0.5, 0.5) for i in range(3000)] + [(5000, "u", "b", False, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id long, text string, bucket string, ok boolean, axis double, score double")
    got = pairs.preference_pairs(df, "id", "text", ["bucket"], ["ok"], ["axis"], "score").collect()
    assert sorted((r["pair"], r["chosen"], r["rejected"]) for r in got) == [(k + 1, k, 5000) for k in range(128)]


def test_share_below_by_ranges(spark):
    rnd = random.Random(4)
    known = spark.createDataFrame([(rnd.choice([1.0, 2.5, rnd.random() * 9]),) for _ in range(700)], "v double")
    asked = spark.createDataFrame([(i, None if i % 50 == 0 else rnd.random() * 10) for i in range(200)] + [(900, 2.5), (901, 2.5)], "id int, x double")
    one, many = ({r["id"]: r["percentile"] for r in stats.share_below(asked, known, "x", "v", most=m).collect()} for m in (10**6, 10))
    values = sorted(r["v"] for r in known.collect())
    want = {r["id"]: None if r["x"] is None else sum(v <= r["x"] for v in values) / 700 for r in asked.collect()}
    assert one == want and many == pytest.approx(want)


def test_novelty_without_a_shared_kmer(spark):
    q = spark.createDataFrame([(1, "ACDEACDE"), (2, ""), (3, "QQQ")], "id long, s string")
    r = spark.createDataFrame([(10, "ACXEAXDE"), (11, "WWWW"), (12, None)], "r long, s string")
    got = {x["id"]: (x["r"], x["identity"], x["jaccard"]) for x in similarity.nearest_by_kmers(q, r, "id", "r", "s").collect()}
    assert got == {1: (10, 0.75, 0.0), 2: (None, 0.0, 0.0), 3: (None, 0.0, 0.0)}


def test_novelty_with_bounds_in_blocks(spark, monkeypatch):
    """Bounds from a part of the references and blocks of queries change nothing."""
    rnd = random.Random(12)
    rows = spark.createDataFrame([(i, "".join(rnd.choice("ACDE") for _ in range(rnd.randint(0, 40)))) for i in range(400)], "id long, s string").cache()
    run = lambda: sorted(tuple(x) for x in similarity.nearest_by_kmers(rows, rows.withColumnRenamed("id", "r"), "id", "r", "s", shortlist=3, other=True).collect())
    plain = run()
    monkeypatch.setattr(similarity, "PILOT_PAIRS", 0)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 150)
    assert run() == plain and len(plain) == 400


def test_every_part_is_a_novelty_query(spark):
    from corvane.plans import catalog

    sf = "/root/testdata/sf0.001"
    got = catalog.queries()["novelty_by_kmers"](spark, sf).select("p_partkey")
    want = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_confidence_without_objectives(spark):
    from corvane.operators.candidates import confidence_weight

    df = spark.createDataFrame([({}, False, 80.0), ({}, True, 0.5), ({"a": 0.5, "b": 1.0}, True, 0.0), (None, None, None)], "m map<string,double>, audited boolean, score double")
    gates = [F.lit(True), F.lit(False), F.lit(None).cast("boolean")]
    got = [r[0] for r in df.select(confidence_weight(F.col("m"), F.col("audited"), gates, F.coalesce("score", F.lit(0.0)))).collect()]
    assert got == [round(1.8 / 4, 4), round(2.5 / 5, 4), round(2.5 / 3, 4), round(1 / 4, 4)]
