"""Exact order statistics against sorted lists, family statistics in full, and the two-stream join."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import scores
from corvane.operators import stats
from corvane.sources.records import scratch_table
from corvane.streaming import telemetry

ASKS = [("low", 0.05, "floor"), ("mid", 0.5, "floor"), ("near", 0.9, "round"), ("least", 0.0, "floor"), ("most", 1.0, "floor")]


def half_up(x):
    return math.floor(x + 0.5)


def plain(values):
    v = sorted(values)
    return tuple(v[(math.floor if how == "floor" else half_up)((len(v) - 1) * q)] for _, q, how in ASKS)


@pytest.mark.parametrize("bins", [1024, 3])
def test_order_statistics(spark, bins):
    rnd = random.Random(bins)
    groups = {
        "even": [rnd.random() for _ in range(500)], "hot": [7.0] * 3000 + [rnd.random() for _ in range(40)], "one": [2.5], None: [float(rnd.randrange(5)) for _ in range(90)],
        "wide": [rnd.choice([1, -1]) * 10.0 ** rnd.randint(-30, 30) for _ in range(60)], "twins": [1.0, math.nextafter(1.0, 2.0)] * 9,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("even", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r[name] for name, *_ in ASKS) for r in stats.order_statistics(df, ["k"], "v", ASKS, scratch_table, bins).collect()}
    assert got == {k: plain(v) for k, v in groups.items()}
    assert stats.order_statistics(df.limit(0), ["k"], "v", ASKS, scratch_table).count() == 0
    whole = stats.order_statistics(df, [], "v", ASKS, scratch_table).first()
    assert tuple(whole[name] for name, *_ in ASKS) == plain([v for vs in groups.values() for v in vs])


def test_family_statistics_and_their_defaults(spark):
    rows = [("GASAGDDDDH", ["GASAG"], [3, 6, 10]), ("GASAGGTSTG", ["GASAG", "GTSTG"], [3, 6, 10]), ("AAAA", [], None), ("SDH", [], [3, 1, 2]), ("SDHS", [], [0, 99, 1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "s string, m array<string>, p array<int>")
    row = stats.family_stats(df, "s", F.col("m"), F.col("p"), scratch_table).first()
    assert row["motifs"] == ["GASAG", "GTSTG"] and (row["low"], row["middle"], row["high"]) == (3.0, 4.0, 10.0)
    assert (row["serine_low"], row["serine_high"]) == (0.25, 0.3) and (row["histidine_low"], row["histidine_high"]) == (0.75, 1.0)
    none = stats.family_stats(df.limit(0), "s", F.col("m"), F.col("p"), scratch_table).first()
    assert none is None or (none["serine_low"], none["histidine_high"]) == (0.45, 0.98)


def test_sign_test_of_many_pairs(spark):
    df = spark.createDataFrame([(7, 3), (0, 0), (500, 500), (400, 600), (3000, 3100)], "w long, l long").select("w", "l", scores.sign_test(F.col("w"), F.col("l")).alias("p"))
    for r in df.collect():
        n, k = r["w"] + r["l"], min(r["w"], r["l"])
        want = min(1.0, 2 * float(sum(math.comb(n, i) for i in range(k + 1)) * 10**30 // 2**n) / 1e30) if n else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_claims_and_intents_as_tables(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    intents = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(5)), ("b", 3, at(0)), (None, 4, at(0))], "k string, intent long, t string").withColumn("t", F.col("t").cast("timestamp"))
    claims = spark.createDataFrame([("a", 10, at(0)), ("a", 11, at(12)), ("b", 12, at(30)), (None, 13, at(1))], "k string, claim long, u string").withColumn("u", F.col("u").cast("timestamp"))
    both = telemetry.matched_claims(intents, claims, ["k"], "t", "u", "10 minutes").select("intent", "claim")
    assert {tuple(r) for r in both.collect()} == {(1, 10), (2, 11)}
    every = telemetry.matched_claims(intents, claims, ["k"], "t", "u", "10 minutes", unmatched=True).select("intent", "claim")
    assert {tuple(r) for r in every.collect()} == {(1, 10), (2, 11), (3, None), (4, None)}


def test_late_claims_are_counted(spark, tmp_path):
    rows = lambda ids, days: spark.createDataFrame([("a", i, f"2024-01-{d:02d} 00:00:00") for i, d in zip(ids, days, strict=True)], "k string, id long, t string").withColumn("t", F.col("t").cast("timestamp"))
    left, right, out, kept = (str(tmp_path / n) for n in ("left", "right", "out", "kept"))
    rows([1, 2], [1, 20]).write.parquet(f"{left}/0")
    rows([10, 11], [1, 20]).write.parquet(f"{right}/0")
    read = lambda p: spark.readStream.schema("k string, id long, t timestamp").option("recursiveFileLookup", "true").parquet(p)
    joined = telemetry.matched_claims(read(left).withColumnsRenamed({"id": "intent"}), read(right).withColumnsRenamed({"id": "claim", "t": "u"}), ["k"], "t", "u", "2 days", "1 day")
    dropped = 0
    for late in ([], [12, 13]):
        if late:
            rows(late, [2, 21]).write.parquet(f"{right}/1")
        q = joined.select("intent", "claim").writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    # 12 is later than the watermark; 13 is in time and meets the intent of the first run
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 10), (2, 11), (2, 13)} and dropped == 1
