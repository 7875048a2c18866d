"""Queries over event streams, and relational queries on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.sources import records
from corvane.streaming import telemetry

from .catalog import register
from .views import table


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.concat(F.lit("run-"), F.col("user_id") % 40).alias("run"), k.alias("step_index"), (k % 7 < 2).alias("collapsed"), F.when(k % 5 == 0, F.array(F.lit("collapsed"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(k % 11 == 0, F.concat(F.lit("c"), k % 3)).otherwise("").alias("constraints"), F.when(k % 13 == 0, k % 2 == 0).alias("gate"), F.when(k % 17 == 0, (k % 100).cast("double")).alias("confidence"),
        (k % 7 >= 2).alias("repeat_ok"), (k % 3 > 0).alias("geometry_ok"), F.when(k % 26 == 0, (k % 50) / 50.0).alias("grade"),
    )


_TOTALS = """
    WITH e AS (SELECT 'run-' || user_id % 40 AS run, event_id AS k, event_id % 7 < 2 AS bad, event_id % 5 = 0 AS flag, CASE WHEN event_id % 11 = 0 THEN 'c' || event_id % 3 END AS c FROM events),
    n AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)"""


@register("telemetry_metrics", f"""{_TOTALS}
    SELECT run, count(*) AS steps, count_if(flag OR (c IS NOT NULL AND c IS DISTINCT FROM before))::BIGINT AS interventions,
           count_if(k % 13 = 0 OR k % 17 = 0)::BIGINT AS finished, count_if(CASE WHEN k % 13 = 0 THEN k % 2 = 0 AND k % 7 >= 2 WHEN k % 17 = 0 THEN k % 100 > 70 AND k % 7 >= 2 AND k % 3 > 0 ELSE false END)::BIGINT AS viable FROM n GROUP BY run""")
def telemetry_metrics(spark, sf_dir):
    return telemetry.run_metrics(_events(spark, sf_dir)).select("run", "steps", "interventions", "finished", "viable")


@register("telemetry_recovery", """
    WITH e AS (SELECT 'run-' || user_id % 40 AS run, event_id AS k, event_id % 7 < 2 AS bad, event_id % 5 = 0 AS flag FROM events), l AS (SELECT *, coalesce(lag(bad AND NOT flag) OVER (PARTITION BY run ORDER BY k), false) AS was FROM e),
    o AS (SELECT *, k - max(CASE WHEN bad AND NOT was THEN k END) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING) AS since FROM l)
    SELECT run, count_if(bad AND NOT was)::BIGINT AS failures, count_if(bad AND flag)::BIGINT AS detections, count_if(NOT bad AND was)::BIGINT AS recoveries,
           avg(CASE WHEN bad AND flag THEN since END) AS detection_latency, avg(CASE WHEN NOT bad AND was THEN since END) AS recovery_time,
           count_if(k % 26 = 0)::BIGINT AS graded, round(avg(CASE WHEN k % 26 = 0 THEN (k % 50) / 50.0::DOUBLE END), 9) AS mean_structural_score FROM o GROUP BY run""")
def telemetry_recovery(spark, sf_dir):
    return telemetry.run_metrics(_events(spark, sf_dir)).select("run", "failures", "detections", "recoveries", "detection_latency", "recovery_time", "graded", F.round("mean_structural_score", 9).alias("mean_structural_score"))


@register("streamed_telemetry", f"""{_TOTALS}
    SELECT run, count(*) AS steps, count_if(flag OR (c IS NOT NULL AND c IS DISTINCT FROM before))::BIGINT AS interventions FROM n GROUP BY run""")
def streamed_telemetry(spark, sf_dir):
    source, out = records.scratch_path(spark), records.scratch_path(spark)
    _events(spark, sf_dir).coalesce(1).write.parquet(source)
    stream = telemetry.stream_metrics(spark.readStream.schema(telemetry.EVENTS).parquet(source))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", records.scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.parquet(out)
    return seen.groupBy("run").agg(F.max_by(F.struct("steps", "interventions"), "batch").alias("x")).select("run", "x.*")


@register("streamed_claims", """
    WITH i AS (SELECT user_id, event_id AS intent, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id AS claim, ts, event_id % 10 = 0 AS held FROM events WHERE event_type = 'purchase'),
    w AS (SELECT least((SELECT max(ts) FROM i), (SELECT max(ts) FROM c WHERE NOT held)) - INTERVAL 1 day AS mark)
    SELECT i.user_id, intent, claim FROM i JOIN c ON i.user_id = c.user_id AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 6 hours, w WHERE NOT held OR c.ts > mark""")
def streamed_claims(spark, sf_dir):
    """Intents and claims as two streams in order of time; each tenth claim is held back to the end, where those behind the watermark are late."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    intents, claims, out = (records.scratch_path(spark) for _ in range(3))
    e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("intent"), F.col("ts").alias("intent_ts")).write.parquet(f"{intents}/0")
    c = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("claim"), F.col("ts").alias("claim_ts"))
    held = F.col("claim") % 10 == 0
    c.filter(~held).write.parquet(f"{claims}/0")
    sides = [spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(path) for kind, path in (("user_id long, intent long, intent_ts timestamp", intents), ("user_id long, claim long, claim_ts timestamp", claims))]
    joined = telemetry.matched_claims(*sides, ["user_id"], "intent_ts", "claim_ts", "6 hours", "1 day")
    kept = records.scratch_path(spark)
    for late in (None, c.filter(held)):  # two runs of one query, which goes on from its checkpoint
        if late is not None:
            late.write.parquet(f"{claims}/1")
        q = joined.select("user_id", "intent", "claim").writeStream.outputMode("append").format("parquet").option("checkpointLocation", kept).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


@register("late_telemetry", f"""{_TOTALS}
    SELECT run, count(*) AS steps, count_if(flag OR (c IS NOT NULL AND c IS DISTINCT FROM before))::BIGINT AS interventions FROM n GROUP BY run""")
def late_telemetry(spark, sf_dir):
    """The steps of every run in an order that has nothing to do with theirs, over several batches; a step of no run at the end moves the watermark past all."""
    source, out = records.scratch_path(spark), records.scratch_path(spark)
    e = _events(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step_index")))
    for k in range(3):
        e.filter(F.pmod(F.xxhash64("step_index"), F.lit(3)) == k).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(telemetry.TIMED_EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(source)
    kept = records.scratch_path(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for last in (None, e.agg(F.max("ts").alias("ts"))):
            if last is not None:
                end = last.select(F.lit("").alias("run"), F.lit(0).cast("long").alias("step_index"), (F.col("ts") + F.expr("INTERVAL 1000 days")).alias("ts"))
                end.write.parquet(f"{source}/end")
            q = telemetry.ordered_metrics(stream, "900 days").writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", kept).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    seen = spark.read.parquet(out).filter("run <> ''")
    return seen.groupBy("run").agg(F.max_by(F.struct("steps", "interventions"), "steps").alias("x")).select("run", "x.*")


@register("tumbling_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    w = telemetry.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("streamed_windows", "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, sf_dir):
    source, out = records.scratch_path(spark), records.scratch_path(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.write.parquet(source)
    w = telemetry.windowed(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source), "ts", ["event_type"], "value", "1 day")
    q = w.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}")).option("checkpointLocation", records.scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress)
    return spark.read.parquet(f"{out}/{last}").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("sessions", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    s = telemetry.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@register("claims_once", "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL")
def claims_once(spark, sf_dir):
    c = telemetry.claims_once(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id", "event_type"])
    return c.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("freshness", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' - INTERVAL 2 days AND TIMESTAMP '2024-01-10' + INTERVAL 1 day")
def freshness(spark, sf_dir):
    return telemetry.fresh(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2024-01-10 00:00:00", "2 days", "1 day").select("event_id")


@register("relevance_join", """
    SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 1000 GROUP BY ALL""")
def relevance_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").filter("o_totalprice > 1000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("pricing_summary", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("as_of_join", "SELECT l.event_id, max_by(r.event_id, (r.ts, r.event_id)) AS latest FROM events l JOIN events r ON l.user_id = r.user_id AND r.event_type = 'view' AND (r.ts, r.event_id) <= (l.ts, l.event_id) WHERE l.event_type = 'purchase' GROUP BY l.event_id")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    v = e.withColumn("latest", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return v.filter("event_type = 'purchase' AND latest IS NOT NULL").select("event_id", "latest")


@register("set_differences", "SELECT o_custkey AS k, 'both' AS side FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT c_custkey, 'no orders' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_differences(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer")
    both = o.intersect(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")).select(F.col("o_custkey").alias("k"), F.lit("both").alias("side"))
    return both.union(c.select("c_custkey").exceptAll(o.distinct()).select("c_custkey", F.lit("no orders")))
