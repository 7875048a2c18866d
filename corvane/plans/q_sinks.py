"""Queries that write and read back: committed sinks, batches by length, structures from tables."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import batching
from corvane.operators.structure import triads
from corvane.sources import committed, records, structures

from .catalog import register
from .views import table


def _failing_once(df):
    """df, whose first task fails on its first attempt after its first rows went on."""

    def rows(batches):
        context = TaskContext.get()
        lost = context.partitionId() == 0 and context.attemptNumber() == 0
        for batch in batches:
            yield batch
            if lost:
                raise RuntimeError("a task lost on purpose")

    return df.mapInArrow(rows, df.schema)


@register("committed_documents", "SELECT o_orderkey, o_orderstatus, o_totalprice, 1::BIGINT AS copies FROM orders")
def committed_documents(spark, sf_dir):
    """Orders as JSON documents. The first write loses a task half-way; it is repeated, and once more after it is committed. Each row counts its copies."""
    path = records.scratch_path(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    try:
        committed.write_committed(_failing_once(o), path, "orders")
    except PySparkException:  # where the session allows a task one attempt only, the whole write is withdrawn
        if committed.read_committed(spark, path, "o_orderkey long").count():
            raise
    committed.write_committed(o, path, "orders")
    committed.write_committed(o, path, "orders")
    back = committed.read_committed(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")
    return back.groupBy("o_orderkey", "o_orderstatus", "o_totalprice").agg(F.count("*").alias("copies"))


@register("committed_stream", "SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def committed_stream(spark, sf_dir):
    """Lines committed in four writes, read as a stream of commits into a second committed sink, and summed from there."""
    path, copy, place = (records.scratch_path(spark) for _ in range(3))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    schema = "l_orderkey long, l_linenumber int, l_extendedprice double"
    for part in range(4):
        committed.write_committed(li.filter(F.col("l_linenumber") % 4 == part), path, f"part-{part}")
        # each run of the stream goes on behind the commits that the run before it has read
        committed.write_stream_committed(committed.stream_committed(spark, path, schema), copy, "copy", place).trigger(availableNow=True).start().awaitTermination()
    back = committed.read_committed(spark, copy, schema)
    return back.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


# the greedy pass, a row at a time
_BATCHES = """
    WITH RECURSIVE d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS length, row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, md5(doc_id::VARCHAR), doc_id) AS i FROM documents),
    g AS (SELECT i, doc_id, length, 0::BIGINT AS batch, 0::BIGINT AS slot, length AS longest, greatest(length - 2, 1) AS cost FROM d WHERE i = 1
      UNION ALL SELECT i, doc_id, length, CASE WHEN fits THEN batch ELSE batch + 1 END, CASE WHEN fits THEN slot + 1 ELSE 0 END, CASE WHEN fits THEN longest ELSE length END, CASE WHEN fits THEN cost + more ELSE more END
      FROM (SELECT d.i, d.doc_id, d.length, g.batch, g.slot, g.longest, g.cost, greatest(d.length - 2, 1) AS more, g.slot + 1 < 16 AND g.longest - d.length <= 32 AND g.cost + greatest(d.length - 2, 1) <= 4096 AS fits FROM g JOIN d ON d.i = g.i + 1))"""


@register("length_batches", f"{_BATCHES} SELECT doc_id, length, batch, slot FROM g")
def length_batches(spark, sf_dir):
    return batching.length_batches(table(spark, sf_dir, "documents"), "doc_id", "text", 16, 32, 4096)


@register("length_batch_report", f"""{_BATCHES}
    SELECT batch, count(*) AS n, min(length) AS shortest, max(length) AS longest, sum(cost)::BIGINT AS cost, round(1 - sum(length) / (max(length) * count(*)), 6) AS padding
    FROM (SELECT batch, length, greatest(length - 2, 1) AS cost FROM g) GROUP BY batch""")
def length_batch_report(spark, sf_dir):
    b = batching.batch_report(batching.length_batches(table(spark, sf_dir, "documents"), "doc_id", "text", 16, 32, 4096))
    return b.withColumn("padding", F.round("padding", 6))


def _structures(spark, sf_dir):
    """Lines of a structure for each turn of a conversation: the letters of its text that are residues, with coordinates and confidences from its key and their places.

    Some have a gap in their numbers, some a second chain, some an unknown residue.
    """
    three = F.create_map(*(F.lit(x) for pair in records.THREE_LETTERS.items() for x in reversed(pair)))
    k, i = F.col("spoken"), F.col("i")
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 8 + F.col("turn")).alias("spoken"), F.regexp_replace(tx.letters("text"), "[BJOUXZ]", "").alias("letters"))
    # what stands beside a generator is computed for each of its rows: the letters and their number come before it
    said = said.filter("letters <> ''").select("spoken", F.length("letters").alias("n"), F.split("letters", "").alias("letters"))
    r = said.select("spoken", "n", F.posexplode("letters").alias("i", "letter")).filter("letter <> ''")
    r = r.select(
        "spoken", "letter", (i + 1).alias("i"),
        F.when((k % 7 == 0) & (i + 1 == F.col("n")), i + 2).otherwise(i + 1).alias("number"),
        F.when((k % 11 == 0) & (i * 2 >= F.col("n")), "B").otherwise("A").alias("chain"),
        F.when((k % 13 == 0) & (i == 0), "UNK").otherwise(three[F.col("letter")]).alias("residue"),
        ((i * 37 + k * 11) % 100 / 10.0).alias("x"), ((i * 53 + k * 7) % 100 / 10.0).alias("y"), ((i * 71 + k) % 100 / 10.0).alias("z"),
        F.when(k % 2 == 0, (k + i) % 100 / 100.0).otherwise((k + i * 3) % 100 * 1.0).alias("confidence"),
    )
    # side-chain atoms stand beside the CA of their residue
    beside = F.when(F.col("letter") == "S", F.array(F.lit("OG"))).when(F.col("letter") == "H", F.array(F.lit("ND1"), F.lit("NE2"))).when(F.col("letter") == "D", F.array(F.lit("OD1"), F.lit("OD2"))).otherwise(F.array().cast("array<string>"))
    a = r.select("*", F.posexplode(F.concat(F.array(F.lit("CA")), beside)).alias("j", "atom"))
    line = structures.atom_line(i, F.col("atom"), F.col("residue"), F.col("chain"), F.col("number"), F.col("x") + F.col("j"), F.col("y"), F.col("z"), F.col("confidence"))
    return a.select("spoken", (i * 4 + F.col("j")).alias("place"), line.alias("line"))


_RESIDUES = """
    WITH p AS (SELECT conv_id * 8 + turn AS k, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') AS s FROM conversations),
    r AS (SELECT k, length(s) AS n, i, s[i + 1] AS letter, (i * 37 + k * 11) % 100 / 10.0::DOUBLE AS x, (i * 53 + k * 7) % 100 / 10.0::DOUBLE AS y, (i * 71 + k) % 100 / 10.0::DOUBLE AS z,
                 CASE WHEN k % 2 = 0 THEN (k + i) % 100 / 100.0::DOUBLE ELSE ((k + i * 3) % 100)::DOUBLE END AS c FROM p, unnest(range(0, length(s))) u(i))"""


@register("structure_sequences", f"""{_RESIDUES},
    t AS (SELECT k, string_agg(letter, '' ORDER BY i) AS s, count(*) AS n, avg(c) AS m, CASE WHEN k % 11 = 0 AND count(*) > 1 THEN 'chains' WHEN k % 7 = 0 THEN 'numbering' WHEN k % 13 = 0 THEN 'residue' END AS problem FROM r GROUP BY k)
    SELECT k AS spoken, CASE WHEN problem IS NULL THEN s END AS sequence, n::INTEGER AS residues, round(CASE WHEN m > 0 AND m <= 1 THEN m * 100 ELSE m END, 6) AS confidence, problem FROM t""")
def structure_sequences(spark, sf_dir):
    s = structures.structure_sequences(_structures(spark, sf_dir), "spoken", "place", "line")
    return s.withColumn("confidence", F.round("confidence", 6))


@register("structure_triads", f"""{_RESIDUES},
    a AS (SELECT k, CASE WHEN k % 7 = 0 AND i + 1 = n THEN i + 2 ELSE i + 1 END AS number, letter, x + j AS x, y, z FROM r, unnest(CASE letter WHEN 'S' THEN [1] ELSE [1, 2] END) u(j) WHERE letter IN ('S', 'H', 'D') AND NOT (k % 13 = 0 AND i = 0)),
    d AS (SELECT a.k, a.number AS f, a.letter AS x, b.number AS g, b.letter AS y, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d FROM a JOIN a b ON a.k = b.k GROUP BY ALL),
    t AS (SELECT s.k, s.f AS ser, s.g AS his, c.g AS asp, s.d AS ser_his, c.d AS his_asp, row_number() OVER (PARTITION BY s.k ORDER BY s.d + c.d, s.f, s.g, c.g) AS o FROM d s JOIN d c ON s.k = c.k AND s.g = c.f WHERE s.x = 'S' AND s.y = 'H' AND c.x = 'H' AND c.y = 'D')
    SELECT k AS spoken, ser::INTEGER AS ser, his::INTEGER AS his, asp::INTEGER AS asp, round(ser_his, 6) AS ser_his, round(his_asp, 6) AS his_asp, ser_his <= 3.5 AND his_asp <= 3.5 AS passes FROM t WHERE o = 1""")
def structure_triads(spark, sf_dir):
    t = triads(structures.structure_atoms(_structures(spark, sf_dir), "spoken", "place", "line"), "spoken", 3.5)
    return t.select("spoken", "ser", "his", "asp", F.round("ser_his", 6).alias("ser_his"), F.round("his_asp", 6).alias("his_asp"), "passes")
