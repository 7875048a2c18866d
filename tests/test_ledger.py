"""Hash-chain ledgers against a plain fold, and every kind of tampering."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import ledger

SCHEMA = "run string, i long, what string, amount double"


def digest(row):
    return hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def plain(rows):
    last, out = {}, []
    for run, i, what, amount in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        row = {"run": run, "i": i, "what": what, "amount": amount, "previous_event_sha256": last.get(run, "ROOT")}
        last[run] = digest(row)
        out.append((run, i, row["previous_event_sha256"], last[run]))
    return sorted(out, key=repr)


def rows_of(seed, n=200):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", "c", None]), i, rnd.choice(["x", None, 'q"uo\\te', "é\n"]), rnd.choice([None, 1.5, -2.25])) for i in range(n)]


def hashes(df):
    return sorted(((r["run"], r["i"], r["previous_event_sha256"], r["event_sha256"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def chain(spark):
    return ledger.opened(spark.createDataFrame(rows_of(1), SCHEMA), ["i"], ["run"]).cache()


def test_chain_is_the_plain_fold(chain):
    assert hashes(chain) == plain(rows_of(1))
    assert ledger.problems(chain, ["i"], ["run"]).count() == 0
    assert ledger.verified(chain, ["i"], ["run"]).count() == 200


def test_one_ledger_and_no_rows(spark):
    df = spark.createDataFrame(rows_of(2), SCHEMA)
    whole = ledger.opened(df, ["i"], [])
    assert whole.filter("previous_event_sha256 = 'ROOT'").count() == 1 and ledger.problems(whole, ["i"], []).count() == 0
    assert ledger.opened(df.limit(0), ["i"], ["run"]).count() == 0


def test_batches_carry_the_hash_along(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert hashes(ledger.opened(spark.createDataFrame(rows_of(3), SCHEMA), ["i"], ["run"])) == plain(rows_of(3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_appending(spark):
    rows = rows_of(4)
    first = ledger.opened(spark.createDataFrame(rows[:120], SCHEMA), ["i"], ["run"])
    news = spark.createDataFrame([*rows[120:], ("new", 900, "z", 0.5)], SCHEMA).withColumn("event_sha256", F.lit("forged"))
    both = first.unionByName(ledger.appended(first, news, ["i"], ["run"]))
    assert hashes(both) == plain([*rows, ("new", 900, "z", 0.5)])
    broken = first.withColumn("what", F.when(F.col("i") == 40, "changed").otherwise(F.col("what")))
    with pytest.raises(Exception, match="ledger is broken"):
        ledger.appended(broken, news, ["i"], ["run"]).collect()


def found(df):
    return {(r["i"], r["problem"]) for r in ledger.problems(df, ["i"], ["run"]).collect()}


def test_every_tampering_shows(spark):
    chain = ledger.opened(spark.createDataFrame([("a", i, f"e{i}", 1.0) for i in range(10)], SCHEMA), ["i"], ["run"])
    put = lambda column, i, value: chain.withColumn(column, F.when(F.col("i") == i, F.lit(value)).otherwise(F.col(column)))
    assert found(put("what", 4, "changed")) == {(4, "event_hash")}  # a payload changed under its hash
    assert found(put("previous_event_sha256", 4, "x")) == {(4, "both")}  # a forged link, of which the hash was over the true one
    assert found(put("event_sha256", 4, "x")) == {(4, "event_hash"), (5, "broken_link")}
    assert found(put("event_sha256", 9, "x")) == {(9, "event_hash")}  # a rewritten last event
    assert found(chain.filter("i <> 4")) == {(5, "broken_link")}  # an event taken out
    assert found(chain.filter("i > 0")) == {(1, "broken_link")}  # the start cut off
    assert found(put("event_sha256", 9, None)) == {(9, "event_hash")}
    # a payload rewritten with its hash breaks the link behind it
    again = put("what", 4, "changed")
    again = again.withColumn("event_sha256", F.when(F.col("i") == 4, ledger.event_hash(chain.columns)).otherwise(F.col("event_sha256")))
    assert found(again) == {(5, "broken_link")}


def test_a_ledger_cut_short_lacks_its_head(spark):
    chain = ledger.opened(spark.createDataFrame([(r, i, "e", 1.0) for r in "ab" for i in range(5)], SCHEMA), ["i"], ["run"])
    kept = ledger.heads(chain, ["i"], ["run"])
    assert ledger.shortened(chain, kept, ["i"], ["run"]).count() == 0
    cut = chain.filter("run = 'a' OR i < 4")
    assert found(cut) == set() and [r["run"] for r in ledger.shortened(cut, kept, ["i"], ["run"]).collect()] == ["b"]
