"""Append-only ledgers: rows that carry the hash of the row before them and of themselves.

A row's event hash is the SHA-256 of its canonical JSON: all columns but that hash, by
name, nulls written out, the previous hash among them. So a changed payload, a forged
link, a row taken out or put in, and a rewritten hash all show.

Building a chain is sequential within a ledger, as each hash needs the one before it:
rows are dealt by ledger, sorted, and folded batch by batch with one hash carried along,
so a ledger of any length holds one batch. Checking it is not: a row's own hash depends on
that row alone and its link on one lag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

PREVIOUS, EVENT = "previous_event_sha256", "event_sha256"
ROOT = "ROOT"


def _halves(columns: Sequence[str]) -> tuple[Column, Column]:
    """The canonical JSON of a row before and behind its previous hash."""
    options = {"ignoreNullFields": "false"}
    rest = sorted(c for c in columns if c not in (PREVIOUS, EVENT))
    before, behind = [c for c in rest if c < PREVIOUS], [c for c in rest if c > PREVIOUS]
    head, tail = F.lit(f'{{"{PREVIOUS}":"'), F.lit('"}')
    if before:
        text = F.to_json(F.struct(*before), options)
        head = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(f',"{PREVIOUS}":"'))
    if behind:
        text = F.to_json(F.struct(*behind), options)
        tail = F.concat(F.lit('",'), F.substring(text, F.lit(2), F.length(text)))
    return head, tail


def event_hash(columns: Sequence[str]) -> Column:
    """What the event hash of a row must be, from its columns and its previous hash."""
    head, tail = _halves(columns)
    return F.sha2(F.concat(head, F.coalesce(F.col(PREVIOUS), F.lit("")), tail), 256)


def _fold(keys: Sequence[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, last = None, ROOT
        for batch in batches:
            previous, own = [], []
            owners = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else ((),) * batch.num_rows
            for key, head, tail, start in zip(owners, *(batch.column(c).to_pylist() for c in ("_head", "_tail", "_start")), strict=True):
                if key != ledger:
                    ledger, last = key, start or ROOT
                previous.append(last)
                last = hashlib.sha256((head + last + tail).encode()).hexdigest()
                own.append(last)
            names = [c for c in batch.schema.names if c not in ("_head", "_tail", "_start")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(previous, pa.string()), pa.array(own, pa.string())], names=[*names, PREVIOUS, EVENT])

    return fold


def _chain(events: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """events (with _start: the hash to go on from) as rows of their ledgers."""
    head, tail = _halves([c for c in events.columns if c != "_start"])
    rows = events.withColumns({"_head": head, "_tail": tail})
    rows = (rows.repartition(*within) if within else rows.repartition(1)).sortWithinPartitions(*within, *order)
    schema = StructType([f for f in events.schema if f.name != "_start"]).add(PREVIOUS, StringType()).add(EVENT, StringType())
    return rows.mapInArrow(_fold(within), schema)


def opened(events: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """New ledgers, one for each value of `within`, of events in order: their columns and the two hashes.

    A null in `within` is a ledger of its own. Events of equal order must be told apart
    by the caller; the order given must be total within a ledger.
    """
    return _chain(events.drop(PREVIOUS, EVENT).withColumn("_start", F.lit(None).cast("string")), order, within)


def appended(ledger: DataFrame, events: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """The rows to append to verified ledgers: events chained on to each ledger's last row. Hashes that events bring along are dropped.

    Reading the result fails where the ledger so far is broken.
    """
    last = verified(ledger, order, within).groupBy(*within).agg(F.max_by(EVENT, F.struct(*order)).alias("_start"))
    fresh = events.drop(PREVIOUS, EVENT).select(*(c for c in ledger.columns if c not in (PREVIOUS, EVENT)))
    same = F.lit(True)
    for k in within:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = fresh.join(last.select(*(F.col(k).alias(f"_{k}") for k in within), "_start"), same, "left") if within else fresh.join(last)
    return _chain(joined.select(*fresh.columns, "_start"), order, within)


def audited(ledger: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """ledger with `link_ok` (the previous hash is the event hash of the row before, ROOT at the start) and `hash_ok` (the row hashes to its own). A missing hash is never ok."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = F.when(F.row_number().over(w) == 1, F.lit(ROOT)).otherwise(F.lag(EVENT).over(w))
    return ledger.withColumns({"link_ok": F.coalesce(F.col(PREVIOUS) == before, F.lit(False)), "hash_ok": F.coalesce(F.col(EVENT) == event_hash(ledger.columns), F.lit(False))})


def problems(ledger: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows that break the chain, with `problem`: broken_link, event_hash or both."""
    found = audited(ledger, order, within).filter("NOT (link_ok AND hash_ok)")
    kind = F.when(~F.col("link_ok") & ~F.col("hash_ok"), "both").when(~F.col("link_ok"), "broken_link").otherwise("event_hash")
    return found.withColumn("problem", kind).drop("link_ok", "hash_ok")


def verified(ledger: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """ledger, failing when it is read at a row that breaks a chain."""
    said = F.concat(F.lit("ledger is broken at "), F.to_json(F.struct(*within, *order)))
    bad = ~F.col("link_ok") | ~F.col("hash_ok")
    return audited(ledger, order, within).withColumn(EVENT, F.when(bad, F.raise_error(said)).otherwise(F.col(EVENT))).drop("link_ok", "hash_ok")


def heads(ledger: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows and last event hash of each ledger: what to keep elsewhere, so that rows cut off the end show."""
    return ledger.groupBy(*within).agg(F.count("*").alias("n_events"), F.max_by(EVENT, F.struct(*order)).alias("head_sha256"))


def shortened(ledger: DataFrame, kept: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Ledgers whose kept head (columns of `heads`) is no row of theirs: events were cut off the end or rewritten."""
    own = ledger.select(*within, F.col(EVENT).alias("head_sha256"))
    return kept.join(own, [*within, "head_sha256"], "left_anti")
