"""Telemetry of generation runs: windows over each run's events in batch, keyed state in a stream.

After an event a run is in failure if the event is collapsed and raises no failure flag,
whatever came before, so in batch the state is a lag and onsets are where it begins. In
a stream, state per run is kept by applyInPandasWithState and the metrics so far are
emitted with each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FAILURE_FLAGS = frozenset(("tandem_repeat", "motif_spam", "geometry_fail", "collapsed"))
#: Fold confidence above which a finished sequence counts when no structural gate was run.
FALLBACK_CONFIDENCE = 70.0


@dataclass
class Metrics:
    """State of a run: sums of what has happened, and whether it is in failure."""

    steps: int = 0
    interventions: int = 0
    failures: int = 0
    detections: int = 0
    detection_steps: int = 0
    recoveries: int = 0
    recovery_steps: int = 0
    finished: int = 0
    viable: int = 0
    failing_since: int = -1
    constraints: str = ""
    graded: int = 0
    grades: float = 0.0

    def step(self, index: int, collapsed: bool, flags: list[str], constraints: str, gate: bool | None, confidence: float | None, repeat_ok: bool, geometry_ok: bool, grade: float | None = None) -> None:
        """One event. A flag raised in failure ends the failure, so such a failure never gives a recovery."""
        self.steps += 1
        new = bool(constraints) and constraints != self.constraints
        if new:
            self.constraints = constraints
        self.interventions += new or bool(flags)
        if collapsed and self.failing_since < 0:
            self.failing_since = index
            self.failures += 1
        elif not collapsed and self.failing_since >= 0:
            self.recoveries += 1
            self.recovery_steps += index - self.failing_since
            self.failing_since = -1
        if self.failing_since >= 0 and any(f in FAILURE_FLAGS for f in flags):
            self.detections += 1
            self.detection_steps += index - self.failing_since
            self.failing_since = -1
        if gate is not None:
            self.finished += 1
            self.viable += gate and repeat_ok
            if grade is not None:
                self.graded += 1
                self.grades += grade
        elif confidence is not None:
            self.finished += 1
            self.viable += confidence > FALLBACK_CONFIDENCE and repeat_ok and geometry_ok


_STATE = ", ".join(f"{f.name} { {'str': 'string', 'float': 'double'}.get(f.type, 'long')}" for f in fields(Metrics))
SCHEMA = "run string, steps long, interventions long, failures long, detections long, recoveries long, finished long, viable long, detection_latency double, recovery_time double, viable_rate double, graded long, mean_structural_score double"
EVENTS = "run string, step_index long, collapsed boolean, flags array<string>, constraints string, gate boolean, confidence double, repeat_ok boolean, geometry_ok boolean"
#: A gate's structural score may stand beside.
GRADED_EVENTS = EVENTS + ", grade double"


def _feed(metrics: Metrics, rows: pd.DataFrame) -> Metrics:
    for r in rows.sort_values("step_index").itertuples(index=False):
        gate = None if pd.isna(r.gate) else bool(r.gate)
        confidence = None if pd.isna(r.confidence) else float(r.confidence)
        metrics.step(int(r.step_index), bool(r.collapsed), [] if r.flags is None else list(r.flags), r.constraints or "", gate, confidence, bool(r.repeat_ok), bool(r.geometry_ok), None if pd.isna(getattr(r, "grade", None)) else float(r.grade))
    return metrics


def _report(run: str, m: Metrics) -> pd.DataFrame:
    row = {
        "run": run, "steps": m.steps, "interventions": m.interventions, "failures": m.failures, "detections": m.detections, "recoveries": m.recoveries, "finished": m.finished, "viable": m.viable,
        "detection_latency": m.detection_steps / m.detections if m.detections else None, "recovery_time": m.recovery_steps / m.recoveries if m.recoveries else None,
        "viable_rate": m.viable / m.finished if m.finished else 0.0, "graded": m.graded, "mean_structural_score": m.grades / m.graded if m.graded else None,
    }
    return pd.DataFrame([row])


def run_metrics(events: DataFrame) -> DataFrame:
    """Metrics of each run from all its events (columns as in EVENTS, or GRADED_EVENTS), ordered by step_index."""
    w = Window.partitionBy("run").orderBy("step_index")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = F.coalesce(F.exists("flags", lambda f: f.isin(sorted(FAILURE_FLAGS))), F.lit(False))
    bad = F.coalesce("collapsed", F.lit(False))
    e = events.withColumns({"bad": bad, "caught": bad & flagged, "words": F.nullif(F.coalesce("constraints", F.lit("")), F.lit("")), "score": F.col("grade") if "grade" in events.columns else F.lit(None).cast("double")})
    e = e.withColumns({"was": F.coalesce(F.lag(F.col("bad") & ~F.col("caught")).over(w), F.lit(False)), "said": F.last("words", ignorenulls=True).over(before)})
    e = e.withColumn("onset", F.when(F.col("bad") & ~F.col("was"), F.col("step_index")))
    e = e.withColumn("since", F.col("step_index") - F.last("onset", ignorenulls=True).over(upto))
    healed = ~F.col("bad") & F.col("was")
    ready, fit = F.col("gate").isNotNull(), F.coalesce("repeat_ok", F.lit(False))
    viable = F.when(ready, F.col("gate") & fit).when(F.col("confidence").isNotNull(), (F.col("confidence") > FALLBACK_CONFIDENCE) & fit & F.coalesce("geometry_ok", F.lit(False)))
    changed = F.col("words").isNotNull() & ~F.col("words").eqNullSafe(F.col("said"))
    return e.groupBy("run").agg(
        F.count("*").alias("steps"), F.count_if(changed | (F.coalesce(F.size("flags"), F.lit(0)) > 0)).alias("interventions"), F.count("onset").alias("failures"), F.count_if("caught").alias("detections"), F.count_if(healed).alias("recoveries"),
        F.count_if(ready | F.col("confidence").isNotNull()).alias("finished"), F.count_if(viable).alias("viable"),
        F.avg(F.when(F.col("caught"), F.col("since"))).alias("detection_latency"), F.avg(F.when(healed, F.col("since"))).alias("recovery_time"),
        F.coalesce(F.try_divide(F.count_if(viable), F.count(viable)), F.lit(0.0)).alias("viable_rate"), F.count(F.when(ready, F.col("score"))).alias("graded"), F.avg(F.when(ready, F.col("score"))).alias("mean_structural_score"),
    )


def stream_metrics(events: DataFrame) -> DataFrame:
    """The same, kept up as events arrive; each micro-batch emits the runs it touched. Steps of a run must not arrive out of order across batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        metrics = Metrics(*state.get) if state.exists else Metrics()
        rows = pd.concat(list(batches))
        _feed(metrics, rows)
        state.update(astuple(metrics))
        yield _report(key[0], metrics)

    return events.groupBy("run").applyInPandasWithState(update, SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)


#: Events whose time says when a step happened, so that late ones can be waited for.
TIMED_EVENTS = GRADED_EVENTS + ", ts timestamp"


#: Rows of a block of waiting steps.
HELD_ROWS = 1024
_WAITING = "first long, last long, steps binary"
_HELD = pa.schema([
    ("ms", pa.int64()), ("step_index", pa.int64()), ("collapsed", pa.bool_()), ("flags", pa.list_(pa.string())), ("constraints", pa.string()), ("gate", pa.bool_()), ("confidence", pa.float64()), ("repeat_ok", pa.bool_()), ("geometry_ok", pa.bool_()), ("grade", pa.float64()),
])


def _blocks(steps: pa.Table) -> list[tuple[int, int, bytes]]:
    """Steps, in order of their times, as blocks: first and last time, Arrow stream."""
    out = []
    for at in range(0, steps.num_rows, HELD_ROWS):
        part, sink = steps.slice(at, HELD_ROWS), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as stream:
            stream.write_table(part)
        out.append((part["ms"][0].as_py(), part["ms"][-1].as_py(), sink.getvalue().to_pybytes()))
    return out


class OrderedRun(StatefulProcessor):
    """Keeps a run's steps until the watermark has passed them, then feeds them in order.

    Steps wait in blocks in order of time, and a run has one timer, that of its earliest
    waiting step: the call it leads to feeds all that the watermark has passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.due = handle.getValueState("due", "ms long")
        self.metrics = handle.getValueState("metrics", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(ms=found["ts"].to_numpy("datetime64[ms]").astype("int64"))
        kept = pa.schema([f for f in _HELD if f.name in found.columns])
        blocks = _blocks(pa.Table.from_pandas(found, kept, preserve_index=False).replace_schema_metadata(None).sort_by("ms"))
        self.waiting.appendList(blocks)
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or blocks[0][0] < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self._wait_for(blocks[0][0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for first, last, steps in self.waiting.get():
            if first > upto:
                later.append((first, last, bytes(steps)))
                continue
            table = pa.ipc.open_stream(bytes(steps)).read_all()
            passed = table.num_rows if last <= upto else int(np.searchsorted(table["ms"].to_numpy(), upto, side="right"))
            ready.append(table.slice(0, passed))
            later += _blocks(table.slice(passed))
        if later:
            self.waiting.put(later)
            self._wait_for(min(first for first, _, _ in later))
        else:
            self.waiting.clear()
            self.due.clear()
        metrics = Metrics(*self.metrics.get()) if self.metrics.exists() else Metrics()
        _feed(metrics, pa.concat_tables(ready).to_pandas())
        self.metrics.update(astuple(metrics))
        return iter((_report(key[0], metrics),))

    def _wait_for(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


def ordered_metrics(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """stream_metrics for steps that arrive in any order across batches (columns as in TIMED_EVENTS).

    A step waits in its run's state until the watermark, `late` behind the newest event,
    has passed its time: no step before it can come then. Steps later than that are
    dropped, as everywhere in a stream. Needs the RocksDB state store.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy("run").transformWithStateInPandas(OrderedRun(), SCHEMA, "Update", "EventTime")


def matched_claims(intents: DataFrame, claims: DataFrame, key: list[str], intent_time: str, claim_time: str, within: str = "10 minutes", late: str = "10 minutes", unmatched: bool = False) -> DataFrame:
    """Claims joined with the intents of their key that they follow within a time; both sides as streams or tables. Other column names must differ.

    In a stream both sides carry a watermark, so state ends with the interval, and rows
    later than `late` are dropped (the query's progress counts them). With `unmatched`
    intents without a claim follow, with nulls, once none can come any more.
    """
    left, right = intents.withWatermark(intent_time, late), claims.withWatermark(claim_time, late)
    right = right.select(*(F.col(c).alias(f"claim_{c}") if c in key else F.col(c) for c in right.columns))
    rule = (F.col(claim_time) >= F.col(intent_time)) & (F.col(claim_time) <= F.col(intent_time) + F.expr(f"INTERVAL {within}"))
    for k in key:
        rule = rule & (F.col(k) == F.col(f"claim_{k}"))
    return left.join(right, rule, "left_outer" if unmatched else "inner").drop(*(f"claim_{k}" for k in key))


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum in tumbling or sliding windows, with a watermark (ignored in batch)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events with less than `gap` between them."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def claims_once(events: DataFrame, time: str, claim: list[str], late: str = "10 minutes") -> DataFrame:
    """Each claim once: within the watermark in a stream, over all rows in batch."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(claim)
    return events.groupBy(*claim).agg(F.min(time).alias(time))


def fresh(events: DataFrame, time: str, now, oldest: str = "10 minutes", ahead: str = "2 minutes") -> DataFrame:
    """Rows no older than `oldest` and no further ahead than `ahead` of a time."""
    at = F.lit(now).cast("timestamp")
    return events.filter((F.col(time) >= at - F.expr(f"INTERVAL {oldest}")) & (F.col(time) <= at + F.expr(f"INTERVAL {ahead}")))
