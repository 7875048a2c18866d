"""The state of ordered runs, against a plain fold, with a handle that keeps states and timers in lists."""

import random
from types import SimpleNamespace

import pandas as pd
from corvane.streaming import telemetry


class Held:
    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows if self.rows is not None else []

    def update(self, row):
        self.rows = row

    put = update

    def appendList(self, rows):
        self.rows = [*(self.rows or []), *rows]

    def clear(self):
        self.rows = None


def test_a_run_has_one_timer_and_feeds_in_order(monkeypatch):
    monkeypatch.setattr(telemetry, "HELD_ROWS", 16, raising=False)
    timers, registered = set(), []
    handle = SimpleNamespace(getListState=lambda *_: Held(), getValueState=lambda *_: Held(), registerTimer=lambda ms: (timers.add(ms), registered.append(ms)), deleteTimer=timers.discard)
    run = telemetry.OrderedRun()
    run.init(handle)
    rnd = random.Random(4)
    steps = [(k, rnd.random() < 0.4, rnd.choice([[], ["collapsed"], None]), rnd.choice(["", "c1", "c2"]), rnd.choice([None, True, False]), rnd.choice([None, 60.0, 90.0]), rnd.random() < 0.5, rnd.random() < 0.5, rnd.choice([None, 0.5])) for k in range(900)]
    names = ["step_index", "collapsed", "flags", "constraints", "gate", "confidence", "repeat_ok", "geometry_ok", "grade"]
    frame = lambda part: pd.DataFrame(part, columns=names)
    order = sorted(range(900), key=lambda k: k + rnd.random() * 100)
    last = None
    for batch in range(9):
        part = frame([steps[k] for k in order[batch * 100 : batch * 100 + 100]])
        part = part.assign(run="r", ts=pd.to_datetime(part["step_index"] * 1000, unit="ms"))
        assert list(run.handleInputRows(("r",), iter([part[:50], part[50:]]), None)) == []
        upto = (batch * 100 - 1) * 1000 if batch < 8 else 10**9  # steps come at most 100 places late
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda upto=upto: upto)
        for ms in sorted(t for t in timers if t <= upto):
            timers.discard(ms)
            for out in run.handleExpiredTimer(("r",), clock, None):
                last = out
                assert out["steps"][0] == min(900, max(0, upto // 1000 + 1))
    want = telemetry._report("r", telemetry._feed(telemetry.Metrics(), frame(steps)))
    pd.testing.assert_frame_equal(last, want)
    assert not timers and len(registered) <= 2 * 9
