"""Stream state against plain programs: any order of arrival gives the same rows."""

import random

import numpy as np
import pandas as pd
import pytest

from kerbline.streaming import preference as P
from kerbline.streaming import trips as T


class State:
    """What a group's state offers to an update, with a watermark moved by the test."""

    def __init__(self):
        self.value, self.now, self.timer, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timer = None

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, ms):
        assert ms > self.now
        self.timer = ms

    def setTimeoutDuration(self, ms):
        assert ms > 0
        self.timer = ms


def plain_trip(way, fixes):
    at, arrived, rows = 0, False, []
    for us, seq, x, y in sorted(fixes):
        gaps = [((x - a) ** 2 + (y - b) ** 2) ** 0.5 for a, b in way]
        near = min(range(at, len(way)), key=lambda i: gaps[i])
        off = gaps[near] > T.OFF_ROUTE_M
        at = at if off else near
        left = gaps[at] + sum(((way[i][0] - way[i + 1][0]) ** 2 + (way[i][1] - way[i + 1][1]) ** 2) ** 0.5 for i in range(at, len(way) - 1))
        arrived = arrived or gaps[-1] < T.ARRIVED_M
        rows.append((seq, at, off, left, max(1.0, np.floor(left / T.SPEED + 0.5)), arrived))
    return rows


def random_trip(rnd, n):
    way = [(40.0 * i + rnd.randint(0, 30), 25.0 * rnd.randint(0, 6)) for i in range(rnd.choice([1, 2, 9]))]
    # Equal times, equal places and detours off the route.
    fixes = [(rnd.randint(0, 50) * 1_000_000, k, way[min(k * len(way) // n, len(way) - 1)][0] + rnd.choice([0, 15, 200]), 30.0 * rnd.randint(0, 5)) for k in range(n)]
    return way, fixes


def chunk(fixes, way=None):
    return pd.DataFrame({
        "us": [f[0] for f in fixes], "seq": [f[1] for f in fixes], "x": [f[2] for f in fixes], "y": [f[3] for f in fixes],
        "way": pd.Series([[{"x": a, "y": b} for a, b in way] if way is not None and i == 0 else None for i in range(len(fixes))], dtype=object)})


def drain(parts):
    out = [tuple(r)[1:] for df in parts for r in df.itertuples(index=False)]
    return out


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_fixes_followed_at_once_equal_one_by_one(monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rnd = random.Random(5)
    for _ in range(40):
        way, fixes = random_trip(rnd, rnd.randint(1, 60))
        fixes.sort()
        got = T.follow(np.array(way, float), 0, False, np.array([f[2] for f in fixes]), np.array([f[3] for f in fixes]))
        rows = list(zip([f[1] for f in fixes], got["waypoint"], got["off_route"], got["remaining_m"], got["minutes"], got["arrived"], strict=True))
        want = plain_trip(way, fixes)
        assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows] == [(w[0], w[1], w[2], w[4], w[5]) for w in want]
        assert np.allclose([r[3] for r in rows], [w[3] for w in want])


def test_trip_rows_do_not_depend_on_arrival():
    rnd = random.Random(6)
    for _ in range(30):
        way, fixes = random_trip(rnd, 40)
        want = plain_trip(way, fixes)
        rnd.shuffle(fixes)
        state, got = State(), []
        cut = rnd.randint(1, 39)
        for part in (fixes[:cut], fixes[cut:]):  # two batches of several chunks; the watermark has not moved
            got += drain(T.monitor_trip((1,), iter([chunk(part[i:i + 7], way if part is not fixes[:cut] and i == 0 else None) for i in range(0, len(part), 7)]), state, 10_000))
        assert not got
        for now in (20_000, 50_001):
            state.now, state.hasTimedOut = now, True
            got += drain(T.monitor_trip((1,), iter([]), state, 10_000))
        assert [(r[0], r[1], r[2], r[4], r[5]) for r in got] == [(w[0], w[1], w[2], w[4], w[5]) for w in want]
        state.now = 70_000
        assert not drain(T.monitor_trip((1,), iter([]), state, 10_000)) and not state.exists


def test_trip_without_route_gives_no_rows_and_ends():
    state = State()
    assert not drain(T.monitor_trip((1,), iter([chunk([(1_000_000, 1, 0.0, 0.0), (2_000_000, None, 1.0, 1.0)])]), state, 10_000))
    state.now, state.hasTimedOut = 5_000, True
    assert not drain(T.monitor_trip((1,), iter([]), state, 10_000)) and state.exists
    state.now = 13_000
    assert not drain(T.monitor_trip((1,), iter([]), state, 10_000)) and not state.exists


def plain_latch(codes, begin):
    at = base = begin
    out = []
    for turn, code in enumerate(codes):
        if code >= P.BASELINE:
            at = base = code - P.BASELINE
        elif code == P.RESET:
            at = base
        elif code != P.PASS:
            at = P.TRANSITIONS[code][at]
        if code != P.PASS:
            out.append((turn, at))
    return out


def rows_of(parts):
    index = {(a, c, o): i for i, (a, c, o) in enumerate(P.STATES)}
    return [(t, index[(a, c, None if np.isnan(o) else o)]) for _, t, a, c, o in [r for df in parts for r in df.itertuples(index=False)]]


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_preferences_do_not_depend_on_arrival(monkeypatch, size):
    monkeypatch.setattr(P, "SLICE", size)
    rnd = random.Random(7)
    begin = P.STATES.index(("max", 0.5, None))
    for _ in range(40):
        codes = [rnd.choice([*range(16), P.RESET, P.PASS, P.BASELINE + rnd.randrange(24)]) for _ in range(rnd.randint(1, 30))]
        events = list(enumerate(codes)) + [(0, codes[0])]  # one comes twice
        rnd.shuffle(events)
        state, got = State(), []
        for lo in range(0, len(events), 4):
            got += rows_of(P.latch((1,), iter([pd.DataFrame(events[lo + i:lo + min(i + 2, 4)], columns=["turn", "code"]) for i in (0, 2)]), state, begin, 1000, 5000))
        assert got == plain_latch(codes, begin)
        assert state.timer == 5000
        state.hasTimedOut = True
        assert not rows_of(P.latch((1,), iter([]), state, begin, 1000, 5000)) and not state.exists


def test_gap_ends_with_patience():
    state, begin = State(), P.STATES.index(("max", 0.5, None))
    turn = lambda *ts: iter([pd.DataFrame({"turn": list(ts), "code": [4] * len(ts)})])
    assert [t for t, _ in rows_of(P.latch((1,), turn(0, 2, 3), state, begin, 1000, 5000))] == [0]
    assert state.timer == 1000
    state.hasTimedOut = True
    assert [t for t, _ in rows_of(P.latch((1,), iter([]), state, begin, 1000, 5000))] == [2, 3]
    state.hasTimedOut = False
    assert [t for t, _ in rows_of(P.latch((1,), turn(1, 4), state, begin, 1000, 5000))] == [4]  # turn 1 is too late


def test_tables_in_several_files_are_streamed_whole(spark, tables, tmp_path):
    from kerbline.catalog import streams_q as Q
    from kerbline.sources.tables import Tables

    tables("conversations").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.stream_preference_state(Tables(spark, str(tmp_path)))
    want = Q.stream_preference_state(tables)
    assert want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
