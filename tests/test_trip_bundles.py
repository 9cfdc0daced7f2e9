"""Trips that share a group's state are followed as if each were alone."""

import random

import pandas as pd
import pytest
from test_streams import State, plain_trip, random_trip

from kerbline.streaming import trips as T


def chunk(rows):
    """Rows (trip, us, seq, x, y, way)."""
    side = lambda c: pd.Series([None if r[5] is None else [p[c] for p in r[5]] for r in rows], dtype=object)
    return pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(["trip", "us", "seq", "x", "y"])} | {"wx": side(0), "wy": side(1)})


def answers(parts):
    return [tuple(r) for df in parts for r in df.itertuples(index=False)]


@pytest.mark.parametrize("rows", [1, 1 << 16])
def test_trips_of_a_bundle_equal_trips_alone(monkeypatch, rows):
    monkeypatch.setattr(T, "ROWS", rows)
    rnd = random.Random(9)
    trips = {t: random_trip(rnd, 25) for t in (3, 8, 2**60 + 1, -4)}
    events = [(t, us, k, x, y, None) for t, (_, fixes) in trips.items() for us, k, x, y in fixes] + [(t, 0, None, None, None, way) for t, (way, _) in trips.items()]
    events += [(8, 0, 7, None, 1.0, None), (77, 5_000_000, 1, 0.0, 0.0, None), (78, 5_000_000, 1, 0.0, 0.0, [])]  # no place, no route, an empty one
    rnd.shuffle(events)
    events = [*events, (8, 1, None, None, None, [(9.0, 9.0)])]  # a route stated later
    state, got = State(), []
    for lo in range(0, len(events), 40):  # batches of several chunks; the watermark has not moved
        got += answers(T.monitor_bundle((0,), iter([chunk(events[lo + i : lo + min(i + 15, 40)]) for i in (0, 15, 30)]), state, 10_000))
    assert not got and state.timer <= min(f[1] for f in events if f[2] is not None) // 1000 + 1
    for now in (16_000, 50_001):
        state.now, state.hasTimedOut = now, True
        got += answers(T.monitor_bundle((0,), iter([]), state, 10_000))
    for t, (way, fixes) in trips.items():
        own = [r[1:] for r in got if r[0] == t]
        want = plain_trip(way, fixes)
        assert [(r[0], r[1], r[2], r[4], r[5]) for r in own] == [(w[0], w[1], w[2], w[4], w[5]) for w in want]
        assert [r[3] for r in own] == pytest.approx([w[3] for w in want])
    assert {r[0] for r in got} == trips.keys() and state.exists


def test_silent_trips_of_a_bundle_are_forgotten_one_by_one():
    state = State()
    way = [(0.0, 0.0), (50.0, 0.0)]
    batch = chunk([(1, 0, None, None, None, way), (2, 9_000_000, None, None, None, way), (3, 1_000_000, 5, 0.0, 0.0, None)])
    assert not answers(T.monitor_bundle((0,), iter([batch]), state, 10_000)) and state.timer == 10_000
    state.now = 12_000
    late = chunk([(1, 15_000_000, 1, 50.0, 0.0, None), (2, 15_000_000, 1, 50.0, 0.0, None)])
    assert not answers(T.monitor_bundle((0,), iter([late]), state, 10_000))  # trip 1 has a new fix in time, trip 3 goes with its fix
    state.now, state.hasTimedOut = 20_000, True
    assert [r[:3] for r in answers(T.monitor_bundle((0,), iter([]), state, 10_000))] == [(1, 1, 1), (2, 1, 1)]
    state.now = 25_001
    assert not answers(T.monitor_bundle((0,), iter([]), state, 10_000)) and not state.exists


def test_groups_are_bundles_and_not_trips(spark, tmp_path):
    """Every trip was a group of its own, with calls and a state entry for each: 24 s for the 15,000 trips of sf0.1."""
    rows = spark.range(300).selectExpr("id as trip", "cast(null as bigint) as seq", "timestamp'2024-01-01' as ts", "0d as x", "0d as y", "array(named_struct('x', 0d, 'y', 0d)) as way")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = T.monitor(stream, bundles=5).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) == 5
