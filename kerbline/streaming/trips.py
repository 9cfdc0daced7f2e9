"""Following walks along their planned waypoints, in the order in which the fixes were taken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Limits in metres, walking speed in metres per minute.
OFF_ROUTE_M, ARRIVED_M, SPEED = 80.0, 20.0, 67.0
BLOCK = 1 << 20  # distances between fixes and waypoints held at once

BUNDLES = 1024  # groups that trips are dealt to; a group's state is read and written as a whole
ROWS = 1 << 16  # answers handed on at once, about

OUT = "trip bigint, seq bigint, waypoint bigint, off_route boolean, remaining_m double, minutes double, arrived boolean"
STATE = "trips binary, xs binary, ys binary, waiting binary"
NAMES = ["trip", "seq", "waypoint", "off_route", "remaining_m", "minutes", "arrived"]
TRIP = np.dtype([("trip", "<i8"), ("last", "<i8"), ("waypoint", "<i8"), ("arrived", "?"), ("points", "<i8")])  # points: of its route, none if unknown
FIX = np.dtype([("trip", "<i8"), ("us", "<i8"), ("seq", "<i8"), ("x", "<f8"), ("y", "<f8")])


def follow(way: np.ndarray, at: int, arrived: bool, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Fixes in order of time: the nearest waypoint not yet passed; a fix off the route does not advance.

    Loops over the advances of a trip, never over its fixes.
    """
    w = np.arange(len(way))
    legs = np.sqrt((np.diff(way, axis=0) ** 2).sum(axis=1))
    ahead = np.r_[np.cumsum(legs[::-1])[::-1], 0.0]
    place, off, left = np.empty(len(x), np.int64), np.empty(len(x), bool), np.empty(len(x))
    step = max(1, BLOCK // len(way))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        gap = np.sqrt((x[part, None] - way[:, 0]) ** 2 + (y[part, None] - way[:, 1]) ** 2)
        least = np.minimum.accumulate(gap[:, ::-1], axis=1)[:, ::-1]  # over this waypoint and those after it
        nearest = np.minimum.accumulate(np.where(gap == least, w, len(way))[:, ::-1], axis=1)[:, ::-1]
        goes = np.where(least > OFF_ROUTE_M, w, nearest)
        here, before, i = np.empty(len(gap), np.int64), np.empty(len(gap), np.int64), 0
        while i < len(gap):
            moves = goes[i:, at] != at
            k = i + int(moves.argmax()) if moves.any() else len(gap)
            here[i:k] = before[i:k + 1] = at
            if k < len(gap):
                here[k] = at = int(goes[k, at])
            i = k + 1
        rows = np.arange(len(gap))
        place[part], off[part], left[part] = here, least[rows, before] > OFF_ROUTE_M, gap[rows, here] + ahead[here]
    ends = np.sqrt((x - way[-1, 0]) ** 2 + (y - way[-1, 1]) ** 2) < ARRIVED_M
    return {
        "waypoint": place, "off_route": off, "remaining_m": left, "minutes": np.maximum(1.0, np.floor(left / SPEED + 0.5)),
        "arrived": np.logical_or.accumulate(ends) | arrived}


def _coming(pdfs: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of all chunks: the fixes, trip and latest time of every row's trip, and of every trip the earliest route stated."""
    parts, seen, stated = [np.zeros(0, FIX)], [np.zeros(0, FIX)], {}
    for df in pdfs:
        rows = np.zeros(len(df), FIX)
        for name in ("trip", "us"):
            rows[name] = df[name].to_numpy(np.int64)
        taken = (df["seq"].notna() & df["x"].notna() & df["y"].notna()).to_numpy()
        fixes = rows[taken]
        for name in ("seq", "x", "y"):
            fixes[name] = df[name].to_numpy()[taken]
        parts.append(fixes)
        seen.append(rows)
        for i in np.flatnonzero(df["wx"].map(lambda w: w is not None and len(w) > 0).to_numpy(bool)):
            trip, us = int(rows["trip"][i]), int(rows["us"][i])
            if trip not in stated or us < stated[trip][0]:
                stated[trip] = us, df["wx"].iat[i], df["wy"].iat[i]
    rows = np.concatenate(seen)
    ids, own = np.unique(rows["trip"], return_inverse=True)
    news = np.zeros(len(ids), TRIP)
    news["trip"] = ids
    np.maximum.at(news["last"], own, rows["us"] // 1000)
    return np.concatenate(parts), news, {trip: (np.asarray(x, "<f8"), np.asarray(y, "<f8")) for trip, (_, x, y) in stated.items()}


def _merged(trips: np.ndarray, xs: np.ndarray, ys: np.ndarray, news: np.ndarray, stated: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """The known trips and the new ones, sorted, each with its route (x and y in columns)."""
    ends = np.cumsum(trips["points"])
    known = {t: np.column_stack([xs[e - n : e], ys[e - n : e]]) for t, n, e in zip(trips["trip"].tolist(), trips["points"].tolist(), ends.tolist(), strict=True) if n}
    both = np.concatenate([trips, news[~np.isin(news["trip"], trips["trip"])]])
    both = both[np.argsort(both["trip"])]
    at = np.searchsorted(both["trip"], news["trip"])
    both["last"][at] = np.maximum(both["last"][at], news["last"])
    none = np.zeros((0, 2))
    ways = [known[t] if t in known else np.column_stack(stated[t]) if t in stated else none for t in both["trip"].tolist()]
    both["points"] = [len(w) for w in ways]
    return both, ways


def monitor_bundle(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    """The trips of one bundle in one batch, with new rows or when a timer has come: fixes that the watermark has passed are followed."""
    packed = state.get if state.exists else (b"", b"", b"", b"")
    trips, xs, ys, fixes = (np.frombuffer(b, kind) for b, kind in zip(packed, (TRIP, "<f8", "<f8", FIX), strict=True))
    more, news, stated = _coming(pdfs if not state.hasTimedOut else iter([]))
    trips, ways = _merged(trips, xs, ys, news, stated)
    fixes = np.concatenate([fixes, more])
    now = state.getCurrentWatermarkMs()
    of = np.searchsorted(trips["trip"], fixes["trip"])
    due = (fixes["us"] // 1000 < now) & (trips["points"][of] > 0)
    ready, of, fixes = np.sort(fixes[due], order=["trip", "us", "seq"]), np.sort(of[due]), fixes[~due]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
    held, n = [], 0
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        trip, part = trips[of[lo] : of[lo] + 1], ready[lo:hi]
        out = follow(ways[of[lo]], int(trip["waypoint"][0]), bool(trip["arrived"][0]), part["x"], part["y"])
        trip["waypoint"], trip["arrived"] = out["waypoint"][-1], out["arrived"][-1]
        held.append({"trip": part["trip"], "seq": part["seq"], **out})
        n += len(part)
        if n >= ROWS:
            yield _frame(held)
            held, n = [], 0
    if held:
        yield _frame(held)
    stays = trips["last"] + idle_ms >= now
    ways = [w for w, here in zip(ways, stays.tolist(), strict=True) if here]
    trips = trips[stays]
    if not len(trips):
        if state.exists:
            state.remove()
        return
    fixes = fixes[np.isin(fixes["trip"], trips["trip"])]
    points = np.concatenate(ways)
    state.update((trips.tobytes(), points[:, 0].tobytes(), points[:, 1].tobytes(), fixes.tobytes()))
    known = trips["points"][np.searchsorted(trips["trip"], fixes["trip"])] > 0
    timer = int((trips["last"] + idle_ms).min())
    if known.any():
        timer = min(timer, int(fixes["us"][known].min()) // 1000)
    state.setTimeoutTimestamp(max(timer, now + 1))


def _frame(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in NAMES})


def monitor_trip(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    """One trip alone, with its route as a list of points (x, y) in ``way``."""
    side = lambda df, c: [None if w is None else [p[c] for p in w] for w in df["way"]]
    rows = (df.assign(trip=key[0], wx=pd.Series(side(df, "x"), dtype=object), wy=pd.Series(side(df, "y"), dtype=object)) for df in pdfs)
    return monitor_bundle(key, rows, state, idle_ms)


def monitor(fixes: DataFrame, delay: str = "10 minutes", idle: str = "1 hour", bundles: int = BUNDLES) -> DataFrame:
    """Position of every fix on its trip, remaining way and arrival (which stays set).

    ``fixes`` (streaming): trip, seq, ts, x, y and way: array<struct<x,y>>. A trip's route is stated once, in a row of
    its own (seq null) or with a fix; ``way`` is null elsewhere. A fix is answered when the watermark, ``delay`` behind
    the latest time seen, has passed it, so fixes may arrive in any order within ``delay`` and are followed by ts
    and seq; later ones are dropped by Spark. Fixes without time or coordinates, and those of trips without a route or with an
    empty one, give no rows. A trip that stays silent for ``idle`` is forgotten: a fix after that needs its route again.

    Trips are dealt to ``bundles``, so that a group's call and its state, some tens of microseconds and hundreds of bytes a trip, serve
    many of them. State of a bundle: of each trip its route, the waypoint reached, the arrival and the latest time, and the fixes whose turn
    has not come, all packed. Their number must not change between runs on one checkpoint.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = fixes.filter(F.col("ts").isNotNull() & F.col("trip").isNotNull()).withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    place = [F.when(F.col("seq").isNotNull(), F.col(c).cast("double")).alias(c) for c in ("x", "y")]
    # pandas holds whole numbers beside nulls as floats, which would round large numbers.
    way = [F.col(f"way.{c}").cast("array<double>").alias(f"w{c}") for c in ("x", "y")]
    rows = timed.select(
        F.pmod(F.xxhash64("trip"), F.lit(bundles)).alias("bundle"), F.col("trip").cast("bigint").alias("trip"), F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"),
        "ts", "us", *place, *way)

    def update(key, pdfs, state):
        return monitor_bundle(key, pdfs, state, idle_ms)

    return rows.groupBy("bundle").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
