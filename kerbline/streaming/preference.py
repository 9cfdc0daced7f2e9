"""Preferences stated in a conversation: rules, their effects, and the state after every utterance.

The state (risk axis, detour cap, cap set by the user) has 24 values, so an utterance is a map from
state to state. Maps compose associatively: long conversations are cut into blocks, blocks are
composed in parallel, and no task ever walks a whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbline.plans.routing import CAP_LADDER

RULE_NAMES = ["safer", "relax", "faster", "late"]
CONFLICT_CAP = 0.15
BLOCK = 256

STATES = list(product(("min", "max"), CAP_LADDER, (None, *CAP_LADDER)))
STATE_TYPE = "struct<axis:string,cap:double,override:double>"


def apply_rules(state: tuple, hits: tuple) -> tuple:
    """State after an utterance in which the given rules fired, one after another."""
    axis, cap, override = state
    safer, relax, faster, late = hits
    if safer:
        axis = "max"
    for fired, move in ((relax, 1), (faster, -1)):
        if fired:
            cap = CAP_LADDER[min(max(CAP_LADDER.index(cap) + move, 0), len(CAP_LADDER) - 1)]
            override = cap
    if late:
        cap = override = CAP_LADDER[0]
    if (safer or relax) and (faster or late):
        axis = "max"
        if cap == CAP_LADDER[0]:
            cap = override = CONFLICT_CAP
    return axis, cap, override


# One row per combination of rules: the next state of each of the 24 states.
TRANSITIONS = [
    [STATES.index(apply_rules(s, tuple(bool(code >> i & 1) for i in range(4)))) for s in STATES] for code in range(16)
]


def rule_flags(text, rules: dict[str, str]) -> dict[str, Column]:
    text = F.col(text) if isinstance(text, str) else text
    return {name: F.coalesce(text.rlike(rules[name]), F.lit(False)) for name in RULE_NAMES}


def rule_code(text, rules: dict[str, str]) -> Column:
    """Rules that fire, as a number from 0 to 15."""
    return sum((flag.cast("int") * (1 << i) for i, flag in enumerate(rule_flags(text, rules).values())), F.lit(0))


def _transition(code: Column) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(v) for v in row]) for row in TRANSITIONS]), code + 1)


def fold(df: DataFrame, key: str, order: str, text: str, rules: dict[str, str], start: tuple = ("max", 0.5, None)) -> DataFrame:
    """State after every utterance: key, order, code, axis, cap, override.

    ``order`` numbers the utterances of a key; blocks are runs of ``BLOCK`` of these numbers.
    """
    rows = df.select(key, order, rule_code(text, rules).alias("code")).withColumn("_b", F.floor(F.col(order) / BLOCK))
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    begin = F.lit(STATES.index(start))
    blocks = rows.groupBy(key, "_b").agg(F.array_sort(F.collect_list(F.struct(order, "code"))).alias("_u"))
    blocks = blocks.withColumn(
        "_map", F.aggregate("_u", identity, lambda acc, u: F.transform(acc, lambda s: F.element_at(_transition(u.code), s + 1)))
    )
    # Composing block maps: super-blocks first, then the few super-blocks of a key in order.
    blocks = blocks.withColumn("_sb", F.floor(F.col("_b") / BLOCK))
    compose = lambda ms: F.aggregate(ms, identity, lambda acc, m: F.transform(acc, lambda s: F.element_at(m.m, s + 1)))
    supers = blocks.groupBy(key, "_sb").agg(F.array_sort(F.collect_list(F.struct("_b", F.col("_map").alias("m")))).alias("_ms"))
    supers = supers.withColumn("_smap", compose(F.col("_ms")))
    tops = supers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_sb", F.col("_smap").alias("m")))).alias("_top"))
    walk = lambda ms, s0: F.aggregate(ms, s0, lambda s, m: F.element_at(m.m, s + 1))
    placed = supers.join(tops, key).withColumn(
        "_s0", walk(F.filter("_top", lambda m: m["_sb"] < F.col("_sb")), begin)
    ).select(key, "_sb", "_s0", "_ms")
    entered = blocks.join(placed, [key, "_sb"]).withColumn("_in", walk(F.filter("_ms", lambda m: m["_b"] < F.col("_b")), F.col("_s0")))
    states = F.array(*[
        F.struct(F.lit(a).alias("axis"), F.lit(c).alias("cap"), F.lit(o).cast("double").alias("override")) for a, c, o in STATES
    ])
    empty = F.struct(F.col("_in").alias("s"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, u):
        nxt = F.element_at(_transition(u.code), acc.s + 1)
        return F.struct(nxt.alias("s"), F.concat(acc.out, F.array(nxt)).alias("out"))

    traced = entered.withColumn("_out", F.aggregate("_u", empty, step, lambda acc: acc.out))
    long = traced.select(key, F.explode(F.arrays_zip("_u", "_out")).alias("r"))
    return long.select(key, F.col(f"r._u.{order}").alias(order), F.col("r._u.code").alias("code"), F.element_at(states, F.col("r._out") + 1).alias("s")).select(
        key, order, "code", "s.axis", "s.cap", "s.override"
    )


# Codes of events beyond the 16 combinations of rules.
RESET, PASS, BASELINE = 16, 17, 32
_STEPS = np.array([*TRANSITIONS, *[list(range(len(STATES)))] * 2], np.uint8)
SLICE = 1 << 16

OUT = "key bigint, turn bigint, axis string, cap double, override double"
LATCH = "turn bigint, at int, base int, early binary"
TURN = np.dtype([("turn", "<i8"), ("code", "<i4")])


def trace(codes: np.ndarray, at: int, base: int) -> tuple[np.ndarray, int]:
    """States after events in order, and the baseline after them.

    Events are maps from state to state; their prefixes are composed by doubling.
    """
    out = np.empty(len(codes), np.int64)
    for lo in range(0, len(codes), SLICE):
        part = codes[lo:lo + SLICE]
        set_at = np.maximum.accumulate(np.where(part >= BASELINE, np.arange(len(part)), -1))
        bases = np.where(set_at >= 0, part[set_at] - BASELINE, base)
        maps = _STEPS[np.minimum(part, PASS)]
        fixed = (part == RESET) | (part >= BASELINE)
        maps[fixed] = bases[fixed, None]
        shift = 1
        while shift < len(maps):
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
            shift *= 2
        out[lo:lo + SLICE] = maps[:, at]
        at, base = int(out[lo + len(part) - 1]), int(bases[-1])
    return out, base


def event_code(event: Column, text: Column, rules: dict[str, str], axis: Column, cap: Column) -> Column:
    """Code of an event: ``baseline`` with axis and cap, ``reset``, ``pass``, or else an utterance."""
    base = F.coalesce(*[F.when((axis == a) & (cap == c), F.lit(BASELINE + STATES.index((a, c, None)))) for a, c in product(("min", "max"), CAP_LADDER)])
    return F.when(event == "baseline", F.coalesce(base, F.lit(PASS))).when(event == "reset", RESET).when(event == "pass", PASS).otherwise(rule_code(text, rules)).cast("int")


_COLUMNS = {
    "axis": np.array([a for a, _, _ in STATES], object), "cap": np.array([c for _, c, _ in STATES], float),
    "override": np.array([np.nan if o is None else o for _, _, o in STATES], float)}


def latch(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, begin: int, patience_ms: int, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """One conversation in one batch: turns whose predecessors are all known are answered, those that come early wait, packed.

    A timer that comes while turns wait ends the patience with gaps; one that comes when none waits ends the conversation.
    """
    due, at, base, early = state.get if state.exists else (0, begin, begin, b"")
    turns = np.frombuffer(early, TURN)
    if state.hasTimedOut:
        if not len(turns):
            state.remove()
            return
    else:
        parts = [turns]
        for df in pdfs:
            new = np.zeros(len(df), TURN)
            for name in TURN.names:
                new[name] = df[name].to_numpy()
            parts.append(new)
        turns = np.concatenate(parts)
        _, first = np.unique(turns["turn"], return_index=True)
        turns = turns[first]
        turns = turns[turns["turn"] >= due]
    n = len(turns) if state.hasTimedOut else int((turns["turn"] == due + np.arange(len(turns))).cumprod().sum())
    ready, rest = turns[:n], turns[n:]
    if n:
        states, base = trace(ready["code"], int(at), int(base))
        due, at = int(ready["turn"][-1]) + 1, int(states[-1])
        said = ready["code"] != PASS
        yield pd.DataFrame({"key": key[0], "turn": ready["turn"][said], **{c: v[states[said]] for c, v in _COLUMNS.items()}})
    state.update((int(due), int(at), int(base), rest.tobytes()))
    state.setTimeoutDuration(patience_ms if len(rest) else ttl_ms)


def stream_preferences(
    events: DataFrame, key: str, order: str, code: Column, start: tuple = ("max", 0.5, None), patience: str = "1 minute", ttl: str = "7 days",
) -> DataFrame:
    """The same latch on a stream of events with the codes of ``event_code``: key, turn, axis, cap, override.

    ``order`` numbers all events of a conversation from 0 without gaps, ``pass`` events (no row) included. Turns may
    arrive in any order: one that comes early waits for those before it. When a turn has waited for ``patience`` (time
    of processing), all that wait go on in order; turns that come after that, and repeats of a turn, give no row.
    ``reset`` returns to the baseline, which is ``start`` until a ``baseline`` event states another. A
    conversation without an event for ``ttl`` is forgotten. Rows without key or turn are left out.
    A run that is to end with its input (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled=false``.
    """
    patience_ms, ttl_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (patience, ttl))
    begin = STATES.index(start)
    coded = events.select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("turn"), code.alias("code")).dropna()

    def update(group, pdfs, state):
        return latch(group, pdfs, state, begin, patience_ms, ttl_ms)

    return coded.groupBy("key").applyInPandasWithState(update, OUT, LATCH, "append", GroupStateTimeout.ProcessingTimeTimeout)
