"""Which starts the route queries search from."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.catalog import graphs as Q
from kerbline.operators import spatial as S


class Given:
    """Tables made by a test."""

    def __init__(self, **tables):
        self.tables = tables

    def __call__(self, name):
        return self.tables[name]


@pytest.fixture(scope="module")
def town(spark):
    """Requests around a few nodes: close to one, far from all, between two at the same distance, twice under one number, and nowhere."""
    rnd = random.Random(4)
    nodes = [(i, 700.0 * rnd.random(), 700.0 * rnd.random()) for i in range(12)] + [(100, 3000.0, 0.0), (101, 3400.0, 0.0)]
    requests = [(i, 1000.0 * rnd.random() - 150, 1000.0 * rnd.random() - 150) for i in range(60)]
    requests += [(200, 3200.0, 0.0), (201, 3000.0, 301.0), (202, 3000.0, 300.0), (203, 3080.0, 0.0), (203, 3390.0, 0.0), (204, None, 5.0)]
    own = [(q, x, y, 1, "safe", 10) for q, x, y in requests]
    return requests, nodes, Given(
        d_requests=spark.createDataFrame(own, "q_id long, x double, y double, grade int, style string, time_left_min int"),
        d_nodes=spark.createDataFrame(nodes, "n long, x double, y double"),
        d_walk=spark.createDataFrame([(0.5,)], "risk double"),
    )


def test_requests_start_at_their_nearest_node_and_candidates_grow_with_need(spark, town, monkeypatch):
    requests, nodes, t = town
    radii = []
    plain = S.nearest_within
    monkeypatch.setattr(S, "nearest_within", lambda p, s, radius, *a, **k: radii.append(radius) or plain(p, s, radius, *a, **k))
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1e4, -1e4), (1e4, -1e4), (1e4, 1e4), (-1e4, 1e4))])
    monkeypatch.setattr(Q, "zone_rings", lambda t: spark.range(1).select(F.col("id").alias("zone_id"), F.lit("s").alias("school_name"), ring.alias("ring")))
    got = {r.q_id: r.src for r in Q.request_frame(t).collect()}
    want = {}
    for q, x, y in requests:
        if x is not None:
            d, n = min((math.hypot(x - a, y - b), n) for n, a, b in nodes)
            if d <= 300:
                want[q] = min(want.get(q, (d, n)), (d, n))
    assert got == {q: n for q, (_, n) in want.items()}
    assert min(radii) <= 75  # all requests were once compared with every node within 300 m


def test_diversity_searches_from_every_start(spark, monkeypatch):
    """40 nodes in the ring around one school: 25 were drawn, the others left out."""
    class Asked(Exception):
        pass

    def routed(t, q):
        raise Asked(q)

    monkeypatch.setattr(Q, "routed", routed)
    nodes = [(i, 200.0 * math.cos(i), 200.0 * math.sin(i)) for i in range(40)] + [(50, 10.0, 0.0), (51, 430.0, 0.0)]  # too close, too far
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0))])
    monkeypatch.setattr(Q, "zone_rings", lambda t: spark.range(1).select(F.col("id").alias("zone_id"), F.lit("s").alias("school_name"), ring.alias("ring")))
    t = Given(
        d_nodes=spark.createDataFrame(nodes, "n long, x double, y double"), d_walk=spark.createDataFrame([(0.5,)], "risk double"),
        d_gates=spark.createDataFrame([("s", 0.0, 0.0)], "school_name string, x double, y double"))
    with pytest.raises(Asked) as asked:
        Q.route_diversity(t)
    got = [(r.src, r["mode"]) for r in asked.value.args[0].collect()]
    assert sorted(got) == sorted((n, m) for n in range(40) for m in ("safest", "balanced", "shortest"))
