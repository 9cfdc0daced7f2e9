"""Searches against a heap-based shortest-path search on the same small graph."""

import heapq
from collections import defaultdict

import pytest

from kerbline.catalog import graphs as Q
from kerbline.operators import graph as G
from kerbline.plans import routing as R
from kerbline.session import cut_lineage


def heap_search(adj, src, alpha):
    best, done = {src: (0.0, 0.0)}, set()
    heap = [(0.0, 0.0, src)]
    while heap:
        cost, length, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        for nxt, w, risk in adj[node]:
            new = (cost + w * (1 + alpha * risk), length + w)
            if nxt not in best or new < best[nxt]:
                best[nxt] = new
                heapq.heappush(heap, (*new, nxt))
    return best


@pytest.fixture(scope="module")
def edges(tables):
    return cut_lineage(Q.walk_graph(tables))


@pytest.fixture(scope="module")
def adj(edges):
    out = defaultdict(list)
    for r in edges.collect():
        out[r.a].append((r.b, r.length_m, r.risk))
        out[r.b].append((r.a, r.length_m, r.risk))
    return out


def test_trees_match_heap_search(spark, edges, adj):
    seeds = spark.createDataFrame([(3, 3, 0.0, 900.0), (40, 40, 2.0, None)], "k long, node long, alpha double, limit double")
    got = {(r.k, r.node): (r.cost, r.len) for r in G.shortest_trees(G.both_directions(edges), seeds, ["k"]).collect()}
    want = {(3, n): v for n, v in heap_search(adj, 3, 0.0).items() if v[0] <= 900.0}
    want |= {(40, n): v for n, v in heap_search(adj, 40, 2.0).items()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-6)


def sequential_route(adj, src, gates, hi, lo, cap, eps=R.BISECTION_EPS):
    def run(alpha):
        return min((heap_search(adj, src, alpha)[g][1], g) for g in gates)[0]

    short = run(0.0)
    ratio = lambda length: length / short - 1 if short > 0 else 0.0
    first = run(hi)
    if ratio(first) <= cap:
        return first, hi, False
    low = run(lo)
    if ratio(low) > cap:
        return low, lo, True
    best = (low, lo)
    while hi - lo > eps:
        mid = (hi + lo) / 2
        length = run(mid)
        if ratio(length) <= cap:
            lo, best = mid, (length, mid)
        else:
            hi = mid
    return (*best, False)


def test_capped_routes_match_one_by_one_bisection(spark, edges, adj):
    nodes = sorted(adj)
    gates = spark.createDataFrame([("s", nodes[30]), ("s", nodes[95])], "school string, gate long")
    cases = []
    for i, src in enumerate([nodes[3], nodes[17], nodes[30], nodes[61], nodes[88], nodes[120]]):
        for j, (hi, lo, cap) in enumerate([(3.0, 0.0, 0.02), (3.0, 0.2, 0.0), (3.0, 0.0, 0.5), (2.5, 0.1, 0.08)]):
            cases.append((i * 10 + j, src, "s", hi, lo, cap))
    req = spark.createDataFrame(cases, "q_id long, src long, school string, alpha_eff double, alpha_lo double, cap double")
    both = cut_lineage(G.both_directions(edges))
    routes, trees = R.capped_routes(both, gates, G.components(edges), req)
    routes = cut_lineage(routes)
    got = {r.q_id: r for r in routes.collect()}
    for q, src, _, hi, lo, cap in cases:
        length, alpha, warning = sequential_route(adj, src, [nodes[30], nodes[95]], hi, lo, cap)
        assert got[q].length == pytest.approx(length, abs=1e-6)
        assert got[q].alpha == pytest.approx(alpha)
        assert got[q].warning == warning
        assert warning or got[q].detour <= cap + 1e-9
    walked = defaultdict(list)
    for r in R.route_edges(routes, trees, both).collect():
        walked[r.q_id].append((r.pos, r.u, r.v, r.length_m))
    for q, row in got.items():
        steps = sorted(walked[q])
        assert sum(s[3] for s in steps) == pytest.approx(row.length, abs=1e-6)
        if steps:
            assert steps[0][1] == row.src and steps[-1][2] == row.gate
            assert all(a[2] == b[1] for a, b in zip(steps, steps[1:]))


def test_tree_sums_equal_sums_over_paths(spark, edges):
    seeds = spark.createDataFrame([(7, 7, 0.0, 700.0)], "k long, node long, alpha double, limit double")
    trees = cut_lineage(G.shortest_trees(G.both_directions(edges), seeds, ["k"]))
    starts = trees.selectExpr("concat('p', node) as id", "k", "node", "cast(node % 5 as double) as w")
    sums = {r.node: r.w for r in G.tree_sums(trees, starts.select("k", "node", "w"), ["k"], "w").collect()}
    want = defaultdict(float)
    weight = {r.id: r.w for r in starts.collect()}
    for r in G.path_nodes(trees, starts, ["k"], "id").collect():
        want[r.node] += weight[r.id]
    assert {n: pytest.approx(v) for n, v in want.items()} == sums


def test_exposure_adds_up_to_enrollment(tables):
    from pyspark.sql import functions as F

    rows = Q.students_allocate(tables).join(tables("d_enrollment"), F.col("school") == F.col("school_name")).groupBy("school", "total").agg(
        F.sum("students").alias("s"), F.sum("households").alias("h")
    ).filter("h > 0 and total is not null").collect()
    assert rows
    for r in rows:
        assert r.s == pytest.approx(r.total, abs=0.05)


def test_labels_behind_the_frontier_are_set_aside(spark, monkeypatch):
    """A search along a chain keeps few rows at hand, and the labels are those of the whole chain."""
    from kerbline.operators import graph as GR

    sizes = []
    cut = GR.cut_lineage

    def counted(df):
        out = cut(df)
        if "best" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(GR, "cut_lineage", counted)
    edges = spark.sql("select id as a, id + 1 as b, 1d as length_m, 0.5d as risk from range(30)")
    seeds = spark.sql("select 0L as gate, 0L as node, 1d as alpha, cast(null as double) as limit")
    got = {r.node: (r.cost, r.len, r.parent) for r in GR.shortest_trees(GR.both_directions(edges), seeds, ["gate"]).collect()}
    assert got == {n: (1.5 * n, float(n), n - 1 if n else None) for n in range(31)}
    assert max(sizes) < 12  # 31 before


def test_components_of_a_long_street_take_few_rounds(spark):
    """Edges are contracted in tasks first; rounds that grow with the street's length were the slow part on large tables."""
    df = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(7000, 7001), (7000, 9000)], "a long, b long")
    first = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = {r.node: r.component for r in G.components(df).collect()}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - first
    assert got == {**{i: 0 for i in range(3001)}, 7000: 7000, 7001: 7000, 9000: 7000}
    assert jobs < 80, jobs
