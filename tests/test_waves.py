"""Searches over blocks of a graph against a plain search over the whole of it."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from kerbline.operators import graph as G
from kerbline.operators import waves as W


def plain_labels(edges, starts, alpha, limit=None):
    """node: (cost, len, len_risk, hops, parent), settled one by one in the order of whole labels."""
    adj = defaultdict(list)
    for u, v, w, r in edges:
        adj[u].append((v, w, r))
    best = {s: (0.0, 0.0, 0.0, 0, -1) for s in starts}
    heap, done = [(*b, s) for s, b in best.items()], set()
    heapq.heapify(heap)
    while heap:
        *label, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        for v, w, r in adj[node]:
            new = (label[0] + w * (1.0 + alpha * r), label[1] + w, label[2] + w * r, label[3] + 1, node)
            if (limit is None or new[0] <= limit) and (v not in best or new < best[v]):
                best[v] = new
                heapq.heappush(heap, (*new, v))
    return best


def grid(n, seed, step=1):
    """Streets of n by n nodes with whole lengths, so that many ways cost the same, and numbers without any order."""
    rnd = random.Random(seed)
    name = rnd.sample(range(10 * n * n), n * n)
    at = lambda i, j: name[i * n + j]
    ends = [(at(i, j), at(i + 1, j)) for i in range(n - 1) for j in range(n)] + [(at(i, j), at(i, j + 1)) for i in range(n) for j in range(n - 1)]
    links = [(u, v, float(rnd.randint(1, 3) * step), rnd.choice([0.0, 0.25, 0.5, 1.0])) for u, v in ends]
    return [*links, *((v, u, w, r) for u, v, w, r in links)], {at(i, j): (i, j) for i in range(n) for j in range(n)}


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, length_m double, risk double")


def found(df, key="k"):
    out = defaultdict(dict)
    for r in df.collect():
        out[r[key]][r.node] = (r.cost, r.len, r.len_risk, r.hops, -1 if r.parent is None else r.parent)
    return out


@pytest.mark.parametrize("placed", [False, True])
def test_trees_over_small_blocks_equal_the_whole_graph(spark, monkeypatch, placed):
    monkeypatch.setattr(G, "BLOCK", 9)
    monkeypatch.setattr(G, "SEARCHES", 2)
    monkeypatch.setattr(W, "CELLS", 150)
    edges, places = grid(11, 2)
    nodes = sorted(places)
    lone = 10**6
    cases = {0: ([nodes[0]], 0.0, None), 1: ([nodes[5]], 2.0, 12.0), 2: ([nodes[60], nodes[90]], 0.5, None), 3: ([lone], 1.0, 50.0), 4: ([nodes[0]], 3.0, 6.5), 5: ([nodes[0]], 0.0, 0.0)}
    seeds = spark.createDataFrame([(k, s, a, x) for k, (starts, a, x) in cases.items() for s in starts], "k long, node long, alpha double, limit double")
    graph = frame(spark, edges)
    if placed:
        graph = G.blocks(graph, spark.createDataFrame([(n, 100.0 * i, 100.0 * j) for n, (i, j) in places.items()], "node long, x double, y double"))
        assert graph.count() > 10
    got = found(G.shortest_trees(graph, seeds, ["k"]))
    assert got == {k: plain_labels(edges, *case) for k, case in cases.items()}


def test_searches_with_targets_give_the_labels_up_to_them(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 9)
    edges, places = grid(11, 3)
    nodes = sorted(places)
    seeds = spark.createDataFrame([(k, nodes[k], 1.0, None) for k in range(4)], "k long, node long, alpha double, limit double")
    goals = {0: [nodes[20], nodes[100]], 1: [nodes[1]], 2: [nodes[7], 10**6]}  # one is out of reach; the last search has no target
    targets = spark.createDataFrame([(k, n) for k, some in goals.items() for n in some], "k long, node long")
    got = found(G.shortest_trees(frame(spark, edges), seeds, ["k"], targets))
    for k in range(4):
        want = plain_labels(edges, [nodes[k]], 1.0)
        bound = max(want[n][0] for n in goals.get(k, nodes) if n in want)
        assert all(want[n] == label for n, label in got[k].items() if label[0] <= bound)
        if k < 2:
            assert {n for n, label in want.items() if label[0] <= bound} <= got[k].keys()
        else:
            assert got[k].keys() == want.keys()


def test_a_long_street_takes_few_jobs(spark, monkeypatch):
    """Each step along the street was a round with jobs of its own: some 900 for these 300 nodes."""
    monkeypatch.setattr(G, "BLOCK", 32, raising=False)
    edges = [(i, i + 1, 1.0, 0.5) for i in range(300)] + [(i + 1, i, 1.0, 0.5) for i in range(300)]
    seeds = spark.createDataFrame([(0, 0, 1.0, None)], "k long, node long, alpha double, limit double")
    first = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = found(G.shortest_trees(frame(spark, edges), seeds, ["k"]))[0]
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - first
    assert {n: (c, p) for n, (c, _, _, _, p) in got.items()} == {n: (1.5 * n, n - 1) for n in range(301)}
    assert jobs < 250, jobs


def test_the_least_of_equal_costs_is_kept():
    rng = np.random.default_rng(8)
    for _ in range(50):
        labels, held = W.Labels(3, 4), {}
        for _ in range(4):
            at = rng.integers(0, 12, 40)
            new = tuple(rng.integers(0, 3, (5, 40)).astype(float))
            labels.improve(at, new)
            for i, place in enumerate(at):
                held[place] = min(held.get(place, (np.inf,)), tuple(x[i] for x in new))
        assert {p: (labels.cost[p], labels.len[p], labels.len_risk[p], labels.hops[p], labels.parent[p]) for p in held} == held


def test_sums_that_differ_in_the_last_place_are_those_of_steps(spark, monkeypatch):
    """Ways of the same lengths in another order: which label is the least depends on the order of the steps, as in SQL."""
    monkeypatch.setattr(G, "BLOCK", 16)
    edges, places = grid(12, 8, 0.1)
    first = sorted(places)[3]
    adj = defaultdict(list)
    for u, v, w, r in edges:
        adj[u].append((v, w, r))
    want = {first: (0.0, 0.0, 0.0, 0, -1)}
    fresh = dict(want)
    while fresh:
        new = {}
        for u, (c, n, lr, h, _) in fresh.items():
            for v, w, r in adj[u]:
                label = (c + w * (1.0 + 0.0 * r), n + w, lr + w * r, h + 1, u)
                new[v] = min(new.get(v, label), label)
        fresh = {v: label for v, label in new.items() if v not in want or label < want[v]}
        want |= fresh
    seeds = spark.createDataFrame([(1, first, 0.0, None)], "k long, node long, alpha double, limit double")
    assert found(G.shortest_trees(frame(spark, edges), seeds, ["k"])) == {1: want}
    assert want != plain_labels(edges, [first], 0.0)  # a search settled in the order of costs gives others
