"""Undirected weighted graphs as edge tables: components, shortest-path trees, sums over trees.

Searches run inside tasks over the blocks of the graph around their starts (``waves.py``), and only those that leave
their blocks run again with more; a tree comes out of one task. Components, sums and paths are found in rounds
whose number grows with a logarithm; lineage is cut to the shared folder every round. The driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from kerbline.operators.contract import contracted
from kerbline.operators.skew import salted_join
from kerbline.operators.waves import run
from kerbline.session import cut_lineage, materialise

BLOCK = 256  # nodes in a block of the graph, about
SEARCHES = 64  # searches that share the blocks in a task, about


def build_edges(links: DataFrame, keep_last: bool = False, order: str = "edge_id", carry: list[str] = ()) -> DataFrame:
    """One edge per node pair (a < b): the shorter of parallel links, or the last one by ``order``.

    ``links``: u, v, length_m, risk, edge_id. Missing risk counts as 0; risk is kept in [0, 1].
    """
    df = links.filter((F.col("length_m") > 0) & (F.col("u") != F.col("v"))).select(
        F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "length_m",
        F.least(F.greatest(F.coalesce("risk", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("risk"), order, *carry,
    )
    value = F.struct("length_m", order, "risk", *carry)
    best = F.max_by(value, F.col(order)) if keep_last else F.min(value)
    return df.groupBy("a", "b").agg(best.alias("_e")).select("a", "b", "_e.*")


def both_directions(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), *rest).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"), *rest)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component named by its smallest node.

    Edges are contracted within tasks first. Then every node takes the smallest label of its neighbours, hands it to its current root, and then
    jumps to its root's label; the rounds grow with the logarithm of the component size.
    """
    ends = cut_lineage(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = cut_lineage(both_directions(contracted(ends, by_range=True)))
    labels = cut_lineage(nodes.withColumn("f", F.col("node")))
    while True:
        grand = salted_join(
            labels, labels.select(F.col("node").alias("f"), F.col("f").alias("g")), ["f"], ["node"]
        )  # node, f, g = f[f]
        seen = salted_join(pairs, grand.select(F.col("node").alias("v"), "g"), ["v"], ["u"]).groupBy(
            F.col("u").alias("node")
        ).agg(F.min("g").alias("m"))
        offered = grand.join(seen, "node")
        proposals = (
            offered.select("node", F.least("m", "g").alias("f"))
            .unionByName(offered.select(F.col("f").alias("node"), F.col("m").alias("f")))
            .unionByName(labels)
        )
        nxt = proposals.groupBy("node").agg(F.min("f").alias("f"))
        changed = cut_lineage(
            nxt.join(labels.withColumnRenamed("f", "old"), "node").withColumn("changed", F.col("f") != F.col("old"))
        )
        labels = changed.select("node", "f")
        if changed.filter("changed").isEmpty():
            return labels.select("node", F.col("f").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes (the smaller name on ties)."""
    comp = components(edges)
    best = comp.groupBy("component").agg(F.count("*").alias("n")).agg(
        F.min(F.struct((-F.col("n")).alias("s"), "component")).alias("b")
    ).select("b.component")
    kept = comp.filter(F.col("component") == best.scalar())
    return edges.join(kept.select(F.col("node").alias("a")), "a", "left_semi")


def _spread(c: Column) -> Column:
    """The lower 31 bits of a number, each followed by a zero."""
    c = c.bitwiseAND(0x7FFFFFFF)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(mask)
    return c


def blocks(edges: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Edges packed into blocks of about ``BLOCK`` neighbouring nodes: block, nodes, beside (blocks that its edges lead to), u, v, length, risk.

    ``edges``: u, v, length_m, risk. ``places`` (node, x, y in metres): blocks are compact in the plane; without them nodes are taken by
    number. How nodes fall into blocks decides on cost only. Edges that are packed already come back as they are.
    """
    if "beside" in edges.columns:
        return edges
    edges = cut_lineage(edges.select("u", "v", F.col("length_m").cast("double").alias("length"), F.col("risk").cast("double").alias("risk")).filter("u is not null and v is not null"))
    nodes = edges.select(F.explode(F.array(F.col("u").cast("bigint"), F.col("v").cast("bigint"))).alias("node")).distinct()
    if places is None:
        nodes = nodes.withColumn("z", F.lit(0).cast("bigint"))
    else:
        near = places.groupBy(F.col("node").cast("bigint").alias("node")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
        cell = lambda c: _spread(F.coalesce(F.floor(c).cast("bigint"), F.lit(0)) + F.lit(1 << 30))
        nodes = nodes.join(near, "node", "left").select("node", cell("x").bitwiseOR(F.shiftleft(cell("y"), 1)).alias("z"))
    nodes = cut_lineage(nodes)
    size = BLOCK
    dealt = nodes.repartitionByRange(max(1, nodes.count() // (64 * size)), "z", "node").sortWithinPartitions("z", "node")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            yield pa.record_batch([b.column("node"), pa.array(first + np.arange(seen, seen + b.num_rows) // size)], names=["node", "block"])
            seen += b.num_rows

    block = cut_lineage(dealt.mapInArrow(number, "node long, block long"))
    side = lambda x, b: block.select(F.col("node").alias(x), F.col("block").alias(b))
    rows = edges.join(side("u", "block"), "u").join(side("v", "_to"), "v")
    packed = rows.groupBy("block").agg(
        F.collect_set("_to").alias("beside"), F.collect_list(F.struct(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), "length", "risk")).alias("_e"))
    return cut_lineage(
        block.groupBy("block").agg(F.collect_list("node").alias("nodes")).join(packed, "block", "left")
        .select("block", "nodes", "beside", *[F.col(f"_e.{c}").alias(c) for c in ("u", "v", "length", "risk")]))


def shortest_trees(edges: DataFrame, seeds: DataFrame, keys: list[str], targets: DataFrame | None = None) -> DataFrame:
    """Least-cost labels from each seed: keys, node, cost, len, len_risk, hops, parent.

    ``edges``: u, v, length_m, risk in both directions, or their ``blocks``. ``seeds``: keys, node, alpha (weight of risk:
    an edge costs length * (1 + alpha * risk)) and limit (largest cost kept, null for none).
    With ``targets`` (keys, node) a search ends once the labels beyond its farthest target cannot
    matter; where one is out of reach, it ends as without. Equal costs are decided by length, then by parent.

    Searches run in tasks that hold the blocks around their start; those that come to the end of their blocks run again with more.
    """
    graph = blocks(edges)
    home = graph.select("block", F.explode("nodes").alias("node"))
    start = F.struct(
        F.lit(0.0).alias("cost"), F.lit(0.0).alias("len"), F.lit(0.0).alias("len_risk"), F.lit(0).alias("hops"),
        F.lit(None).cast("bigint").alias("parent"),
    )
    searches = seeds.withColumn("node", F.col("node").cast("bigint")).join(home, "node", "left").groupBy(*keys).agg(
        F.first("alpha").cast("double").alias("alpha"), F.first("limit").cast("double").alias("limit"),
        F.coalesce(F.min("block"), F.lit(-1)).alias("home"), F.collect_set("node").alias("starts"),
        F.collect_set(F.when(F.col("block").isNull(), F.col("node"))).alias("loose"), F.min(start).alias("best"),
    )
    none = F.array().cast("array<bigint>")
    if targets is None:
        searches = searches.withColumn("targets", none)
    else:
        searches = searches.join(targets.groupBy(*keys).agg(F.collect_set(F.col("node").cast("bigint")).alias("targets")), keys, "left")
    searches = cut_lineage(searches.withColumn("search", F.monotonically_increasing_id()))
    kinds = dict(seeds.dtypes)
    out = StructType([
        *[f for f in searches.schema.fields if f.name in keys], StructField("node", LongType()), StructField("alpha", DoubleType()), StructField("cost", DoubleType()),
        StructField("len", DoubleType()), StructField("len_risk", DoubleType()), StructField("hops", IntegerType()), StructField("parent", LongType()),
        StructField("search", LongType()), StructField("ended", BooleanType())])
    task = run(to_arrow_schema(out), keys)
    beside = graph.select(F.col("block").alias("member"), F.explode("beside").alias("next")).filter("member <> next")
    todo, found, hops = searches, [], 1
    near = searches.filter("home >= 0").select("home", F.col("home").alias("member")).distinct()
    while True:
        for _ in range(hops):
            near = near.unionByName(near.join(beside, "member").select("home", F.col("next").alias("member"))).distinct()
        near = cut_lineage(near)
        parts = todo.groupBy("home").agg(F.ceil(F.count("*") / SEARCHES).alias("parts"))
        dealt = todo.join(parts, "home").withColumn("salt", F.pmod(F.xxhash64("search"), F.col("parts")))
        held = dealt.select("home", "salt").distinct().join(near, "home").join(graph.withColumnRenamed("block", "member"), "member")
        rows = dealt.select("home", "salt", F.lit(1).alias("kind"), *keys, "alpha", "limit", "starts", "loose", "targets", "search").unionByName(
            held.select("home", "salt", F.lit(0).alias("kind"), "nodes", "u", "v", "length", "risk"), allowMissingColumns=True)
        labels = materialise(rows.repartition("home", "salt").sortWithinPartitions("home", "salt", "kind").mapInArrow(task, out), "labels")
        found.append(labels)
        again = labels.filter("not ended").select("search")
        if again.isEmpty():
            break
        todo = cut_lineage(todo.join(again, "search", "left_semi"))
        near = near.join(todo.select("home").distinct(), "home", "left_semi")
        hops = 2 * hops if len(found) > 1 else 1  # 1, 2, 4, 8 … blocks around the home
    both = found[0]
    for part in found[1:]:
        both = both.unionByName(part)
    return both.filter("ended").select(
        *keys, F.col("node").cast(kinds["node"]).alias("node"), F.col("alpha").cast(kinds["alpha"]).alias("alpha"), "cost", "len", "len_risk", "hops", "parent")


def tree_sums(labels: DataFrame, weights: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of ``value`` over each node's subtree (all starts whose path runs through the node).

    Doubling: with sums over descendants nearer than 2^k and the 2^k-th ancestor as jump, adding
    the sums of the nodes that jump here gives the sums for 2^(k+1).
    """
    w = weights.groupBy(*keys, "node").agg(F.sum(value).alias("s"))
    state = cut_lineage(
        labels.select(*keys, "node", F.col("parent").alias("jump"), "parent").join(w, [*keys, "node"], "left")
        .withColumn("s", F.coalesce("s", F.lit(0.0)))
    )
    while not state.filter(F.col("jump").isNotNull()).isEmpty():
        gained = state.filter(F.col("jump").isNotNull()).groupBy(*keys, F.col("jump").alias("node")).agg(F.sum("s").alias("g"))
        hop = state.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("jump2"))
        state = cut_lineage(
            state.join(gained, [*keys, "node"], "left")
            .join(hop, [*keys, "jump"], "left")
            .select(*keys, "node", F.col("jump2").alias("jump"), "parent", (F.col("s") + F.coalesce("g", F.lit(0.0))).alias("s"))
        )
    return state.select(*keys, "node", "parent", F.col("s").alias(value))


def path_nodes(labels: DataFrame, starts: DataFrame, keys: list[str], start_id: str) -> DataFrame:
    """Nodes on the way from each start to its root: start_id, keys, node, parent, position from the start.

    ``starts``: start_id, keys, node. Ancestors are found by doubling, so the rounds grow with the
    logarithm of the path length and only wanted paths are written out.
    """
    jumps = cut_lineage(labels.select(*keys, "node", F.col("parent").alias("jump")))
    found = cut_lineage(starts.select(start_id, *keys, "node"))
    while not jumps.filter(F.col("jump").isNotNull()).isEmpty():
        more = found.join(jumps.filter(F.col("jump").isNotNull()), [*keys, "node"]).select(start_id, *keys, F.col("jump").alias("node"))
        found = cut_lineage(found.unionByName(more))
        hop = jumps.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("jump2"))
        jumps = cut_lineage(jumps.join(hop, [*keys, "jump"], "left").select(*keys, "node", F.col("jump2").alias("jump")))
    info = labels.select(*keys, "node", "parent", "hops", "len")
    top = starts.join(info.select(*keys, "node", F.col("hops").alias("_h")), [*keys, "node"]).select(start_id, *keys, "_h")
    return (
        found.join(info, [*keys, "node"]).join(top, [start_id, *keys])
        .select(start_id, *keys, "node", "parent", "len", (F.col("_h") - F.col("hops")).alias("pos"))
    )
