"""Risk-aware, detour-capped routes for a whole table of requests.

Searches start at the school gates, so their number depends on gates and risk weights, not on
requests: all requests to one gate read the same shortest-path tree. The largest feasible risk
weight is found by bisection in stages of three halvings; the seven inner points of a stage are
searched at once, which gives the same answer as one halving after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.bands import CAUTION_MAX, SAFE_MAX, risk_band
from kerbline.operators import graph as GR
from kerbline.operators.frames import jaccard
from kerbline.session import cut_lineage

# Risk-weight budgets, detour caps, walking speeds (m/min) and persona table.
D_MAX, D_MIN, D_FLOOR = 1.50, 0.05, 0.10
CAP_LADDER = (0.0, 0.15, 0.50)
BISECTION_EPS = 0.05
SPEED_BY_GRADE = {1: 45.0, 2: 45.0, 3: 55.0, 4: 55.0, 5: 65.0, 6: 65.0}
DEFAULT_SPEED = 55.0
PERSONAS = [  # id, risk axis, cap, allowed grades, fallback
    ("timid", "max", 0.50, [1, 2, 3, 4, 5, 6], "timid"),
    ("safe_rush", "max", 0.15, [1, 2, 3, 4, 5, 6], "safe_rush"),
    ("leisurely", "min", 0.50, [4, 5, 6], "timid"),
    ("default", "min", 0.15, [4, 5, 6], "safe_rush"),
]
CROSSWALK_CASES = ["case_D_crosswalk", "case_D_crossing"]


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def alpha_for(axis, r_ref) -> Column:
    return F.when(_c(axis) == "max", D_MAX).otherwise(D_MIN) / _c(r_ref)


def alpha_floor(grade, r_ref) -> Column:
    """Grades 1-3 always keep some risk weight."""
    return F.when(_c(grade).isin(1, 2, 3), F.lit(D_FLOOR) / _c(r_ref)).otherwise(0.0)


def persona_of(axis, cap) -> Column:
    axis, cap = _c(axis), _c(cap)
    out = F.when(cap == 0.0, F.when(axis == "max", "safe_rush").otherwise("default"))
    for name, ax, c, _, _ in PERSONAS:
        out = out.when((axis == ax) & (cap == c), name)
    return out.otherwise("default")


def resolve_persona(df: DataFrame, axis: str, cap: str, grade: str) -> DataFrame:
    """Persona of the axis and cap, replaced by its safe fallback where the grade is not allowed."""
    table = F.create_map(*[x for n, _, _, g, f in PERSONAS for x in (
        F.lit(n), F.struct(F.array(*[F.lit(i) for i in g]).alias("grades"), F.lit(f).alias("fallback")))])
    df = df.withColumn("wanted", persona_of(axis, cap)).withColumn("_p", F.element_at(table, F.col("wanted")))
    allowed = F.coalesce(F.array_contains(F.col("_p.grades"), F.col(grade).cast("int")), F.lit(False))
    return df.withColumn("allowed", allowed).withColumn(
        "persona", F.when(allowed, F.col("wanted")).otherwise(F.col("_p.fallback"))
    ).drop("_p")


def walking_speed(grade) -> Column:
    out = None
    for g, v in SPEED_BY_GRADE.items():
        out = F.when(_c(grade) == g, v) if out is None else out.when(_c(grade) == g, v)
    return out.otherwise(DEFAULT_SPEED)


def cap_from_time(time_left, length, grade) -> Column:
    """Detour cap the remaining time allows."""
    minutes = _c(length) / walking_speed(grade)
    slack = F.when(minutes > 0, _c(time_left) / F.nullif(minutes, F.lit(0.0)) - 1).otherwise(1.0)
    return F.when(slack >= 0.5, 0.5).when(slack >= 0.15, 0.15).otherwise(0.0)


def cap_step(cap, direction) -> Column:
    """Nearest rung of the ladder, moved by ``direction`` and kept on it."""
    cap, direction = _c(cap), _c(direction) if not isinstance(direction, int) else F.lit(direction)
    rung = F.array_min(F.array(*[
        F.struct(F.abs(F.lit(v) - cap).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(CAP_LADDER)
    ])).getField("i")
    at = F.least(F.greatest(rung + direction, F.lit(0)), F.lit(len(CAP_LADDER) - 1))
    return F.element_at(F.array(*[F.lit(v) for v in CAP_LADDER]), (at + 1).cast("int"))


def route_mode(axis, cap, warning) -> Column:
    return (
        F.when(_c(warning) | (_c(cap) <= 0), "shortest")
        .when((_c(axis) == "max") & (_c(cap) >= 0.5), "safest").otherwise("balanced")
    )


def slack_mode(remaining_min, baseline_min) -> Column:
    slack = _c(remaining_min) - _c(baseline_min)
    return F.when(slack >= 5, "safest").when(slack >= -2, "balanced").otherwise("shortest")


def choose_gates(requests: DataFrame, gates: DataFrame) -> DataFrame:
    """Request × gate rows: only gates of the preferred type, or all gates where there is none.

    ``requests``: q_id, school, preferred. ``gates``: school, gate, gate_type.
    """
    has = requests.join(
        gates.select("school", F.col("gate_type").alias("preferred")).distinct().withColumn("_has", F.lit(True)),
        ["school", "preferred"], "left",
    )
    return has.join(gates, "school").filter(F.col("_has").isNull() | (F.col("gate_type") == F.col("preferred"))).drop("_has")


def band_counts(edges: DataFrame, keys: list[str], risk: str = "risk", length: str = "length_m") -> DataFrame:
    """Edges and metres per risk band and in total."""
    r, m = F.col(risk), F.col(length)
    bands = {"safe": r <= SAFE_MAX, "warn": (r > SAFE_MAX) & (r <= CAUTION_MAX), "danger": r > CAUTION_MAX}
    return edges.groupBy(*keys).agg(
        F.count("*").alias("total"), F.sum(m).alias("total_m"),
        *[F.count_if(c).alias(b) for b, c in bands.items()],
        *[F.sum(F.when(c, m).otherwise(0.0)).alias(f"{b}_m") for b, c in bands.items()],
    )


def route_metrics(route_edges: DataFrame, routes: DataFrame) -> DataFrame:
    """Detour ratio, minutes, school-zone share and band counts per route.

    ``route_edges``: q_id, length_m, risk, in_zone. ``routes``: q_id, grade, short_len.
    """
    counts = band_counts(route_edges, ["q_id"])
    zone = route_edges.groupBy("q_id").agg(F.sum(F.when(F.col("in_zone"), F.col("length_m")).otherwise(0.0)).alias("zone_m"))
    df = routes.join(counts, "q_id", "left").join(zone, "q_id", "left")
    df = df.fillna(0, [c for c in [*counts.columns, "zone_m"] if c != "q_id"])  # an empty route has no edges
    return df.withColumns({
        "detour": F.coalesce(F.try_divide(F.col("total_m"), F.col("short_len")) - 1, F.lit(0.0)),
        "minutes": F.greatest(F.lit(1.0), F.bround(F.col("total_m") / walking_speed("grade"))),
        "zone_share": F.coalesce(F.try_divide(F.col("zone_m"), F.col("total_m")), F.lit(0.0)),
    })


def path_overlap(nodes: DataFrame, route: str, mode: str, node: str, a, b) -> DataFrame:
    """Intersection over union of the node sets of two modes, from rows (no set is ever collected)."""
    flags = nodes.groupBy(route, node).agg(
        F.bool_or(F.col(mode) == a).alias("a"), F.bool_or(F.col(mode) == b).alias("b")
    )
    return flags.groupBy(route).agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("any"),
        F.bool_or("a").alias("_a"), F.bool_or("b").alias("_b"),
    ).filter("_a and _b").select(route, F.try_divide(F.col("both"), F.col("any")).alias("iou"))


# --- searches -------------------------------------------------------------------------------------


def reachable(requests: DataFrame, gates: DataFrame, component: DataFrame) -> DataFrame:
    """Request × gate rows in the same component: class columns, gate."""
    c = component
    pairs = requests.join(gates.select("school", "gate"), "school")
    return (
        pairs.join(c.select(F.col("node").alias("src"), F.col("component").alias("_cs")), "src")
        .join(c.select(F.col("node").alias("gate"), F.col("component").alias("_cg")), "gate")
        .filter(F.col("_cs") == F.col("_cg")).drop("_cs", "_cg")
    )


def baseline(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shortest length per (src, gate): src, gate, len0, risk0 (risk-weighted length of that path)."""
    wanted = cut_lineage(pairs.select("gate", "src").distinct())
    seeds = wanted.select("gate").distinct().select(
        "gate", F.col("gate").alias("node"), F.lit(0.0).alias("alpha"), F.lit(None).cast("double").alias("limit")
    )
    trees = GR.shortest_trees(edges, seeds, ["gate"], wanted.select("gate", F.col("src").alias("node")))
    return trees.select(F.col("node").alias("src"), "gate", F.col("len").alias("len0"), F.col("len_risk").alias("risk0")).join(
        wanted, ["src", "gate"], "left_semi"
    )


def weighted_trees(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Trees per (gate, alpha). ``wanted``: gate, alpha, src, len0, risk0.

    The baseline path bounds the cost of the best one, so each tree stops at the largest bound.
    """
    seeds = wanted.groupBy("gate", "alpha").agg(
        (F.max(F.col("len0") + F.col("alpha") * F.col("risk0")) * (1 + 1e-9) + 1e-9).alias("limit")
    ).select("gate", F.col("alpha").alias("a"), F.col("gate").alias("node"), "alpha", "limit")
    return GR.shortest_trees(edges, seeds, ["gate", "a"]).drop("alpha").withColumnRenamed("a", "alpha")


def best_gate(pairs: DataFrame, trees: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the gate whose least-cost path is shortest. ``pairs``: keys, src, gate, alpha."""
    joined = pairs.join(
        trees.select("gate", "alpha", F.col("node").alias("src"), F.col("len").alias("length"), "len_risk"), ["gate", "alpha", "src"]
    )
    best = joined.groupBy(*keys).agg(F.min(F.struct("length", "gate", "len_risk", "alpha")).alias("b"))
    return best.select(*keys, "b.gate", "b.length", "b.len_risk", "b.alpha")


def capped_routes(edges: DataFrame, gates: DataFrame, component: DataFrame, requests: DataFrame, eps: float = BISECTION_EPS):
    """The route of the largest risk weight whose detour stays within the cap.

    ``edges``: both directions, or their blocks. ``requests``: q_id, src, school, alpha_eff, alpha_lo, and either cap
    or (time_left_min, grade). Returns (routes, trees): routes has q_id, src, gate, alpha, length,
    short_len, detour, cap, warning; trees holds the labels the paths follow. Requests without a
    reachable gate have no route. Where even the smallest weight exceeds the cap, that route is
    given with a warning.
    """
    edges = GR.blocks(edges)
    pairs = cut_lineage(reachable(requests.select("q_id", "src", "school"), gates, component))
    base = cut_lineage(baseline(edges, pairs))
    pairs = pairs.join(base, ["src", "gate"])
    short = pairs.groupBy("q_id").agg(F.min("len0").alias("short_len"))
    req = requests.join(short, "q_id")
    if "cap" not in requests.columns:
        req = req.withColumn("cap", cap_from_time("time_left_min", "short_len", "grade"))
    req = req.select("q_id", "src", "school", "alpha_eff", "alpha_lo", "short_len", "cap")
    pairs = cut_lineage(pairs.join(req.select("q_id", "alpha_eff", "alpha_lo", "cap", "short_len"), "q_id"))

    def search(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Best gate per (q_id, alpha) and the trees for the rows' weights."""
        classes = rows.select("gate", "alpha", "src", "len0", "risk0").distinct()
        trees = cut_lineage(weighted_trees(edges, classes))
        hit = best_gate(rows.select("q_id", "src", "gate", "alpha", F.col("alpha").alias("tried")), trees, ["q_id", "tried"])
        return hit, trees

    ends = pairs.select("*", F.explode(F.array_distinct(F.array("alpha_eff", "alpha_lo"))).alias("alpha"))
    hit, trees = search(ends)
    found = hit.select("q_id", "tried", F.struct("length", "gate", "alpha").alias("r"))
    both = req.join(found.select("q_id", F.col("tried").alias("alpha_eff"), F.col("r").alias("hi")), ["q_id", "alpha_eff"]).join(
        found.select("q_id", F.col("tried").alias("alpha_lo"), F.col("r").alias("lo")), ["q_id", "alpha_lo"]
    )
    over = lambda r: F.coalesce(F.try_divide(F.col(f"{r}.length"), F.col("short_len")) - 1, F.lit(0.0)) > F.col("cap")
    state = cut_lineage(both.select(
        "q_id", "src", "short_len", "cap",
        F.when(~over("hi"), F.col("hi")).otherwise(F.col("lo")).alias("best"),
        (over("hi") & over("lo")).alias("warning"),
        F.when(over("hi") & ~over("lo"), F.col("alpha_lo")).alias("a"),
        F.when(over("hi") & ~over("lo"), F.col("alpha_eff")).alias("b"),
    ))
    all_trees = [trees]
    while True:
        todo = state.filter(F.col("b") - F.col("a") > eps)
        if todo.isEmpty():
            break
        grid = todo.select("q_id", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("i")).withColumn(
            "alpha", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 8
        )
        grid = cut_lineage(grid)
        rows = pairs.select("q_id", "src", "gate", "len0", "risk0").join(grid.select("q_id", "alpha"), "q_id")
        hit, trees = search(rows)
        all_trees.append(trees)
        tried = grid.join(hit.select("q_id", F.col("tried").alias("alpha"), F.struct("length", "gate", "alpha").alias("r")), ["q_id", "alpha"])
        per = tried.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("m"))
        df = state.join(per, "q_id", "left")
        start = F.struct(F.lit(0).alias("lo"), F.lit(8).alias("hi"))
        unit = (F.col("b") - F.col("a")) / 8

        def halve(acc, _):
            mid = ((acc.lo + acc.hi) / 2).cast("int")
            go = (acc.hi - acc.lo) * unit > eps
            ok = F.coalesce(F.try_divide(F.element_at("m", mid).getField("length"), F.col("short_len")) - 1 <= F.col("cap"), F.lit(False))
            return F.struct(
                F.when(go & ok, mid).otherwise(acc.lo).alias("lo"), F.when(go & ~ok, mid).otherwise(acc.hi).alias("hi")
            )

        df = df.withColumn("_w", F.when(F.col("m").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, halve)))
        lo, hi = F.col("_w.lo"), F.col("_w.hi")
        state = cut_lineage(df.select(
            "q_id", "src", "short_len", "cap",
            F.when(lo > 0, F.element_at("m", lo)).otherwise(F.col("best")).alias("best"), "warning",
            F.when(F.col("_w").isNotNull(), F.col("a") + lo * unit).otherwise(F.col("a")).alias("a"),
            F.when(F.col("_w").isNotNull(), F.col("a") + hi * unit).otherwise(F.col("b")).alias("b"),
        ))
    routes = state.select(
        "q_id", "src", F.col("best.gate").alias("gate"), F.col("best.alpha").alias("alpha"), F.col("best.length").alias("length"),
        "short_len", F.coalesce(F.try_divide(F.col("best.length"), F.col("short_len")) - 1, F.lit(0.0)).alias("detour"), "cap", "warning",
    )
    labels = all_trees[0]
    for tr in all_trees[1:]:
        labels = labels.unionByName(tr)
    return routes, labels


def route_edges(routes: DataFrame, trees: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of every route in walking order: q_id, pos, u, v and the edge columns."""
    used = routes.select("gate", "alpha").distinct()
    labels = trees.join(used, ["gate", "alpha"], "left_semi").dropDuplicates(["gate", "alpha", "node"])
    starts = routes.select("q_id", "gate", "alpha", F.col("src").alias("node"))
    nodes = GR.path_nodes(cut_lineage(labels), starts, ["gate", "alpha"], "q_id").filter(F.col("parent").isNotNull())
    return nodes.select("q_id", "pos", F.col("node").alias("u"), F.col("parent").alias("v")).join(edges, ["u", "v"])


def route_geometry(edges: DataFrame) -> DataFrame:
    """Per edge: band, crosswalk flag and the middle vertex of crosswalks."""
    cross = F.col("basis").isin(*CROSSWALK_CASES)
    return edges.select(
        "q_id", "pos", "u", "v", F.round("risk", 3).alias("risk"), risk_band("risk").alias("band"), cross.alias("is_crosswalk"),
        F.when(cross, F.col("x2")).alias("mid_x"), F.when(cross, F.col("y2")).alias("mid_y"),
    )
