"""Walking-edge safety: classify every walking edge by its relation to the roads around it.

One spatial join yields all (walking edge, road) pairs within the largest radius. Every rule is a
conditional aggregate over those pairs, and a single ``when`` chain applies the priorities. Many
parameter sets are classified in the same job; sets that agree in a rule share its aggregate.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as G
from kerbline.functions.bands import distance_discount
from kerbline.operators import spatial as S
from kerbline.operators.ranking import pct_rank
from kerbline.session import cut_lineage

# Road classes and walking types the rules refer to.
MAJOR_CLASSES = [
    "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "busway",
]
LOCAL_CLASSES = ["residential", "living_street"]
MIXED_TYPE = "1111"
PEDESTRIAN_TYPES = ["1000", "1011"]
CASES = [
    "case_D_crosswalk", "special_safe_facility", "case_D_crossing", "case_A_separated", "case_B_shared_road",
    "case_A_separated_two_sided", "case_C_no_nearby_road", "case_B_nearest_road", "unclassified",
]


@dataclass(frozen=True)
class Rules:
    """Thresholds in metres, degrees and ratios (fixed default values)."""

    crossing_snap: float = 2.0
    crossing_angle: float = 45.0
    crossing_shared: float = 1.0
    crosswalk_max: float = 80.0
    crosswalk_angle: float = 30.0
    shared_radius: float = 5.0
    shared_angle: float = 30.0
    shared_ratio: float = 0.5
    no_road: float = 80.0
    nearest_max: float = 80.0
    sep_min: float = 3.0
    sep_max: float = 25.0
    sep_angle: float = 20.0
    sep_ratio: float = 0.55
    sep_length: float = 20.0
    local_max: float = 18.0
    local_angle: float = 15.0
    local_ratio: float = 0.70
    local_length: float = 25.0


# The sensitivity scenarios as changes of the defaults.
SCENARIOS: dict[str, Rules] = {
    "default": Rules(),
    "B_nearest_no_discount": Rules(shared_radius=80.0),
    "B_nearest_tight_decay": Rules(shared_radius=3.0, sep_max=15.0, no_road=60.0),
    "B_nearest_loose_decay": Rules(shared_radius=10.0, sep_max=40.0),
    "A1111_strict_separation": Rules(sep_max=18.0),
    "A1111_loose_separation": Rules(sep_max=35.0),
    "A1111_high_overlap": Rules(sep_ratio=0.70),
    "A1111_low_overlap": Rules(sep_ratio=0.40),
    "A1111_strict_angle": Rules(sep_angle=12.0),
    "A1111_loose_angle": Rules(sep_angle=30.0),
    "combined_tight_all": Rules(shared_radius=3.0, sep_max=18.0, no_road=60.0, sep_angle=15.0, sep_ratio=0.65),
    "combined_loose_all": Rules(shared_radius=7.0, sep_max=35.0, no_road=100.0, sep_angle=25.0, sep_ratio=0.45),
}
SIDE_RADIUS, SIDE_ANGLE, SIDE_RATIO = 10.0, 15.0, 0.5

WALK_SEG = ("x1", "y1", "x2", "y2")
ROAD_SEG = ("rx1", "ry1", "rx2", "ry2")


def with_scenarios(df: DataFrame, scenarios: dict[str, Rules]) -> DataFrame:
    """Repeat every row once per parameter set, with the thresholds as struct ``p``."""
    rows = [
        F.struct(F.lit(name).alias("scenario"), *[F.lit(v).alias(k) for k, v in asdict(rules).items()])
        for name, rules in scenarios.items()
    ]
    return df.withColumn("p", F.explode(F.array(*rows)))


def load_walk(rows: DataFrame, district: str | None = None) -> DataFrame:
    """LINK rows with LINESTRING geometry, typed flags, and length falling back to the geometry."""
    from kerbline.functions.text import parse_wkt_line, to_number, zero_pad

    df = rows.filter(F.col("kind") == "LINK")
    if district is not None:
        df = df.filter(F.col("district") == district)
    df = df.withColumn("geom", parse_wkt_line("wkt")).filter(F.col("geom").isNotNull())
    return df.select(
        "walk_edge_id", zero_pad("type_code").alias("walking_type"),
        *[F.coalesce(to_number(c).cast("int"), F.lit(0)).alias(c) for c in ("crosswalk", "overpass", "park_green")],
        F.coalesce(to_number("length"), G.line_length("geom")).alias("length_m"), "geom",
    )


def with_road_pct(roads: DataFrame, risk: str = "risk_index") -> DataFrame:
    """Average-rank percentile of road risk; roads without a risk are dropped."""
    return pct_rank(roads.filter(F.col(risk).isNotNull()), risk, "risk_pct")


def _road_columns(roads: DataFrame) -> DataFrame:
    return roads.select(
        F.col("osm_edge_id").alias("road_id"), "road_class", "road_name", "risk_index", "risk_pct",
        F.col("x1").alias("rx1"), F.col("y1").alias("ry1"), F.col("x2").alias("rx2"), F.col("y2").alias("ry2"),
    )


def candidate_pairs(walk: DataFrame, roads: DataFrame, radius: float) -> DataFrame:
    """(walking edge, road) pairs with distance, angle difference, shared length, midpoint distance."""
    pairs = S.segment_pairs(
        walk.select("walk_edge_id", "walking_type", "length_m", *WALK_SEG), _road_columns(roads), radius,
        "walk_edge_id", WALK_SEG, ROAD_SEG, cell=max(radius, 100.0),
    )
    x1, y1, x2, y2 = (F.col(c) for c in WALK_SEG)
    return pairs.withColumns({
        "angle_diff": G.angle_diff(G.angle(*WALK_SEG), G.angle(*ROAD_SEG)),
        "shared": G.shared_length(WALK_SEG, ROAD_SEG),
        "mid_distance": G.point_segment_distance((x1 + x2) / 2, (y1 + y2) / 2, *ROAD_SEG),
    })


def _may_separate() -> Column:
    """A mixed walking edge beside a major or a named local road."""
    name = F.lower(F.trim(F.coalesce("road_name", F.lit(""))))
    local = F.col("road_class").isin(*LOCAL_CLASSES) & (name != "") & (name != "nan")
    return (F.col("walking_type") == MIXED_TYPE) & (F.col("road_class").isin(*MAJOR_CLASSES) | local)


def _radii(scenarios: dict[str, Rules]) -> list[float]:
    return sorted({r for rules in scenarios.values() for r in (rules.shared_radius, rules.sep_max, rules.local_max)})


def with_overlaps(pairs: DataFrame, scenarios: dict[str, Rules]) -> DataFrame:
    """Pairs with ``overlaps``: metres at each radius of the parameter sets, null where no rule reads it for the pair."""
    d = F.col("distance")
    shared = {rules.shared_radius for rules in scenarios.values()}
    wanted = [F.when((d <= r) & (F.lit(r in shared) | _may_separate()), F.lit(r)) for r in _radii(scenarios)]
    return pairs.withColumn("overlaps", G.overlap_lengths(WALK_SEG, ROAD_SEG, F.array(*wanted)))


def two_sided_edges(walk: DataFrame, roads: DataFrame) -> DataFrame:
    """Walking edges parallel to a road that has such edges on both of its sides."""
    pairs = S.segment_pairs(
        walk.select("walk_edge_id", *WALK_SEG), _road_columns(roads), SIDE_RADIUS, "walk_edge_id", WALK_SEG, ROAD_SEG, cell=100.0
    )
    x1, y1, x2, y2 = (F.col(c) for c in WALK_SEG)
    left, right = G.half_sides((x1 + x2) / 2, (y1 + y2) / 2, *ROAD_SEG, SIDE_RADIUS)
    ratio = F.try_divide(G.overlap_length(ROAD_SEG, WALK_SEG, SIDE_RADIUS), G.distance(*ROAD_SEG))
    pairs = pairs.filter(
        (G.angle_diff(G.angle(*WALK_SEG), G.angle(*ROAD_SEG)) <= SIDE_ANGLE) & (F.coalesce(ratio, F.lit(0.0)) >= SIDE_RATIO)
    ).select("walk_edge_id", "road_id", left.alias("l"), right.alias("r")).filter("l or r")
    both = pairs.groupBy("road_id").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r")).filter("l and r").select("road_id")
    return pairs.join(both, "road_id", "left_semi").select("walk_edge_id").distinct()


def _pick(condition: Column, *keys: Column) -> Column:
    """Best pair by ``keys`` (largest first), carrying the road."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    carried = [F.col(c) for c in ("road_id", "risk_index", "risk_pct", "distance", "mid_distance", "angle_diff")]
    return F.max(F.when(condition, F.struct(*named, *carried)))


def rule_matches(pairs: DataFrame, scenarios: dict[str, Rules]) -> DataFrame:
    """Per scenario and walking edge: the road each rule would choose (null when it has none).

    Pairs are not repeated: scenarios that agree in all thresholds of a rule share its aggregate, and the scenarios are
    listed once per edge afterwards.
    """
    pairs, radii = with_overlaps(pairs, scenarios), _radii(scenarios)
    d, ad, length, mid, pct = (F.col(c) for c in ("distance", "angle_diff", "length_m", "mid_distance", "risk_pct"))
    major = F.col("road_class").isin(*MAJOR_CLASSES)
    mixed = F.col("walking_type") == MIXED_TYPE

    def overlap(radius: float) -> Column:
        return F.try_divide(F.col("overlaps")[radii.index(radius)], length)

    def crossing(angle, snap, common) -> Column:
        return (ad >= angle) & (d <= snap) & (F.col("shared") <= common)

    def separated(low, high, angle, ratio, shortest, local_high, local_angle, local_ratio, local_shortest) -> Column:
        either = lambda x, y: F.when(major, x).otherwise(y)
        share = either(overlap(high), overlap(local_high))
        fits = (
            _may_separate() & (length >= shortest) & (length >= either(shortest, local_shortest)) & (d >= low)
            & (d <= either(high, local_high)) & (ad <= either(angle, local_angle)) & (share >= either(ratio, local_ratio))
        )
        return _pick(fits, major.cast("int"), share, -d, pct)

    cross = ("crossing_angle", "crossing_snap", "crossing_shared")
    rules = {  # rule: the thresholds it reads, and the pair it takes
        "cw_cross": (cross, lambda *v: _pick(crossing(*v), ad, -d, pct)),
        "cw_angle": (("crosswalk_max", "crosswalk_angle"), lambda most, angle: _pick((mid <= most) & (ad >= angle), ad, -mid)),
        "cw_near": (("crosswalk_max",), lambda most: _pick(mid <= most, -mid)),
        "crossing": (cross, lambda *v: _pick(crossing(*v) & ~mixed, ad, -mid, pct)),
        "separated": (
            ("sep_min", "sep_max", "sep_angle", "sep_ratio", "sep_length", "local_max", "local_angle", "local_ratio", "local_length"), separated),
        "shared": (
            ("shared_radius", "shared_angle", "shared_ratio"),
            lambda r, angle, ratio: _pick((d <= r) & (ad <= angle) & (overlap(r) >= ratio), -d)),
        "any_near": (("no_road",), lambda most: F.bool_or(d <= most)),
        "nearest": (("nearest_max",), lambda most: _pick(mixed & (d <= most), -d)),
    }
    aggregates, places = {}, []
    for scenario, values in scenarios.items():
        place = [F.lit(scenario).alias("scenario")]
        for rule, (names, pick) in rules.items():
            key = (rule, *[getattr(values, n) for n in names])
            if key not in aggregates:
                aggregates[key] = pick(*key[1:]).alias(f"{rule}_{len(aggregates)}")
            place.append(F.col(f"{rule}_{list(aggregates).index(key)}").alias(rule))
        places.append(F.struct(*place))
    best = pairs.groupBy("walk_edge_id").agg(*aggregates.values())
    return best.select("walk_edge_id", F.explode(F.array(*places)).alias("m")).select("m.scenario", "walk_edge_id", *[f"m.{r}" for r in rules])


def classify(walk: DataFrame, roads: DataFrame, scenarios: dict[str, Rules] | None = None) -> DataFrame:
    """Basis, matched road and score of every walking edge, once per scenario.

    ``walk``: walk_edge_id, walking_type, crosswalk, special (any of overpass, bridge, tunnel, park),
    length_m and a segment. ``roads``: osm_edge_id, road_class, road_name, risk_index, risk_pct and a
    segment. Edges are single segments; bent edges must be cut at their vertices first, and are then
    classified piece by piece.
    """
    scenarios = scenarios or {"default": Rules()}
    walk, roads = cut_lineage(walk), cut_lineage(roads)
    radius = max(
        max(r.crosswalk_max, r.shared_radius, r.no_road, r.nearest_max, r.sep_max, r.local_max) for r in scenarios.values()
    )
    matches = rule_matches(candidate_pairs(walk, roads, radius), scenarios)
    sided = two_sided_edges(walk, roads).withColumn("two_sided", F.lit(True))
    base = with_scenarios(
        walk.select("walk_edge_id", "walking_type", "crosswalk", "special", "length_m"), scenarios
    ).join(sided, "walk_edge_id", "left")
    df = base.withColumn("scenario", F.col("p.scenario")).join(matches, ["scenario", "walk_edge_id"], "left")
    mixed = F.col("walking_type") == MIXED_TYPE
    steps = [  # (condition, basis, matched road, score: the road's pct or a constant)
        ((F.col("crosswalk") == 1) & F.col("cw_cross").isNotNull(), "case_D_crosswalk", "cw_cross", None),
        ((F.col("crosswalk") == 1) & F.col("cw_angle").isNotNull(), "case_D_crosswalk", "cw_angle", None),
        ((F.col("crosswalk") == 1) & F.col("cw_near").isNotNull(), "case_D_crosswalk", "cw_near", None),
        (F.col("crosswalk") == 1, "case_C_no_nearby_road", None, 0.0),
        (F.col("special") == 1, "special_safe_facility", None, 0.0),
        (F.col("crossing").isNotNull(), "case_D_crossing", "crossing", None),
        (F.col("separated").isNotNull(), "case_A_separated", "separated", 0.0),
        (F.col("shared").isNotNull(), "case_B_shared_road", "shared", None),
        (F.col("walking_type").isin(*PEDESTRIAN_TYPES), "case_A_separated", None, 0.0),
        (F.coalesce("two_sided", F.lit(False)) & ~mixed, "case_A_separated_two_sided", None, 0.0),
        (~F.coalesce("any_near", F.lit(False)), "case_C_no_nearby_road", None, 0.0),
        (F.col("nearest").isNotNull(), "case_B_nearest_road", "nearest", "discount"),
    ]
    step = F.coalesce(*[F.when(c, F.lit(i)) for i, (c, *_rest) in enumerate(steps)], F.lit(len(steps)))
    df = df.withColumn("_step", step)
    here = lambda i: F.col("_step") == i

    def road(field: str) -> Column:
        return F.coalesce(*[F.when(here(i), F.col(f"{r}.{field}")) for i, (_, _, r, _) in enumerate(steps) if r])

    discount = distance_discount(F.col("nearest.distance"), F.col("p.shared_radius"), F.col("p.sep_max"), F.col("p.no_road"))
    scores = []
    for i, (_, _, r, s) in enumerate(steps):
        value = F.col(f"{r}.risk_pct") if s is None else (F.col(f"{r}.risk_pct") * discount if s == "discount" else F.lit(s))
        scores.append(F.when(here(i), value))
    basis = F.coalesce(*[F.when(here(i), F.lit(b)) for i, (_, b, *_r) in enumerate(steps)], F.lit("unclassified"))
    subtype = (
        F.when(here(6), F.when(F.col("separated.k0") == 1, "parallel_separated").otherwise("named_local_parallel_separated"))
        .when(here(8), "walking_type_only").when(here(9), "two_sided")
    )
    return df.select(
        "scenario", "walk_edge_id", "walking_type", "length_m", basis.alias("basis"),
        subtype.alias("subtype"), road("road_id").alias("matched_road_id"), road("risk_index").alias("matched_risk_index"),
        road("risk_pct").alias("matched_risk_pct"), F.coalesce(*scores).alias("score"),
        F.when(here(0), F.col("cw_cross.distance")).when(here(1), F.col("cw_angle.mid_distance"))
        .when(here(2), F.col("cw_near.mid_distance")).when(here(5), F.col("crossing.mid_distance"))
        .when(here(6), F.col("separated.distance")).when(here(7), F.col("shared.distance"))
        .when(here(11), F.col("nearest.distance")).alias("distance_m"),
    )


def exclude_outside(walk: DataFrame, boundary: DataFrame, forest: DataFrame, ring: str = "ring") -> DataFrame:
    """Drop edges whose midpoint is outside every boundary area or inside a forest area."""
    mids = walk.select("walk_edge_id", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    inside = S.points_in_rings(mids, boundary.select(ring), "walk_edge_id", ring, "mx", "my").select("walk_edge_id")
    wooded = S.points_in_rings(mids, forest.select(ring), "walk_edge_id", ring, "mx", "my").select("walk_edge_id")
    return walk.join(inside, "walk_edge_id", "left_semi").join(wooded, "walk_edge_id", "left_anti")


def demote_far_crosswalks(scored: DataFrame, limit: float = 80.0) -> DataFrame:
    """Crosswalk edges matched beyond ``limit`` become 'no nearby road' with score 0 and a note."""
    far = (F.col("basis") == "case_D_crosswalk") & (F.col("distance_m") > limit)
    far = F.coalesce(far, F.lit(False))
    return scored.withColumns({
        "note": F.when(far, F.lit("crosswalk_beyond_limit")),
        "score": F.when(far, F.lit(0.0)).otherwise(F.col("score")),
        "matched_road_id": F.when(~far, F.col("matched_road_id")),
        "basis": F.when(far, F.lit("case_C_no_nearby_road")).otherwise(F.col("basis")),
    })


def case_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Case counts before and after a correction, and their difference."""
    both = before.select("basis", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select("basis", F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return both.groupBy("basis").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after")).withColumn(
        "change", F.col("n_after") - F.col("n_before")
    )


SHORT_M, TOP_RISK, HIGH_RISK = 5.0, 0.95, 0.8  # fixed values of the report
FACILITY_FLAGS = ("overpass", "bridge", "tunnel", "building", "park_green")


def validation_report(scored: DataFrame, walk: DataFrame) -> DataFrame:
    """Checks of a table scored under one set of rules as (check, item, value) rows.

    ``walk`` has the flags of the edges; of the facility flags those that it has are counted. Means and quantiles
    leave out missing scores; without any score they are null.
    """
    from kerbline.operators.ranking import quantiles

    flags = [c for c in FACILITY_FLAGS if c in walk.columns]
    df = scored.join(walk.select("walk_edge_id", "crosswalk", *flags), "walk_edge_id")
    basis, score = F.col("basis"), F.col("score")
    short, shared = F.col("length_m") < SHORT_M, basis == "case_B_shared_road"
    checks = {
        "totals": {
            "rows": F.lit(True), "unclassified": basis == "unclassified", "score_missing": score.isNull(),
            "score_out_of_range": (score < 0) | (score > 1), "zero_score": score == 0, "high_score": score >= HIGH_RISK, "top_risk": score >= TOP_RISK,
            "demoted_crosswalks": (F.col("crosswalk") == 1) & (basis == "case_C_no_nearby_road"), "short_links": short, "short_shared": short & shared},
        "facility_flags": {c: (basis == "special_safe_facility") & (F.col(c) == 1) for c in flags},
    }
    named = {f"{check}:{item}": F.count_if(rule).cast("double") for check, rules in checks.items() for item, rule in rules.items()}
    one = df.agg(*[value.alias(name) for name, value in named.items()], F.avg(score).alias("scores:mean"))
    spread = quantiles(df.filter(score.isNotNull()), "score", [0.25, 0.5, 0.75, 0.95], [f"scores:{q}" for q in ("p25", "median", "p75", "p95")])

    def long(wide: DataFrame) -> DataFrame:
        at = F.split("name", ":")
        return wide.unpivot([], wide.columns, "name", "value").select(at[0].alias("check"), at[1].alias("item"), "value")

    def by(check: str, item: str, rows: Column, value: Column) -> DataFrame:
        return df.filter(rows).groupBy(F.col(item).alias("item")).agg(value.alias("value")).select(F.lit(check).alias("check"), "item", "value")

    count = F.count("*").cast("double")
    parts = [
        long(one), long(spread), by("cases", "basis", F.lit(True), count), by("shared_types", "walking_type", shared, count),
        by("short_cases", "basis", short, count), by("mean_by_type", "walking_type", F.lit(True), F.avg(score)),
    ]
    return reduce(DataFrame.unionByName, parts)


def scenario_summary(scored: DataFrame) -> DataFrame:
    """Case counts and score statistics per scenario."""
    from kerbline.operators.ranking import quantiles

    cases = [F.count_if(F.col("basis") == c).alias(f"n_{c}") for c in CASES]
    basics = scored.groupBy("scenario").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_if(F.col("score") == 0).alias("n_zero"),
        F.count_if(F.col("score") >= 0.8).alias("n_high"), *cases,
    )
    qs = quantiles(scored, "score", [0.5, 0.95], ["median", "p95"], ["scenario"])
    return basics.join(qs, "scenario")


def scenario_range(summary: DataFrame, metrics: list[str], base: str = "default") -> DataFrame:
    """Per metric: base value, smallest and largest value, and their relative change from the base."""
    long = summary.select(
        "scenario", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e")
    ).select("scenario", "e.metric", "e.v")
    out = long.groupBy("metric").agg(
        F.max(F.when(F.col("scenario") == base, F.col("v"))).alias("base"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    return out.withColumns({
        "low_change": F.try_divide(F.col("low"), F.col("base")) - 1, "high_change": F.try_divide(F.col("high"), F.col("base")) - 1,
    })


def display_layers(walk_scored: DataFrame, roads: DataFrame) -> DataFrame:
    """Both scored tables in one display schema with rounding and defaults."""
    w = walk_scored.select(
        F.lit("walk").alias("layer"), F.col("walk_edge_id").cast("string").alias("id"),
        F.round(F.coalesce("score", F.lit(0.0)), 3).alias("value"), F.coalesce("basis", F.lit("unclassified")).alias("label"),
    )
    r = roads.select(
        F.lit("road").alias("layer"), F.col("osm_edge_id").alias("id"), F.round(F.coalesce("risk_pct", F.lit(0.0)), 3).alias("value"),
        F.coalesce("road_class", F.lit("unknown")).alias("label"),
    )
    return w.unionByName(r)
