"""Road risk index: physical links, mapped features, correlation-selected z-scores, group weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geometry import distance
from kerbline.operators import spatial as S
from kerbline.operators import stats as ST
from kerbline.operators.frames import mixed_aggregate
from kerbline.operators.ranking import deciles, first_per_key, pct_rank, quantiles
from kerbline.session import cut_lineage

# Drivable classes, hourly volumes and usual lanes per class, limits.
ROAD_CLASSES = [
    "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "residential", "living_street", "busway", "service", "unclassified",
]
CLASS_VOLUME = {
    "trunk": 2275.0, "trunk_link": 940.0, "primary": 1800.0, "primary_link": 800.0, "secondary": 480.0, "secondary_link": 320.0,
    "tertiary": 260.0, "tertiary_link": 90.0, "residential": 80.0, "living_street": 30.0, "busway": 600.0, "service": 30.0,
    "unclassified": 80.0,
}
DEFAULT_VOLUME = 80.0
USUAL_LANES = {"primary": 4.0, "secondary": 2.5, "tertiary": 2.0, "residential": 1.0, "service": 1.0, "living_street": 1.0}
MIN_LENGTH, DENSITY_CAP, FACILITY_RADIUS, WIDE_LANES = 20.0, 8.0, 80.0, 6


def _by_class(table: dict[str, float], default: float) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col("road_class")), F.lit(default))


def physical_id(u="u", v="v", key="key") -> Column:
    """Undirected link id from the text forms of both ends and the key."""
    a, b = F.col(u).cast("string"), F.col(v).cast("string")
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b), F.col(key))


def base_network(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drivable edges, and the nodes they use."""
    kept = edges.filter(F.col("road_class").isin(*ROAD_CLASSES))
    ends = kept.select(F.col("u").alias("n")).union(kept.select("v"))
    return kept, nodes.join(ends, "n", "left_semi")


def collapse(edges: DataFrame, mean_columns: list[str], key: str = "physical_edge_id") -> DataFrame:
    """One row per physical link: text and geometry of its longest row (smaller id on ties), mean or
    maximum of the numbers, and the number of directed edges."""
    geometry = [c for c in ("x1", "y1", "x2", "y2") if c in edges.columns]
    texts = [c for c, k in edges.dtypes if k == "string" and c not in (key, "osm_edge_id")]
    order = [-F.coalesce("length_m", F.lit(-1.0)), F.col("osm_edge_id")]
    rep = first_per_key(edges, [key], order, texts + geometry)
    numbers = mixed_aggregate(edges.drop("u", "v", *geometry), key, mean_columns)
    count = edges.groupBy(key).agg(F.count("*").alias("directed_edge_count"))
    return rep.join(numbers, key).join(count, key)


def collapse_report(edges: DataFrame, key: str = "physical_edge_id") -> DataFrame:
    """Edges before and after, how many were merged, and how many links had several edges."""
    per = edges.groupBy(key).agg(F.count("*").alias("c"))
    return per.agg(
        F.sum("c").alias("before_directed"), F.count("*").alias("after_physical"),
        (F.sum("c") - F.count("*")).alias("collapsed"), F.count_if(F.col("c") > 1).alias("duplicate_groups"),
    )


def nearest_facilities(edges: DataFrame, points: DataFrame, category: str, radius: float = FACILITY_RADIUS) -> DataFrame:
    """Points of a category per physical link (nearest edge within ``radius``) and their mean distance."""
    pts = points.filter(F.col("category") == category)
    hit = S.nearest_within(pts, edges, radius, "fid", "osm_edge_id", carry=["physical_edge_id"])
    return hit.groupBy("physical_edge_id").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance"))


def incident_facilities(edges: DataFrame, nodes: DataFrame, points: DataFrame, radius: float = FACILITY_RADIUS) -> DataFrame:
    """Points snapped to their nearest node and passed to all edges at that node: count and equal shares."""
    snapped = S.nearest_within(points, S.points_as_segments(nodes), radius, "fid", "n")
    per_node = snapped.groupBy("n").agg(F.count("*").alias("c"))
    ends = edges.select("osm_edge_id", F.explode(F.array("u", "v")).alias("n")).distinct()
    degree = ends.groupBy("n").agg(F.count("*").alias("deg"))
    weighted = per_node.join(degree, "n")
    return ends.join(weighted, "n").groupBy("osm_edge_id").agg(
        F.sum("c").alias("n_points"), F.sum(F.col("c") / F.col("deg")).alias("weight")
    )


def estimated_volume(lanes="lanes") -> Column:
    """Class volume scaled by lanes over the usual lanes, at least one half; two decimals.

    Text that is no number counts as one lane; a missing number gives the factor one half.
    """
    number = F.when(F.col(lanes).isNotNull(), F.coalesce(F.col(lanes).cast("string").try_cast("double"), F.lit(1.0)))
    factor = F.greatest(F.lit(0.5), F.coalesce(number / _by_class(USUAL_LANES, 1.0), F.lit(0.5)))
    return F.rint(_by_class(CLASS_VOLUME, DEFAULT_VOLUME) * factor * 100) / 100


def inverse_speed(speed="speed_kmh") -> Column:
    """One over the speed, which counts as 1 at least; 0 where it is unknown."""
    return F.when(F.col(speed).isNull(), 0.0).otherwise(F.lit(1.0) / F.greatest(F.col(speed), F.lit(1.0)))


def density_100m(count: str, length: str = "length_m", line: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Column:
    """Objects per 100 m; a link without a length is measured on its line."""
    metres = F.coalesce(F.col(length), distance(*line))
    return F.least(F.greatest(F.coalesce(F.col(count), F.lit(0)) / F.greatest(metres, F.lit(MIN_LENGTH)) * 100, F.lit(0.0)), F.lit(DENSITY_CAP))


def positive_cap(df: DataFrame, column: str, out: str, q: float = 0.95) -> DataFrame:
    """Cap at the q-quantile of the positive values, which is taken as at least 1."""
    value = F.greatest(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn(out, value)
    cap = quantiles(df.filter(F.col(out) > 0), out, [q], ["cap"]).select(F.greatest("cap", F.lit(1.0)).alias("cap"))
    return ST.attach(df, cap, "_cap").withColumn(out, F.least(out, F.coalesce("_cap.cap", F.lit(0.0)))).drop("_cap")


def overlap_with_zones(roads: DataFrame, zones: DataFrame, line_id: str = "osm_edge_id") -> DataFrame:
    """Metres inside zones, share of the length (0 to 1) and flag per road."""
    hit = S.segments_in_rings(roads.select(line_id, "x1", "y1", "x2", "y2"), zones.select("zone_id", "ring"), line_id)
    per = hit.groupBy(line_id).agg(F.sum("inter_len").alias("zone_len"))
    df = roads.join(per, line_id, "left").withColumn("zone_len", F.coalesce("zone_len", F.lit(0.0)))
    share = F.coalesce(F.try_divide(F.col("zone_len"), distance("x1", "y1", "x2", "y2")), F.lit(0.0))
    return df.withColumns({
        "zone_share": F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), "zone_flag": (F.col("zone_len") > 0).cast("int"),
    })


def risk_index(
    edges: DataFrame, features: list[str], target: str, groups: dict[str, list[str]], id_column: str
) -> DataFrame:
    """Score links: Σ z of the selected square-root features × the product of the group weights.

    ``groups`` maps a group to its 0/1 flag columns; a link gets the group's weight when any flag is
    set. A feature counts when |r| with the target reaches the mean |r| of all features (none: all).
    Everything the score needs from the whole table is one row of statistics from a single pass.
    """
    roots = {f: f"{f}_sqrt" for f in features}
    df = edges.withColumns({r: ST.sqrt_clip(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f, r in roots.items()})
    flags = [c for cols in groups.values() for c in cols]
    aggs = []
    for f, r in roots.items():
        aggs += [F.coalesce(ST.pearson(r, target), F.lit(0.0)).alias(f"r_{f}"), F.avg(r).alias(f"m_{f}"), F.stddev_pop(r).alias(f"s_{f}")]
    aggs += [F.abs(F.coalesce(ST.pearson(F.col(c).cast("double"), target), F.lit(0.0))).alias(f"g_{c}") for c in flags]
    stats = df.agg(*aggs)
    df = ST.attach(df, stats)
    st = lambda name: F.col(f"_s.{name}")
    limit = sum((F.abs(st(f"r_{f}")) for f in features), F.lit(0.0)) / F.lit(float(len(features)))
    any_selected = F.lit(False)
    for f in features:
        any_selected = any_selected | (F.abs(st(f"r_{f}")) >= limit)
    total = F.lit(0.0)
    for f, r in roots.items():
        chosen = (F.abs(st(f"r_{f}")) >= limit) | ~any_selected
        total = total + F.when(chosen, ST.zscore(F.col(r), st(f"m_{f}"), st(f"s_{f}"))).otherwise(0.0)
    strength = {g: F.greatest(*[st(f"g_{c}") for c in cols]) if len(cols) > 1 else st(f"g_{cols[0]}") for g, cols in groups.items()}
    r_sum = sum(strength.values(), F.lit(0.0))
    weight = F.lit(1.0)
    out = {}
    for g, cols in groups.items():
        on = F.lit(False)
        for c in cols:
            on = on | (F.col(c) == 1)
        out[f"{g}_weight"] = F.when(on, ST.group_weight(strength[g], r_sum)).otherwise(F.lit(1.0))
        weight = weight * F.col(f"{g}_weight")
    df = df.withColumn("_z", total).withColumns(out).withColumn("final_weight", weight)
    df = df.withColumn("risk_index", F.col("_z") * F.col("final_weight")).withColumn("safety_index", -F.col("risk_index"))
    return df.drop("_s", "_z", *roots.values())


def with_rank_columns(scored: DataFrame, id_column: str) -> DataFrame:
    """Percentile and decile of the risk index (ties by id), from one materialised score table."""
    scored = cut_lineage(scored)
    ranked = cut_lineage(pct_rank(scored, "risk_index", "risk_percentile"))
    return deciles(ranked, "risk_index", id_column, "risk_decile")


def index_features(roads: DataFrame, facilities: DataFrame, accidents: DataFrame, childcare: DataFrame) -> DataFrame:
    """Physical links with every mapped feature, ready for ``risk_index``.

    ``roads``: directed edges. ``facilities``: fid, category, x, y. ``accidents``: acdnt_no, x, y.
    ``childcare``: fid, x, y.
    """
    roads = cut_lineage(roads.withColumn("physical_edge_id", physical_id()))
    links = cut_lineage(collapse(roads, ["length_m", "speed_kmh", "lanes"]).withColumn("osm_edge_id", F.col("physical_edge_id")))
    facility = S.nearest_within(
        facilities.filter(F.col("category").isin("crosswalk", "signal")), roads, FACILITY_RADIUS, "fid", "osm_edge_id", carry=["physical_edge_id"]
    ).join(facilities.select("fid", "category"), "fid")
    counts = facility.groupBy("physical_edge_id").agg(
        F.count_if(F.col("category") == "crosswalk").alias("crosswalk_count"),
        F.count_if(F.col("category") == "signal").alias("signal_count"),
        F.avg(F.when(F.col("category") == "crosswalk", F.col("distance"))).alias("crosswalk_distance_m"),
        F.avg(F.when(F.col("category") == "signal", F.col("distance"))).alias("signal_distance_m"),
    )
    near = S.nearest_within(accidents, links, FACILITY_RADIUS, "acdnt_no", "osm_edge_id").groupBy("osm_edge_id").agg(
        F.count("*").alias("accident_weight")
    )
    care = S.count_within(childcare, links, 300.0, "fid", "osm_edge_id", "child_facility_count")
    df = links.join(counts, "physical_edge_id", "left").join(near, "osm_edge_id", "left").join(care, "osm_edge_id", "left")
    zero = ["crosswalk_count", "signal_count", "accident_weight", "child_facility_count"]
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zero})
    df = df.withColumns({
        "crosswalk_density": density_100m("crosswalk_count"), "signal_density": density_100m("signal_count"),
        "volume": estimated_volume(), "inverse_speed": inverse_speed(), "lanes_known": F.coalesce("lanes", F.lit(0.0)),
    })
    return positive_cap(cut_lineage(df), "child_facility_count", "child_facility_capped")


FEATURES = ["crosswalk_density", "signal_density", "lanes_known", "volume", "inverse_speed", "child_facility_capped"]
GROUPS = {"wide_or_busy": ["wide_flag", "busy_flag"], "child_facility": ["child_flag"]}


def scored_roads(roads: DataFrame, facilities: DataFrame, accidents: DataFrame, childcare: DataFrame) -> DataFrame:
    """The whole road risk job: features, flags, index, percentile and decile."""
    df = cut_lineage(index_features(roads, facilities, accidents, childcare))
    mean = df.agg(F.avg("volume").alias("m"))
    df = ST.attach(df, mean, "_m").withColumns({
        "wide_flag": (F.col("lanes_known") >= WIDE_LANES).cast("int"), "busy_flag": (F.col("volume") > F.col("_m.m")).cast("int"),
        "child_flag": (F.col("child_facility_capped") > 0).cast("int"),
    }).drop("_m")
    return with_rank_columns(risk_index(df, FEATURES, "accident_weight", GROUPS, "osm_edge_id"), "osm_edge_id")


def accidents_per_link(accidents: DataFrame, links: list[str]) -> DataFrame:
    """Accidents counted on every link they name (up to three each)."""
    return accidents.select(F.explode(F.array(*links)).alias("link_id")).filter(F.col("link_id").isNotNull()).groupBy("link_id").agg(
        F.count("*").alias("accidents")
    )


def union_facilities(sources: dict[str, DataFrame]) -> DataFrame:
    """Facility tables (fid, name, x, y) in one frame, tagged with their source."""
    out = None
    for source, df in sources.items():
        one = df.select("fid", "name", F.lit(source).alias("source"), "x", "y")
        out = one if out is None else out.unionByName(one)
    return out


def population_by_dong(rows: DataFrame, dong: str = "dong") -> DataFrame:
    """Mean hourly population per dong with child and elderly shares.

    Age columns are found by name: ``age_0``… are children, ``age_65``… the elderly.
    """
    from kerbline.operators.frames import row_sum_matching

    df = row_sum_matching(row_sum_matching(rows, ["age_0", "age_10"], "child"), ["age_65", "age_70"], "elderly")
    agg = df.groupBy(dong).agg(F.avg("total").alias("total"), F.avg("child").alias("child"), F.avg("elderly").alias("elderly"))
    return agg.withColumns({
        "vulnerable": F.col("child") + F.col("elderly"),
        "child_ratio": F.try_divide(F.col("child"), F.col("total")), "elderly_ratio": F.try_divide(F.col("elderly"), F.col("total")),
    })
