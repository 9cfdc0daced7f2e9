"""Key joins and name matching."""

from pyspark.sql import functions as F

from kerbline.catalog.functions_q import SYL, SYL2
from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.operators import frames as O
from kerbline.operators.skew import salted_join


@query("join_left_count_zero", """select c.c_custkey, count(o.o_orderkey) as n from customer c left join orders o on o.o_custkey=c.c_custkey group by 1""")
def left_count_zero(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return O.left_count(t("customer").select("c_custkey"), "c_custkey", counts, "n")


@query("join_inner_key", "select w.walk_edge_id, w.risk, r.road_class from d_walk w join d_roads r on r.u=w.u and r.v=w.v where r.u<r.v")
def inner_key(t):
    roads = t("d_roads").filter("u < v").select("u", "v", "road_class")
    return t("d_walk").select("walk_edge_id", "risk", "u", "v").join(roads, ["u", "v"]).select("walk_edge_id", "risk", "road_class")


@query("join_feature_fanin", """select l.u, l.v, coalesce(a.n,0) as accidents, coalesce(b.risk,0) as risk from d_lattice l
    left join (select cast(x as bigint) as k, count(*) as n from d_accidents group by 1) a on a.k=l.u
    left join (select u, v, max(risk) as risk from d_walk where walk_edge_id<10000000 group by 1,2) b on b.u=l.u and b.v=l.v""")
def feature_fanin(t):
    a = t("d_accidents").groupBy(F.col("x").cast("bigint").alias("u")).agg(F.count("*").alias("accidents"))
    b = t("d_walk").filter("walk_edge_id<10000000").groupBy("u", "v").agg(F.max("risk").alias("risk"))
    df = t("d_lattice").select("u", "v").join(a, "u", "left").join(b, ["u", "v"], "left")
    return df.fillna({"accidents": 0, "risk": 0.0})


@query("join_admin_dim", """with d as (select n_nationkey as dong, n_name as name from nation where n_nationkey%2=0)
    select p.dong, d.name, round(avg(p.total),6)+0 as total from d_population p left join d on d.dong=p.dong group by 1,2""")
def admin_dim(t):
    dim = t("nation").filter("n_nationkey%2=0").select(F.col("n_nationkey").cast("bigint").alias("dong"), F.col("n_name").alias("name"))
    mean = t("d_population").groupBy("dong").agg(r_to(F.avg("total")).alias("total"))
    return mean.join(dim, "dong", "left")


@query("join_matched_road", """with r as (select case when u<v then osm_edge_id end as id, lanes, speed_kmh, road_class from d_roads where u<v)
    select w.walk_edge_id, coalesce(r.lanes,0) as lanes, coalesce(r.speed_kmh,30) as speed_kmh, coalesce(r.road_class,'unknown') as road_class
    from d_walk w left join r on r.id=case when w.walk_edge_id%9=0 then 'none' else concat(cast(w.u as string),'_',cast(w.v as string),'_0') end""")
def matched_road(t):
    roads = t("d_roads").filter("u < v").select(F.col("osm_edge_id").alias("matched"), "lanes", "speed_kmh", "road_class")
    walk = t("d_walk").select("walk_edge_id", F.when(F.expr("walk_edge_id%9=0"), "none").otherwise(F.concat_ws("_", "u", "v", F.lit("0"))).alias("matched"))
    df = salted_join(walk, roads, ["matched"], ["walk_edge_id"], "left").drop("matched")
    return df.fillna({"lanes": 0.0, "speed_kmh": 30.0, "road_class": "unknown"})


@query("join_positional", """with a as (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) as rn from supplier), b as (select zone_id, row_number() over (order by cx, zone_id) as rn from d_zones)
    select a.s_suppkey, b.zone_id from a join b on a.rn=b.rn""")
def positional(t):
    """Two tables paired by an explicit ordinal, after checking that both have the same number of rows."""
    from kerbline.operators.ranking import row_numbers

    left, right = t("supplier").select("s_suppkey", "s_acctbal"), t("d_zones").select("zone_id", "cx")
    if left.count() != right.count():
        raise ValueError("tables to pair have different lengths")
    a = row_numbers(left, "s_acctbal", "s_suppkey", "ord")
    b = row_numbers(right, "cx", "zone_id", "ord")
    return a.select("s_suppkey", "ord").join(b.select("zone_id", "ord"), "ord").select("s_suppkey", "zone_id")


FUZZY_SCHOOLS = f"select s_suppkey as school, concat({SYL},{SYL2},'초') as short from supplier"
FUZZY_LAYERS = f"select s_suppkey as layer, case s_suppkey%3 when 0 then concat({SYL},{SYL2},'초') when 1 then concat('신',{SYL},{SYL2},'초') else concat({SYL2},'초') end as short from supplier"


@query("join_name_fuzzy", f"""with s as ({FUZZY_SCHOOLS}), l as ({FUZZY_LAYERS}),
    m as (select s.school, l.layer, s.short=l.short as exact from s join l on contains(l.short, s.short) or contains(s.short, l.short)),
    r as (select *, row_number() over (partition by school order by case when exact then 0 else 1 end, layer) as rn from m)
    select school, layer, exact from r where rn=1""")
def name_fuzzy(t):
    from kerbline.plans.exposure import match_layers

    return match_layers(t.sql(FUZZY_SCHOOLS), t.sql(FUZZY_LAYERS)).select("school", "layer", "exact")


@query("set_merge_frames", "select osm_edge_id as id, road_class as kind, cast(null as double) as x from d_roads union all select cast(fid as varchar), category, x from d_facilities")
def merge_frames(t):
    a = t("d_roads").select(F.col("osm_edge_id").alias("id"), F.col("road_class").alias("kind"))
    b = t("d_facilities").select(F.col("fid").cast("string").alias("id"), F.col("category").alias("kind"), "x")
    return a.unionByName(b, allowMissingColumns=True)
