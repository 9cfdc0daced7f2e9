"""Road risk index: collapse, mapped features, statistics, and the whole scoring job."""

from pyspark.sql import functions as F

from kerbline.catalog import sqltext as Q
from kerbline.catalog.areas import near
from kerbline.catalog.measures import INSIDE_SQL, zone_rings
from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.operators import stats as S
from kerbline.plans import road_risk as R

PHYS = "concat(least(cast(u as string),cast(v as string)),'_',greatest(cast(u as string),cast(v as string)),'_',key)"
ROADS = f"select *, {PHYS} as pid from d_roads"


@query("road_physical_id", f"select osm_edge_id, {PHYS} as physical_edge_id from d_roads")
def physical_id(t):
    return t("d_roads").select("osm_edge_id", R.physical_id().alias("physical_edge_id"))


@query("road_collapse", f"""with r as ({ROADS}), k as (select *, row_number() over (partition by pid order by length_m desc, osm_edge_id) as rn from r),
    a as (select pid, avg(length_m) as length_m, avg(lanes) as lanes, avg(speed_kmh) as speed_kmh, count(*) as c from r group by 1)
    select k.pid as physical_edge_id, k.road_class, k.x1, k.y1, round(a.length_m,6)+0 as length_m, round(a.lanes,6)+0 as lanes, round(a.speed_kmh,6)+0 as speed_kmh, a.c as directed_edge_count
    from k join a on a.pid=k.pid where rn=1""")
def road_collapse(t):
    roads = t("d_roads").withColumn("physical_edge_id", R.physical_id())
    c = R.collapse(roads, ["length_m", "lanes", "speed_kmh"])
    return c.select("physical_edge_id", "road_class", "x1", "y1", r_to("length_m").alias("length_m"), r_to("lanes").alias("lanes"),
                    r_to("speed_kmh").alias("speed_kmh"), "directed_edge_count")


@query("road_collapse_report", f"""with r as ({ROADS}), g as (select pid, count(*) as c from r group by 1) select cast(sum(c) as bigint) as before_directed, count(*) as after_physical,
    cast(sum(c)-count(*) as bigint) as collapsed, count(*) filter (c>1) as duplicate_groups from g""")
def road_collapse_report(t):
    return R.collapse_report(t("d_roads").withColumn("physical_edge_id", R.physical_id()))


@query("road_base_network", "select n from d_nodes where n in (select u from d_roads where road_class<>'service' union select v from d_roads where road_class<>'service')")
def road_base_network(t):
    roads = t("d_roads").withColumn("road_class", F.when(F.col("road_class") == "service", "footway").otherwise(F.col("road_class")))
    return R.base_network(roads, t("d_nodes"))[1].select("n")


@query("road_facility_nearest", f"""with r as ({ROADS}), f as (select fid, x, y from d_facilities where category='crosswalk'),
    p as (select f.fid, r.pid, r.osm_edge_id, {Q.psd('f.x', 'f.y', 'r.x1', 'r.y1', 'r.x2', 'r.y2')} as d from f join r on f.x between least(r.x1,r.x2)-80 and greatest(r.x1,r.x2)+80 and f.y between least(r.y1,r.y2)-80 and greatest(r.y1,r.y2)+80),
    b as (select *, row_number() over (partition by fid order by d, osm_edge_id) as rn from p where d<=80), c as (select pid, count(*) as n, avg(d) as m from b where rn=1 group by 1)
    select r.osm_edge_id, coalesce(c.n,0) as crosswalk_count, round(c.m,6)+0 as mean_distance from r left join c on c.pid=r.pid""")
def road_facility_nearest(t):
    """Counts made on the physical link and copied to both directions."""
    roads = t("d_roads").withColumn("physical_edge_id", R.physical_id())
    near_ = R.nearest_facilities(roads, t("d_facilities"), "crosswalk")
    return roads.join(near_, "physical_edge_id", "left").select(
        "osm_edge_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("crosswalk_count"), r_to("mean_distance").alias("mean_distance"))


VOLUME = """round(case road_class when 'primary' then 1800 when 'secondary' then 480 when 'tertiary' then 260 when 'residential' then 80 else 30 end
    *greatest(0.5::double, coalesce(lanes/case road_class when 'primary' then 4 when 'secondary' then 2.5::double when 'tertiary' then 2 else 1 end,0.5::double)),2)+0"""
TEXT_LANES = VOLUME.replace("coalesce(lanes/", "coalesce((case when u%23=0 then 1 else lanes end)/")


@query("road_volume_estimate", f"select osm_edge_id, {TEXT_LANES} as volume from d_roads")
def road_volume_estimate(t):
    lanes = F.when(F.expr("u%23=0"), "two").otherwise(F.col("lanes").cast("string"))
    return t("d_roads").withColumn("lanes", lanes).select("osm_edge_id", R.estimated_volume().alias("volume"))


@query("road_inverse_speed", "select osm_edge_id, case when u%19=0 then 0 else round(1/greatest(speed_kmh-30,1),6)+0 end as inverse_speed from d_roads")
def road_inverse_speed(t):
    return t("d_roads").withColumn("speed_kmh", F.when(F.expr("u%19<>0"), F.col("speed_kmh") - 30)).select("osm_edge_id", r_to(R.inverse_speed()).alias("inverse_speed"))


@query("road_density_100m", "select osm_edge_id, round(least(greatest((u%12)/greatest(length_m,20)*100,0),8),6)+0 as density from d_roads")
def road_density(t):
    roads = t("d_roads").withColumn("n", F.col("u") % 12).withColumn("length_m", F.when(F.expr("v%17<>0"), F.col("length_m")))
    return roads.select("osm_edge_id", r_to(R.density_100m("n")).alias("density"))


STAT = f"select osm_edge_id, coalesce(lanes,0) as lanes, speed_kmh, length_m, {VOLUME} as volume, cast((u*31+v)%7 as double) as target, cast(5 as double) as flat from d_roads"
STAT_FEATURES = ["lanes", "speed_kmh", "length_m", "volume", "flat"]


def stat_frame(t):
    df = t("d_roads").withColumn("volume", R.estimated_volume())
    return df.select("osm_edge_id", F.coalesce("lanes", F.lit(0.0)).alias("lanes"), "speed_kmh", "length_m", "volume",
                     ((F.col("u") * 31 + F.col("v")) % 7).cast("double").alias("target"), F.lit(5.0).alias("flat"))


def _corr(col: str) -> str:
    return f"coalesce(covar_pop(sqrt({col}),target)/nullif(stddev_pop(sqrt({col}))*stddev_pop(target),0),0)"


@query("stat_corr_matrix", f"with s as ({STAT}) select " + ", ".join(f"round({_corr(c)},6)+0 as {c}" for c in STAT_FEATURES) + " from s")
def corr_matrix(t):
    df = stat_frame(t)
    df = df.withColumns({c: S.sqrt_clip(c) for c in STAT_FEATURES})
    return S.feature_correlations(df, STAT_FEATURES, "target").select(*[r_to(c).alias(c) for c in STAT_FEATURES])


@query("stat_select_features", f"with s as ({STAT}), c as (" + " union all ".join(f"select '{c}' as feature, {_corr(c)} as r from s" for c in STAT_FEATURES)
       + ") select feature, round(r,6)+0 as r, abs(r)>=(select avg(abs(r)) from c) as selected from c")
def select_features(t):
    df = stat_frame(t)
    df = df.withColumns({c: S.sqrt_clip(c) for c in STAT_FEATURES})
    out = S.select_features(S.feature_correlations(df, STAT_FEATURES, "target"), STAT_FEATURES)
    return out.select("feature", r_to("r").alias("r"), "selected")


@query("stat_zscore", f"with s as ({STAT}) select osm_edge_id, round((length_m-avg(length_m) over ())/stddev_pop(length_m) over (),6)+0 as z, 0::double as z_flat from s")
def zscore(t):
    df = stat_frame(t)
    one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in ("length_m", "flat")], *[F.stddev_pop(c).alias(f"s_{c}") for c in ("length_m", "flat")])
    df = S.attach(df, one)
    z = lambda c: S.zscore(F.col(c), F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}"))
    return df.select("osm_edge_id", r_to(z("length_m")).alias("z"), r_to(z("flat")).alias("z_flat"))


@query("stat_group_weight", f"""with s as ({STAT}), c as (select abs({_corr('lanes')}) as a, abs({_corr('volume')}) as b from s)
    select round(1+round(a/(a+b),3),6)+0 as w_lanes, round(1+round(b/(a+b),3),6)+0 as w_volume from c""")
def group_weight(t):
    df = stat_frame(t)
    df = df.withColumns({c: S.sqrt_clip(c) for c in STAT_FEATURES})
    c = S.feature_correlations(df, ["lanes", "volume"], "target")
    total = F.abs("lanes") + F.abs("volume")
    return c.select(r_to(S.group_weight(F.col("lanes"), total)).alias("w_lanes"), r_to(S.group_weight(F.col("volume"), total)).alias("w_volume"))


def _fcorr(flag: str) -> str:
    return f"coalesce(abs(covar_pop({flag},target)/nullif(stddev_pop({flag})*stddev_pop(target),0)),0)"


INDEX_SQL = f"""s as ({STAT}), f as (select *, sqrt(lanes) as l, sqrt(speed_kmh) as sp, sqrt(length_m) as le, sqrt(volume) as vo, case when lanes>=6 then 1::double else 0 end as wide,
      case when volume>(select avg(volume) from s) then 1::double else 0 end as busy, case when speed_kmh>55 then 1::double else 0 end as fast from s),
    c as (select {_corr('lanes')} as r1, {_corr('speed_kmh')} as r2, {_corr('length_m')} as r3, {_corr('volume')} as r4, greatest({_fcorr('wide')},{_fcorr('busy')}) as g1, {_fcorr('fast')} as g2,
      avg(l) as m1, stddev_pop(l) as s1, avg(sp) as m2, stddev_pop(sp) as s2, avg(le) as m3, stddev_pop(le) as s3, avg(vo) as m4, stddev_pop(vo) as s4 from f),
    k as (select *, (abs(r1)+abs(r2)+abs(r3)+abs(r4))/4 as lim from c),
    x as (select f.osm_edge_id, (case when abs(r1)>=lim then (l-m1)/s1 else 0 end)+(case when abs(r2)>=lim then (sp-m2)/s2 else 0 end)+(case when abs(r3)>=lim then (le-m3)/s3 else 0 end)
        +(case when abs(r4)>=lim then (vo-m4)/s4 else 0 end) as z, case when wide=1 or busy=1 then 1+round(g1/(g1+g2),3) else 1 end as w1, case when fast=1 then 1+round(g2/(g1+g2),3) else 1 end as w2 from f cross join k)"""


def index_frame(t):
    df = stat_frame(t)
    df = S.attach(df, df.agg(F.avg("volume").alias("m")), "_m")
    df = df.withColumns({
        "wide": (F.col("lanes") >= 6).cast("int"), "busy": (F.col("volume") > F.col("_m.m")).cast("int"), "fast": (F.col("speed_kmh") > 55).cast("int"),
    }).drop("_m", "flat")
    return R.risk_index(df, ["lanes", "speed_kmh", "length_m", "volume"], "target", {"road": ["wide", "busy"], "speed": ["fast"]}, "osm_edge_id")


@query("stat_flag_weights", f"with {INDEX_SQL} select osm_edge_id, round(w1,6)+0 as road_weight, round(w2,6)+0 as speed_weight, round(w1*w2,6)+0 as final_weight from x")
def flag_weights(t):
    return index_frame(t).select("osm_edge_id", *[r_to(c).alias(c) for c in ("road_weight", "speed_weight", "final_weight")])


@query("road_risk_index", f"with {INDEX_SQL} select osm_edge_id, round(z*w1*w2,6)+0 as risk_index, round(-(z*w1*w2),6)+0 as safety_index from x")
def risk_index(t):
    return index_frame(t).select("osm_edge_id", r_to("risk_index").alias("risk_index"), r_to("safety_index").alias("safety_index"))


@query("road_risk_job")
def risk_job(t):
    """The whole job on physical links: nearest facilities and accidents, childcare buffer, index, ranks."""
    f = t("d_facilities")
    care = f.filter("category='cctv'").select("fid", "x", "y")
    df = R.scored_roads(t("d_roads"), f, t("d_accidents").select("acdnt_no", "x", "y"), care)
    return df.select("osm_edge_id", "directed_edge_count", "crosswalk_count", "signal_count", "child_facility_capped", "accident_weight",
                     *[r_to(c).alias(c) for c in ("crosswalk_density", "volume", "final_weight", "risk_index", "risk_percentile")], "risk_decile")


@query("road_schoolzone_overlap", f"""with {INSIDE_SQL}, z as (select u, v, sum(inter_len) as zl, max(len) as len from inside group by 1,2)
    select l.u, l.v, round(coalesce(zl,0),4)+0 as zone_len, round(least(coalesce(zl/len,0),1),6)+0 as zone_share, cast(coalesce(zl,0)>0.001::double as integer) as zone_flag from d_lattice l left join z on z.u=l.u and z.v=l.v""")
def schoolzone_overlap(t):
    roads = t("d_lattice").withColumn("osm_edge_id", F.concat_ws("_", "u", "v"))
    df = R.overlap_with_zones(roads, zone_rings(t))
    return df.select("u", "v", r_to("zone_len", 4).alias("zone_len"), r_to("zone_share").alias("zone_share"), (F.col("zone_len") > 0.001).cast("int").alias("zone_flag"))


@query("population_by_dong", """select dong, round(avg(total),6)+0 as total, round(avg(age_0_14+age_65_up),6)+0 as vulnerable, round(avg(age_0_14)/avg(total),6)+0 as child_ratio,
    round(avg(age_65_up)/avg(total),6)+0 as elderly_ratio from d_population group by 1""")
def population(t):
    df = R.population_by_dong(t("d_population"))
    return df.select("dong", *[r_to(c).alias(c) for c in ("total", "vulnerable", "child_ratio", "elderly_ratio")])


@query("facility_union", """select fid, category as name, 'local' as source, x, y from d_facilities where category in ('crosswalk','signal') union all select zone_id, school_name, 'school', cx, cy from d_zones""")
def facility_union(t):
    a = t("d_facilities").filter(F.col("category").isin("crosswalk", "signal")).select("fid", F.col("category").alias("name"), "x", "y")
    b = t("d_zones").select(F.col("zone_id").alias("fid"), F.col("school_name").alias("name"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return R.union_facilities({"local": a, "school": b})


@query("accidents_per_link_multi", """select link_id, count(*) as accidents from (select event_id%997 as link_id from events union all select event_id%491 from events where event_id%3=0
    union all select user_id from events where event_id%5=0) group by 1""")
def accidents_multi(t):
    e = t("events").select((F.col("event_id") % 997).alias("l1"), F.when(F.expr("event_id%3=0"), F.col("event_id") % 491).alias("l2"),
                           F.when(F.expr("event_id%5=0"), F.col("user_id")).alias("l3"))
    return R.accidents_per_link(e, ["l1", "l2", "l3"])
