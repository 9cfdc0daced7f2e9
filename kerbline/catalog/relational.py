"""Filters, projections, aggregates, ranks, limits and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.catalog.registry import query
from kerbline.functions import text as X
from kerbline.functions.geometry import haversine, r_to
from kerbline.operators import frames as O
from kerbline.operators import ranking as R
from kerbline.operators import stats as S

# --- filters and projections ----------------------------------------------------------------------


@query("filter_valid_coords", "select acdnt_no, x, y from d_accidents where x<>0 and y<>0")
def filter_valid_coords(t):
    return O.valid_coords(t("d_accidents")).select("acdnt_no", "x", "y")


@query("filter_contains", "select doc_id, lang from documents where contains(coalesce(source,''),'e') or contains(lang,'e')")
def filter_contains(t):
    return O.contains_in_any(t("documents").select("doc_id", "lang", "source"), ["source", "lang", "absent"], "e").select("doc_id", "lang")


@query("filter_in_set", "select osm_edge_id, road_class from d_roads where road_class in ('primary','secondary','residential')")
def filter_in_set(t):
    return t("d_roads").filter(F.col("road_class").isin("primary", "secondary", "residential")).select("osm_edge_id", "road_class")


@query("filter_range_korea", """select acdnt_no, 126+x/5000 as lon, 37+y/3000 as lat from d_accidents
    where 126+x/5000 between 126.2::double-0.005::double and 126.7::double+0.005::double
      and 37+y/3000 between 37.1::double-0.005::double and 37.8::double+0.005::double""")
def filter_range_korea(t):
    pts = t("d_accidents").select("acdnt_no", (126 + F.col("x") / 5000).alias("lon"), (37 + F.col("y") / 3000).alias("lat"))
    return O.within_box(pts, "lon", "lat", 126.2, 37.1, 126.7, 37.8, 0.005)


LENGTHS = """select u, v, case when (u+v)%7=0 then 'x' when (u+v)%11=0 then '-1' when (u+v)%13=0 then '0'
    else cast(cast(u%90+1 as double) as string) end as length_text from d_lattice"""


@query("filter_positive_weight", f"""with l as ({LENGTHS}) select u, v, try_cast(length_text as double) as length_text from l
    where try_cast(length_text as double)>0""")
def filter_positive_weight(t):
    return O.positive_weight(t.sql(LENGTHS), "length_text")


@query("project_rename_pick", "select osm_edge_id as link_id, road_class as rank, length_m from d_roads")
def project_rename_pick(t):
    return t("d_roads").select(F.col("osm_edge_id").alias("link_id"), F.col("road_class").alias("rank"), "length_m")


@query("project_pad_missing", "select osm_edge_id, length_m, cast(null as double) as topis_speed, cast(null as varchar) as road_name from d_roads")
def project_pad_missing(t):
    return O.pad_missing(t("d_roads"), [("osm_edge_id", "string"), ("length_m", "double"), ("topis_speed", "double"), ("road_name", "string")])


@query("impute_median", "select osm_edge_id, coalesce(lanes,(select quantile_cont(lanes,0.5) from d_roads)) as lanes from d_roads")
def impute_median(t):
    return O.impute_median(t("d_roads").select("osm_edge_id", "lanes"), "lanes")


@query("impute_zero", "select bld_id, coalesce(floors,0) as floors from d_buildings")
def impute_zero(t):
    return t("d_buildings").select("bld_id", "floors").fillna({"floors": 0.0})


@query("split_safe_risky", """select case when r<=0 then 'safe' else 'risky' end as side, count(*) as n from d_candidates group by 1""")
def split_safe_risky(t):
    return t("d_candidates").groupBy(F.when(F.col("r") <= 0, "safe").otherwise("risky").alias("side")).agg(F.count("*").alias("n"))


@query("project_major_flag", """select osm_edge_id, case when road_class in ('trunk','trunk_link','primary','primary_link','secondary',
    'secondary_link','tertiary','tertiary_link','busway') then true else false end as is_major from d_roads""")
def project_major_flag(t):
    from kerbline.plans.walk_safety import MAJOR_CLASSES

    return t("d_roads").select("osm_edge_id", F.col("road_class").isin(*MAJOR_CLASSES).alias("is_major"))


CLICKS = "select user_id, event_id, cast((event_id/3)%7 as bigint)*0.5 as lat, cast((user_id)%5 as double) as lon from events"


@query("filter_repeat_pin", """with c as (select user_id, event_id, cast((event_id//4)%3 as double)/2 as lat, cast(user_id%5 as double) as lon from events),
    l as (select *, lag(round(lat,6)) over w as plat, lag(round(lon,6)) over w as plon from c window w as (partition by user_id order by event_id))
    select user_id, event_id, lat, lon from l where plat is null or plat<>round(lat,6) or plon<>round(lon,6)""")
def filter_repeat_pin(t):
    clicks = t("events").select(
        "user_id", "event_id", (F.floor(F.col("event_id") / 4) % 3 / 2).cast("double").alias("lat"),
        (F.col("user_id") % 5).cast("double").alias("lon"),
    )
    return O.drop_repeats(clicks, ["user_id"], ["event_id"], [F.round("lat", 6).alias("a"), F.round("lon", 6).alias("b")])


# --- aggregates -----------------------------------------------------------------------------------


@query("agg_count_by_key", "select user_id, severity, count(*) as n from d_accidents group by user_id, severity")
def agg_count_by_key(t):
    return t("d_accidents").groupBy("user_id", "severity").agg(F.count("*").alias("n"))


@query("agg_mean_by_key", "select road_class, round(avg(length_m),6)+0 as mean_length from d_roads group by road_class")
def agg_mean_by_key(t):
    return t("d_roads").groupBy("road_class").agg(r_to(F.avg("length_m")).alias("mean_length"))


@query("agg_ratio", """select dong, round(avg(age_0_14)/avg(total),6)+0 as child_ratio, round(avg(age_65_up)/avg(total),6)+0 as elderly_ratio
    from d_population group by dong""")
def agg_ratio(t):
    return t("d_population").groupBy("dong").agg(
        r_to(F.try_divide(F.avg("age_0_14"), F.avg("total"))).alias("child_ratio"),
        r_to(F.try_divide(F.avg("age_65_up"), F.avg("total"))).alias("elderly_ratio"),
    )


@query("agg_row_sum_pattern", "select dong, hour, round(coalesce(age_0_14,0)+coalesce(age_65_up,0),6)+0 as vulnerable from d_population")
def agg_row_sum_pattern(t):
    return O.row_sum_matching(t("d_population"), ["age_0", "age_65"], "v").select("dong", "hour", r_to("v").alias("vulnerable"))


@query("agg_mixed_mean_max", """select road_class, round(avg(length_m),6)+0 as length_m, max(lanes) as lanes, max(speed_kmh) as speed_kmh
    from d_roads group by road_class""")
def agg_mixed_mean_max(t):
    df = t("d_roads").select("road_class", "length_m", "lanes", "speed_kmh")
    return O.mixed_aggregate(df, "road_class", ["length_m"]).withColumn("length_m", r_to("length_m"))


@query("agg_value_counts", """with c as (select case when u%17=0 then null else road_class end as road_class from d_roads),
    k as (select unnest(['primary','secondary','tertiary','residential','service','living_street','trunk','<null>']) as road_class)
    select k.road_class, count(c.rc) as n from k left join (select coalesce(road_class,'<null>') as rc from c) c on c.rc=k.road_class group by 1""")
def agg_value_counts(t):
    df = t("d_roads").select(F.when(F.col("u") % 17 != 0, F.col("road_class")).alias("road_class"))
    return O.value_counts(df, "road_class", ["primary", "secondary", "tertiary", "residential", "service", "living_street", "trunk"])


@query("agg_score_distribution", """with s as (select case when u%19=0 then null else risk end as risk from d_walk)
    select round(avg(risk),6)+0 as mean, round(quantile_cont(risk,0.5),6)+0 as median, round(quantile_cont(risk,0.25),6)+0 as p25,
      round(quantile_cont(risk,0.75),6)+0 as p75, round(quantile_cont(risk,0.95),6)+0 as p95,
      count(*) filter (risk=0) as n_zero, count(*) filter (risk>=0.8::double) as n_high, count(*) filter (risk is null) as n_null from s""")
def agg_score_distribution(t):
    df = t("d_walk").select(F.when(F.col("u") % 19 != 0, F.col("risk")).alias("risk"))
    d = S.score_distribution(df, "risk")
    return d.select(*[r_to(c).alias(c) for c in ("mean", "median", "p25", "p75", "p95")], "n_zero", "n_high", "n_null")


@query("agg_scalar_mean_positive", "select round(coalesce(avg(risk) filter (risk>0),0.5),6)+0 as r_ref from d_walk")
def agg_scalar_mean_positive(t):
    return t("d_walk").agg(r_to(F.coalesce(F.avg(F.when(F.col("risk") > 0, F.col("risk"))), F.lit(0.5))).alias("r_ref"))


@query("agg_quantile_positive_cap", """select link_id, round(least(greatest(r,0),(select greatest(quantile_cont(r,0.95),1) from d_candidates where r>0)),6)+0 as capped
    from d_candidates""")
def agg_quantile_positive_cap(t):
    df = t("d_candidates").select("link_id", F.greatest("r", F.lit(0.0)).alias("r"))
    cap = R.quantiles(df.filter("r > 0"), "r", [0.95], ["p"]).select(F.greatest("p", F.lit(1.0)).alias("p"))
    return S.attach(df, cap).select("link_id", r_to(F.least("r", F.coalesce(F.col("_s.p"), F.lit(0.0)))).alias("capped"))


@query("agg_centroid_mean", "select school_name, round(avg(x),6)+0 as x, round(avg(y),6)+0 as y from d_gates group by school_name")
def agg_centroid_mean(t):
    return t("d_gates").groupBy("school_name").agg(r_to(F.avg("x")).alias("x"), r_to(F.avg("y")).alias("y"))


@query("agg_collect_sorted", """select school_name, string_agg(gate_type||':'||cast(gate_id as varchar), ',' order by case gate_type when 'main' then 0 else 1 end, gate_id) as gates
    from d_gates group by school_name""")
def agg_collect_sorted(t):
    order = F.struct(F.when(F.col("gate_type") == "main", 0).otherwise(1).alias("o"), "gate_id", "gate_type")
    g = t("d_gates").groupBy("school_name").agg(F.array_sort(F.collect_list(order)).alias("g"))
    return g.select("school_name", F.array_join(F.transform("g", lambda e: F.concat_ws(":", e.gate_type, e.gate_id.cast("string"))), ",").alias("gates"))


@query("agg_distinct_counts", """select count(distinct school_name) as schools, count(*)-count(distinct school_name) as duplicates,
    (select count(distinct school_name) from d_enrollment e where not exists (select 1 from d_gates g where g.school_name=e.school_name and g.gate_type='back')) as without_back
    from d_gates""")
def agg_distinct_counts(t):
    g, e = t("d_gates"), t("d_enrollment")
    extra = e.join(g.filter("gate_type='back'"), "school_name", "left_anti").agg(F.countDistinct("school_name").alias("n"))
    one = g.agg(F.countDistinct("school_name").alias("schools"), (F.count("*") - F.countDistinct("school_name")).alias("duplicates"))
    return S.attach(one, extra).select("schools", "duplicates", F.col("_s.n").alias("without_back"))


@query("agg_total_length_share", """select u%500 as route, count(*) as total, count(*) filter (risk<=0.33::double) as safe,
    count(*) filter (risk>0.33::double and risk<=0.66::double) as warn, count(*) filter (risk>0.66::double) as danger,
    round(sum(case when risk<=0.33::double then length_m else 0 end)/sum(length_m),6)+0 as safe_share, round(sum(length_m),6)+0 as total_m
    from d_walk group by 1""")
def agg_total_length_share(t):
    from kerbline.plans.routing import band_counts

    df = t("d_walk").withColumn("route", F.col("u") % 500)
    return band_counts(df, ["route"]).select(
        "route", "total", "safe", "warn", "danger", r_to(F.col("safe_m") / F.col("total_m")).alias("safe_share"),
        r_to("total_m").alias("total_m"),
    )


@query("agg_flag_counts", """select 'wide' as flag, count(*) filter (lanes>=6) as n from d_roads
    union all select 'fast', count(*) filter (speed_kmh>50) from d_roads union all select 'known_lanes', count(*) filter (lanes is not null) from d_roads""")
def agg_flag_counts(t):
    one = t("d_roads").agg(
        F.count_if(F.col("lanes") >= 6).alias("wide"), F.count_if(F.col("speed_kmh") > 50).alias("fast"),
        F.count_if(F.col("lanes").isNotNull()).alias("known_lanes"),
    )
    return one.unpivot([], ["wide", "fast", "known_lanes"], "flag", "n")


@query("agg_link_exposure", """select l_partkey as link_id, sum(l_quantity) as students, count(*) as paths from lineitem group by 1""")
def agg_link_exposure(t):
    from kerbline.plans.exposure import exposure_of_paths

    paths = t("lineitem").select(F.col("l_partkey").alias("link_id"), F.col("l_quantity").alias("students"))
    return exposure_of_paths(paths, "link_id", "students")


# --- windows and ranks ----------------------------------------------------------------------------


@query("win_pct_rank_avg", """select link_id, round((rank() over (order by r)+(count(*) over (partition by r)-1)/2.0::double)/count(*) over (),9)+0 as pct from d_candidates""")
def win_pct_rank_avg(t):
    return R.pct_rank(t("d_candidates"), "r", "pct").select("link_id", r_to("pct", 9).alias("pct"))


@query("win_decile_qcut", """with c as (select link_id, case when link_id%13<>0 then r end as r from d_candidates)
    select link_id, cast(greatest(1,ceil((row_number() over (order by r,link_id)-1)*10.0::double/(count(*) over ()-1))) as integer) as decile from c where r is not null
    union all select link_id, null from c where r is null""")
def win_decile_qcut(t):
    c = t("d_candidates").withColumn("r", F.when(F.expr("link_id%13<>0"), F.col("r")))
    return R.deciles(c, "r", "link_id").select("link_id", "decile")


@query("win_first_per_key", """select user_id, acdnt_no, x from (select *, row_number() over (partition by user_id order by x desc, acdnt_no) rn from d_accidents) where rn=1""")
def win_first_per_key(t):
    return R.first_per_key(t("d_accidents"), ["user_id"], [-F.col("x"), F.col("acdnt_no")], ["acdnt_no", "x"])


@query("win_rank_in_group", """select link_id, cast(floor(rank() over (partition by is_sz order by e desc)+(count(*) over (partition by is_sz,e)-1)/2.0::double) as bigint) as track_rank,
    (case is_sz when 1 then 'A' else 'B' end)||'-#'||cast(cast(floor(rank() over (partition by is_sz order by e desc)+(count(*) over (partition by is_sz,e)-1)/2.0::double) as bigint) as varchar) as label
    from d_candidates""")
def win_rank_in_group(t):
    from kerbline.plans.shortlist import rank_in_track

    df = t("d_candidates").withColumn("track", F.when(F.col("is_sz") == 1, "A").otherwise("B"))
    return rank_in_track(df, "track", "e").select("link_id", "track_rank", F.col("track_label").alias("label"))


@query("win_share_of_total", """select o_orderkey, round(o_totalprice/sum(o_totalprice) over (partition by o_custkey),9)+0 as share from orders""")
def win_share_of_total(t):
    from kerbline.plans.exposure import share_of_total

    return share_of_total(t("orders"), "o_custkey", "o_totalprice", "share").select("o_orderkey", r_to("share", 9).alias("share"))


RUN_EDGES = "select u%200 as route, walk_edge_id as edge_id, risk, length_m from d_walk"
RUN_SQL = f"""with e as ({RUN_EDGES}), s as (select *, case when risk>0.66::double and not coalesce(lag(risk>0.66::double) over w,false) then 1 else 0 end as st from e window w as (partition by route order by edge_id)),
    r as (select *, sum(st) over (partition by route order by edge_id) as run from s)"""


@query("win_runs", RUN_SQL + " select route, count(distinct run) as runs, count(*) as edges from r where risk>0.66::double group by route")
def win_runs(t):
    runs = O.runs_above(t.sql(RUN_EDGES), ["route"], "edge_id", "risk", 0.66)
    per = runs.groupBy("route", "run").agg(F.count("*").alias("c"))
    return per.groupBy("route").agg(F.count("*").alias("runs"), F.sum("c").alias("edges"))


@query("win_run_representative", RUN_SQL + """ , h as (select *, row_number() over (partition by route,run order by risk desc, edge_id) as rn, sum(length_m) over (partition by route,run) as len, count(*) over (partition by route,run) as n from r where risk>0.66::double)
    select route, edge_id, risk, round(len,6)+0 as length_m, n as n_edges from h where rn=1""")
def win_run_representative(t):
    runs = O.runs_above(t.sql(RUN_EDGES), ["route"], "edge_id", "risk", 0.66)
    return O.run_representatives(runs, ["route"], "edge_id", "risk", "length_m", "edge_id").select(
        "route", "edge_id", "risk", r_to("length_m").alias("length_m"), "n_edges"
    )


@query("win_consecutive_dedupe", """with w as (select user_id as trip, event_id as seq, cast((event_id//5)%6 as double) as x, cast((event_id//10)%3 as double) as y from events),
    l as (select *, lag(x) over q as px, lag(y) over q as py from w window q as (partition by trip order by seq))
    select trip, seq, x, y from l where px is null or px<>x or py<>y""")
def win_consecutive_dedupe(t):
    w = t("events").select(
        F.col("user_id").alias("trip"), F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 5) % 6).cast("double").alias("x"), (F.floor(F.col("event_id") / 10) % 3).cast("double").alias("y"),
    )
    return O.drop_repeats(w, ["trip"], ["seq"], [F.col("x"), F.col("y")])


@query("win_flag_above_mean", "select osm_edge_id, coalesce(cast(lanes>(select avg(lanes) from d_roads) as integer),0) as flag from d_roads")
def win_flag_above_mean(t):
    return O.flag_above_mean(t("d_roads").select("osm_edge_id", "lanes"), "lanes", "flag").select("osm_edge_id", "flag")


# --- sorts, limits, sets --------------------------------------------------------------------------


@query("sort_desc_output", "select user_id, count(*) as n from d_accidents group by user_id order by n desc, user_id")
def sort_desc_output(t):
    return t("d_accidents").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id")


@query("topk_capacity", "select link_id, e from d_candidates order by e desc, link_id limit 111")
def topk_capacity(t):
    from kerbline.plans.shortlist import capacity

    n, _ = capacity(2_000_000_000, 18_000_000, 150)
    return R.top_k(t("d_candidates").select("link_id", "e"), n, F.desc("e"), F.col("link_id"))


@query("topk_cases", "select walk_edge_id, round(risk*length_m,6)+0 as score from d_walk order by risk*length_m desc, walk_edge_id limit 10")
def topk_cases(t):
    df = t("d_walk").withColumn("s", F.col("risk") * F.col("length_m"))
    return R.top_k(df, 10, F.desc("s"), F.col("walk_edge_id")).select("walk_edge_id", r_to("s").alias("score"))


FACTORS = """select walk_edge_id, 'traffic' as k, risk as w from d_walk union all select walk_edge_id, 'accident', (walk_edge_id%7)/cast(10 as double) from d_walk
    union all select walk_edge_id, 'facility', (walk_edge_id%5)/cast(8 as double) from d_walk union all select walk_edge_id, 'speed', (walk_edge_id%11)/cast(12 as double) from d_walk"""


@query("topk_factors", f"""with f as ({FACTORS}) select walk_edge_id, string_agg(k, ',' order by w desc, k) as top from
    (select *, row_number() over (partition by walk_edge_id order by w desc, k) rn from f) where rn<=3 group by walk_edge_id""")
def topk_factors(t):
    from kerbline.plans.explain import top_factors

    m = F.col("walk_edge_id")
    arr = F.array(*[
        F.struct(w.cast("double").alias("weighted"), F.lit(k).alias("key"))
        for k, w in (("traffic", F.col("risk")), ("accident", m % 7 / 10), ("facility", m % 5 / 8), ("speed", m % 11 / 12))
    ])
    return t("d_walk").select("walk_edge_id", F.array_join(F.transform(top_factors(arr, 3), lambda f: f.key), ",").alias("top"))


@query("sample_per_group")
def sample_per_group(t):
    return O.sample_per_group(t("d_accidents").select("user_id", "acdnt_no"), "user_id", "acdnt_no", 25)


@query("set_union_all", "select distinct n from (select u as n from d_roads union all select v from d_roads)")
def set_union_all(t):
    r = t("d_roads")
    return r.select(F.col("u").alias("n")).union(r.select("v")).distinct()


@query("set_difference_report", """with a as (select distinct user_id as k from events where event_id%3=0), b as (select c_custkey as k from customer where c_custkey%2=0)
    select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)""")
def set_difference_report(t):
    a = t("events").filter("event_id%3=0").select(F.col("user_id").alias("k"))
    return O.key_differences(a, t("customer").filter("c_custkey%2=0").select(F.col("c_custkey").alias("k")), "k")


PATHS = """select o_custkey as route, o_orderkey%40 as node, case when o_orderkey%3=0 then 1 else 0 end as mode from orders"""


@query("set_jaccard_paths", f"""with p as (select distinct route, mode, node from ({PATHS})),
    a as (select * from p where mode=0), b as (select * from p where mode=1),
    i as (select a.route, count(*) as c from a join b on a.route=b.route and a.node=b.node group by 1),
    n as (select route, count(distinct node) as u from p group by 1)
    select n.route, round(coalesce(i.c,0)/n.u::double,6)+0 as iou from n left join i on i.route=n.route
    where n.route in (select route from a) and n.route in (select route from b)""")
def set_jaccard_paths(t):
    from kerbline.plans.routing import path_overlap

    p = t.sql(PATHS)
    return path_overlap(p, "route", "mode", "node", 0, 1).select("route", r_to("iou").alias("iou"))


@query("set_edge_keys", """with r as (select distinct least(u,v) as a, greatest(u,v) as b from d_roads), w as (select distinct least(u,v) as a, greatest(u,v) as b from d_walk where crosswalk=1)
    select r.a, r.b from r join w on r.a=w.a and r.b=w.b""")
def set_edge_keys(t):
    def keys(df):
        a, b = O.edge_key("u", "v")
        return df.select(a.alias("a"), b.alias("b"))

    return keys(t("d_roads")).intersect(keys(t("d_walk").filter("crosswalk=1")))
