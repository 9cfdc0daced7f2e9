"""Walking-edge safety: every rule of the classification, the whole job, reports and scenarios."""

from pyspark.sql import functions as F

from kerbline.catalog import sqltext as Q
from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.operators import spatial as S
from kerbline.plans import walk_safety as W
from kerbline.session import cut_lineage

WS = ("w.x1", "w.y1", "w.x2", "w.y2")
RS = ("r.x1", "r.y1", "r.x2", "r.y2")
MID = Q.psd("(w.x1+w.x2)/2", "(w.y1+w.y2)/2", *RS)
MAJOR = "('trunk','trunk_link','primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','busway')"


def walk_sql(reach: int = 80) -> str:
    """All pairs of walking edges and roads within ``reach`` by nested comparison, with every measure."""
    p, q = "((r.x1-w.x1)*(w.x2-w.x1)+(r.y1-w.y1)*(w.y2-w.y1))/wl", "((r.x2-w.x1)*(w.x2-w.x1)+(r.y2-w.y1)*(w.y2-w.y1))/wl"
    flat = f"{Q.cross(*WS, 'r.x1', 'r.y1')}=0 and {Q.cross(*WS, 'r.x2', 'r.y2')}=0"
    return f"""rp as (select *, (rank() over (order by risk_index)+(count(*) over (partition by risk_index)-1)/2.0::double)/count(*) over () as pct from d_wroads),
    ww as (select *, greatest(overpass, park_green) as special, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as wl from d_walk),
    near as (select w.walk_edge_id, w.walking_type, w.length_m, r.osm_edge_id as road_id, r.road_class, r.road_name, r.risk_index, r.pct,
        w.x1 as wx1, w.y1 as wy1, w.x2 as wx2, w.y2 as wy2, r.x1 as rx1, r.y1 as ry1, r.x2 as rx2, r.y2 as ry2,
        {Q.ssd(WS, RS)} as d, {Q.angle_diff(Q.angle(*WS), Q.angle(*RS))} as ad, {MID} as md,
        case when {flat} then greatest(least(greatest({p},{q}),wl)-greatest(least({p},{q}),0),0) else 0 end as shared
      from ww w join rp r on greatest(w.x1,w.x2)>=least(r.x1,r.x2)-{reach} and least(w.x1,w.x2)<=greatest(r.x1,r.x2)+{reach}
        and greatest(w.y1,w.y2)>=least(r.y1,r.y2)-{reach} and least(w.y1,w.y2)<=greatest(r.y1,r.y2)+{reach}),
    cand as (select * from near where d<={reach})"""


def walk_input(t):
    return t("d_walk").withColumn("special", F.greatest("overpass", "park_green"))


def road_input(t):
    return W.with_road_pct(t("d_wroads"))


def matches(t, radius: float = 80.0):
    return W.rule_matches(W.candidate_pairs(walk_input(t), road_input(t), radius), {"default": W.Rules()})


CROSS = "ad>=45 and d<=2 and shared<=1"


@query("walk_load", """select walk_edge_id, walking_type, cast(crosswalk as integer) as crosswalk, cast(overpass as integer) as overpass, cast(park_green as integer) as park_green,
    round(case when u%7=0 then sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) else length_m end,6)+0 as length_m from d_walk where u%3<>0 and u%11<>0""")
def walk_load(t):
    """Text rows as they come from the file: numbers as text, a missing length, other districts, broken geometry."""
    w = t("d_walk")
    num = lambda c: F.col(c).cast("string")
    wkt = F.concat(F.lit("LINESTRING("), num("x1"), F.lit(" "), num("y1"), F.lit(", "), num("x2"), F.lit(" "), num("y2"), F.lit(")"))
    rows = w.select(
        "walk_edge_id", F.lit("LINK").alias("kind"), F.when(F.expr("u%3=0"), "other").otherwise("here").alias("district"),
        F.concat(F.col("walking_type"), F.lit(".0")).alias("type_code"), num("crosswalk").alias("crosswalk"), num("overpass").alias("overpass"),
        num("park_green").alias("park_green"), F.when(F.expr("u%7<>0"), num("length_m")).alias("length"),
        F.when(F.expr("u%11=0"), "POINT(1 1)").otherwise(wkt).alias("wkt"),
    )
    df = W.load_walk(rows.unionByName(rows.withColumn("kind", F.lit("NODE"))), "here")
    return df.select("walk_edge_id", "walking_type", "crosswalk", "overpass", "park_green", r_to("length_m").alias("length_m"))


@query("walk_case_crosswalk", f"""with {walk_sql()}, c as (select * from cand where walk_edge_id in (select walk_edge_id from d_walk where crosswalk=1)),
    r1 as (select walk_edge_id, road_id, row_number() over (partition by walk_edge_id order by ad desc, d, pct desc, road_id desc) as rn from c where {CROSS}),
    r2 as (select walk_edge_id, road_id, row_number() over (partition by walk_edge_id order by ad desc, md, road_id desc) as rn from c where md<=80 and ad>=30),
    r3 as (select walk_edge_id, road_id, row_number() over (partition by walk_edge_id order by md, road_id desc) as rn from c where md<=80)
    select w.walk_edge_id, coalesce(r1.road_id, r2.road_id, r3.road_id) as road_id, case when r1.road_id is not null then 1 when r2.road_id is not null then 2 when r3.road_id is not null then 3 else 0 end as step
    from d_walk w left join r1 on r1.walk_edge_id=w.walk_edge_id and r1.rn=1 left join r2 on r2.walk_edge_id=w.walk_edge_id and r2.rn=1
    left join r3 on r3.walk_edge_id=w.walk_edge_id and r3.rn=1 where w.crosswalk=1""")
def walk_case_crosswalk(t):
    m = t("d_walk").filter("crosswalk=1").select("walk_edge_id").join(matches(t), "walk_edge_id", "left")
    return m.select(
        "walk_edge_id", F.coalesce("cw_cross.road_id", "cw_angle.road_id", "cw_near.road_id").alias("road_id"),
        F.when(F.col("cw_cross").isNotNull(), 1).when(F.col("cw_angle").isNotNull(), 2).when(F.col("cw_near").isNotNull(), 3).otherwise(0).alias("step"),
    )


@query("walk_case_special", "select walk_edge_id from d_walk where crosswalk<>1 and (overpass=1 or park_green=1)")
def walk_case_special(t):
    return walk_input(t).filter("crosswalk<>1 and special=1").select("walk_edge_id")


@query("walk_case_crossing", f"""with {walk_sql()}, r as (select walk_edge_id, road_id, md, row_number() over (partition by walk_edge_id order by ad desc, md, pct desc, road_id desc) as rn
    from cand where {CROSS} and walking_type<>'1111') select walk_edge_id, road_id, round(md,6)+0 as mid_distance from r where rn=1""")
def walk_case_crossing(t):
    m = matches(t).filter(F.col("crossing").isNotNull())
    return m.select("walk_edge_id", F.col("crossing.road_id").alias("road_id"), r_to("crossing.mid_distance").alias("mid_distance"))


SEP_SQL = f"""sc as (select *, road_class in {MAJOR} as major, case when road_class in {MAJOR} then 25 else 18 end as lim from cand
      where walking_type='1111' and (road_class in {MAJOR} or (road_class in ('residential','living_street') and lower(trim(coalesce(road_name,''))) not in ('','nan')))),
    {Q.overlap_cte('sc', ('wx1', 'wy1', 'wx2', 'wy2'), ('rx1', 'ry1', 'rx2', 'ry2'), 'lim', 'walk_edge_id, road_id, major, lim, d, ad, pct, risk_index, length_m')},
    sp as (select *, ov/length_m as ratio from ov_final where length_m>=case when major then 20 else 25 end and d>=3 and d<=lim and ad<=case when major then 20 else 15 end
      and ov/length_m>=case when major then 0.55::double else 0.7::double end),
    sep as (select *, row_number() over (partition by walk_edge_id order by major desc, ratio desc, d, pct desc, road_id desc) as rn from sp)"""


@query("walk_case_separated_1111", f"with {walk_sql()}, {SEP_SQL} select walk_edge_id, road_id, major, round(d,6)+0 as distance from sep where rn=1")
def walk_case_separated(t):
    m = matches(t).filter(F.col("separated").isNotNull())
    return m.select("walk_edge_id", F.col("separated.road_id").alias("road_id"), (F.col("separated.k0") == 1).alias("major"), r_to("separated.distance").alias("distance"))


SHARED_OV = Q.overlap_cte("(select * from cand where d<=5)", ("wx1", "wy1", "wx2", "wy2"), ("rx1", "ry1", "rx2", "ry2"), "5",
                          "walk_edge_id, road_id, d, ad, pct, risk_index, length_m")
SHARED_SQL = SHARED_OV.replace("ov_final", "sh_final").replace("ov0", "sh0").replace("ov1", "sh1").replace("ov2", "sh2").replace(
    "ov3", "sh3").replace("ov4", "sh4").replace("ov5", "sh5") + """,
    sh as (select *, row_number() over (partition by walk_edge_id order by d, road_id desc) as rn from sh_final where ad<=30 and ov/length_m>=0.5::double)"""


@query("walk_case_shared", f"with {walk_sql()}, {SHARED_SQL} select walk_edge_id, road_id, round(d,6)+0 as distance from sh where rn=1")
def walk_case_shared(t):
    m = matches(t).filter(F.col("shared").isNotNull())
    return m.select("walk_edge_id", F.col("shared.road_id").alias("road_id"), r_to("shared.distance").alias("distance"))


@query("walk_case_pedestrian_type", "select walk_edge_id from d_walk where walking_type in ('1000','1011')")
def walk_case_pedestrian(t):
    return t("d_walk").filter(F.col("walking_type").isin(*W.PEDESTRIAN_TYPES)).select("walk_edge_id")


def _half(sign: int) -> str:
    n = "sqrt((rx2-rx1)*(rx2-rx1)+(ry2-ry1)*(ry2-ry1))"
    nx, ny = f"(-(ry2-ry1)/{n}*5*{sign})", f"((rx2-rx1)/{n}*5*{sign})"
    mx, my = "((wx1+wx2)/2)", "((wy1+wy2)/2)"
    return f"({Q.psd(mx, my, 'rx1', 'ry1', 'rx2', 'ry2')}<=10 and {Q.psd(mx, my, f'(rx1+{nx})', f'(ry1+{ny})', f'(rx2+{nx})', f'(ry2+{ny})')}<=10)"


TWO_OV = Q.overlap_cte("(select * from cand where d<=10 and ad<=15)", ("rx1", "ry1", "rx2", "ry2"), ("wx1", "wy1", "wx2", "wy2"), "10",
                       "walk_edge_id, road_id, wx1, wy1, wx2, wy2, rx1, ry1, rx2, ry2")
for _i in range(6):
    TWO_OV = TWO_OV.replace(f"ov{_i}", f"ts{_i}")
TWO_SQL = TWO_OV.replace("ov_final", "ts_final") + f""",
    tw as (select walk_edge_id, road_id, {_half(1)} as l, {_half(-1)} as r from ts_final where ov/sqrt(n)>=0.5::double),
    tb as (select road_id from tw group by road_id having bool_or(l) and bool_or(r)),
    two as (select distinct walk_edge_id from tw where (l or r) and road_id in (select road_id from tb))"""


@query("walk_case_two_sided", f"with {walk_sql()}, {TWO_SQL} select walk_edge_id from two")
def walk_case_two_sided(t):
    return W.two_sided_edges(t("d_walk"), road_input(t))


FAR_WALK = "select walk_edge_id, walking_type, length_m, crosswalk, overpass, park_green, x1+u%5*200 as x1, y1, x2+u%5*200 as x2, y2 from d_walk"


@query("walk_case_no_road", """with far as (select walk_edge_id, x1+u%5*4000 as x1, y1, x2+u%5*4000 as x2, y2 from d_walk),
    hit as (select distinct w.walk_edge_id from far w join d_wroads r on greatest(w.x1,w.x2)>=least(r.x1,r.x2)-80 and least(w.x1,w.x2)<=greatest(r.x1,r.x2)+80
      and greatest(w.y1,w.y2)>=least(r.y1,r.y2)-80 and least(w.y1,w.y2)<=greatest(r.y1,r.y2)+80 where """ + Q.ssd(WS, RS) + """<=80)
    select walk_edge_id from far where walk_edge_id not in (select walk_edge_id from hit)""")
def walk_case_no_road(t):
    far = t("d_walk").withColumns({"x1": F.col("x1") + F.col("u") % 5 * 4000, "x2": F.col("x2") + F.col("u") % 5 * 4000})
    hit = W.candidate_pairs(far, road_input(t), 80.0).select("walk_edge_id")
    return far.join(hit, "walk_edge_id", "left_anti").select("walk_edge_id")


NEAR_SQL = """nr as (select *, row_number() over (partition by walk_edge_id order by d, road_id desc) as rn from cand where walking_type='1111')"""
DISC = "greatest(least(case when d<=5 then 1 when d<=25 then 1-0.5::double*(d-5)/20 when d<=80 then 0.5::double-0.5::double*(d-25)/55 else 0 end,1),0)"


@query("walk_case_nearest", f"with {walk_sql()}, {NEAR_SQL} select walk_edge_id, road_id, round(pct*{DISC},6)+0 as score from nr where rn=1")
def walk_case_nearest(t):
    from kerbline.functions.bands import distance_discount

    m = matches(t).filter(F.col("nearest").isNotNull())
    return m.select("walk_edge_id", F.col("nearest.road_id").alias("road_id"),
                    r_to(F.col("nearest.risk_pct") * distance_discount("nearest.distance")).alias("score"))


FULL_SQL = f"""{walk_sql()}, {SEP_SQL}, {SHARED_SQL}, {TWO_SQL}, {NEAR_SQL},
    k1 as (select walk_edge_id, road_id, pct, d, row_number() over (partition by walk_edge_id order by ad desc, d, pct desc, road_id desc) as rn from cand where {CROSS}),
    k2 as (select walk_edge_id, road_id, pct, md, row_number() over (partition by walk_edge_id order by ad desc, md, road_id desc) as rn from cand where md<=80 and ad>=30),
    k3 as (select walk_edge_id, road_id, pct, md, row_number() over (partition by walk_edge_id order by md, road_id desc) as rn from cand where md<=80),
    k4 as (select walk_edge_id, road_id, pct, md, row_number() over (partition by walk_edge_id order by ad desc, md, pct desc, road_id desc) as rn from cand where {CROSS} and walking_type<>'1111'),
    joined as (select w.*, k1.road_id as a1, k1.pct as p1, k1.d as d1, k2.road_id as a2, k2.pct as p2, k2.md as d2, k3.road_id as a3, k3.pct as p3, k3.md as d3,
        k4.road_id as a4, k4.pct as p4, k4.md as d4, sep.road_id as a5, sep.d as d5, sh.road_id as a6, sh.pct as p6, sh.d as d6, two.walk_edge_id is not null as sided, nr.road_id as a7, nr.pct*{DISC.replace('d<', 'nr.d<').replace('(d-', '(nr.d-')} as p7, nr.d as d7,
        exists(select 1 from cand c where c.walk_edge_id=w.walk_edge_id) as anyn
      from ww w left join k1 on k1.walk_edge_id=w.walk_edge_id and k1.rn=1 left join k2 on k2.walk_edge_id=w.walk_edge_id and k2.rn=1
      left join k3 on k3.walk_edge_id=w.walk_edge_id and k3.rn=1 left join k4 on k4.walk_edge_id=w.walk_edge_id and k4.rn=1
      left join sep on sep.walk_edge_id=w.walk_edge_id and sep.rn=1 left join sh on sh.walk_edge_id=w.walk_edge_id and sh.rn=1
      left join two on two.walk_edge_id=w.walk_edge_id left join nr on nr.walk_edge_id=w.walk_edge_id and nr.rn=1),
    stepped as (select *, case when crosswalk=1 and a1 is not null then 1 when crosswalk=1 and a2 is not null then 2 when crosswalk=1 and a3 is not null then 3 when crosswalk=1 then 4
        when special=1 then 5 when a4 is not null then 6 when a5 is not null then 7 when a6 is not null then 8 when walking_type in ('1000','1011') then 9
        when sided and walking_type<>'1111' then 10 when not anyn then 11 when a7 is not null then 12 else 13 end as step from joined),
    scored as (select walk_edge_id, walking_type, length_m,
        case when step in (1,2,3) then 'case_D_crosswalk' when step in (4,11) then 'case_C_no_nearby_road' when step=5 then 'special_safe_facility' when step=6 then 'case_D_crossing'
          when step in (7,9) then 'case_A_separated' when step=8 then 'case_B_shared_road' when step=10 then 'case_A_separated_two_sided' when step=12 then 'case_B_nearest_road' else 'unclassified' end as basis,
        case step when 1 then a1 when 2 then a2 when 3 then a3 when 6 then a4 when 7 then a5 when 8 then a6 when 12 then a7 end as matched_road_id,
        case step when 1 then p1 when 2 then p2 when 3 then p3 when 6 then p4 when 8 then p6 when 12 then p7 when 13 then null else 0 end as score,
        case step when 1 then d1 when 2 then d2 when 3 then d3 when 6 then d4 when 7 then d5 when 8 then d6 when 12 then d7 end as distance_m from stepped)"""


def scored(t, scenarios=None):
    return W.classify(walk_input(t), road_input(t), scenarios)


@query("walk_edge_safety", f"with {FULL_SQL} select walk_edge_id, basis, matched_road_id, round(score,6)+0 as score, round(distance_m,6)+0 as distance_m from scored")
def walk_edge_safety(t):
    return scored(t).select("walk_edge_id", "basis", "matched_road_id", r_to("score").alias("score"), r_to("distance_m").alias("distance_m"))


@query("walk_unclassified", f"with {FULL_SQL} select walk_edge_id from scored where basis='unclassified'")
def walk_unclassified(t):
    return scored(t).filter("basis='unclassified' and score is null").select("walk_edge_id")


@query("walk_reclassify_far_crosswalk", f"""with {FULL_SQL}, a as (select *, case when basis='case_D_crosswalk' and distance_m>0 then 'case_C_no_nearby_road' else basis end as nb from scored),
    k as (select basis as b from a union select nb from a)
    select k.b as basis, cast((select count(*) from a where a.basis=k.b) as bigint) as n_before, cast((select count(*) from a where a.nb=k.b) as bigint) as n_after from k""")
def walk_reclassify(t):
    before = cut_lineage(scored(t))
    after = W.demote_far_crosswalks(before, 0.0)
    return W.case_changes(before, after).select("basis", "n_before", "n_after")


REPORT_RULES = {
    ("totals", "rows"): "true", ("totals", "unclassified"): "basis='unclassified'", ("totals", "score_missing"): "score is null",
    ("totals", "score_out_of_range"): "score<0 or score>1", ("totals", "zero_score"): "score=0", ("totals", "high_score"): "score>=0.8::double",
    ("totals", "top_risk"): "score>=0.95::double", ("totals", "demoted_crosswalks"): "crosswalk=1 and basis='case_C_no_nearby_road'",
    ("totals", "short_links"): "length_m<5", ("totals", "short_shared"): "length_m<5 and basis='case_B_shared_road'",
    ("facility_flags", "overpass"): "basis='special_safe_facility' and overpass=1", ("facility_flags", "park_green"): "basis='special_safe_facility' and park_green=1",
}
COUNTED = "\n    union all ".join(f"select '{c}' as \"check\", '{i}' as item, (count(*) filter ({rule}))::double as value from flagged" for (c, i), rule in REPORT_RULES.items())


@query("walk_validation_report", f"""with {FULL_SQL}, flagged as (select s.*, w.crosswalk, w.overpass, w.park_green from scored s join ww w using (walk_edge_id))
    {COUNTED}
    union all select 'scores', 'mean', round(avg(score),6)+0 from flagged
    union all select 'scores', i, round(v,6)+0 from (select unnest(['p25','median','p75','p95']) as i, unnest(quantile_cont(score, [0.25,0.5,0.75,0.95])) as v from flagged)
    union all select 'cases', basis, count(*)::double from flagged group by basis
    union all select 'shared_types', walking_type, count(*)::double from flagged where basis='case_B_shared_road' group by walking_type
    union all select 'short_cases', basis, count(*)::double from flagged where length_m<5 group by basis
    union all select 'mean_by_type', walking_type, round(avg(score),6)+0 from flagged group by walking_type""")
def walk_validation_report(t):
    return W.validation_report(cut_lineage(scored(t)), walk_input(t)).withColumn("value", r_to("value"))


@query("walk_sensitivity")
def walk_sensitivity(t):
    s = W.scenario_summary(cut_lineage(scored(t, W.SCENARIOS)))
    return s.withColumns({c: r_to(c) for c in ("mean", "median", "p95")})


@query("walk_scenario_range")
def walk_scenario_range(t):
    summary = W.scenario_summary(cut_lineage(scored(t, W.SCENARIOS)))
    df = W.scenario_range(summary, ["mean", "median", "n_zero", "n_high"])
    return df.withColumns({c: r_to(c) for c in ("base", "low", "high", "low_change", "high_change")})


@query("walk_road_layer", f"""with {FULL_SQL} select 'walk' as layer, cast(walk_edge_id as varchar) as id, round(coalesce(score,0),3)+0 as value, basis as label from scored
    union all select 'road', osm_edge_id, round(pct,3)+0, road_class from rp""")
def walk_road_layer(t):
    df = W.display_layers(scored(t), road_input(t))
    return df.withColumn("value", F.col("value") + F.lit(0.0))
