"""Exposure, graph, routing and explanation queries."""

from pyspark.sql import functions as F

from kerbline.catalog import sqltext as Q
from kerbline.catalog.measures import zone_rings
from kerbline.catalog.registry import query
from kerbline.functions.geometry import distance, r_to
from kerbline.operators import graph as G
from kerbline.operators import spatial as S
from kerbline.plans import explain as X
from kerbline.plans import exposure as E
from kerbline.plans import routing as R
from kerbline.session import cut_lineage

WALK_LINKS = "select u, v, length_m, risk, walk_edge_id as edge_id from d_walk"


def walk_graph(t):
    return G.build_edges(t.sql(WALK_LINKS))


def walk_blocks(t, both):
    """The edges in blocks that are compact on the map."""
    return G.blocks(both, t("d_nodes").select(F.col("n").alias("node"), "x", "y"))


# --- exposure -------------------------------------------------------------------------------------


@query("gates_normalise", """select gate_id, trim(school_name) as school, case when gate_id%5=0 then 'main' else gate_type end as gate_type, x<>0 and y<>0 as valid from d_gates""")
def gates_normalise(t):
    from kerbline.sources.delimited import normalise_gates

    raw = t("d_gates").select(
        "gate_id", F.concat(F.lit(" "), F.col("school_name"), F.lit(" ")).alias("school_name"),
        F.when(F.expr("gate_id%5=0"), F.lit("")).otherwise(F.col("gate_type")).alias("gate_type"), F.col("x").cast("string").alias("lon"), F.col("y").cast("string").alias("lat"),
    )
    return normalise_gates(raw, "main").select("gate_id", F.col("school_name").alias("school"), "gate_type", "valid")


@query("zones_normalise", "select zone_id, concat(regexp_replace(school_name,'[^0-9A-Za-z]','가','g'),'초_res') as layer from d_zones where zone_id%3=0")
def zones_normalise(t):
    from kerbline.sources.delimited import normalise_zones
    from kerbline.functions.text import garble

    city = F.when(F.expr("zone_id%3=0"), "11").otherwise("26")
    raw = t("d_zones").select("zone_id", city.alias("city_code"), garble(F.concat(F.regexp_replace("school_name", "[^0-9A-Za-z]", "가"), F.lit("초통학구역"))).alias("zone_name"))
    return normalise_zones(raw, "11").select("zone_id", "layer")


@query("households_proxy", "select bld_id, cast(round_even(greatest(coalesce(floors/2,1),1),0) as bigint) as households from d_buildings")
def households_proxy(t):
    return t("d_buildings").select("bld_id", E.households(F.col("floors") / 2).alias("households"))


@query("enrollment_load", "select school_name as school, cast(total as bigint) as total from d_enrollment where total is not null")
def enrollment_load(t):
    from kerbline.sources.delimited import load_enrollment

    rows = t("d_enrollment").select("school_name", F.col("total").cast("string").alias("total"), F.lit(1).alias("line"))
    older = rows.select("school_name", F.lit("12").alias("total"), F.lit(0).alias("line")).filter("total is not null")
    bad = rows.select("school_name", F.lit("x").alias("total"), F.lit(2).alias("line"))
    known = rows.filter("total is not null").select("school_name")
    return load_enrollment(rows.union(older.join(known, "school_name", "left_semi")).union(bad), "school_name", "total", "line")


@query("graph_build_network", """with l as (select least(u,v) as a, greatest(u,v) as b, length_m, walk_edge_id as e from d_walk where length_m>0), k as (select *, row_number() over (partition by a, b order by e desc) as rn from l)
    select a, b, round(length_m,6)+0 as length_m, e as edge_id from k where rn=1""")
def graph_build_network(t):
    return G.build_edges(t.sql(WALK_LINKS), keep_last=True).select("a", "b", r_to("length_m").alias("length_m"), "edge_id")


@query("graph_build_risk", """with l as (select least(u,v) as a, greatest(u,v) as b, length_m, risk, walk_edge_id as e from d_walk where length_m>0), k as (select *, row_number() over (partition by a, b order by length_m, e) as rn from l)
    select a, b, round(length_m,6)+0 as length_m, risk, e as edge_id from k where rn=1""")
def graph_build_risk(t):
    return walk_graph(t).select("a", "b", r_to("length_m").alias("length_m"), "risk", "edge_id")


CUT_LINKS = "select u, v, length_m, risk, walk_edge_id as edge_id from d_walk where u%50 not in (17,18) and v%50 not in (17,18)"


@query("graph_components", """with e as (select distinct u, v from d_walk where u%50 not in (17,18) and v%50 not in (17,18))
    select n as node, min(n) over (partition by case when n%50<17 then 0 else 1 end) as component from (select u as n from e union select v from e)""")
def graph_components(t):
    return G.components(G.build_edges(t.sql(CUT_LINKS))).select("node", "component")


@query("graph_largest_component", "select distinct least(u,v) as a, greatest(u,v) as b from d_walk where u%50>18 and v%50>18")
def graph_largest(t):
    return G.largest_component(G.build_edges(t.sql(CUT_LINKS))).select("a", "b")


def school_gates(t):
    """Gates snapped to their nearest node: school, gate (node), gate_type, rank (main first)."""
    near = S.nearest_within(t("d_gates"), S.points_as_segments(t("d_nodes")), 200.0, "gate_id", "n")
    g = t("d_gates").join(near, "gate_id").select(
        F.col("school_name").alias("school"), F.col("n").alias("gate"), "gate_type", F.when(F.col("gate_type") == "main", 0).otherwise(1).alias("rank"), "gate_id")
    best = g.groupBy("school", "gate").agg(F.min(F.struct("rank", "gate_id", "gate_type")).alias("b"))
    return cut_lineage(best.select("school", "gate", "b.gate_type", "b.rank"))


CUTOFF = 10_000.0

# The same start rows in SQL: edges in both directions, gates at their nearest node, homes in the zones, requests at their nearest node.
NET_SQL = f"""eb as (select least(u,v) as a, greatest(u,v) as b, length_m, risk, walk_edge_id as e, row_number() over (partition by least(u,v), greatest(u,v) order by length_m, walk_edge_id) as rn from d_walk where length_m>0 and u<>v),
    ed as (select a as u, b as v, length_m as w, risk from eb where rn=1 union all select b, a, length_m, risk from eb where rn=1),
    gn as (select g.gate_id, g.school_name as school, g.gate_type, n.n, row_number() over (partition by g.gate_id order by {Q.dist('g.x', 'g.y', 'n.x', 'n.y')}, n.n) as rn from d_gates g
      join d_nodes n on n.x between g.x-200 and g.x+200 and n.y between g.y-200 and g.y+200 where {Q.dist('g.x', 'g.y', 'n.x', 'n.y')}<=200),
    sg as (select school, n as gate, min(case when gate_type='main' then 0 else 1 end) as rank from gn where rn=1 group by school, n)"""
HOMES_SQL = f"""{Q.RING_EDGES}, zb as (select zone_id, min(x) as a, max(x) as b, min(y) as c, max(y) as d from d_ring group by zone_id),
    hz as (select b.bld_id, z.zone_id from d_buildings b join zb z on b.x between z.a and z.b and b.y between z.c and z.d join re e on e.zone_id=z.zone_id group by b.bld_id, z.zone_id, b.x, b.y having {Q.in_ring('b.x', 'b.y')}),
    hn as (select b.bld_id, n.n, row_number() over (partition by b.bld_id order by {Q.dist('b.x', 'b.y', 'n.x', 'n.y')}, n.n) as rn from d_buildings b
      join d_nodes n on n.x between b.x-100 and b.x+100 and n.y between b.y-100 and b.y+100 where {Q.dist('b.x', 'b.y', 'n.x', 'n.y')}<=100),
    hm as (select hz.bld_id as home_id, z.school_name as school, hn.n as node, greatest(round_even(coalesce(b.floors,1),0),1)::bigint as households
      from hz join d_zones z on z.zone_id=hz.zone_id join hn on hn.bld_id=hz.bld_id and hn.rn=1 join d_buildings b on b.bld_id=hz.bld_id)"""
REQUESTS_SQL = f"""{Q.RING_EDGES}, zb as (select zone_id, min(x) as a, max(x) as b, min(y) as c, max(y) as d from d_ring group by zone_id),
    qz as (select q_id, min(zone_id) as zone_id from (select q.q_id, z.zone_id from d_requests q join zb z on q.x between z.a and z.b and q.y between z.c and z.d join re e on e.zone_id=z.zone_id
      group by q.q_id, z.zone_id, q.x, q.y having {Q.in_ring('q.x', 'q.y')}) group by q_id),
    qn as (select q.q_id, n.n, row_number() over (partition by q.q_id order by {Q.dist('q.x', 'q.y', 'n.x', 'n.y')}, n.n) as rn from d_requests q
      join d_nodes n on n.x between q.x-300 and q.x+300 and n.y between q.y-300 and q.y+300 where {Q.dist('q.x', 'q.y', 'n.x', 'n.y')}<=300),
    rq as (select q.q_id, qn.n as src, z.school_name as school, q.grade, case when q.style='safe' then 1.5::double else 0.05::double end/(select avg(risk) from d_walk where risk>0) as alpha
      from d_requests q join qn on qn.q_id=q.q_id and qn.rn=1 join qz on qz.q_id=q.q_id join d_zones z on z.zone_id=qz.zone_id)"""


def labels_sql(seeds: str, limit: str = "1e300") -> str:
    """Least-cost labels ``lab`` (gate, alpha, node, best) from ``seeds`` (gate, alpha), relaxed until none improves."""
    return f"""lab(gate, alpha, node, best) using key (gate, alpha, node) as (
      select gate, alpha, gate, {{'cost': 0::double, 'len': 0::double, 'lr': 0::double, 'hops': 0, 'parent': null::bigint}} from {seeds}
      union
      select c.gate, c.alpha, c.node, c.best from (
        select lab.gate, lab.alpha, ed.v as node, min({{'cost': lab.best.cost+ed.w*(1::double+lab.alpha*ed.risk), 'len': lab.best.len+ed.w, 'lr': lab.best.lr+ed.w*ed.risk, 'hops': lab.best.hops+1, 'parent': lab.node}}) as best
        from lab join ed on ed.u=lab.node group by lab.gate, lab.alpha, ed.v) c
      left join recurring.lab o on o.gate=c.gate and o.alpha=c.alpha and o.node=c.node
      where c.best.cost<={limit} and (o.gate is null or c.best<o.best))"""


GATE_LABELS = f"{NET_SQL}, seed as (select distinct gate, 0::double as alpha from sg), {labels_sql('seed', str(CUTOFF))}"
BEST_SQL = f"""with recursive {HOMES_SQL}, {GATE_LABELS},
    hit as (select h.home_id, h.school, h.node, h.households, s.gate, l.best.len as distance, row_number() over (partition by h.home_id, h.school order by l.best.len, s.rank, s.gate) as rn
      from hm h join sg s on s.school=h.school join lab l on l.gate=s.gate and l.node=h.node),
    bg as (select * from hit where rn=1)"""


def trees(t, gates, homes=None):
    return E.gate_trees(walk_blocks(t, G.both_directions(walk_graph(t))), gates, CUTOFF, homes)


def homes(t):
    """Buildings in a school zone with their nearest node: home_id, school, node, households."""
    z = zone_rings(t).select("zone_id", F.col("school_name").alias("school"), "ring")
    inside = S.points_in_rings(t("d_buildings"), z, "bld_id").select(F.col("bld_id").alias("home_id"), "school", "x", "y", E.households("floors").alias("households"))
    node = S.nearest_within(t("d_buildings"), S.points_as_segments(t("d_nodes")), 100.0, "bld_id", "n")
    return cut_lineage(inside.join(node.select(F.col("bld_id").alias("home_id"), F.col("n").alias("node")), "home_id"))


@query("graph_sssp_gate", f"with recursive {GATE_LABELS} select s.school, s.gate, l.node, round(l.best.len,6)+0 as distance, l.best.parent as parent from sg s join lab l on l.gate=s.gate")
def sssp_gate(t):
    return trees(t, school_gates(t)).select("school", "gate", "node", r_to("len").alias("distance"), "parent")


@query("path_best_gate", f"{BEST_SQL} select home_id, school, gate, round(distance,6)+0 as distance from bg")
def path_best_gate(t):
    gates = school_gates(t)
    h = homes(t).select("home_id", "school", "node")
    best = E.best_gate_per_home(h, trees(t, gates, h), gates.select("school", "gate", "rank"))
    return best.select("home_id", "school", "gate", r_to("distance").alias("distance"))


@query("path_reconstruct", f"""{BEST_SQL}, st as (select distinct school, gate, node from bg),
    wk(path_id, gate, pos, node) as (select concat_ws('|', school, gate, node), gate, 0, node from st
      union all select wk.path_id, wk.gate, wk.pos+1, l.best.parent from wk join lab l on l.gate=wk.gate and l.node=wk.node where l.best.parent is not null)
    select path_id, pos::integer as pos, node from wk""")
def path_reconstruct(t):
    """Paths home → gate as ordered node rows (one start per node and school)."""
    gates = school_gates(t)
    h = homes(t).select("home_id", "school", "node")
    tr = cut_lineage(trees(t, gates, h))
    best = E.best_gate_per_home(h, tr, gates.select("school", "gate", "rank"))
    starts = best.select("school", "gate", "node").distinct().withColumn("path_id", F.concat_ws("|", "school", "gate", "node"))
    return G.path_nodes(tr, starts, ["school", "gate"], "path_id").select("path_id", "pos", "node")


@query("path_distance_stats", f"""{BEST_SQL} select school, count(*) as paths, round(avg(distance),6)+0 as mean_m, round(min(distance),6)+0 as min_m, round(max(distance),6)+0 as max_m from bg group by school""")
def path_distance_stats(t):
    gates = school_gates(t)
    h = homes(t).select("home_id", "school", "node")
    best = E.best_gate_per_home(h, trees(t, gates, h), gates.select("school", "gate", "rank"))
    return best.groupBy("school").agg(F.count("*").alias("paths"), *[r_to(f("distance")).alias(n) for n, f in (("mean_m", F.avg), ("min_m", F.min), ("max_m", F.max))])


@query("students_allocate", """with pth as (select a.acdnt_no as path_id, a.x, a.y, z.school_name as school from d_accidents a join d_zones z on z.zone_id=a.user_id%(select count(*) from d_zones)+1),
    k as (select p.path_id, b.bld_id, b.floors, sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) as d from pth p join d_buildings b on b.x between p.x-100 and p.x+100 and b.y between p.y-100 and p.y+100),
    n as (select *, row_number() over (partition by path_id order by d, bld_id) as rn from k where d<=100),
    h as (select p.path_id, p.school, coalesce(cast(greatest(coalesce(n.floors,1),1) as bigint),0) as households from pth p left join n on n.path_id=p.path_id and n.rn=1),
    h2 as (select h.path_id, h.school, case when exists(select 1 from n where n.path_id=h.path_id and n.rn=1) then h.households else 0 end as households from h)
    select h2.path_id, h2.school, h2.households, round(coalesce(h2.households/nullif(sum(h2.households) over (partition by h2.school),0)::double*e.total,0),4)+0 as students from h2 left join d_enrollment e on e.school_name=h2.school""")
def students_allocate(t):
    zones = t("d_zones").agg(F.count("*").alias("n"))
    paths = t("d_accidents").withColumn("zone_id", F.col("user_id") % zones.scalar() + 1).join(t("d_zones").select("zone_id", "school_name"), "zone_id").select(
        F.col("acdnt_no").alias("path_id"), F.col("school_name").alias("school"), "x", "y")
    h = t("d_buildings").select(F.col("bld_id").alias("home_id"), "x", "y", E.households("floors").alias("households"))
    e = t("d_enrollment").select(F.col("school_name").alias("school"), "total")
    return E.allocate_students(paths, h, e, 100.0).withColumn("students", r_to("students", 4))


@query("link_exposure", f"""{BEST_SQL}, tot as (select school, sum(households) as h from bg group by school),
    st as (select bg.school, bg.gate, bg.node, sum(bg.households/tot.h::double*e.total) as students from bg join tot on tot.school=bg.school
      join d_enrollment e on e.school_name=bg.school where e.total is not null group by bg.school, bg.gate, bg.node),
    wk(gate, node, parent, students) as (select st.gate, st.node, l.best.parent, st.students from st join lab l on l.gate=st.gate and l.node=st.node
      union all select wk.gate, wk.parent, l.best.parent, wk.students from wk join lab l on l.gate=wk.gate and l.node=wk.parent where wk.parent is not null)
    select least(node, parent) as a, greatest(node, parent) as b, round(sum(students),4)+0 as students from wk where parent is not null and students>0 group by 1, 2""")
def link_exposure(t):
    """Homes → best gate → students by households → students per link, summed over the gate trees."""
    gates = school_gates(t)
    h = homes(t)
    tr = cut_lineage(trees(t, gates, h))
    best = E.best_gate_per_home(h.select("home_id", "school", "node"), tr, gates.select("school", "gate", "rank"))
    e = t("d_enrollment").select(F.col("school_name").alias("school"), "total").filter("total is not null")
    shares = E.share_of_total(best.join(h.select("home_id", "school", "households"), ["home_id", "school"]), "school", "households", "share")
    starts = shares.join(e, "school").select("school", "gate", "node", (F.col("share") * F.col("total")).alias("students"))
    return E.link_exposure(tr, starts).select("a", "b", r_to("students", 4).alias("students"))


# --- routing --------------------------------------------------------------------------------------


ZONE_FLAG = f"""with {Q.RING_EDGES}, cand as (select w.walk_edge_id, w.x1 as ax, w.y1 as ay, w.x2 as bx, w.y2 as by0, z.zone_id from d_walk w join d_zones z
      on greatest(w.x1,w.x2)>=z.cx-z.half and least(w.x1,w.x2)<=z.cx+z.half and greatest(w.y1,w.y2)>=z.cy-z.half and least(w.y1,w.y2)<=z.cy+z.half),
    hit as (select c.walk_edge_id, c.zone_id, bool_or({Q.ssd(('c.ax', 'c.ay', 'c.bx', 'c.by0'), ('e.x1', 'e.y1', 'e.x2', 'e.y2'))}=0) or {Q.in_ring('c.ax', 'c.ay')} as meets
      from cand c join re e on e.zone_id=c.zone_id group by c.walk_edge_id, c.zone_id, ax, ay)
    select walk_edge_id, walk_edge_id in (select walk_edge_id from hit where meets) as in_zone from d_walk"""


@query("edge_zone_flag", ZONE_FLAG)
def edge_zone_flag(t):
    """Flag by edge id, so parallel edges keep their own."""
    return S.meets_any(t("d_walk"), zone_rings(t).select("ring"), "walk_edge_id").select("walk_edge_id", "in_zone")


@query("alpha_from_persona", """with r as (select avg(risk) as r_ref from d_walk where risk>0) select q_id, round(case when style='safe' then 1.5::double else 0.05::double end/r_ref,6)+0 as alpha,
    round(case when grade<=3 then 0.1::double/r_ref else 0 end,6)+0 as alpha_lo from d_requests cross join r""")
def alpha_from_persona(t):
    return with_alpha(t, t("d_requests")).select("q_id", r_to("alpha_eff").alias("alpha"), r_to("alpha_lo").alias("alpha_lo"))


def with_alpha(t, requests):
    from kerbline.operators.stats import attach

    ref = t("d_walk").agg(F.coalesce(F.avg(F.when(F.col("risk") > 0, F.col("risk"))), F.lit(0.5)).alias("r"))
    df = attach(requests, ref).withColumn("axis", F.when(F.col("style") == "safe", "max").otherwise("min"))
    return df.withColumns({"alpha_eff": R.alpha_for("axis", "_s.r"), "alpha_lo": R.alpha_floor("grade", "_s.r")}).drop("_s")


@query("persona_resolve", """with q as (select q_id, grade, case when style='safe' then 'max' else 'min' end as axis, case q_id%3 when 0 then 0.5::double when 1 then 0.15::double else 0 end as cap from d_requests),
    w as (select *, case when cap=0 then case when axis='max' then 'safe_rush' else 'default' end when axis='max' then case when cap=0.5::double then 'timid' else 'safe_rush' end else case when cap=0.5::double then 'leisurely' else 'default' end end as wanted from q)
    select q_id, wanted, case when wanted in ('leisurely','default') and grade<4 then case wanted when 'leisurely' then 'timid' else 'safe_rush' end else wanted end as persona from w""")
def persona_resolve(t):
    q = t("d_requests").withColumn("axis", F.when(F.col("style") == "safe", "max").otherwise("min")).withColumn(
        "cap", F.when(F.expr("q_id%3=0"), 0.5).when(F.expr("q_id%3=1"), 0.15).otherwise(0.0))
    return R.resolve_persona(q, "axis", "cap", "grade").select("q_id", "wanted", "persona")


@query("cap_from_time", """with s as (select q_id, time_left_min/((x/4+1)/case when grade<=2 then 45 when grade<=4 then 55 else 65 end::double)-1 as slack from d_requests)
    select q_id, case when slack>=0.5::double then 0.5::double when slack>=0.15::double then 0.15::double else 0 end as cap from s""")
def cap_from_time(t):
    return t("d_requests").select("q_id", R.cap_from_time("time_left_min", F.col("x") / 4 + 1, "grade").alias("cap"))


@query("cap_ladder_step", """with c as (select event_id, (event_id%12)/20.0::double as cap, cast(event_id%3-1 as integer) as dir from events),
    s as (select *, case when cap<=0.075::double then 0 when cap<=0.325::double then 1 else 2 end as i from c)
    select event_id, case least(greatest(i+dir,0),2) when 0 then 0::double when 1 then 0.15::double else 0.5::double end as cap from s""")
def cap_ladder_step(t):
    e = t("events").select("event_id", ((F.col("event_id") % 12) / 20.0).alias("cap"), (F.col("event_id") % 3 - 1).cast("int").alias("dir"))
    return e.select("event_id", R.cap_step("cap", "dir").alias("cap"))


@query("route_mode", """select q_id, case when q_id%7=0 or q_id%3=2 then 'shortest' when style='safe' and q_id%3=0 then 'safest' else 'balanced' end as mode,
    case when time_left_min-20>=5 then 'safest' when time_left_min-20>=-2 then 'balanced' else 'shortest' end as slack_mode from d_requests""")
def route_mode(t):
    cap = F.when(F.expr("q_id%3=0"), 0.5).when(F.expr("q_id%3=1"), 0.15).otherwise(0.0)
    axis = F.when(F.col("style") == "safe", "max").otherwise("min")
    return t("d_requests").select("q_id", R.route_mode(axis, cap, F.expr("q_id%7=0")).alias("mode"), R.slack_mode("time_left_min", F.lit(20)).alias("slack_mode"))


@query("route_gate_choice", """with q as (select q_id, z.school_name as school, case when q_id%4=0 then 'back' when q_id%4=2 then 'main' end as pref from d_requests join d_zones z on z.zone_id=q_id%(select count(*) from d_zones)+1)
    select q.q_id, g.gate_id from q join d_gates g on g.school_name=q.school where q.pref=g.gate_type or q.pref is null or not exists (select 1 from d_gates h where h.school_name=q.school and h.gate_type=q.pref)""")
def route_gate_choice(t):
    zones = t("d_zones").agg(F.count("*").alias("n"))
    q = t("d_requests").withColumn("zone_id", F.col("q_id") % zones.scalar() + 1).join(t("d_zones").select("zone_id", F.col("school_name").alias("school")), "zone_id").select(
        "q_id", "school", F.when(F.expr("q_id%4=0"), "back").when(F.expr("q_id%4=2"), "main").alias("preferred"))
    gates = t("d_gates").select(F.col("school_name").alias("school"), F.col("gate_id").alias("gate"), "gate_type")
    return R.choose_gates(q, gates).select("q_id", F.col("gate").alias("gate_id"))


def request_frame(t):
    """Requests with their start node, school (first zone at the point) and risk weights."""
    q = t("d_requests")
    near = S.nearest(q, S.points_as_segments(t("d_nodes")), "q_id", "n", 75.0, limit=300.0)
    node = near.groupBy("q_id").agg(F.min(F.struct("distance", "n")).alias("b")).select("q_id", F.col("b.n").alias("src"))
    z = zone_rings(t).select("zone_id", F.col("school_name").alias("school"), "ring")
    hit = S.points_in_rings(q.select("q_id", "x", "y"), z, "q_id").groupBy("q_id").agg(F.min(F.struct("zone_id", "school")).alias("z"))
    df = q.join(node, "q_id").join(hit.select("q_id", F.col("z.school").alias("school")), "q_id")
    return cut_lineage(with_alpha(t, df).select("q_id", "src", "school", "grade", "style", "axis", "time_left_min", "alpha_eff", "alpha_lo"))


def routed(t, requests=None):
    edges = walk_graph(t)
    both = cut_lineage(G.both_directions(edges))
    comp = G.components(edges)
    req = request_frame(t) if requests is None else requests
    routes, tr = R.capped_routes(walk_blocks(t, both), school_gates(t).select("school", "gate"), comp, req)
    return req, cut_lineage(routes), tr, both


@query("route_shortest", f"""with recursive {REQUESTS_SQL}, {NET_SQL}, seed as (select distinct gate, 0::double as alpha from sg), {labels_sql('seed')}
    select rq.q_id, round(min(l.best.len),6)+0 as length_m from rq left join sg on sg.school=rq.school left join lab l on l.gate=sg.gate and l.node=rq.src group by rq.q_id""")
def route_shortest(t):
    req = request_frame(t)
    edges = walk_graph(t)
    pairs = cut_lineage(R.reachable(req.select("q_id", "src", "school"), school_gates(t), G.components(edges)))
    base = R.baseline(walk_blocks(t, G.both_directions(edges)), pairs)
    best = pairs.join(base, ["src", "gate"]).groupBy("q_id").agg(F.min("len0").alias("m"))
    return req.select("q_id").join(best, "q_id", "left").select("q_id", r_to("m").alias("length_m"))


@query("route_alpha", f"""with recursive {REQUESTS_SQL}, {NET_SQL}, seed as (select distinct sg.gate, rq.alpha from rq join sg on sg.school=rq.school), {labels_sql('seed')},
    k as (select rq.q_id, sg.gate, l.best.len as len, row_number() over (partition by rq.q_id order by l.best.len, sg.gate) as rn
      from rq join sg on sg.school=rq.school join lab l on l.gate=sg.gate and l.alpha=rq.alpha and l.node=rq.src)
    select q_id, gate, round(len,6)+0 as length_m from k where rn=1""")
def route_alpha(t):
    req = request_frame(t)
    edges = walk_blocks(t, G.both_directions(walk_graph(t)))
    pairs = cut_lineage(R.reachable(req.select("q_id", "src", "school", "alpha_eff"), school_gates(t), G.components(walk_graph(t))))
    base = cut_lineage(R.baseline(edges, pairs))
    rows = pairs.join(base, ["src", "gate"]).withColumnRenamed("alpha_eff", "alpha")
    tr = R.weighted_trees(edges, rows.select("gate", "alpha", "src", "len0", "risk0").distinct())
    return R.best_gate(rows.select("q_id", "src", "gate", "alpha"), tr, ["q_id"]).select("q_id", "gate", r_to("length").alias("length_m"))


@query("route_capped")
def route_capped(t):
    _, routes, _, _ = routed(t)
    return routes.select("q_id", "gate", r_to("alpha").alias("alpha"), r_to("length").alias("length_m"), r_to("short_len").alias("short_m"),
                         r_to("detour").alias("detour"), "cap", "warning")


def routed_edges(t):
    req, routes, tr, both = routed(t)
    w = t("d_walk").select(F.col("walk_edge_id").alias("edge_id"), "x1", "y1", "x2", "y2", "crosswalk")
    z = S.meets_any(t("d_walk"), zone_rings(t).select("ring"), "walk_edge_id").select(F.col("walk_edge_id").alias("edge_id"), "in_zone")
    e = R.route_edges(routes, tr, both).join(w, "edge_id").join(z, "edge_id")
    basis = F.when(F.col("crosswalk") == 1, "case_D_crosswalk").otherwise("case_B_shared_road")
    return req, routes, cut_lineage(e.withColumn("basis", basis))


@query("route_metrics")
def route_metrics(t):
    req, routes, e = routed_edges(t)
    m = R.route_metrics(e, routes.join(req.select("q_id", "grade", "axis"), "q_id"))
    return m.select("q_id", r_to("detour").alias("detour"), "minutes", r_to("zone_share").alias("zone_share"), "safe", "warn", "danger", "total", r_to("total_m").alias("total_m"),
                    R.route_mode("axis", "cap", "warning").alias("mode"))


@query("route_geometry")
def route_geometry(t):
    return R.route_geometry(routed_edges(t)[2])


@query("route_danger_runs")
def route_danger_runs(t):
    return X.danger_runs(routed_edges(t)[2], ["q_id"], "pos").select("q_id", "run", "edge_id", "risk", "length_m", "n_edges", "band")


@query("route_compare", f"""with e as (select u%300 as q, case when walk_edge_id%2=0 then 'safe' else 'fast' end as style, length_m, risk from d_walk),
    m as (select q, style, sum(length_m) as len, count(*) filter (risk>0.66::double) as risky from e group by 1,2)
    select a.q, round(a.len-b.len,6)+0 as delta_m, a.risky-b.risky as delta_risky from m a join m b on a.q=b.q and a.style='safe' and b.style='fast'""")
def route_compare(t):
    e = t("d_walk").withColumn("q", F.col("u") % 300).withColumn("safe_", F.col("walk_edge_id") % 2 == 0)
    sign = F.when(F.col("safe_"), 1.0).otherwise(-1.0)
    m = e.groupBy("q").agg(
        F.sum(sign * F.col("length_m")).alias("d"), F.sum(F.when(F.col("risk") > 0.66, sign.cast("bigint")).otherwise(F.lit(0))).alias("r"),
        F.bool_or("safe_").alias("a"), F.bool_or(~F.col("safe_")).alias("b"),
    ).filter("a and b")
    return m.select("q", r_to("d").alias("delta_m"), F.col("r").cast("bigint").alias("delta_risky"))


@query("route_diversity")
def route_diversity(t):
    """Nodes of a zone 150-420 m from its school, three modes each, scored by overlap and spread of length.

    The zones of the derived tables are 300-500 m wide, so the distances are about half of those used on real zones.
    """
    from kerbline.operators.stats import attach

    zones = zone_rings(t).select("zone_id", F.col("school_name").alias("school"), "ring")
    inside = S.points_in_rings(t("d_nodes").select(F.col("n").alias("src"), "x", "y"), zones, "src").select("src", "school")
    centre = t("d_gates").groupBy(F.col("school_name").alias("school")).agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    nodes = t("d_nodes").select(F.col("n").alias("src"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    d = distance("nx", "ny", "gx", "gy")
    starts = inside.distinct().join(nodes, "src").join(centre, "school").filter((d >= 150) & (d <= 420)).select("src", "school")
    ref = t("d_walk").agg(F.avg(F.when(F.col("risk") > 0, F.col("risk"))).alias("r"))
    modes = F.array(*[
        F.struct(F.lit(n).alias("mode"), F.lit(float(a)).alias("d"), F.lit(c).alias("cap")) for n, a, c in (("safest", 1.5, 0.5), ("balanced", 0.05, 0.15), ("shortest", 0.0, 0.0))
    ])
    q = attach(starts, ref).select("src", "school", F.explode(modes).alias("m"), F.col("_s.r").alias("r")).select(
        "src", "school", "m.mode", "m.cap", (F.col("m.d") / F.col("r")).alias("alpha_eff"), F.lit(0.0).alias("alpha_lo"),
        F.concat_ws("|", "school", "src", "m.mode").alias("q_id"))
    q = cut_lineage(q)
    _, routes, tr, both = routed(t, q)
    named = routes.join(q.select("q_id", "school", "mode"), "q_id").withColumn("case_id", F.concat_ws("|", "school", "src"))
    nodes = R.route_edges(routes, tr, both).select("q_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = cut_lineage(nodes.join(named.select("q_id", "case_id", "mode"), "q_id"))
    iou = None
    for a, b in (("safest", "balanced"), ("safest", "shortest"), ("balanced", "shortest")):
        one = R.path_overlap(nodes, "case_id", "mode", "node", a, b)
        iou = one if iou is None else iou.unionByName(one)
    worst = iou.groupBy("case_id").agg(F.min("iou").alias("iou"))
    spread = named.groupBy("case_id").agg(((F.max("length") - F.min("length")) / F.min("length")).alias("spread"), F.count("*").alias("c"), F.min("length").alias("m")).filter("c = 3 and m >= 200")
    out = worst.join(spread, "case_id").withColumn("score", r_to(F.lit(1.0) - F.col("iou") + F.col("spread")))
    return out.orderBy(F.desc("score"), "case_id").limit(10).select("case_id", "score", r_to("iou").alias("iou"), r_to("spread").alias("spread"))


# --- explanation ----------------------------------------------------------------------------------

FACTS = """select walk_edge_id as edge_id, risk as score, case walk_edge_id%8 when 0 then 'case_D_crossing' when 1 then 'case_D_crosswalk' when 2 then 'case_B_shared_road' when 3 then 'case_B_nearest_road'
      when 4 then 'case_A_separated' when 5 then 'special_safe_facility' when 6 then 'case_C_no_nearby_road' else null end as basis,
    case u%4 when 0 then 'primary' when 1 then 'residential' when 2 then 'service' else 'x' end as road_class, case when u%5=0 then null else cast(1+u%7 as double) end as lanes,
    case when u%6=0 then null else cast(20+u%40 as double) end as speed, cast(1 as double)+(u%4)*cast(0.25 as double) as w_traffic, (v%5)*cast(0.5 as double) as w_accident,
    cast(1 as double)+(u%3)*cast(0.015625 as double) as w_facility, u%3 as child_fac, v%2 as elderly_fac, u%2 as crosswalk_n, v%3 as signal_n, u%7=0 as is_school_zone from d_walk"""
FACTOR_SQL = f"""fx as ({FACTS}), fs as (select edge_id, 'traffic' as k, least((w_traffic-1)/0.949::double,1)*0.68::double as w from fx where w_traffic>1
    union all select edge_id, 'accident', least(w_accident/2,1)*0.22::double from fx where w_accident>0 union all select edge_id, 'facility', least((w_facility-1)/0.0281::double,1)*0.04::double from fx where w_facility>1)"""


@query("factor_rank", f"with {FACTOR_SQL} select edge_id, string_agg(k||'='||cast(cast(round(w*1000000) as bigint) as varchar), ',' order by w desc, k) as factors from fs group by 1")
def factor_rank(t):
    f = t.sql(FACTS).withColumn("f", X.ranked_factors()).filter(F.size("f") > 0)
    return f.select("edge_id", F.array_join(F.transform("f", lambda e: F.concat(e.key, F.lit("="), F.round(e.weighted * 1000000).cast("bigint").cast("string"))), ",").alias("factors"))


# Labels, scales and limits of the explanations, as in plans/explain.py.
_LABEL = "case {c} when 'traffic' then '넓은 차도·교통량' when 'accident' then '보행자 사고 이력' when 'facility' then '어린이·노약자 시설 밀집' end"
_CASE = "case basis when 'case_D_crossing' then '차도를 직접 건너는 구간' when 'case_D_crosswalk' then '차도를 건너는 횡단보도' when 'case_B_shared_road' then '차도와 바로 맞붙은 보도' when 'case_B_nearest_road' then '가까운 차도에 노출된 구간' end"
PRIMARY_SQL = f"""{FACTOR_SQL}, top as (select edge_id, arg_max(k, w) as k from fs group by 1), strong as (select edge_id, arg_max(k, w) as k from fs where k<>'facility' and w>=0.1::double group by 1),
    pr as (select fx.*, strong.k as sk, top.k as tk, coalesce({_LABEL.format(c='strong.k')}, {_CASE}, {_LABEL.format(c='top.k')}, '주변 차도 노출') as label from fx left join strong on strong.edge_id=fx.edge_id left join top on top.edge_id=fx.edge_id)"""


@query("factor_primary", f"with {PRIMARY_SQL} select edge_id, label, sk is null and ({_CASE} is not null or tk is null) as is_case from pr")
def factor_primary(t):
    f = t.sql(FACTS).withColumn("f", X.ranked_factors()).withColumn("r", X.primary_reason("f"))
    return f.select("edge_id", F.col("r.label").alias("label"), F.col("r.is_case").alias("is_case"))


@query("factor_notes", f"""with fx as ({FACTS}) select edge_id, concat_ws('|', coalesce({_CASE}, case basis when 'case_A_separated' then '차도와 분리된 보행로' when 'special_safe_facility' then '육교·교량 등 차도와 분리된 시설' when 'case_C_no_nearby_road' then '인근에 차도가 없는 구간' end),
    case when basis is null or ({_CASE}) is not null then case when crosswalk_n=0 and signal_n=0 then '주변에 횡단보도·신호등 보호시설이 없음' end end, case when is_school_zone then '스쿨존 구간' end) as notes from fx""")
def factor_notes(t):
    return t.sql(FACTS).select("edge_id", F.array_join(X.notes(), "|").alias("notes"))


RULES = "select walk_edge_id, cast(u%60 as double) as no_sidewalk_m, crosswalk=1 as is_crossing, v%3 as signal_n, u%7=0 as is_school_zone, cast(1+u%7 as double) as lanes, u%2=0 as separated from d_walk"


@query("factor_rules_spec", f"""with r as ({RULES}) select walk_edge_id, 'sidewalk_break' as rule, no_sidewalk_m as evidence from r where no_sidewalk_m>30 union all select walk_edge_id, 'unsignalled_crossing', 1 from r where is_crossing and signal_n=0
    union all select walk_edge_id, 'school_zone', 1 from r where is_school_zone union all select walk_edge_id, 'wide_unseparated', lanes from r where lanes>=4 and not separated""")
def factor_rules(t):
    return t.sql(RULES).select("walk_edge_id", F.inline(X.rule_findings()))


@query("factor_sentence")
def factor_sentence(t):
    df = X.explain(t.sql(FACTS).withColumn("road_name", F.lit(None).cast("string")))
    return df.select("edge_id", "band", "score_pct", "sentence")
