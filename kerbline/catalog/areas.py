"""Spatial joins, each against a join over all pairs in the twin query."""

from pyspark.sql import functions as F

from kerbline.catalog import sqltext as Q
from kerbline.catalog.measures import INSIDE_SQL, zone_rings
from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.operators import spatial as S
from kerbline.operators.frames import left_count
from kerbline.operators.ranking import first_per_key

SEGS = ("x1", "y1", "x2", "y2")
LINKS = "select concat(cast(u as string),'_',cast(v as string)) as link_id, x1, y1, x2, y2, length_m from d_lattice"
PD = Q.psd("a.x", "a.y", "l.x1", "l.y1", "l.x2", "l.y2")


def near(points: str, cols: str, reach: int) -> str:
    """All pairs of points and links within a box of ``reach`` metres, with their distance."""
    return f"""links as ({LINKS}), pts as ({points}), pairs as (select {cols}, l.link_id, {PD} as d from pts a join links l
        on a.x between least(l.x1,l.x2)-{reach} and greatest(l.x1,l.x2)+{reach} and a.y between least(l.y1,l.y2)-{reach} and greatest(l.y1,l.y2)+{reach})"""


ACC = "select acdnt_no, x, y from d_accidents"
FAC = "select fid, x, y, category from d_facilities"


@query("entry_accidents_per_link", f"""with {near(ACC, 'a.acdnt_no', 400)}, best as (select *, row_number() over (partition by acdnt_no order by d, link_id) as rn from pairs)
    select l.link_id, round(max(l.length_m),6)+0 as length_m, count(b.acdnt_no) as accidents from links l left join (select * from best where rn=1) b on b.link_id=l.link_id group by 1""")
def entry_accidents_per_link(t):
    links = t.sql(LINKS)
    points = t("d_accidents").select("acdnt_no", "x", "y")
    hit = S.nearest(points, links, "acdnt_no", "link_id", 60.0)
    counts = hit.groupBy("link_id").agg(F.count("*").alias("accidents"))
    return left_count(links.select("link_id", r_to("length_m").alias("length_m")), "link_id", counts, "accidents")


@query("sjoin_nearest", f"""with {near(ACC, 'a.acdnt_no', 400)}, best as (select *, row_number() over (partition by acdnt_no order by d, link_id) as rn from pairs)
    select acdnt_no, link_id, round(d,6)+0 as distance from best where rn=1""")
def sjoin_nearest(t):
    return S.nearest(t(
        "d_accidents"), t.sql(LINKS), "acdnt_no", "link_id", 60.0).withColumn("distance", r_to("distance"))


@query("sjoin_nearest_max", f"""with {near(FAC, 'a.fid', 30)}, best as (select *, row_number() over (partition by fid order by d, link_id) as rn from pairs where d<=30)
    select fid, link_id, round(d,6)+0 as distance from best where rn=1""")
def sjoin_nearest_max(t):
    return S.nearest_within(t("d_facilities"), t.sql(LINKS), 30.0, "fid", "link_id").withColumn("distance", r_to("distance"))


@query("sjoin_within_buffer", f"""with {near(FAC, 'a.fid', 100)} select link_id, count(*) as n from pairs where d<=100 group by 1""")
def sjoin_within_buffer(t):
    return S.count_within(t("d_facilities"), t.sql(LINKS), 100.0, "fid", "link_id")


INZONE = f"""{Q.RING_EDGES}, pts as (select acdnt_no, x, y from d_accidents),
    pz as (select p.acdnt_no, z.zone_id, p.x as px, p.y as py from pts p join d_zones z on p.x between z.cx-z.half and z.cx+z.half and p.y between z.cy-z.half and z.cy+z.half),
    hits as (select pz.acdnt_no, pz.zone_id from pz join re e on e.zone_id=pz.zone_id group by pz.acdnt_no, pz.zone_id, px, py having {Q.in_ring('px', 'py')})"""


@query("sjoin_within", f"with {INZONE} select acdnt_no, zone_id from hits")
def sjoin_within(t):
    return S.points_in_rings(t("d_accidents").select("acdnt_no", "x", "y"), zone_rings(t).select("zone_id", "ring"), "acdnt_no").select("acdnt_no", "zone_id")


@query("sjoin_intersects", f"with {INSIDE_SQL} select u, v, zone_id from inside where inter_len>0.001::double")
def sjoin_intersects(t):
    lines = t("d_lattice").withColumn("line", F.concat_ws("_", "u", "v"))
    return S.segments_in_rings(lines, zone_rings(t), "line").filter("inter_len > 0.001").select("u", "v", "zone_id")


TOUCH = Q.ssd(("c.ax", "c.ay", "c.bx", "c.by0"), ("e.x1", "e.y1", "e.x2", "e.y2"))


@query("sjoin_any_semi", f"""with {INSIDE_SQL}, touch as (select distinct c.u, c.v from cand c join re e on e.zone_id=c.zone_id where {TOUCH}=0
    union select u, v from inside where inter_len>0) select l.u, l.v, exists(select 1 from touch i where i.u=l.u and i.v=l.v) as in_zone from d_lattice l""")
def sjoin_any_semi(t):
    lines = t("d_lattice").withColumn("line", F.concat_ws("_", "u", "v"))
    return S.meets_any(lines, zone_rings(t), "line").select("u", "v", "in_zone")


@query("overlay_intersection", f"with {INSIDE_SQL} select i.u, i.v, i.zone_id, z.school_name, round(inter_len,5)+0 as inter_len from inside i join d_zones z on z.zone_id=i.zone_id where inter_len>0.001::double")
def overlay_intersection(t):
    lines = t("d_lattice").withColumn("line", F.concat_ws("_", "u", "v"))
    hit = S.segments_in_rings(lines, zone_rings(t), "line").filter("inter_len > 0.001")
    return hit.select("u", "v", "zone_id", "school_name", r_to("inter_len", 5).alias("inter_len"))


@query("assign_max_overlap", f"""with {INSIDE_SQL}, r as (select *, row_number() over (partition by u, v order by round(inter_len,5) desc, zone_id) as rn from inside where inter_len>0.001::double)
    select u, v, zone_id from r where rn=1""")
def assign_max_overlap(t):
    lines = t("d_lattice").withColumn("line", F.concat_ws("_", "u", "v"))
    hit = S.segments_in_rings(lines, zone_rings(t), "line").filter("inter_len > 0.001")
    return first_per_key(hit, ["u", "v"], [-F.round("inter_len", 5), F.col("zone_id")], ["zone_id"])


NODE_D = "sqrt((a.x-n.x)*(a.x-n.x)+(a.y-n.y)*(a.y-n.y))"


@query("snap_nearest_node", f"""with p as (select a.q_id, n.n, {NODE_D} as d from d_requests a join d_nodes n on n.x between a.x-100 and a.x+100 and n.y between a.y-100 and a.y+100),
    r as (select *, row_number() over (partition by q_id order by d, n) as rn from p where d<=100) select q_id, n, round(d,6)+0 as distance from r where rn=1""")
def snap_nearest_node(t):
    nodes = S.points_as_segments(t("d_nodes"))
    return S.nearest_within(t("d_requests"), nodes, 100.0, "q_id", "n").withColumn("distance", r_to("distance"))


@query("snap_nearest_vertex_edge", """with e as (select walk_edge_id, x1 as vx, y1 as vy from d_walk union all select walk_edge_id, x2, y2 from d_walk),
    p as (select a.q_id, e.walk_edge_id, sqrt((a.x-e.vx)*(a.x-e.vx)+(a.y-e.vy)*(a.y-e.vy)) as d from d_requests a join e on e.vx between a.x-60 and a.x+60 and e.vy between a.y-60 and a.y+60),
    r as (select *, row_number() over (partition by q_id order by d, walk_edge_id) as rn from p where d<=60) select q_id, walk_edge_id, round(d,6)+0 as distance from r where rn=1""")
def snap_nearest_vertex_edge(t):
    w = t("d_walk")
    vertices = w.select("walk_edge_id", F.col("x1").alias("vx"), F.col("y1").alias("vy")).union(w.select("walk_edge_id", "x2", "y2"))
    return S.nearest_within(t("d_requests"), S.points_as_segments(vertices, "vx", "vy"), 60.0, "q_id", "walk_edge_id").withColumn(
        "distance", r_to("distance"))


@query("locate_zone", f"with {INZONE} select acdnt_no, min(zone_id) as zone_id from hits group by 1")
def locate_zone(t):
    hit = S.points_in_rings(t("d_accidents").select("acdnt_no", "x", "y"), zone_rings(t).select("zone_id", "ring"), "acdnt_no")
    return hit.groupBy("acdnt_no").agg(F.min("zone_id").alias("zone_id"))


@query("filter_clip_to_region", f"with {INZONE} select acdnt_no from pts where acdnt_no in (select acdnt_no from hits)")
def filter_clip_to_region(t):
    pts = t("d_accidents").select("acdnt_no", "x", "y")
    hit = S.points_in_rings(pts, zone_rings(t).select("ring"), "acdnt_no")
    return pts.join(hit.select("acdnt_no"), "acdnt_no", "left_semi").select("acdnt_no")


@query("filter_exclude_area", f"""with {Q.RING_EDGES}, m as (select walk_edge_id, (x1+x2)/2 as px, (y1+y2)/2 as py from d_walk),
    pz as (select m.*, z.zone_id from m join d_zones z on px between z.cx-z.half and z.cx+z.half and py between z.cy-z.half and z.cy+z.half),
    hits as (select pz.walk_edge_id, pz.zone_id from pz join re e on e.zone_id=pz.zone_id group by pz.walk_edge_id, pz.zone_id, px, py having {Q.in_ring('px', 'py')})
    select distinct walk_edge_id from hits where zone_id%4<>0 and walk_edge_id not in (select walk_edge_id from hits where zone_id%4=0)""")
def filter_exclude_area(t):
    from kerbline.plans.walk_safety import exclude_outside

    z = zone_rings(t)
    return exclude_outside(t("d_walk"), z.filter("zone_id%4<>0"), z.filter("zone_id%4=0")).select("walk_edge_id")


@query("buildings_in_zone", """select b.bld_id, z.zone_id from d_buildings b join d_zones z on b.x+6>=z.cx-z.half and b.x-6<=z.cx+z.half and b.y+5>=z.cy-z.half and b.y-5<=z.cy+z.half
    and not (b.x-6>z.cx+20 and b.y-5>z.cy+10)""")
def buildings_in_zone(t):
    """Buildings (12 m × 10 m footprints) meeting a school zone; one may be in several zones."""
    from kerbline.functions import geometry as G

    x, y = F.col("x"), F.col("y")
    b = t("d_buildings").withColumn("foot", G.line((x - 6, y - 5), (x + 6, y - 5), (x + 6, y + 5), (x - 6, y + 5)))
    return S.rings_in_rings(b.select("bld_id", "foot"), zone_rings(t).select("zone_id", "ring"), "bld_id", "foot", "ring").select("bld_id", "zone_id")


@query("join_incident_edges", f"""with p as (select a.fid, n.n, {NODE_D} as d from d_facilities a join d_nodes n on n.x between a.x-80 and a.x+80 and n.y between a.y-80 and a.y+80),
    s as (select fid, n from (select *, row_number() over (partition by fid order by d, n) as rn from p where d<=80) where rn=1),
    c as (select n, count(*) as c from s group by 1), e as (select osm_edge_id, u as n from d_roads union all select osm_edge_id, v from d_roads),
    g as (select n, count(*) as deg from e group by 1)
    select e.osm_edge_id, cast(sum(c.c) as bigint) as n_points, round(sum(c.c/g.deg::double),6)+0 as weight from e join c on c.n=e.n join g on g.n=e.n group by 1""")
def join_incident_edges(t):
    from kerbline.plans.road_risk import incident_facilities

    return incident_facilities(t("d_roads"), t("d_nodes"), t("d_facilities")).withColumn("weight", r_to("weight"))


@query("closest_candidate_rank", f"""with w as (select * from d_walk where crosswalk=1), c as (select w.walk_edge_id, l.u, l.v, {Q.angle_diff(Q.angle('w.x1','w.y1','w.x2','w.y2'), Q.angle('l.x1','l.y1','l.x2','l.y2'))} as ad,
      {Q.ssd(('w.x1','w.y1','w.x2','w.y2'), ('l.x1','l.y1','l.x2','l.y2'))} as d from w join d_lattice l on greatest(w.x1,w.x2)>=least(l.x1,l.x2)-40 and least(w.x1,w.x2)<=greatest(l.x1,l.x2)+40
      and greatest(w.y1,w.y2)>=least(l.y1,l.y2)-40 and least(w.y1,w.y2)<=greatest(l.y1,l.y2)+40),
    r as (select *, row_number() over (partition by walk_edge_id order by round(ad,6) desc, round(d,6), u desc, v desc) as rn from c where d<=40) select walk_edge_id, u, v from r where rn=1""")
def closest_candidate_rank(t):
    from kerbline.functions import geometry as G

    walk = t("d_walk").filter("crosswalk=1").select("walk_edge_id", *SEGS)
    roads = t("d_lattice").select("u", "v", *[F.col(c).alias("r" + c) for c in SEGS])
    rs = tuple("r" + c for c in SEGS)
    pairs = S.segment_pairs(walk, roads, 40.0, "walk_edge_id", SEGS, rs)
    ad = F.round(G.angle_diff(G.angle(*SEGS), G.angle(*rs)), 6)
    best = pairs.groupBy("walk_edge_id").agg(F.max(F.struct(ad.alias("a"), (-F.round("distance", 6)).alias("d"), "u", "v")).alias("b"))
    return best.select("walk_edge_id", "b.u", "b.v")
