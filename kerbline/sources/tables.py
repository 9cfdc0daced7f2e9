"""Input tables: raw Parquet, and the street-network tables derived from it.

Every derived table is one SQL block that both Spark and an ANSI engine can run, so a query and
its SQL twin start from the same rows. Units are metres in a local plane unless a column says
otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_ROAD_CLASS = (
    "case u%6 when 0 then 'primary' when 1 then 'secondary' when 2 then 'tertiary' "
    "when 3 then 'residential' when 4 then 'service' else 'living_street' end"
)
_W = "cast(5000 as bigint)"
_H = "(select h from d_extent)"

DERIVED: dict[str, str] = {
    "d_extent": "select cast(5000 as bigint) as w, cast(ceil(count(*)/50.0) as bigint)*100 as h from customer",
    "d_nodes": """
        select c_custkey as n,
          cast((c_custkey%50)*100+(c_custkey*37)%41 as double) as x,
          cast(cast(floor(c_custkey/50.0) as bigint)*100+(c_custkey*53)%43 as double) as y
        from customer""",
    "d_lattice": """
        select a.n as u, b.n as v, a.x as x1, a.y as y1, b.x as x2, b.y as y2,
          sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) as length_m
        from d_nodes a join d_nodes b on b.n=a.n+1 where a.n%50<49
        union all
        select a.n, b.n, a.x, a.y, b.x, b.y, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))
        from d_nodes a join d_nodes b on b.n=a.n+50""",
    "d_roads": f"""
        select concat(cast(u as string),'_',cast(v as string),'_0') as osm_edge_id, u, v, '0' as key,
          {_ROAD_CLASS} as road_class,
          case when (u+v)%11=0 then null else cast(1+u%8 as double) end as lanes,
          cast(20+(u*7+v)%50 as double) as speed_kmh, length_m, x1, y1, x2, y2
        from d_lattice
        union all
        select concat(cast(v as string),'_',cast(u as string),'_0'), v, u, '0',
          {_ROAD_CLASS},
          case when (u+v)%11=0 then null else cast(1+u%8 as double) end,
          cast(20+(u*7+v)%50 as double), length_m, x2, y2, x1, y1
        from d_lattice where (u+v)%3<>0""",
    "d_accidents": f"""
        select event_id as acdnt_no, cast((event_id*7919+13)%{_W} as double) as x,
          cast((event_id*104729+7)%{_H} as double) as y, user_id, ts, event_type as severity
        from events""",
    "d_facilities": f"""
        select p_partkey as fid,
          case p_size%4 when 0 then 'crosswalk' when 1 then 'signal' when 2 then 'speed_bump' else 'cctv' end as category,
          cast((p_partkey*6151+31)%{_W} as double) as x, cast((p_partkey*3571+17)%{_H} as double) as y
        from part""",
    "d_zones": f"""
        select s_suppkey as zone_id, s_name as school_name, cast((s_suppkey*977+211)%{_W} as double) as cx,
          cast((s_suppkey*1409+89)%{_H} as double) as cy, cast(150+s_suppkey%100 as double) as half
        from supplier""",
    "d_gates": f"""
        select s_suppkey*2 as gate_id, s_name as school_name, 'main' as gate_type,
          cast((s_suppkey*977+211)%{_W} as double) as x, cast((s_suppkey*1409+89)%{_H} as double) as y
        from supplier
        union all
        select s_suppkey*2+1, s_name, 'back', cast((s_suppkey*977+211)%{_W}+40 as double),
          cast((s_suppkey*1409+89)%{_H}+25 as double)
        from supplier where s_suppkey%2=0""",
    "d_enrollment": """
        select s_name as school_name, case when s_suppkey%29=0 then null else 200+(s_suppkey*13)%700 end as total
        from supplier""",
    "d_buildings": f"""
        select o_orderkey as bld_id, case when o_orderkey%17=0 then null else cast(o_orderkey%21 as double) end as floors,
          cast((o_orderkey*6067+101)%{_W} as double) as x, cast((o_orderkey*2903+53)%{_H} as double) as y
        from orders""",
    "d_walk": """
        select u*2+(case when v=u+1 then 0 else 1 end) as walk_edge_id, u, v,
          case u%5 when 0 then '1111' when 1 then '1000' when 2 then '1011' when 3 then '1100' else '0000' end as walking_type,
          0 as crosswalk, case when u%101=0 then 1 else 0 end as overpass, case when u%97=0 then 1 else 0 end as park_green,
          x1+(case when v=u+1 then 0 else 2+(u%6)*4 end) as x1, y1+(case when v=u+1 then 2+(u%6)*4 else 0 end) as y1,
          x2+(case when v=u+1 then 0 else 2+(u%6)*4 end) as x2, y2+(case when v=u+1 then 2+(u%6)*4 else 0 end) as y2,
          length_m, cast((u*31+v)%100 as double)/cast(100 as double) as risk
        from d_lattice
        union all
        select 10000000+u, u, v, case when u%2=0 then '1000' else '1100' end, cast(u%2 as int), 0, 0,
          floor((x1+x2)/2), floor((y1+y2)/2)-15, floor((x1+x2)/2)+3, floor((y1+y2)/2)+15,
          sqrt(cast(909 as double)), cast((u*17)%100 as double)/cast(100 as double)
        from d_lattice where v=u+1 and u%7=0""",
    "d_requests": f"""
        select event_id as q_id, cast((event_id*7919+13)%{_W} as double) as x,
          cast((event_id*104729+7)%{_H} as double) as y,
          1+user_id%6 as grade, case when event_id%2=0 then 'safe' else 'fast' end as style,
          5+(event_id*7)%40 as time_left_min
        from events""",
    "d_candidates": """
        select o_orderkey as link_id, cast((o_orderkey*37)%400 as double)/cast(10 as double) as e,
          cast((o_orderkey*53)%1000 as double)/cast(100 as double)-cast(5 as double) as r,
          case when o_orderkey%4=0 then 1 else 0 end as is_sz, case when (o_orderkey*7)%9=0 then 1 else 0 end as accident
        from orders""",
    "d_cmf": """
        select 0 as measure_id, cast(0.55 as double) as cmf, cast(12000000 as double) as cost
        union all select 1, cast(0.60 as double), cast(5000000 as double)
        union all select 2, cast(null as double), cast(800000 as double)
        union all select 3, cast(0.95 as double), cast(15000000 as double)
        union all select 4, cast(1.07 as double), cast(300000 as double)
        union all select 5, cast(null as double), cast(null as double)
        union all select 6, cast(0.26 as double), cast(30000000 as double)""",
    # Two orders in three have their measures on links outside the candidates (negative ids).
    "d_measures": """
        select distinct case when l_orderkey%3=0 then l_orderkey else -l_orderkey end as link_id, cast(l_partkey%7 as int) as measure_id
        from lineitem""",
    "d_population": """
        select user_id%21 as dong, event_id%24 as hour, 100+value as total,
          value/cast(10 as double) as age_0_14, value/cast(5 as double) as age_65_up
        from events""",
    "d_utterances": """
        select conv_id, turn, text from conversations where role='user'""",
    # Physical roads with a name on every third and a risk index.
    "d_wroads": f"""
        select concat(cast(u as string),'_',cast(v as string),'_0') as osm_edge_id, u, v, {_ROAD_CLASS} as road_class,
          case when u%3=0 then concat('road',cast(u as string)) when u%3=1 then 'nan' else null end as road_name,
          cast((u*53+v*7)%1000 as double)/cast(100 as double)-cast(5 as double) as risk_index, length_m, x1, y1, x2, y2
        from d_lattice""",
    # Five-vertex bent lines, one per part, in long form (line_id, seq, x, y).
    "d_vertices": """
        select fid as line_id, 0 as seq, x, y from d_facilities
        union all select fid, 1, x+20+fid%7, y+5 from d_facilities
        union all select fid, 2, x+35+fid%7, y-12+fid%23 from d_facilities
        union all select fid, 3, x+60, y+3-fid%5 from d_facilities
        union all select fid, 4, x+75+fid%11, y+30 from d_facilities""",
    # Six-vertex L-shaped rings around the zones, in long form (zone_id, seq, x, y), counter-clockwise.
    "d_ring": """
        select zone_id, 0 as seq, cx-half as x, cy-half as y from d_zones
        union all select zone_id, 1, cx+half, cy-half from d_zones
        union all select zone_id, 2, cx+half, cy+10 from d_zones
        union all select zone_id, 3, cx+20, cy+10 from d_zones
        union all select zone_id, 4, cx+20, cy+half from d_zones
        union all select zone_id, 5, cx-half, cy+half from d_zones""",
}


def dependencies(sql: str) -> list[str]:
    """Derived and raw tables ``sql`` needs, in an order in which they can be defined."""
    known = set(DERIVED) | set(RAW)
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:from|join)\s+([a-z_]+)", text, flags=re.I):
            if name in known and name not in order:
                if name in DERIVED:
                    visit(DERIVED[name])
                order.append(name)

    visit(sql)
    return order


def with_derived(sql: str) -> str:
    """ANSI SQL text in which the derived tables are defined as common table expressions."""
    ctes = [f"{n} as ({DERIVED[n]})" for n in dependencies(sql) if n in DERIVED]
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"with\s+recursive\s", body, flags=re.I):
        return "with recursive " + ",\n".join(ctes) + ",\n" + re.sub(r"^with\s+recursive\s", "", body, flags=re.I)
    if re.match(r"with\s", body, flags=re.I):
        return "with " + ",\n".join(ctes) + ",\n" + re.sub(r"^with\s", "", body, flags=re.I)
    return "with " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Lazy access to the raw and derived tables below one Parquet folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return self.sql(f"select * from {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run ``text`` over the raw and derived tables."""
        ctes = []
        for n in dependencies(text):
            body = DERIVED.get(n, f"select * from parquet.`{self.folder}/{n}.parquet`")
            ctes.append(f"{n} as ({body})")
        return self.spark.sql("with " + ",\n".join(ctes) + "\n" + text)
