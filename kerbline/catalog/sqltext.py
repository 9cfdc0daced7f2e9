"""Geometry formulas as SQL text for the twin queries."""


def dist(x1, y1, x2, y2):
    return f"sqrt(({x2}-({x1}))*({x2}-({x1}))+({y2}-({y1}))*({y2}-({y1})))"


def psd(px, py, x1, y1, x2, y2):
    """Point to segment."""
    dx, dy = f"({x2}-({x1}))", f"({y2}-({y1}))"
    size = f"({dx}*{dx}+{dy}*{dy})"
    t = f"(case when {size}>0 then least(greatest((({px}-({x1}))*{dx}+({py}-({y1}))*{dy})/{size},0),1) else 0 end)"
    return dist(px, py, f"({x1}+{t}*{dx})", f"({y1}+{t}*{dy})")


def cross(ax, ay, bx, by, cx, cy):
    return f"(({bx}-({ax}))*({cy}-({ay}))-({by}-({ay}))*({cx}-({ax})))"


def ssd(a, b):
    """Segment to segment; a and b are 4-tuples of column texts."""
    hit = (
        f"(sign({cross(*b, a[0], a[1])})*sign({cross(*b, a[2], a[3])})<0 and "
        f"sign({cross(*a, b[0], b[1])})*sign({cross(*a, b[2], b[3])})<0)"
    )
    ends = ",".join([psd(a[0], a[1], *b), psd(a[2], a[3], *b), psd(b[0], b[1], *a), psd(b[2], b[3], *a)])
    return f"(case when {hit} then 0 else least({ends}) end)"


def angle(x1, y1, x2, y2):
    d = f"degrees(atan2({y2}-({y1}),{x2}-({x1})))"
    return f"(case when {x1}<>{x2} or {y1}<>{y2} then case when {d}<0 then {d}+180 when {d}>=180 then {d}-180 else {d} end end)"


def angle_diff(a, b):
    d = f"abs({a}-{b})"
    return f"coalesce(least({d},180-{d}),90)"


def overlap_cte(source: str, a: tuple, b: tuple, r: str, keep: str) -> str:
    """CTE bodies computing ``ov``, the length of a within r of b, by clipping against the two end
    discs and the rectangle; returns text of several chained CTEs ending in ``ov_final``."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    return f"""
    ov0 as (select {keep}, {ax1} as ax,{ay1} as ay,{ax2}-{ax1} as dx,{ay2}-{ay1} as dy,{bx1} as px,{by1} as py,{bx2} as qx,{by2} as qy,
        {bx2}-{bx1} as ex,{by2}-{by1} as ey,cast({r} as double) as rr from {source}),
    ov1 as (select *, dx*dx+dy*dy as n, sqrt(ex*ex+ey*ey) as el from ov0),
    ov2 as (select *, (ax-px)*dx+(ay-py)*dy as h1, (ax-px)*(ax-px)+(ay-py)*(ay-py)-rr*rr as c1,
        (ax-qx)*dx+(ay-qy)*dy as h2, (ax-qx)*(ax-qx)+(ay-qy)*(ay-qy)-rr*rr as c2,
        ((ay-py)*ex-(ax-px)*ey)/el as s0, (dy*ex-dx*ey)/el as sd, ((ax-px)*ex+(ay-py)*ey)/el as l0, (dx*ex+dy*ey)/el as ld from ov1),
    ov3 as (select *,
        case when h1*h1-n*c1>=0 then greatest((-h1-sqrt(h1*h1-n*c1))/n,0) end as d1a, case when h1*h1-n*c1>=0 then least((-h1+sqrt(h1*h1-n*c1))/n,1) end as d1b,
        case when h2*h2-n*c2>=0 then greatest((-h2-sqrt(h2*h2-n*c2))/n,0) end as d2a, case when h2*h2-n*c2>=0 then least((-h2+sqrt(h2*h2-n*c2))/n,1) end as d2b,
        case when sd=0 then case when abs(s0)<=rr then 0 end else least((-rr-s0)/sd,(rr-s0)/sd) end as pa,
        case when sd=0 then case when abs(s0)<=rr then 1 end else greatest((-rr-s0)/sd,(rr-s0)/sd) end as pb,
        case when ld=0 then case when l0 between 0 and el then 0 end else least(-l0/ld,(el-l0)/ld) end as qa,
        case when ld=0 then case when l0 between 0 and el then 1 end else greatest(-l0/ld,(el-l0)/ld) end as qb from ov2),
    ov4 as (select *, case when pa is not null and qa is not null then greatest(pa,qa,0) end as ra,
        case when pa is not null and qa is not null then least(pb,qb,1) end as rb from ov3),
    ov5 as (select *, least(case when d1a<=d1b then d1a end, case when d2a<=d2b then d2a end, case when ra<=rb then ra end) as lo,
        greatest(case when d1a<=d1b then d1b end, case when d2a<=d2b then d2b end, case when ra<=rb then rb end) as hi from ov4),
    ov_final as (select *, coalesce((hi-lo)*sqrt(n),0) as ov from ov5)"""


def in_ring(px, py, edge="e"):
    """Count of ring edges hit by a ray, as an aggregate over rows of edges (x1,y1,x2,y2)."""
    e = edge
    return (
        f"(sum(case when ({e}.y1>{py})<>({e}.y2>{py}) and {px}<({e}.x2-{e}.x1)*({py}-{e}.y1)/({e}.y2-{e}.y1)+{e}.x1 then 1 else 0 end)%2=1)"
    )


RING_EDGES = """re as (select zone_id, seq, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2,
    coalesce(lead(y) over w, first_value(y) over w) as y2 from d_ring window w as (partition by zone_id order by seq rows between unbounded preceding and unbounded following))"""
LINE_EDGES = """le as (select * from (select line_id, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2
    from d_vertices window w as (partition by line_id order by seq)) where x2 is not null)"""
