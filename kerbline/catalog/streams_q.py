"""Streams over the given tables, run until the input is used up, and their batch twins."""

import uuid

from pyspark.sql import functions as F

from kerbline.catalog import sqltext as Q
from kerbline.catalog.areas import ACC, LINKS, near
from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.session import run_dir
from kerbline.streaming import accidents as A
from kerbline.streaming import preference as P
from kerbline.streaming import trips as T

RULES_EN = {"safer": "ound", "relax": "ation", "faster": "ering", "late": "thth"}  # letters that occur in the texts at hand


def table_stream(t, name: str):
    """The table as a stream: a folder of files as it is; a single file is picked from the folder it lies in."""
    path = f"{t.folder}/{name}.parquet"
    table = t.spark.read.parquet(path)
    stream = t.spark.readStream.schema(table.schema)
    if [f.rpartition("/")[2] for f in table.inputFiles()] != [f"{name}.parquet"]:
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(t, df, name: str, empty_batches: bool = True):
    """Runs a stream until its input is used up. Timers of processing time ask for empty batches without end, so such streams run without."""
    base = f"{run_dir(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = t.spark.conf.get(EMPTY_BATCHES)
    t.spark.conf.set(EMPTY_BATCHES, str(empty_batches).lower())  # a query takes its settings when it starts
    q = df.writeStream.format("parquet").option("checkpointLocation", base + "/state").option("path", base + "/rows").trigger(availableNow=True).start()
    t.spark.conf.set(EMPTY_BATCHES, before)
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(base + "/rows")


U = "select conv_id, turn, text from d_utterances"
FLAGS = f"""ut as ({U}), fl as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn, contains(text,'ound') as a, contains(text,'ation') as b,
    contains(text,'ering') as c, contains(text,'thth') as d from ut)"""


@query("utterance_rules", f"""with {FLAGS} select conv_id, turn, cast(a as integer)+2*cast(b as integer)+4*cast(c as integer)+8*cast(d as integer) as code from fl""")
def utterance_rules(t):
    return t("d_utterances").select("conv_id", "turn", P.rule_code("text", RULES_EN).alias("code"))


_UP = "case when {c}=0 then 0.15::double else 0.5::double end"
_DOWN = "case when {c}=0.5::double then 0.15::double else 0::double end"


STATE_SQL = f"""with recursive {FLAGS}, st(conv_id, rn, turn, axis, cap, ovr) as (
      select conv_id, cast(0 as bigint), cast(-1 as bigint), 'max', cast(0.5 as double), cast(null as double) from (select distinct conv_id from fl)
      union all select x.conv_id, x.rn, x.turn, case when a or (b and (c or d)) then 'max' else axis end, case when conflict and cap3=0 then 0.15::double else cap3 end,
        case when conflict and cap3=0 then 0.15::double when b or c or d then cap3 else ovr end
      from (select *, (a or b) and (c or d) as conflict, case when d then 0::double else cap2 end as cap3 from (select *, case when c then {_DOWN.format(c='cap1')} else cap1 end as cap2 from (
        select f.conv_id, f.rn, f.turn, f.a, f.b, f.c, f.d, s.axis, s.ovr, case when f.b then {_UP.format(c='s.cap')} else s.cap end as cap1 from st s join fl f on f.conv_id=s.conv_id and f.rn=s.rn+1) k1) k2) x)
    select conv_id, turn, axis, cap, ovr as override from st where rn>0"""


@query("preference_state", STATE_SQL)
def preference_state(t):
    """Latched state after each utterance, composed in blocks."""
    return P.fold(t("d_utterances"), "conv_id", "turn", "text", RULES_EN).select("conv_id", "turn", "axis", "cap", "override")


_BASE = {"axis": "case conv_id%3 when 1 then 'min' else 'max' end", "cap": "case conv_id%3 when 0 then 0.5::double when 1 then 0.15::double else 0::double end"}
EVENT_SQL = f"""with recursive {FLAGS}, fz as (select fl.*, contains(ut.text,'able') as z from fl join ut using (conv_id, turn)), st(conv_id, rn, turn, axis, cap, ovr) as (
      select conv_id, cast(0 as bigint), cast(-1 as bigint), {_BASE['axis']}, {_BASE['cap']}, cast(null as double) from (select distinct conv_id from fz)
      union all select x.conv_id, x.rn, x.turn, case when z then {_BASE['axis']} when a or (b and (c or d)) then 'max' else axis end, case when z then {_BASE['cap']} when conflict and cap3=0 then 0.15::double else cap3 end,
        case when z then null when conflict and cap3=0 then 0.15::double when b or c or d then cap3 else ovr end
      from (select *, (a or b) and (c or d) as conflict, case when d then 0::double else cap2 end as cap3 from (select *, case when c then {_DOWN.format(c='cap1')} else cap1 end as cap2 from (
        select f.conv_id, f.rn, f.turn, f.a, f.b, f.c, f.d, f.z, s.axis, s.ovr, case when f.b then {_UP.format(c='s.cap')} else s.cap end as cap1 from st s join fz f on f.conv_id=s.conv_id and f.rn=s.rn+1) k1) k2) x)
    select conv_id, turn, axis, cap, ovr as override from st where rn>0"""


@query("stream_preference_state", EVENT_SQL)
def stream_preference_state(t):
    """Conversations as they come in: a baseline for each, what users say, and resets; the other turns only keep the count."""
    c = table_stream(t, "conversations").select("conv_id", "turn", "role", "text")
    third = F.col("conv_id") % 3
    kind = F.when(F.col("role") != "user", "pass").when(F.contains("text", F.lit("able")), "reset").otherwise("say")
    first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("baseline").alias("event"))
    own = F.struct((F.col("turn") + 1).alias("n"), kind.alias("event"))
    events = c.withColumn("e", F.explode(F.when(F.col("turn") == 0, F.array(first, own)).otherwise(F.array(own)))).select("conv_id", "text", "e.*")
    code = P.event_code(F.col("event"), F.col("text"), RULES_EN, F.when(third == 1, "min").otherwise("max"), F.when(third == 0, 0.5).when(third == 1, 0.15).otherwise(0.0))
    out = run_to_table(t, P.stream_preferences(events, "conv_id", "n", code), "preference", empty_batches=False).filter("turn>0")
    return out.select(F.col("key").alias("conv_id"), (F.col("turn") - 1).alias("turn"), "axis", "cap", F.nanvl("override", F.lit(None)).alias("override"))


WAY_SQL = "select c_custkey as trip, unnest([0,1,2,3,4]) as i from customer"
STEPS_SQL = """fx as (select user_id as trip, event_id as seq, cast((event_id*13)%360 as double) as x, cast((event_id*7)%190 as double) as y, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    gaps as (select f.trip, f.rn, w.i, sqrt((f.x-w.wx)*(f.x-w.wx)+(f.y-w.wy)*(f.y-w.wy)) as d from fx f join way w on w.trip=f.trip),
    goes as (select g.trip, g.rn, a.i as pl, min(g.d) as least, arg_min(g.i, (g.d, g.i)) as nearest from gaps g join (select unnest([0,1,2,3,4]) as i) a on g.i>=a.i group by 1, 2, 3)"""


@query("stream_trip_monitor", f"""with recursive way as (select trip, i, cast(trip%20*10+40*i as double) as wx, cast(trip%7*12+25*i as double) as wy from ({WAY_SQL})), {STEPS_SQL},
    st(trip, rn, pl, away, arrived) as (select trip, cast(0 as bigint), 0, false, false from (select distinct trip from fx)
      union all select s.trip, g.rn, case when g.least>80 then s.pl else g.nearest end, g.least>80, s.arrived or z.d<20
      from st s join goes g on g.trip=s.trip and g.rn=s.rn+1 and g.pl=s.pl join gaps z on z.trip=g.trip and z.rn=g.rn and z.i=4),
    legs as (select trip, i, coalesce(sum(leg) over (partition by trip order by i desc rows between unbounded preceding and current row),0) as ahead from (
      select trip, i, sqrt((lead(wx) over w-wx)*(lead(wx) over w-wx)+(lead(wy) over w-wy)*(lead(wy) over w-wy)) as leg from way window w as (partition by trip order by i))),
    r as (select s.trip, f.seq, s.pl, s.away, g.d+l.ahead as remaining, s.arrived from st s join fx f on f.trip=s.trip and f.rn=s.rn join gaps g on g.trip=s.trip and g.rn=s.rn and g.i=s.pl join legs l on l.trip=s.trip and l.i=s.pl)
    select trip, seq, cast(pl as bigint) as waypoint, away as off_route, round(remaining,4)+0 as remaining_m, greatest(1::double, floor(remaining/67+0.5)) as minutes, arrived from r""")
def stream_trip_monitor(t):
    """Fixes of every user against five waypoints; routes come from the customers, and the regions tell that time has passed."""
    key = F.col("c_custkey")
    way = F.array(*[F.struct((key % 20 * 10 + 40 * i).cast("double").alias("x"), (key % 7 * 12 + 25 * i).cast("double").alias("y")) for i in range(5)])
    none = F.lit(None)
    fixes = table_stream(t, "events").select(
        F.col("user_id").cast("bigint").alias("trip"), F.col("event_id").cast("bigint").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") * 13) % 360).cast("double").alias("x"), ((F.col("event_id") * 7) % 190).cast("double").alias("y"), none.cast("array<struct<x:double,y:double>>").alias("way"),
    )
    row = [none.cast("bigint").alias("seq"), none.cast("double").alias("x"), none.cast("double").alias("y")]
    routes = table_stream(t, "customer").select(key.cast("bigint").alias("trip"), row[0], F.lit("2000-01-01").cast("timestamp").alias("ts"), *row[1:], way.alias("way"))
    clock = table_stream(t, "region").select(F.lit(-1).cast("bigint").alias("trip"), row[0], F.lit("2200-01-01").cast("timestamp").alias("ts"), *row[1:], none.cast("array<struct<x:double,y:double>>").alias("way"))
    out = run_to_table(t, T.monitor(fixes.unionByName(routes).unionByName(clock), idle="36500 days"), "trips")
    return out.select("trip", "seq", "waypoint", "off_route", r_to("remaining_m", 4).alias("remaining_m"), "minutes", "arrived")


@query("stream_accident_ingest", f"""with {near(ACC, 'a.acdnt_no', 400)}, best as (select *, row_number() over (partition by acdnt_no order by d, link_id) as rn from pairs)
    select link_id, count(*) as accidents from best where rn=1 group by 1""")
def stream_accident_ingest(t):
    """The event file as a stream in which every accident arrives twice."""
    h = t("d_extent").first().h
    once = table_stream(t, "events").select(
        F.col("event_id").alias("acdnt_no"), F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") * 7919 + 13) % 5000).cast("double").alias("x"), ((F.col("event_id") * 104729 + 7) % h).cast("double").alias("y"),
    )
    twice = once.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    base = f"{run_dir(t.spark)}/ingest-{uuid.uuid4().hex[:12]}"
    q = A.ingest(twice, t.sql(LINKS), 40.0, base + "/counts", base + "/state", "36500 days")
    q.awaitTermination()
    return A.read_counts(t.spark, base + "/counts").select("link_id", "accidents")
