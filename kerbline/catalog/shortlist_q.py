"""Policy shortlist queries."""

from pyspark.sql import functions as F

from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.operators import stats as S
from kerbline.plans import shortlist as P
from kerbline.session import cut_lineage

PCT = lambda c: f"((rank() over (order by {c})+(count(*) over (partition by {c})-1)/2.0::double)/count(*) over ())"
GATED = f"""rk as (select *, {PCT('e')} as pe, {PCT('r')} as pr from d_candidates), gated as (select * from rk where pe>=1-0.2::double and pr>=1-0.3::double and is_sz=0)"""
ECR = f"""ep as (select *, round({PCT('r')}*2*10000)/10000 as rbar from d_candidates), ecr as (select *, round(e*rbar*100)/100 as ecr from ep)"""
EFF = """eff as (select m.link_id, m.measure_id, round(1-c.cmf,2) as effect, case when round(1-c.cmf,2)<>0 and c.cost<>0 then round(round(1-c.cmf,2)/c.cost*1000000,4) end as ce
    from d_measures m left join d_cmf c on c.measure_id=m.measure_id)"""
FULL = f"""{ECR}, {EFF}, ms as (select link_id, count(*) as measures, max(ce) as max_ce from eff group by 1),
    cand as (select e.link_id, e.e, e.r, e.ecr, m.link_id is not null as linked, case when m.link_id is not null then cast(1+e.link_id%5 as bigint) end as tags, m.measures, m.max_ce from ecr e left join ms m on m.link_id=e.link_id)"""
TRACK = f"""{FULL}, q as (select quantile_cont(ecr,2/3.0::double) as q1, (select quantile_cont(tags,2/3.0::double) from cand where linked) as q2, (select quantile_cont(measures,2/3.0::double) from cand where linked) as q3,
      (select quantile_cont(max_ce,2/3.0::double) from cand where linked) as q4 from cand),
    tr as (select c.*, case when not linked then 'wait' when ecr>=q1-1e-12 and tags>=q2-1e-12 and measures>=q3-1e-12 and coalesce(max_ce>=q4-1e-12,false) then 'A' else 'B' end as track from cand c cross join q)"""


def effects(t):
    return P.measure_effects(t("d_measures"), t("d_cmf"))


def candidates(t):
    ms = P.measure_summary(effects(t))
    df = P.ecr_score(t("d_candidates")).join(ms.withColumn("linked", F.lit(True)), "link_id", "left")
    df = df.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("tags", F.when(F.col("linked"), (1 + F.col("link_id") % 5)))
    return cut_lineage(df.select("link_id", "e", "r", "ecr", "linked", F.col("tags").cast("bigint").alias("tags"), "measures", "max_ce"))


@query("gate_candidates", f"with {GATED} select link_id, round(pe,9)+0 as pct_e, round(pr,9)+0 as pct_r from gated")
def gate_candidates(t):
    return P.gate_candidates(t("d_candidates")).select("link_id", r_to("pct_e", 9).alias("pct_e"), r_to("pct_r", 9).alias("pct_r"))


@query("ecr_score", f"with {ECR} select link_id, rbar, ecr from ecr")
def ecr_score(t):
    return P.ecr_score(t("d_candidates")).select("link_id", "rbar", "ecr")


@query("measure_effects", f"with {EFF} select link_id, measure_id, effect+0 as effect, ce+0 as ce from eff")
def measure_effects(t):
    return effects(t).select("link_id", "measure_id", r_to("effect", 2).alias("effect"), r_to("ce", 4).alias("ce"))


@query("measure_best_notes", f"""with {EFF}, b as (select *, row_number() over (partition by link_id order by effect desc nulls last, measure_id) as re, row_number() over (partition by link_id order by ce desc nulls last, measure_id) as rc from eff)
    select link_id, measure_id, case when re=1 and effect is not null and rc=1 and ce is not null then 'best_effect_and_value' when re=1 and effect is not null then 'best_effect' when rc=1 and ce is not null then 'best_value' else '' end as note from b""")
def best_notes(t):
    return P.best_measure_notes(effects(t)).select("link_id", "measure_id", "note")


@query("track_classify", f"with {TRACK} select link_id, track from tr")
def track_classify(t):
    return P.classify_tracks(candidates(t)).select("link_id", "track")


@query("track_rank_label", f"""with {TRACK}, k as (select link_id, track, cast(floor(rank() over (partition by track order by ecr desc)+(count(*) over (partition by track, ecr)-1)/2.0::double) as bigint) as rk from tr where track<>'wait')
    select link_id, rk as track_rank, track||'-#'||cast(rk as varchar) as track_label from k""")
def track_rank_label(t):
    df = cut_lineage(P.classify_tracks(candidates(t))).filter("track <> 'wait'")
    return P.rank_in_track(df, "track", "ecr").select("link_id", "track_rank", "track_label")


@query("track_axes_check", f"""with {TRACK} select link_id, a.axis as axis, round(a.value,6)+0 as value, round(a.threshold,6)+0 as threshold, coalesce(a.value,0)>=a.threshold-1e-12 as passed from (
    select link_id, 'ecr' as axis, ecr as value, (select q1 from q) as threshold from cand where linked union all select link_id, 'tags', tags, (select q2 from q) from cand where linked
    union all select link_id, 'measures', measures, (select q3 from q) from cand where linked union all select link_id, 'max_ce', max_ce, (select q4 from q) from cand where linked) a""")
def track_axes_check(t):
    df = P.axes_check(candidates(t))
    return df.select("link_id", "axis", r_to("value").alias("value"), r_to("threshold").alias("threshold"), "passed")


def _sens(name: str, q: str) -> str:
    lim = lambda c, w: f"(select quantile_cont({c},{q}) from cand {w})-1e-12"
    linked = "where linked"
    return f"""select '{name}' as quantile, count(*) filter (linked and ecr>={lim('ecr', '')} and tags>={lim('tags', linked)} and measures>={lim('measures', linked)} and max_ce>={lim('max_ce', linked)}) as n_a from cand"""


@query("track_quantile_sensitivity", f"with {FULL} " + " union all ".join(_sens(n, q) for n, q in (("q75", "0.75::double"), ("q67", "2/3.0::double"), ("q50", "0.5::double"))))
def quantile_sensitivity(t):
    return P.quantile_sensitivity(candidates(t), {"q75": 0.75, "q67": 2 / 3, "q50": 0.5})


@query("capacity_plan", f"""with {TRACK}, top as (select track from tr order by ecr desc, link_id limit 111) select least(111,(select count(*) from tr))::bigint as n_admin, 'budget' as bottleneck, count(*) filter (track='A') as n_a,
    count(*) filter (track='B') as n_b, greatest((select count(*) from tr)-111,0)::bigint as n_wait from top""")
def capacity_plan(t):
    return P.capacity_plan(cut_lineage(P.classify_tracks(candidates(t))), 2_000_000_000, 18_000_000, 150)


@query("review_flag", f"with {FULL}, top as (select link_id from cand order by ecr desc, link_id limit 111) select link_id, link_id in (select link_id from top) and (coalesce(tags,0)>=3 or coalesce(measures,0)>=3) as review from cand")
def review_flag(t):
    c = candidates(t)
    n, _ = P.capacity(2_000_000_000, 18_000_000, 150)
    top = c.select("link_id", "ecr").orderBy(F.desc("ecr"), "link_id").limit(n).select("link_id").withColumn("priority", F.lit(True))
    df = c.join(top, "link_id", "left").withColumn("priority", F.coalesce("priority", F.lit(False)))
    return P.review_flag(df).select("link_id", "review")


@query("delta_ecr", f"with {ECR}, {EFF} select f.link_id, f.measure_id, round(e.ecr*f.effect,6)+0 as delta_ecr from eff f join ecr e on e.link_id=f.link_id")
def delta_ecr(t):
    df = effects(t).join(P.ecr_score(t("d_candidates")).select("link_id", "ecr"), "link_id")
    return P.delta_ecr(df).select("link_id", "measure_id", r_to("delta_ecr").alias("delta_ecr"))


TAGGED = """select o_orderkey as link_id, case o_orderkey%6 when 0 then '우회전 미감속' when 1 then '우회전 미감속,시야 제한 상충' when 2 then '짧은 PET/TTC' when 3 then '횡단부 상충,우회전 미감속' when 4 then '' else '등교시간 반복 상충' end as tags from orders"""
_VALUES = ",".join(f"('{k}','{m}')" for k, v in P.TAG_MEASURES.items() for m in v)


@query("tag_to_measures", f"with g as ({TAGGED}), s as (select link_id, unnest(string_split(tags,',')) as tag from g), d(tag, measure) as (values {_VALUES}) select distinct s.link_id, d.measure from s join d on d.tag=s.tag")
def tag_to_measures(t):
    from kerbline.functions.text import split_tags

    return P.measures_for_tags(t.sql(TAGGED).select("link_id", split_tags("tags").alias("tags")))


@query("candidate_filter_view", f"with {TRACK} select link_id, ecr, track from tr where track='A' or not linked order by ecr desc, link_id")
def candidate_filter_view(t):
    df = P.classify_tracks(candidates(t)).filter((F.col("track") == "A") | ~F.col("linked"))
    return df.select("link_id", "ecr", "track").orderBy(F.desc("ecr"), "link_id")


@query("eval_auc", """with k as (select accident, rank() over (order by r)+(count(*) over (partition by r)-1)/2.0::double as ar from d_candidates)
    select round((sum(case when accident=1 then ar else 0 end)-sum(accident)*(sum(accident)+1)/2.0::double)/(sum(accident)*sum(1-accident))::double,6)+0 as auc from k""")
def eval_auc(t):
    return S.auc(t("d_candidates"), "r", "accident").select(r_to("auc").alias("auc"))


@query("eval_lift", f"with {GATED} select round((select avg(accident) from gated)/(select avg(accident) from d_candidates),6)+0 as lift")
def eval_lift(t):
    g = P.gate_candidates(t("d_candidates")).select("link_id").withColumn("hit", F.lit(True))
    df = t("d_candidates").join(g, "link_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return S.lift(df, "hit", "accident").select(r_to("lift").alias("lift"))


_VARS = {"pct_squared": "2*pr*pr", "pct_root": "2*sqrt(pr)", "raw_scaled": "(r-lo)/(hi-lo)", "log_shift": "ln(r-lo+0.1::double)"}


def _stab() -> str:
    parts = []
    for n, f in _VARS.items():
        parts.append(f"""select '{n}' as variant, (select corr(a,b) from (select {PCT('ecr')} as a, {PCT('x')} as b from (select ecr, round(e*{f},9) as x from st))) as rho,
          (select count(*) from (select link_id from st order by ecr desc, link_id limit 20) where link_id in (select link_id from st order by round(e*{f},9) desc, link_id limit 20)) as c""")
    return " union all ".join(parts)


@query("eval_rank_stability", f"""with {ECR}, st as (select *, {PCT('r')} as pr, min(r) over () as lo, max(r) over () as hi from ecr), v as ({_stab()})
    select variant, round(rho,6)+0 as spearman, round(c/(40-c)::double,6)+0 as jaccard_20 from v""")
def rank_stability(t):
    from kerbline.operators.ranking import pct_rank

    base = cut_lineage(pct_rank(P.ecr_score(t("d_candidates")), "r", "pr"))
    df = S.attach(base, base.agg(F.min("r").alias("lo"), F.max("r").alias("hi")))
    pr, r, e, lo, hi = (F.col(c) for c in ("pr", "r", "e", "_s.lo", "_s.hi"))
    variants = {"pct_squared": pr * pr * 2, "pct_root": F.sqrt(pr) * 2, "raw_scaled": (r - lo) / (hi - lo), "log_shift": F.log(r - lo + 0.1)}
    out = P.rank_stability(df, {k: F.round(e * v, 9) for k, v in variants.items()}, [20])
    return out.select("variant", r_to("spearman").alias("spearman"), r_to("jaccard_20").alias("jaccard_20"))
