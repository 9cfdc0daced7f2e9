"""Text, cast and score functions."""

from pyspark.sql import functions as F

from kerbline.catalog.registry import query
from kerbline.functions import bands as B
from kerbline.functions import text as X
from kerbline.functions.geometry import clamp, r_to
from kerbline.operators.stats import sqrt_clip

KOREAN = "가나다라마바사아자차카타파하"
SYL = f"substr('{KOREAN}', cast(1+s_suppkey%14 as int), 1)"
SYL2 = f"substr('{KOREAN}', cast(1+(s_suppkey*5)%14 as int), 1)"
ZONE_NAMES = f"""
    select s_suppkey, case s_suppkey%4 when 0 then concat('서울',{SYL},{SYL2},'초통학구역')
      when 1 then concat({SYL},{SYL2},'초통학구역')
      when 2 then concat('서울',{SYL},'초서울',{SYL2},'초공동통학구역') else concat({SYL},'-구역 ',{SYL2}) end as zone_name
    from supplier"""
ADDRESSES = f"""
    select s_suppkey, case s_suppkey%5 when 0 then concat('서울시 ',{SYL},'로  ',cast(s_suppkey as string),' (',{SYL2},'동)')
      when 1 then concat('관악구 ',{SYL},'길 ',cast(s_suppkey as string))
      when 2 then concat('서울 ',{SYL},'로 ',cast(s_suppkey%90 as string),'  101동 203호')
      when 3 then concat({SYL},'아파트 12 동') else concat('  ',{SYL},{SYL2},'   골목') end as address
    from supplier"""
NUMBERS = """
    select event_id, case event_id%6 when 0 then 'n/a' when 1 then '' when 2 then concat(' ',cast(event_id as string),' ')
      when 3 then concat(cast(event_id as string),'.0') when 4 then concat('-',cast(event_id as string),'.5') else null end as raw
    from events"""


@query("fn_coerce_numeric", f"with n as ({NUMBERS}) select event_id, try_cast(trim(raw) as double) as value from n")
def coerce_numeric(t):
    return t.sql(NUMBERS).select("event_id", X.to_number("raw").alias("value"))


@query("fn_id_normalise", f"""with n as ({NUMBERS}) select event_id,
    cast(trunc(try_cast(trim(raw) as double)) as bigint) as id from n where event_id%6 in (0,1,2,3,5)""")
def id_normalise(t):
    return t.sql(NUMBERS).filter("event_id%6 in (0,1,2,3,5)").select("event_id", X.to_id("raw").alias("id"))


@query("fn_code_zero_pad", """select event_id, case when event_id%7=0 then 'NA'
    else lpad(cast((event_id*13)%10000 as varchar), 4, '0') end as code from events""")
def code_zero_pad(t):
    raw = F.when(F.expr("event_id%7") != 0, ((F.col("event_id") * 13) % 10000).cast("double"))
    return t("events").select("event_id", X.zero_pad(raw).alias("code"))


CLEAN = """select event_id, case event_id%5 when 0 then '  ' when 1 then 'NaN' when 2 then concat(' ',event_type,' ')
    when 3 then null else event_type end as raw from events"""


@query("fn_clean_str", f"""with c as ({CLEAN}) select event_id,
    case when lower(trim(raw)) in ('','nan') then null else trim(raw) end as value from c""")
def clean_str(t):
    return t.sql(CLEAN).select("event_id", X.clean("raw").alias("value"))


@query("fn_fix_mojibake", f"with z as ({ZONE_NAMES}) select s_suppkey, zone_name, zone_name as repaired from z")
def mojibake(t):
    """Korean names garbled the way a wrong decoder leaves them, and repaired."""
    names = t.sql(ZONE_NAMES)
    from kerbline.functions.text import garble

    return names.select("s_suppkey", "zone_name", X.fix_mojibake(garble("zone_name")).alias("repaired"))


@query("fn_zone_to_layer", f"""with z as ({ZONE_NAMES}),
    a as (select s_suppkey, regexp_replace(regexp_replace(zone_name,'공동통학구역$',''),'통학구역$','') as nm from z),
    b as (select s_suppkey, case when regexp_extract(nm,'서울\\S+초|[가-힣]+초',0)<>'' then regexp_extract(nm,'서울\\S+초|[가-힣]+초',0) else nm end as nm from a),
    c as (select s_suppkey, regexp_replace(regexp_replace(nm,'^서울',''),'[^\\p{{L}}\\p{{N}}_]','','g') as nm from b)
    select s_suppkey, case when nm='' then 'unknown_res' else concat(nm,'_res') end as layer from c""")
def zone_to_layer(t):
    return t.sql(ZONE_NAMES).select("s_suppkey", X.zone_layer("zone_name").alias("layer"))


SCHOOLS = f"select s_suppkey, concat(case when s_suppkey%2=0 then '서울' else '' end,{SYL},{SYL2},'초등학교') as school from supplier"


@query("fn_school_short_name", f"""with s as ({SCHOOLS}) select s_suppkey,
    regexp_replace(regexp_replace(school,'^서울',''),'등학교$','') as short,
    concat(regexp_replace(regexp_replace(school,'^서울',''),'등학교$',''),'_x') as layer from s""")
def school_short_name(t):
    s = t.sql(SCHOOLS).withColumn("short", X.school_short("school"))
    return s.select("s_suppkey", "short", F.concat(X.layer_short(F.concat("short", F.lit("_res"))), F.lit("_x")).alias("layer"))


@query("fn_zone_to_school", f"""with z as ({ZONE_NAMES}), s as ({SCHOOLS})
    select s_suppkey, concat(substr(zone_name,1,length(zone_name)-4),'등학교') as school from z
    where right(zone_name,5)='초통학구역'
      and concat(substr(zone_name,1,length(zone_name)-4),'등학교') in (select school from s)""")
def zone_to_school(t):
    zones = t.sql(ZONE_NAMES).select("s_suppkey", X.zone_school("zone_name").alias("school"))
    return zones.join(t.sql(SCHOOLS).select("school"), "school", "left_semi")


@query("fn_address_clean", f"""with a as ({ADDRESSES}),
    b as (select s_suppkey, replace(replace(address,'서울시','서울특별시'),'서울 ','서울특별시 ') as s from a),
    c as (select s_suppkey, case when starts_with(s,'관악구') then concat('서울특별시 ',s) else s end as s from b)
    select s_suppkey, trim(regexp_replace(regexp_replace(s,'\\([^)]*\\)','','g'),'\\s+',' ','g')) as address from c""")
def address_clean(t):
    return t.sql(ADDRESSES).select("s_suppkey", X.clean_address("address").alias("address"))


@query("fn_address_variants", f"""with a as ({ADDRESSES}),
    q as (select s_suppkey, regexp_replace(trim(address),'\\s+',' ','g') as q from a),
    v as (select s_suppkey, q as v from q
      union select s_suppkey, trim(regexp_replace(regexp_replace(q,'\\s+\\d{{1,4}}\\s*동(\\s+\\d{{1,4}}\\s*호)?$',''),'\\s+\\d{{1,4}}\\s*동.*$','')) from q
      union select s_suppkey, concat('서울 관악구 ',q) from q where not starts_with(q,'서울') and not starts_with(q,'관악구'))
    select s_suppkey, v as variant from v where v<>''""")
def address_variants(t):
    return t.sql(ADDRESSES).select("s_suppkey", F.explode(X.address_variants("address")).alias("variant"))


@query("fn_contains_any_column", "select s_suppkey, s_name from supplier where contains(s_name, '7')")
def contains_any_column(t):
    s = t("supplier")
    col = X.first_column_containing(s, ["s_nationkey_x", "s_name"] if "s_nationkey_x" in s.columns else ["s_name"], ["7"])
    return s.filter(F.col(col).contains("7")).select("s_suppkey", "s_name")


TAGS = "select o_orderkey, concat(o_orderstatus,',',case when o_orderkey%3=0 then '' else o_orderpriority end,',','z') as tags from orders"


@query("fn_tags_csv_split", f"""with s as ({TAGS}), x as (select o_orderkey, list_filter(string_split(tags,','), lambda v: v<>'') as l from s)
    select o_orderkey, cast(len(l) as int) as n, array_to_string(l,',') as again, l[1] as first_tag from x""")
def tags_csv_split(t):
    s = t.sql(TAGS).withColumn("l", X.split_tags("tags"))
    return s.select("o_orderkey", F.size("l").alias("n"), X.join_tags("l").alias("again"), F.element_at("l", 1).alias("first_tag"))


@query("fn_json_array_parse", """select l_orderkey, l_linenumber, concat('m',cast(l_partkey%7 as varchar)) as measure,
    cast(l_partkey%5 as double)/4 as effect_reduction from lineitem""")
def json_array_parse(t):
    text = F.concat(
        F.lit('[{"measure":"m'), (F.col("l_partkey") % 7).cast("string"), F.lit('","effect_reduction":'),
        ((F.col("l_partkey") % 5) / 4).cast("string"), F.lit("}]"),
    )
    return (
        t("lineitem").select("l_orderkey", "l_linenumber", F.inline(X.parse_measures(text)))
        .select("l_orderkey", "l_linenumber", "measure", "effect_reduction")
    )


@query("fn_json_nan_to_null", """select event_id, case when event_id%4 in (0,1) then null else value end as v,
    case when event_id%4=0 then '{"event_id":'||event_id||'}' else null end as j from events""")
def json_nan_to_null(t):
    v = (
        F.when(F.expr("event_id%4=0"), F.lit(float("nan"))).when(F.expr("event_id%4=1"), F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    df = X.finite_columns(t("events").select("event_id", v.alias("v")))
    return df.withColumn("j", F.when(F.expr("event_id%4=0"), F.to_json(F.struct("event_id", "v"))))


@query("fn_first_matching_column", "select c_custkey, c_name as picked from customer")
def first_matching(t):
    c = t("customer")
    return c.select("c_custkey", F.col(X.first_matching_column(c.columns, ["name"], ["_name"])).alias("picked"))


@query("fn_sqrt_clip", "select link_id, case when link_id%13=0 then null else round(sqrt(greatest(r,0)),6)+0 end as v from d_candidates")
def sqrt_clip_q(t):
    return t("d_candidates").select("link_id", r_to(sqrt_clip(F.when(F.expr("link_id%13<>0"), F.col("r")))).alias("v"))


@query("fn_clip", "select link_id, case when link_id%13=0 then null else greatest(least(r,cast(2 as double)),cast(-1 as double)) end as v from d_candidates")
def clip_q(t):
    return t("d_candidates").select("link_id", clamp(F.when(F.expr("link_id%13<>0"), F.col("r")), -1.0, 2.0).alias("v"))


@query("fn_discount_piecewise", """select link_id, round(case when e*3<=5 then 1 when e*3<=25 then 1-(e*3-5)/40
    when e*3<=80 then 0.5-(e*3-25)/110 else 0 end::double,6)+0 as v from d_candidates""")
def discount(t):
    return t("d_candidates").select("link_id", r_to(B.distance_discount(F.col("e") * 3)).alias("v"))


@query("fn_risk_band", """select walk_edge_id, case when risk<=0.33::double then 'safe' when risk<=0.66::double then 'caution'
    when risk<=0.85::double then 'danger' else 'severe' end as band from d_walk""")
def risk_band(t):
    return t("d_walk").select("walk_edge_id", B.risk_band("risk").alias("band"))


@query("fn_color_band", """select walk_edge_id, case when walk_edge_id%13=0 then '#9ca3af' when risk<=0 then '#1a9850'
    when risk<0.2::double then '#66bd63' when risk<0.4::double then '#a6d96a' when risk<0.6::double then '#fee08b'
    when risk<0.8::double then '#f46d43' else '#d73027' end as walk_colour,
    case when walk_edge_id%13=0 then '#9ca3af' when risk<0.2::double then '#1a9850' when risk<0.4::double then '#91cf60'
    when risk<0.6::double then '#ffffbf' when risk<0.8::double then '#fc8d59' else '#d73027' end as road_colour from d_walk""")
def color_band(t):
    s = F.when(F.expr("walk_edge_id%13<>0"), F.col("risk"))
    return t("d_walk").select("walk_edge_id", B.walk_colour(s).alias("walk_colour"), B.road_colour(s).alias("road_colour"))
