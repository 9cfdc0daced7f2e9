"""Readers and writers: data rendered from the tables in the formats of the real inputs and read back."""

import uuid

from pyspark.sql import functions as F

from kerbline.catalog.functions_q import SYL, SYL2
from kerbline.catalog.measures import part_lines
from kerbline.catalog.registry import query
from kerbline.functions.geometry import r_to
from kerbline.operators import spatial as S
from kerbline.operators.frames import valid_coords
from kerbline.session import run_dir
from kerbline.sources import delimited as D
from kerbline.sources import layers as L
from kerbline.sources import records as J


def folder(t, name: str) -> str:
    return f"{run_dir(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


NAMED = f"select s_suppkey, concat({SYL},{SYL2},'초') as name, s_acctbal from supplier"


@query("src_csv_encoded", f"select s_suppkey, concat({SYL},{SYL2},'초') as name from supplier")
def csv_encoded(t):
    """A cp949 file written and read in its encoding."""
    path = folder(t, "cp949")
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    t.sql(NAMED).select("s_suppkey", "name").write.csv(path, header=True, encoding="cp949")
    return D.read_csv_encoded(t.spark, path, "s_suppkey bigint, name string", "cp949")


@query("src_csv_sep_sniff", f"select s_suppkey, concat({SYL},{SYL2},'초') as name from supplier")
def csv_sep_sniff(t):
    """Commas in UTF-8 and tabs in cp949, told apart per file."""
    path = folder(t, "mixed")
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    n = t.sql(NAMED).select("s_suppkey", "name")
    n.filter("s_suppkey%2=0").coalesce(1).write.mode("append").csv(path, header=True, encoding="UTF-8")
    n.filter("s_suppkey%2=1").coalesce(1).write.mode("append").csv(path, header=True, encoding="cp949", sep="\t")
    df = D.read_any_csv(t.spark, path + "/*.csv", ["s_suppkey", "name"])
    return df.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "name")


MIXED = """select 'NODE' as kind, cast(n as string) as node_id, cast(null as string) as link_id, cast(null as string) as length from d_nodes
    union all select 'LINK', null, cast(walk_edge_id as string), cast(length_m as string) from d_walk"""


@query("src_csv_chunked", "select 'NODE' as kind, count(*) as n from d_nodes union all select 'LINK', count(*) from d_walk")
def csv_chunked(t):
    path = folder(t, "network")
    t.sql(MIXED).write.csv(path, header=True)
    parts = D.split_by_kind(D.read_csv_encoded(t.spark, path, "kind string, node_id string, link_id string, length string"), "kind")
    return parts["NODE"].unionByName(parts["LINK"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("src_multi_file_union", "select case when s_suppkey%3=0 then 'east' when s_suppkey%3=1 then 'north' else 'west' end as district, count(*) as n from supplier group by 1")
def multi_file_union(t):
    """Files per district, one of them without the needed columns, which goes to the quarantine."""
    path, columns = folder(t, "districts"), ["s_suppkey", "name"]
    n = t.sql(NAMED).withColumn("d", F.when(F.expr("s_suppkey%3=0"), "east").when(F.expr("s_suppkey%3=1"), "north").otherwise("west"))
    for d in ("east", "north", "west"):
        n.filter(F.col("d") == d).select(*columns).coalesce(1).write.csv(f"{path}/gates_{d}", header=True)
    n.filter("s_suppkey<5").select("s_acctbal").coalesce(1).write.csv(f"{path}/gates_broken", header=True)
    good = D.good_rows(D.scan_any_csv(t.spark, path + "/gates_*/*.csv", columns, columns), columns)
    return good.groupBy(F.regexp_extract("path", r"gates_([a-z]+)/", 1).alias("district")).agg(F.count("*").alias("n"))


QUOTED = f"select s_suppkey, concat({SYL},{SYL2},', \"',cast(s_suppkey as string),'\"',chr(10),'초') as name from supplier"


@query("src_csv_quoted", QUOTED)
def csv_quoted(t):
    """Cells with separators, quotes and line breaks, in commas and in tabs."""
    path = folder(t, "quoted")
    n = t.sql(QUOTED)
    n.filter("s_suppkey%2=0").write.mode("append").csv(path, header=True, escape='"')
    n.filter("s_suppkey%2=1").write.mode("append").csv(path, header=True, escape='"', sep="\t")
    df = D.read_any_csv(t.spark, path + "/*.csv", ["name", "s_suppkey"])
    return df.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "name")


@query("src_csv_quarantine", """with b as (select s_suppkey, floor(s_suppkey/20.0) as file from supplier)
    select 'read' as reason, count(*) as n from b where file%3<>2 and s_suppkey%10<>0
    union all select 'more cells than columns', count(*) from b where file%3<>2 and s_suppkey%10=0
    union all select 'column missing: name', count(distinct file) from b where file%3=2""")
def csv_quarantine(t):
    """Files of twenty suppliers; every third lacks a column, and every tenth row has a cell too many. Reasons without rows count 0."""
    path, columns = folder(t, "quarantine"), ["s_suppkey", "name"]
    line = F.expr("concat(s_suppkey, ',', name, if(s_suppkey%10=0, ',x', ''))")
    files = t.sql(NAMED).groupBy(F.expr("cast(floor(s_suppkey/20.0) as int)").alias("file")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    text = F.concat(F.when(F.expr("file%3=2"), "s_suppkey,title\n").otherwise("s_suppkey,name\n"), "body")
    files.select("file", text.alias("value")).write.partitionBy("file").text(path)
    scanned = D.scan_any_csv(t.spark, path + "/*/*.txt", columns, columns)
    reasons = F.explode(F.array(*[F.lit(r) for r in ("read", "more cells than columns", "column missing: name")]))
    rows = scanned.select(F.coalesce("reason", F.lit("read")).alias("reason"), F.lit(1).alias("n"))
    return rows.unionByName(t.spark.range(1).select(reasons.alias("reason"), F.lit(0).alias("n"))).groupBy("reason").agg(F.sum("n").alias("n"))


ACC_STRUCT = "struct<acdnt_no:bigint,x_crdnt:double,y_crdnt:double>"


@query("src_json_records", "select user_id, acdnt_no, x as x_crdnt, y as y_crdnt from d_accidents where user_id%4<>3")
def json_records(t):
    """Accident lists under three different keys; a fourth kind of document holds none."""
    rec = F.to_json(F.collect_list(F.struct("acdnt_no", F.col("x").alias("x_crdnt"), F.col("y").alias("y_crdnt"))))
    docs = t("d_accidents").groupBy("user_id", F.expr("acdnt_no div 500").alias("page")).agg(rec.alias("l")).select("user_id", (
        F.when(F.expr("user_id%4=0"), F.concat(F.lit('{"resultValue":{"accidentInfoList":'), F.col("l"), F.lit("}}")))
        .when(F.expr("user_id%4=1"), F.concat(F.lit('{"items":'), F.col("l"), F.lit("}")))
        .when(F.expr("user_id%4=2"), F.concat(F.lit('{"data":'), F.col("l"), F.lit(',"n":1}'))).otherwise(F.lit('{"none":[1]}'))
    ).alias("doc"))
    return J.first_records(docs, "doc", ACC_STRUCT)


@query("src_json_item_or_list", "select s_suppkey, k as item from supplier cross join (select 0 as k union all select 1) where s_suppkey%5<>4 and (s_suppkey%2=0 or k=0)")
def json_item_or_list(t):
    one = '{"item":0}'
    body = F.when(F.expr("s_suppkey%2=0"), F.lit('[{"item":0},{"item":1}]')).otherwise(F.lit(one))
    doc = F.concat(F.lit('{"response":{"body":{"items":{"item":'), body, F.lit("}}}"), F.when(F.expr("s_suppkey%5=4"), "").otherwise("}"))
    return J.item_or_list(t("supplier").select("s_suppkey", doc.alias("doc")), "doc", "struct<item:int>")


@query("src_json_batches", "select acdnt_no, x, y from d_accidents")
def json_batches(t):
    path = folder(t, "batches")
    t("d_accidents").select("acdnt_no", "x", "y").repartition(4).write.json(path)
    return J.read_json_batches(t.spark, path, "acdnt_no bigint, x double, y double").select("acdnt_no", "x", "y")


@query("src_geojson", "select fid, category, x, y from d_facilities")
def geojson(t):
    path = folder(t, "points")
    f = t("d_facilities").select(J.to_feature(J.point_geometry("x", "y"), ["fid", "category"], "fid").alias("value"))
    J.write_features(f, path)
    df = J.read_feature_lines(t.spark, path, "fid:bigint,category:string", "array<double>")
    return df.select("properties.fid", "properties.category", F.get("geometry.coordinates", F.lit(0)).alias("x"), F.get("geometry.coordinates", F.lit(1)).alias("y"))


@query("src_geojson_collection", "select fid from d_facilities")
def geojson_collection(t):
    """Whole FeatureCollection documents, one per category and bucket."""
    path = folder(t, "collections")
    one = F.struct(F.lit("Feature").alias("type"), J.point_geometry("x", "y").alias("geometry"), F.struct("fid").alias("properties"))
    docs = t("d_facilities").groupBy("category", F.expr("fid div 200").alias("b")).agg(F.collect_list(one).alias("features"))
    docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).repartition(4, "value").write.text(path)
    rows = t.spark.read.schema(
        "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<fid:bigint>>>"
    ).json(path)
    return rows.select(F.explode("features").alias("f")).select("f.properties.fid")


@query("sink_geojson")
def sink_geojson(t):
    return part_lines(t).select("line_id", J.to_feature(J.line_geometry("geom"), ["line_id"], "line_id").alias("feature"))


@query("sink_geojson_collection", """select line_id, count(*) as points, max(x) filter (seq=0) as x0, max(y) filter (seq=4) as y4, (select count(*) from d_facilities) as stated
    from d_vertices group by 1""")
def sink_geojson_collection(t):
    """Lines written as FeatureCollection files and read back, beside the number of features that the files state."""
    path = folder(t, "lines")
    J.write_collections(part_lines(t).select(J.to_feature(J.line_geometry("geom"), ["line_id"], "line_id").alias("value")), path, {"layer": "lines"}, files=4)
    at = lambda i, c: F.get(F.get("geometry.coordinates", F.lit(i)), F.lit(c))
    lines = J.read_feature_collection(t.spark, path, "line_id:bigint").select(
        "properties.line_id", F.size("geometry.coordinates").cast("bigint").alias("points"), at(0, 0).alias("x0"), at(4, 1).alias("y4"))
    return lines.withColumn("stated", J.read_collection_counts(t.spark, path).agg(F.sum("features")).scalar())


@query("merge_geojson", "select fid as id, category as kind from d_facilities union all select zone_id, school_name from d_zones")
def merge_geojson(t):
    a, b = folder(t, "a"), folder(t, "b")
    J.write_features(t("d_facilities").select(J.to_feature(J.point_geometry("x", "y"), ["fid", "category"]).alias("value")), a)
    J.write_features(t("d_zones").select(J.to_feature(J.point_geometry("cx", "cy"), ["zone_id", "school_name"]).alias("value")), b)
    fa = J.read_feature_lines(t.spark, a, "fid:bigint,category:string", "array<double>").select("geometry", "properties.*")
    fb = J.read_feature_lines(t.spark, b, "zone_id:bigint,school_name:string", "array<double>").select("geometry", "properties.*")
    m = fa.unionByName(fb, allowMissingColumns=True)
    return m.select(F.coalesce("fid", "zone_id").alias("id"), F.coalesce("category", "school_name").alias("kind"))


@query("validate_features", """select case fid%5 when 0 then 'type' when 1 then 'geometry_type' when 2 then 'coordinates' else 'ok' end as reason, count(*) as n from d_facilities group by 1""")
def validate_features(t):
    text = (
        F.when(F.expr("fid%5=0"), '{"type":"Thing","geometry":null,"properties":{}}').when(F.expr("fid%5=1"), '{"type":"Feature","geometry":{"type":"Blob","coordinates":[1,2]},"properties":{}}')
        .when(F.expr("fid%5=2"), '{"type":"Feature","geometry":{"type":"Point"},"properties":{}}').when(F.expr("fid%5=3"), '{"type":"Feature","geometry":null,"properties":{}}')
        .otherwise(J.to_feature(J.point_geometry("x", "y"), ["fid"]))
    )
    df = J.validate_features(t("d_facilities").withColumn("text", text), "text")
    return df.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("validate_bbox_warn", """select count(*) filter (not (124+x/500 between 124 and 132 and 30+y/300 between 33 and 39)) as outside, count(*)-count(distinct school_name) as duplicate_names from d_gates""")
def bbox_warn(t):
    g = t("d_gates").select("school_name", (124 + F.col("x") / 500).alias("lon"), (30 + F.col("y") / 300).alias("lat"))
    return J.bbox_warnings(g, "school_name", "lon", "lat")


@query("sink_csv_dual", f"select s_suppkey, concat({SYL},{SYL2},'초') as utf8_name, concat({SYL},{SYL2},'초') as cp949_name from supplier")
def csv_dual(t):
    path = folder(t, "dual")
    D.write_csv_dual(t.sql(NAMED).select("s_suppkey", "name"), path, "schools")
    a = D.read_csv_encoded(t.spark, path + "/schools_utf8", "s_suppkey bigint, utf8_name string")
    b = D.read_csv_encoded(t.spark, path + "/schools_cp949", "s_suppkey bigint, cp949_name string", "cp949")
    return a.join(b, "s_suppkey")


@query("sink_summary_json", "select '{\"links\":'||count(*)||',\"primary\":'||count(*) filter (road_class='primary')||'}' as summary from d_roads")
def sink_summary(t):
    return J.summary_json(t("d_roads"), [F.count("*").alias("links"), F.count_if(F.col("road_class") == "primary").alias("primary")])


@query("src_bbox_scan", "select u, v from d_lattice where greatest(x1,x2)>=700 and least(x1,x2)<=2300 and greatest(y1,y2)>=100 and least(y1,y2)<=1300")
def bbox_scan(t):
    """Links stored with their extent and read back through a box, padded by 300 m."""
    path = folder(t, "links")
    S.with_bbox(t("d_lattice")).repartitionByRange("minx", "miny").write.parquet(path)
    return S.bbox_scan(t.spark.read.parquet(path), 1000, 400, 2000, 1000, 300).select("u", "v")


@query("src_column_subset", "select o_orderkey, o_totalprice from orders")
def column_subset(t):
    return t("orders").select("o_orderkey", "o_totalprice")


@query("layered_write_read", "select bld_id, x, y from d_buildings where bld_id%20=7")
def layered(t):
    path = folder(t, "layers")
    b = t("d_buildings").withColumn("zone_layer", F.concat(F.lit("zone"), (F.col("bld_id") % 20).cast("string")))
    first = F.col("zone_layer").isin("zone1", "zone7")
    L.write_layers(b.filter(first), path)
    L.write_layers(b, path)  # layers already written are skipped
    return L.read_layer(t.spark, path, "zone7").select("bld_id", "x", "y")


@query("export_optimize")
def export_optimize(t):
    return L.slim_report(L.slim(part_lines(t), ["line_id"], "geom", 6.0)).withColumn("shrink_pct", r_to("shrink_pct", 2))


@query("src_valid_points", "select acdnt_no from d_accidents where x<>0 and y<>0 and acdnt_no%10<>0")
def valid_points(t):
    """Service records with their dummy zero coordinates dropped."""
    zero = F.when(F.expr("acdnt_no%10=0"), 0.0)
    df = t("d_accidents").withColumns({"x": F.coalesce(zero, "x"), "y": F.coalesce(zero, "y")})
    return valid_coords(df).select("acdnt_no")
