"""File sources and exports (S1-S3, S5, S12, S13, S15): the given tables are written out as such files, in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import bound, table
from lodestar.bindings.spatial import _ELEM, elements
from lodestar.sources import files as S
from lodestar.sources.scratch import scratch

col = F.col


def folder(spark) -> str:
    return scratch(spark, "files")


def told(name: str, kind: str = "bigint"):
    """The value of a folder name=value in a file's path."""
    return F.regexp_extract("file", f"{name}=([^/]+)", 1).cast(kind).alias(name)


def element_files(spark, d):
    """A table for each chart: points and curves of the parts."""
    e = elements(spark, d)
    none = F.lit(None).cast("double")
    rows = e.select("chart", "n", F.when(col("shape") == "punto", "punto").otherwise("curva").alias("tipo"), "id", col("series").alias("serie"), (col("x1") / 7).alias("x1_mm"), col("y1").alias("y1_mm"), (col("x2") / 7).alias("x2_mm"), col("y2").alias("y2_mm"), F.when(col("shape") == "punto", col("x1")).otherwise(none).alias("valor_x"), none.alias("valor_y"), F.lit(None).cast("string").alias("tendencia"), F.concat(F.lit('dice "'), "id", F.lit('", y más')).alias("texto"))
    out = folder(spark)
    S.write_elements(rows, out, "chart")
    return out


@bound("s1_element_tables", f"""with e as ({_ELEM}) select chart, id, case shape when 'punto' then 'punto' else 'curva' end as tipo, series as serie, round_even(x1/7, 4) as x1_mm, y1 as y1_mm, round_even(x2/7, 4) as x2_mm, y2 as y2_mm, case when shape = 'punto' then x1 end as valor_x, 'dice "' || id || '", y más' as texto from e""")
def s1(spark, d):
    rows, _ = S.read_elements(spark, element_files(spark, d) + "/*")
    return rows.select(told("chart"), "id", "tipo", "serie", "x1_mm", "y1_mm", "x2_mm", "y2_mm", "valor_x", "texto")


@bound("s12_element_export", f"""with e as ({_ELEM}) select chart, count(*) + 1 as lineas, string_agg(id, ',' order by case shape when 'punto' then 3 else 4 end, n) as ids from e group by 1""")
def s12(spark, d):
    lines = spark.read.text(element_files(spark, d) + "/*", wholetext=True).select(col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\n"), lambda x: x != "").alias("v"))
    ids = F.transform(F.slice("v", 2, F.size("v")), lambda x: F.get(F.split(x, ","), F.lit(1)))
    return lines.select(told("chart"), F.size("v").alias("lineas"), F.array_join(ids, ",").alias("ids"))


@bound("s2_point_tables", """with p as (select user_id, event_id, value as x, event_id % 300 - 100.0 as y, event_id*2.0 as v from events), g as (select user_id, count(*) as puntos, min(x) as a, max(x) as b, min(y) as c, max(y) as e, round(sum(v), 3) as total from p group by 1)
 select user_id, puntos, total, 'Usuario ' || user_id as titulo, round(case when user_id % 3 = 0 then -5 else a - greatest(10, 0.08*(b-a)) end, 6) as x0, round(b + greatest(10, 0.08*(b-a)), 6) as x1, round(c - greatest(10, 0.08*(e-c)), 6) as y0, round(e + greatest(10, 0.08*(e-c)), 6) as y1 from g""")
def s2(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "value")
    # every second table has other names, semicolons and decimal commas; every third says where x begins
    odd = col("user_id") % 2 == 1
    say = lambda c: F.when(odd, F.translate(c.cast("string"), ".", ",")).otherwise(c.cast("string"))
    sep = F.when(odd, ";").otherwise(",")
    line = F.concat(F.lit("e"), col("event_id").cast("string"), sep, say(col("value")), sep, say(col("event_id") % 300 - 100.0), sep, say(col("event_id") * 2.0))
    head = F.array(F.concat(F.lit("# Título: Usuario "), col("user_id").cast("string")), F.when(col("user_id") % 3 == 0, "#origen_x = -5").otherwise("# nota: ninguna"), F.when(odd, "Etiqueta;X;Y;Value").otherwise("mes,x,y,valor"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(col("event_id").alias("k"), line.alias("line")))), lambda x: x["line"])
    texts = ev.groupBy("user_id").agg(lines.alias("lines")).select("user_id", F.array_join(F.concat(head, "lines"), "\n").alias("text"))
    out = folder(spark)
    S.write_texts(texts, out, "user_id", "text")
    pts, charts = S.read_points(spark, out + "/*")
    sums = pts.groupBy("file").agg(F.count(F.lit(1)).alias("puntos"), F.round(F.sum("valor"), 3).alias("total"))
    return charts.join(sums, "file").select(F.regexp_extract("titulo", "([0-9]+)$", 1).cast("bigint").alias("user_id"), "puntos", "total", "titulo", *(F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")))


@bound("s3_sessions", """select case when s_suppkey % 2 = 0 then 'P' || s_suppkey else 'placa=' || s_suppkey end as placa, count(l_orderkey) as ensayos, round(sum(l_quantity), 3) as error, count_if(l_returnflag = 'R') as aciertos from supplier left join lineitem on l_suppkey = s_suppkey where s_suppkey % 7 > 0 group by s_suppkey""")
def s3(spark, d):
    trial = F.struct(F.concat(F.lit("e"), "l_partkey").alias("objetivo"), col("l_linenumber").alias("frames"), (col("l_returnflag") == "R").alias("acierto_estricto"), col("l_quantity").cast("double").alias("error_mm"))
    trials = table(spark, d, "lineitem").groupBy(col("l_suppkey").alias("s_suppkey")).agg(F.collect_list(trial).alias("detalle"))
    doc = F.to_json(F.struct(F.lit("objetivos").alias("prueba"), F.when(col("s_suppkey") % 2 == 0, F.concat(F.lit("P"), "s_suppkey")).alias("placa"), F.lit("2026-01-01").alias("fecha"), "detalle"))
    files = table(spark, d, "supplier").select("s_suppkey").join(trials, "s_suppkey", "left").select(col("s_suppkey").alias("placa"), F.when(col("s_suppkey") % 7 == 0, "{ no es un documento").otherwise(doc).alias("text"))
    out = folder(spark)
    S.in_folders(files, "placa").text(out)
    found = S.read_sessions(spark, out + "/*")
    t = found.select("placa", F.explode_outer("detalle").alias("t"))
    return t.groupBy("placa").agg(F.count("t").alias("ensayos"), F.round(F.sum("t.error_mm"), 3).alias("error"), F.count_if("t.acierto_estricto").alias("aciertos"))


@bound("s5_file_hashes", "select s_suppkey, strlen(s_name) + 1 as length, md5(s_name || chr(10)) as md5 from supplier")
def s5(spark, d):
    out = folder(spark)
    S.in_folders(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").text(out)
    return S.scan_files(spark, out, "*.txt").withColumnRenamed("path", "file").select(told("s_suppkey"), "length", "md5")


@bound("s13_reading_export", """with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as i from lineitem), o as (select distinct l_orderkey as id from l), r as (
 select id, 'resumen' as tipo, null as elemento, null::double as x1, null::double as y1, null::double as x2, null::double as y2, null::double as ancho_px, null::double as alto_px, null::double as valor_x, null::double as valor_y, 'orden ' || id as texto, null as descripcion from o where id % 3 > 0
 union all select l_orderkey, 'advertencia', (row_number() over (partition by l_orderkey order by i) - 1)::varchar, null, null, null, null, null, null, null, null, 'vuelto ' || l_linenumber, null from l where l_returnflag = 'R'
 union all select id, 'eje', 'x', 0, 100, 100, 100, null, null, null, null, null, 'lineal' from o
 union all select l_orderkey, 'texto', i::varchar, l_quantity, l_linenumber, null, null, 12, 8, null, null, 'p' || l_partkey, null from l
 union all select l_orderkey, 'curva', 's:' || i, l_quantity, l_linenumber, null, null, null, null, l_extendedprice, l_discount, null, null from l
 union all select l_orderkey, 'barra', l_returnflag, l_linenumber, 0, l_linenumber + 1, l_quantity, null, null, null, l_extendedprice, l_linestatus, null from l)
 select id, tipo, elemento, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2, ancho_px::double as ancho_px, alto_px::double as alto_px, valor_x::double as valor_x, valor_y::double as valor_y, texto, descripcion from r""")
def s13(spark, d):
    li = table(spark, d, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice", "l_discount", "l_linestatus")
    o = li.groupBy(col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("l"))
    num = lambda x: x.cast("double")
    readings = o.select(
        "id", F.when(col("id") % 3 > 0, F.concat(F.lit("orden "), "id")).alias("resumen"),
        F.transform(F.filter("l", lambda x: x["l_returnflag"] == "R"), lambda x: F.concat(F.lit("vuelto "), x["l_linenumber"].cast("string"))).alias("avisos"),
        F.array(F.struct(F.lit("x").alias("nombre"), *(F.lit(v).alias(c) for c, v in (("x1", 0.0), ("y1", 100.0), ("x2", 100.0), ("y2", 100.0))), F.lit("lineal").alias("escala"))).alias("ejes"),
        F.transform("l", lambda x: F.struct(num(x["l_quantity"]).alias("x"), num(x["l_linenumber"]).alias("y"), F.lit(12.0).alias("ancho"), F.lit(8.0).alias("alto"), F.concat(F.lit("p"), x["l_partkey"].cast("string")).alias("texto"))).alias("textos"),
        F.array(F.struct(F.lit("s").alias("serie"), F.transform("l", lambda x: F.struct(num(x["l_quantity"]).alias("px"), num(x["l_linenumber"]).alias("py"), num(x["l_extendedprice"]).alias("valor_x"), num(x["l_discount"]).alias("valor_y"))).alias("puntos"))).alias("curvas"),
        F.transform("l", lambda x: F.struct(x["l_returnflag"].alias("serie"), num(x["l_linenumber"]).alias("x1"), F.lit(0.0).alias("y1"), num(x["l_linenumber"] + 1).alias("x2"), num(x["l_quantity"]).alias("y2"), num(x["l_extendedprice"]).alias("valor"), x["l_linestatus"].alias("categoria"))).alias("barras"),
    )
    return S.reading_rows(readings, "id")


@bound("s15_plate_documents", """with w as (select o_custkey as c, o_orderpriority as s, o_orderkey as x, o_totalprice as y from orders), g as (select c, s, max(y) as ymax, min(y) as ymin, count(*) as n from w group by 1, 2), a as (select c, min(x) as x0, max(x) as x1, round(min(y), 2) as y0, round(max(y), 2) as y1 from w group by 1)
 select c, x0, x1, y0, y1, 'cliente ' || c as contexto, 'a es ' || c as leyenda, g.s, round(ymax, 2) as y_max, round(ymin, 2) as y_min, least(n, 40) as valores from a join g using (c)""")
def s15(spark, d):
    o = table(spark, d, "orders").select(col("o_custkey").alias("c"), col("o_orderpriority").alias("s"), col("o_orderkey").alias("x"), col("o_totalprice").cast("double").alias("y"))
    about = o.select("c").distinct().select("c", F.concat(F.lit("cliente "), "c").alias("contexto"), F.concat(F.lit("a es "), "c").alias("leyenda"))
    docs = S.plate_documents(o, "c", "s", "x", "y", 40, about)
    side = "struct<min:double,max:double>"
    read = docs.select("c", F.from_json("json", f"series array<struct<serie:string,valores:array<struct<x:double,y:double>>,y_max:double,y_min:double>>, ejes struct<x:{side},y:{side}>, contexto string, leyenda string").alias("d"))
    return read.select("c", "d", F.explode("d.series").alias("e")).select("c", col("d.ejes.x.min").alias("x0"), col("d.ejes.x.max").alias("x1"), F.round("d.ejes.y.min", 2).alias("y0"), F.round("d.ejes.y.max", 2).alias("y1"), "d.contexto", "d.leyenda", col("e.serie").alias("s"), F.round("e.y_max", 2).alias("y_max"), F.round("e.y_min", 2).alias("y_min"), F.size("e.valores").alias("valores"))
