"""Scalar operators (P, S16, A24, A42, J24) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import bound, table
from lodestar.functions import columns as C

_FOLD = f"translate(%s, '{C.MARKED}', '{C.PLAIN}')"
col = F.col


@bound("p1_header_key", f"""select doc_id, replace(lower(trim({_FOLD % "text"})), ' ', '_') as key,
 case when trim(regexp_replace(lower({_FOLD % "text"}), '[^0-9a-z]', '_', 'g'), '_') = '' then 'x' else trim(regexp_replace(lower({_FOLD % "text"}), '[^0-9a-z]', '_', 'g'), '_') end as slug from documents""")
def p1(spark, d):
    return table(spark, d, "documents").select("doc_id", C.header_key(col("text")).alias("key"), C.slug(col("text")).alias("slug"))


@bound("p2_missing_columns", """select c_custkey, array_to_string(list_sort(list_filter(['x','y','machinery','building'], lambda v: v <> lower(c_mktsegment) and not (v = 'x' and c_nationkey % 2 = 0))), ',') as missing from customer""")
def p2(spark, d):
    present = F.when(col("c_nationkey") % 2 == 0, F.array(F.lower("c_mktsegment"), F.lit("x"))).otherwise(F.array(F.lower("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(C.missing_columns(["x", "y", "machinery", "building"], present), ",").alias("missing"))


@bound("p3_parse_number", """with t as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice as v, case l_linenumber % 5
  when 0 then replace(printf('%.2f', l_extendedprice), '.', ',') when 1 then format('{:,.2f}', l_extendedprice) when 2 then replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '_'), '.', ','), '_', '.')
  when 3 then 'x' || printf('%.2f', l_extendedprice) else ' −' || printf('%.2f', l_extendedprice) end as s from lineitem)
 select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 5 when 3 then null when 4 then -round(v, 2) else round(v, 2) end as v from t""")
def p3(spark, d):
    plain = F.format_string("%.2f", "l_extendedprice")
    us = F.format_string("%,.2f", "l_extendedprice")
    k = col("l_linenumber") % 5
    text = F.when(k == 0, F.replace(plain, F.lit("."), F.lit(","))).when(k == 1, us).when(k == 2, F.translate(us, ",.", ".,")).when(k == 3, F.concat(F.lit("x"), plain)).otherwise(F.concat(F.lit(" −"), plain))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.parse_number(text).alias("v"))


@bound("p4_valid_rows", """with r as (select event_id, user_id, case when value is null then 'missing' when value > 300 then 'range' end as reason, count(*) over (partition by user_id) as n from events)
 select event_id, coalesce(reason, case when n > 120 then 'too many' end) as reason, coalesce(reason, case when n > 120 then 'too many' end) is null as valid from r""")
def p4(spark, d):
    from lodestar.operators.validity import split_rows

    ev = table(spark, d, "events")
    return split_rows(ev, [("missing", col("value").isNull()), ("range", col("value") > 300)], ["user_id"], 120).select("event_id", "reason", col("reason").isNull().alias("valid"))


@bound("p5_origin_shift", """select p_partkey, round(case when p_type like '%E%' then 100 - p_size else p_size end, 6) as x, round(case when p_brand like '%1%' then 3000 - p_retailprice else p_retailprice end, 6) as y from part""")
def p5(spark, d):
    corner = F.concat(F.when(col("p_brand").contains("1"), "inferior ").otherwise("superior "), F.when(col("p_type").contains("E"), "derecha").otherwise("izquierda"))
    x, y = C.origin_shift(col("p_size").cast("double"), col("p_retailprice"), corner, F.lit(100.0), F.lit(3000.0))
    return table(spark, d, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@bound("p6_shape", """select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'N' then 'punto' when l_linestatus = 'O' or abs(l_discount*10 - l_tax*10) < 0.5 or abs(l_quantity - 25) < 0.5 then 'segmento' else 'rect' end as forma from lineitem""")
def p6(spark, d):
    x2 = F.when(col("l_returnflag") != "N", col("l_discount") * 10)
    s = C.shape(col("l_linestatus"), col("l_tax") * 10, F.lit(25.0), x2, col("l_quantity"), ("O",))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("forma"))


@bound("p9_default_text", """select p_partkey, case when p_size % 2 = 0 then p_name else concat_ws('. ', p_type, nullif(case when p_size % 3 = 0 then '' else p_brand end, '')) end as texto from part""")
def p9(spark, d):
    return table(spark, d, "part").select("p_partkey", C.or_default(F.when(col("p_size") % 2 == 0, col("p_name")), col("p_type"), F.when(col("p_size") % 3 == 0, "").otherwise(col("p_brand"))).alias("texto"))


@bound("p10_first_sentence", """select doc_id, substr(trim(regexp_replace(split_part('Gráfica ' || doc_id || ': ' || text, '. ', 1), '^\\s*gr[aá]fic[ao]\\s*\\d*\\s*:\\s*', '', 'i')), 1, 120) as titulo from documents""")
def p10(spark, d):
    return table(spark, d, "documents").select("doc_id", C.first_sentence(F.concat(F.lit("Gráfica "), col("doc_id").cast("string"), F.lit(": "), col("text"))).alias("titulo"))


@bound("p19_rect_map", """select p_partkey, round(p_size * 4.0::double + 100, 6) as x, round(p_retailprice * 0.2, 6) as y, round(p_size * 0.2::double + 195.0, 6) as ux, round(p_retailprice * 0.2 + 0.0, 6) as uy from part""")
def p19(spark, d):
    x, y = C.fit_rect(col("p_size"), col("p_retailprice"), (50, 3000), (100, 0, 200, 600), False)
    ux, uy = C.fit_rect(col("p_size"), col("p_retailprice"), (50, 3000), (100, 0, 200, 600))
    return table(spark, d, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(ux, 6).alias("ux"), F.round(uy, 6).alias("uy"))


_REG = "select s_suppkey, 1.0 + s_nationkey*0.01 as m0, 0.1 as m1, s_acctbal*0.001 as m2, -0.05 as m3, 0.9 as m4, 3.0 as m5, 0.0001 as m6, 0.0002 as m7, 1.0 as m8 from supplier"


@bound("p20_projective_map", f"""with m as ({_REG}), l as (select * from lineitem join m on l_suppkey = s_suppkey)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((m0*l_quantity + m1*l_discount*100 + m2)/(m6*l_quantity + m7*l_discount*100 + m8), 6) as u,
 round((m3*l_quantity + m4*l_discount*100 + m5)/(m6*l_quantity + m7*l_discount*100 + m8), 6) as v,
 (m0*l_quantity + m1*l_discount*100 + m2)/(m6*l_quantity + m7*l_discount*100 + m8) between -2 and 42 and (m3*l_quantity + m4*l_discount*100 + m5)/(m6*l_quantity + m7*l_discount*100 + m8) between -2 and 12 as dentro from l""")
def p20(spark, d):
    s = table(spark, d, "supplier")
    reg = s.select("s_suppkey", (1.0 + col("s_nationkey") * 0.01).alias("m0"), F.lit(0.1).alias("m1"), (col("s_acctbal") * 0.001).alias("m2"), F.lit(-0.05).alias("m3"), F.lit(0.9).alias("m4"), F.lit(3.0).alias("m5"), F.lit(0.0001).alias("m6"), F.lit(0.0002).alias("m7"), F.lit(1.0).alias("m8"))
    li = table(spark, d, "lineitem")
    j = li.join(reg, li.l_suppkey == reg.s_suppkey)
    u, v = C.project(col("l_quantity"), col("l_discount") * 100, [col(f"m{k}") for k in range(9)])
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), C.inside(u, v, 40, 10, 2).alias("dentro"))


@bound("p22_axis_round", """select o_orderkey, round(round_even(o_totalprice/1000.0, 0)*1000.0, 6) as lineal, round(round_even(o_totalprice*power(10, 2 - floor(log10(o_totalprice))), 0)/power(10, 2 - floor(log10(o_totalprice))), 6) as log from orders where o_totalprice > 0""")
def p22(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0")
    return o.select("o_orderkey", F.round(C.rounded_for(col("o_totalprice"), F.lit(500000.0)), 6).alias("lineal"), F.round(C.significant(col("o_totalprice")), 6).alias("log"))


@bound("p22_number_text", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(case when l_discount = 0 then '0' else rtrim(printf('%.2f', l_discount), '0') end, '.', ',') as texto from lineitem""")
def p22b(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.number_text(col("l_discount"), 2).alias("texto"))


@bound("p23_direct_url", """select page_id, case page_id % 4 when 0 then 'https://docs.google.com/spreadsheets/d/k' || page_id || '/export?format=csv&gid=' || (page_id % 7)
 when 1 then 'https://raw.githubusercontent.com/o/r/main/f' || page_id || '.csv' when 2 then 'https://x.test/q/AB12' || page_id || 'Z' else url end as enlace from pages""")
def p23(spark, d):
    k, id_ = col("page_id") % 4, col("page_id").cast("string")
    given = F.when(k == 0, F.concat(F.lit("docs.google.com/spreadsheets/d/k"), id_, F.lit("/edit#gid="), (col("page_id") % 7).cast("string"))).when(k == 1, F.concat(F.lit(" https://github.com/o/r/blob/main/f"), id_, F.lit(".csv"))).when(k == 2, F.concat(F.lit("ab12"), id_, F.lit("z"))).otherwise(col("url"))
    return table(spark, d, "pages").select("page_id", C.direct_url(given, "https://x.test/q/").alias("enlace"))


@bound("p24_token", "select page_id, substr(sha1(url), 1, 10) as token, upper(substr(sha1(url), 1, 10)) as impreso from pages")
def p24(spark, d):
    return table(spark, d, "pages").select("page_id", C.token(col("url")).alias("token"), F.upper(C.token(col("url"))).alias("impreso"))


@bound("p25_order_label", "select o_orderkey, 'TV-' || format('{:05d}', o_orderkey) as etiqueta from orders")
def p25(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.order_label(col("o_orderkey")).alias("etiqueta"))


# hues from 0 to 179, some curves told by intensity, some without a hue
@bound("p26_hue_name", """with h as (select event_id, event_type = 'error' as gris, case when event_type <> 'click' then event_id*7 % 180 end as h from events)
 select event_id, case when gris then 'negra' when h is null then null when h <= 8 then 'roja' when h <= 19 then 'naranja' when h <= 33 then 'amarilla' when h <= 80 then 'verde' when h <= 100 then 'celeste' when h <= 130 then 'azul' when h <= 150 then 'morada' when h <= 169 then 'rosada' else 'roja' end as color from h""")
def p26(spark, d):
    hue = F.when(col("event_type") != "click", col("event_id") * 7 % 180)
    return table(spark, d, "events").select("event_id", C.hue_name(hue, col("event_type") == "error").alias("color"))


@bound("p27_small_figures", "select p_partkey, p_size*p_retailprice < 15000 or (p_size*p_retailprice <= 60000 and p_size*30.0/p_retailprice between 0.75 and 1.25 and p_size*30.0*p_retailprice/30.0 <= 60000) as fuera from part")
def p27(spark, d):
    # boxes of the part's area whose sides are 30 times the size and a thirtieth of the price
    w, h = col("p_size") * F.sqrt(F.lit(30.0)), col("p_retailprice") / F.sqrt(F.lit(30.0))
    return table(spark, d, "part").select("p_partkey", C.small_or_logo(w, h).alias("fuera"))


@bound("s16_clean_export", "select event_id, round_even(value/7.0, 4) as a, case when value > 400 then null else round_even(value, 4) end as b from events")
def s16(spark, d):
    ev = table(spark, d, "events")
    return C.clean_export(ev.select("event_id", (col("value") / 7.0).alias("a"), F.when(col("value") > 400, F.lit(float("inf"))).otherwise(col("value")).alias("b"), col("value").alias("_inner")))


@bound("a24_sus", """with r as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, floor(value)::bigint % 5 + 1 as r from events)
 select user_id, 2.5*sum(case when k % 2 = 1 then r - 1 else 5 - r end)::double as sus from r where k <= 10 group by user_id having count(*) = 10""")
def a24(spark, d):
    from pyspark.sql.window import Window

    from lodestar.operators.rates import sus_score

    rows = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"), (F.floor("value") % 5 + 1).alias("r")).where("k <= 10")
    return sus_score(rows, ["user_id"], "k", "r")


_LAB = "select vec_id, abs(embedding[1])*100.0 as l1, embedding[2]*90.0 as a1, embedding[3]*90.0 as b1, abs(embedding[4])*100.0 as l2, embedding[5]*90.0 as a2, embedding[6]*90.0 as b2 from (select vec_id, embedding::double[] as embedding from embeddings)"


@bound("a42_delta_e", f"""with t as ({_LAB}), u as (select *, 1 + 0.5*(1 - sqrt(power((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2,7)/(power((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2,7)+power(25.0,7)))) as g from t),
 v as (select *, sqrt(g*a1*g*a1+b1*b1) as c1, sqrt(g*a2*g*a2+b2*b2) as c2, degrees(atan2(b1,g*a1)) + case when atan2(b1,g*a1) < 0 then 360 else 0 end as h1, degrees(atan2(b2,g*a2)) + case when atan2(b2,g*a2) < 0 then 360 else 0 end as h2 from u),
 w as (select *, case when h2-h1 > 180 then h2-h1-360 when h2-h1 < -180 then h2-h1+360 else h2-h1 end as turn, case when abs(h1-h2) <= 180 then (h1+h2)/2 when h1+h2 < 360 then (h1+h2+360)/2 else (h1+h2-360)/2 end as hm, (c1+c2)/2 as cm, power((l1+l2)/2-50,2) as mid from v),
 x as (select *, 1-0.17*cos(radians(hm-30))+0.24*cos(radians(2*hm))+0.32*cos(radians(3*hm+6))-0.20*cos(radians(4*hm-63)) as t from w),
 y as (select *, (l2-l1)/(1+0.015*mid/sqrt(20+mid)) as el, (c2-c1)/(1+0.045*cm) as ec, 2*sqrt(c1*c2)*sin(radians(turn)/2)/(1+0.015*cm*t) as eh, -sin(radians(60*exp(-power((hm-275)/25,2))))*2*sqrt(power(cm,7)/(power(cm,7)+power(25.0,7))) as bend from x)
 select vec_id, round(sqrt(el*el+ec*ec+eh*eh+bend*ec*eh), 6) as de, round(0.114*l1+0.587*a1+0.299*b1, 6) as gris from y""")
def a42(spark, d):
    e = lambda k: col("embedding")[k].cast("double")
    one, two = [F.abs(e(0)) * 100.0, e(1) * 90.0, e(2) * 90.0], [F.abs(e(3)) * 100.0, e(4) * 90.0, e(5) * 90.0]
    return table(spark, d, "embeddings").select("vec_id", F.round(C.delta_e(one, two), 6).alias("de"), F.round(C.grey(*one), 6).alias("gris"))


# pages: a brand's parts, and a page more for every 400 part keys
@bound("j24_box_overlap", """with b as (select p_partkey, p_brand, p_partkey // 400 as pag, p_size::double as x0, p_retailprice/100.0 as y0, p_size+10.0 as x1, p_retailprice/100.0+5 as y1 from part),
 i as (select a.p_partkey as a, b.p_partkey as b, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) as w from b a join b b on a.p_brand = b.p_brand and a.pag = b.pag and a.p_partkey < b.p_partkey)
 select a, b, round(w/(100-w), 6) as iou from i""")
def j24(spark, d):
    box = table(spark, d, "part").select("p_partkey", "p_brand", F.floor(col("p_partkey") / 400).alias("pag"), F.array(col("p_size").cast("double"), col("p_retailprice") / 100.0, col("p_size") + 10.0, col("p_retailprice") / 100.0 + 5).alias("box"))
    a, b = box.alias("a"), box.alias("b")
    j = a.join(b, (col("a.p_brand") == col("b.p_brand")) & (col("a.pag") == col("b.pag")) & (col("a.p_partkey") < col("b.p_partkey")))
    side = lambda n: [col(f"{n}.box")[k] for k in range(4)]
    return j.select(col("a.p_partkey").alias("a"), col("b.p_partkey").alias("b"), F.round(C.iou(side("a"), side("b")), 6).alias("iou"))
