"""Requests, files, reports (S6-S18, P11-P18, J10-J12, J27, U1, U3) on the given tables: orders are requests, customers accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.rates import criteria_rows, metric_rows
from lodestar.bindings.registry import bound, table
from lodestar.functions.columns import looks_like_html
from lodestar.operators import requests as Q
from lodestar.plans import report

col = F.col


def orders(spark, d):
    return table(spark, d, "orders")


@bound("s6_changed_files", "select page_id from pages a where not exists (select 1 from pages b where b.page_id % 3 > 0 and b.url = a.url and b.page_id % 5 = a.page_id % 4 and length(b.html) = length(a.html))")
def s6(spark, d):
    p = table(spark, d, "pages")
    now = p.select("page_id", col("url").alias("path"), (col("page_id") % 4).alias("mtime"), F.length("html").alias("length"))
    old = p.where("page_id % 3 > 0").select(col("url").alias("path"), (col("page_id") % 5).alias("mtime"), F.length("html").alias("length"))
    return Q.changed_files(now, old).select("page_id")


@bound("s7_prefix_listing", "select page_id, url from pages where starts_with(url, 'https://m.')")
def s7(spark, d):
    return Q.files_with_prefix(table(spark, d, "pages").withColumnRenamed("url", "path"), "https://m.").select("page_id", col("path").alias("url"))


@bound("s8_stale", "select o_orderkey from orders where o_orderkey % 4 = 0 or o_orderkey % 4 = 1 and o_orderkey % 3 = 0")
def s8(spark, d):
    o = orders(spark, d)
    old = o.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when((col("o_orderkey") % 4 == 1) & (col("o_orderkey") % 3 == 0), col("o_totalprice") + 1).otherwise(col("o_totalprice"))).select("o_orderkey", Q.signature(["o_custkey", "o_totalprice"]).alias("sig"))
    return Q.stale(o, old, "o_orderkey", ["o_custkey", "o_totalprice"]).select("o_orderkey")


@bound("s9_table_scan", "select c_custkey, c_name, c_acctbal from customer where c_acctbal > 9000")
def s9(spark, d):
    return spark.read.schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").parquet(f"{d}/customer.parquet").where("c_acctbal > 9000").select("c_custkey", "c_name", "c_acctbal")


@bound("s10_upsert", "with u as (select o_custkey as k, o_orderdate as ts, o_orderkey, o_totalprice as v from orders), r as (select *, row_number() over (partition by k order by ts desc, o_orderkey desc) as n from u) select k, o_orderkey, v from r where n = 1")
def s10(spark, d):
    o = orders(spark, d).select(col("o_custkey").alias("k"), col("o_orderdate").alias("ts"), "o_orderkey", col("o_totalprice").alias("v"))
    return Q.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "k", "ts", "o_orderkey").select("k", "o_orderkey", "v")


@bound("s11_apply_changes", "select o_orderkey, case when o_orderkey % 3 = 0 then 'F' else o_orderstatus end as o_orderstatus, case when o_orderkey % 6 = 0 then 1.5 else o_totalprice end as o_totalprice, case when o_orderkey % 3 = 0 and o_orderstatus <> 'F' then timestamp '2030-01-01' else o_orderdate end as o_orderdate from orders")
def s11(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus"), F.when(col("o_orderkey") % 6 == 0, 1.5).alias("o_totalprice"), F.lit(None).cast("timestamp").alias("o_orderdate"))
    return Q.apply_changes(o, c, "o_orderkey", ["o_orderstatus", "o_totalprice"], "o_orderstatus", "o_orderdate", F.lit("2030-01-01").cast("timestamp"))


_M = """m as (select event_type, unnest(['hit','median','p95','users','free']) as metric, unnest([100.0*avg((value>50)::int), median(value), quantile_cont(value, 0.95), count(distinct user_id)::double, 1.0]) as value from events group by 1),
 c(metric, grp, op, lo, hi) as (values ('hit','seleccion','>=',38.0,null),('median','seleccion','<=',null,34.0),('p95','mano','between',140.0,160.0),('users','mano','=',150.0,null)),
 j as (select e.event_type, c.grp, c.metric, value, case op when '>=' then value >= lo when '<=' then value <= hi when '=' then value = lo when 'between' then value between lo and hi end as ok from (select distinct event_type from m) e cross join c left join m on m.event_type = e.event_type and m.metric = c.metric and m.event_type <> 'view')"""


@bound("s14_long_report", f"with {_M} select event_type, grp, metric, round(value, 6) as value, case when ok then 'si' when not ok then 'no' end as cumple from j")
def s14(spark, d):
    m = metric_rows(spark, d)
    part = m.where("event_type <> 'view'").unionByName(m.where("event_type = 'view'").select("event_type", F.lit("none").alias("metric"), F.lit(None).cast("double").alias("value")))
    return report.long_report(part, criteria_rows(spark), "event_type").withColumn("value", F.round("value", 6))


@bound("s14_wide_report", f"with {_M} select grp, metric, " + ", ".join(f"round(max(value) filter (where event_type = '{e}'), 6) as {e}" for e in ("click", "error", "purchase")) + " from j where value is not null group by 1, 2")
def s14b(spark, d):
    long = report.long_report(metric_rows(spark, d).where("event_type <> 'view'"), criteria_rows(spark), "event_type")
    w = report.wide_report(long, "event_type", ["click", "error", "purchase"])
    return w.withColumns({c: F.round(c, 6) for c in ("click", "error", "purchase")})


@bound("u1_registry", "with c(metric, grp) as (values ('hit','seleccion'),('median','seleccion'),('p95','mano'),('users','mano'),('extra','mano')) select e.event_type, c.metric, c.grp from (select distinct event_type from events) e cross join c")
def u1(spark, d):
    more = criteria_rows(spark).unionByName(spark.createDataFrame([("extra", "mano", ">=", 0.0, None)], "metric string, grp string, op string, lo double, hi double"))
    return report.long_report(metric_rows(spark, d), more, "event_type").select("event_type", "metric", "grp")


@bound("j10_borrowed", "with p as (select c_custkey as placa, c_mktsegment as cond, case when c_custkey % 4 = 0 then c_acctbal end as v from customer), f as (select cond, min(placa) as de from p where v is not null group by 1) select p.placa, p.cond, coalesce(p.v, q.v) as v, case when p.v is null then f.de end as de from p left join f on p.cond = f.cond left join p q on q.placa = f.de")
def j10(spark, d):
    c = table(spark, d, "customer").select(col("c_custkey").alias("placa"), col("c_mktsegment").alias("cond"), F.when(col("c_custkey") % 4 == 0, col("c_acctbal")).alias("v"))
    return report.borrowed(c, "placa", "cond", "v")


@bound("s17_fallback", "select o.o_orderkey, coalesce(n.n_name, o.o_orderstatus) as titulo, coalesce(n.n_regionkey::varchar, o.o_orderpriority) as tipo from (select *, o_custkey % 40 as k from orders) o left join nation n on n_nationkey = k")
def s17(spark, d):
    o = orders(spark, d).select("o_orderkey", (col("o_custkey") % 40).alias("k"), col("o_orderstatus").alias("titulo"), col("o_orderpriority").alias("tipo"))
    n = table(spark, d, "nation").select(col("n_nationkey").alias("k"), col("n_name").alias("titulo"), col("n_regionkey").cast("string").alias("tipo"))
    return Q.with_fallback(o, n, "k", ["titulo", "tipo"]).select("o_orderkey", "titulo", "tipo")


@bound("s18_fetch_log", """with l as (select page_id, url, case when page_id % 6 = 0 then null when page_id % 5 = 0 then 404 else 200 end as st, case when page_id % 4 = 0 then html else 'a;b' end as body from pages), s as (select url, arg_max('v' || page_id, page_id) as old from pages where page_id % 2 = 0 group by 1),
 w as (select l.*, old, case when st is null then 'sin respuesta' when st >= 400 then 'estado ' || st when length(body) > 5000 then 'grande' when regexp_matches(lower(substr(ltrim(body),1,300)), '^(<!doctype|<html|<head|<body)') then 'pagina' end as why from l left join s on l.url = s.url)
 select page_id, md5(case when why is null then body else old end) as h, case when why is null then 'fresca' when old is not null then 'guardada' else why end as origen from w""")
def s18(spark, d):
    p = table(spark, d, "pages")
    k = col("page_id")
    log = p.select("page_id", "url", F.when(k % 6 == 0, None).when(k % 5 == 0, 404).otherwise(200).alias("st"), F.when(k % 4 == 0, col("html")).otherwise("a;b").alias("body"))
    stored = p.where("page_id % 2 = 0").select("url", F.concat(F.lit("v"), k.cast("string")).alias("body"), k.alias("ts"))
    return Q.fetched(log, stored, "url", "body", "st", "ts", 5000, looks_like_html(col("body"))).select("page_id", F.md5("body").alias("h"), "origen")


@bound("p11_account_filter", "select c_custkey from customer where lower(c_mktsegment) = lower('Machinery') and lower(c_name) = lower('CUSTOMER#' || lpad(c_custkey::varchar, 9, '0'))")
def p11(spark, d):
    return table(spark, d, "customer").where(Q.same_text("c_mktsegment", F.lit("Machinery")) & Q.same_text("c_name", F.concat(F.lit("CUSTOMER#"), F.lpad(col("c_custkey").cast("string"), 9, "0")))).select("c_custkey")


@bound("p12_safe_projection", "select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def p12(spark, d):
    return Q.without_secrets(table(spark, d, "customer"), ("c_acctbal",))


@bound("p13_derived_state", "select o_orderkey, case when o_custkey % 7 = 0 then 'rechazada' else o_orderstatus end as estado, case when o_orderkey % 2 = 0 then o_orderdate + interval 1 day else o_orderdate end as cambio from orders")
def p13(spark, d):
    o = orders(spark, d).withColumn("rechazo", F.when(col("o_custkey") % 7 == 0, "x")).withColumn("act", F.when(col("o_orderkey") % 2 == 0, col("o_orderdate") + F.expr("interval 1 day")))
    state, at = Q.derived_state("rechazo", "o_orderstatus", "act", "o_orderdate")
    return o.select("o_orderkey", state.alias("estado"), at.alias("cambio"))


@bound("p14_transitions", "with t as (select o_orderkey, case o_orderstatus when 'O' then 'pendiente' when 'P' then 'imprimiendo' else 'impreso' end as e, case o_custkey % 3 when 0 then 'imprimiendo' when 1 then 'impreso' else 'pendiente' end as q from orders) select o_orderkey, (e = 'pendiente' and q = 'imprimiendo') or (e = 'imprimiendo' and q = 'impreso') as legal from t")
def p14(spark, d):
    k = col("o_custkey") % 3
    o = orders(spark, d).select("o_orderkey", F.when(col("o_orderstatus") == "O", "pendiente").when(col("o_orderstatus") == "P", "imprimiendo").otherwise("impreso").alias("e"), F.when(k == 0, "imprimiendo").when(k == 1, "impreso").otherwise("pendiente").alias("q"))
    return Q.legal_moves(spark, o, "e", "q").select("o_orderkey", "legal")


@bound("p15_readiness", """with g as (select l_orderkey, count_if(not (l_quantity < 10)) as n, count_if(l_quantity >= 10 and l_discount > 0.09) as e, count_if(l_quantity >= 10 and l_tax > 0.07) as u, count_if(l_quantity >= 10 and l_returnflag = 'N') as p from lineitem group by 1)
 select l_orderkey, case when n = 0 then 'ninguna' when e > 0 then 'error' when u > 0 then 'sin leer' when p > 0 then 'faltan ' || p end as motivo from g""")
def p15(spark, d):
    return Q.readiness(table(spark, d, "lineitem"), "l_orderkey", col("l_quantity") < 10, col("l_discount") > 0.09, col("l_returnflag") != "N", ~(col("l_tax") > 0.07))


@bound("p17_edit_overlay", """with e as (select p_partkey, p_brand, coalesce(case when p_partkey % 5 = 0 then 'nuevo' end, p_name) as texto, p_partkey % 5 = 0 and (p_size % 2 = 0 or p_brand = 'Brand#1') or p_brand = 'Brand#2' and p_partkey % 5 = 0 as oculto from part), w as (select *, max((not oculto)::int) over (partition by p_brand) as q from e) select p_partkey, texto from w where not (oculto and q = 1)""")
def p17(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", col("p_name").alias("texto"))
    e = table(spark, d, "part").where("p_partkey % 5 = 0").select("p_partkey", F.lit("nuevo").alias("new_text"), ((col("p_size") % 2 == 0) | col("p_brand").isin("Brand#1", "Brand#2")).alias("hidden"))
    return Q.overlaid(p, e, ["p_partkey"], ["p_brand"], "texto").select("p_partkey", "texto")


@bound("p18_capped", "with k as (select * from lineitem where l_partkey % 3 > 0), r as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as n from k) select l_suppkey, l_orderkey, l_linenumber, l_partkey from r where n <= 50")
def p18(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    known = table(spark, d, "part").where("p_partkey % 3 > 0").withColumnRenamed("p_partkey", "l_partkey")
    return Q.capped(li, known, "l_suppkey", "l_partkey", "o").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@bound("j11_enriched", "select o_orderkey, c_name as alumno, c_mktsegment as grupo from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0")
def j11(spark, d):
    return Q.enriched(orders(spark, d), table(spark, d, "customer").where("c_custkey % 2 = 0"), "o_custkey", "c_custkey", {"c_name": "alumno", "c_mktsegment": "grupo"}).select("o_orderkey", "alumno", "grupo")


@bound("j12_routed", "select o_orderkey, coalesce(case when c_custkey % 3 = 0 then (c_nationkey + 10)::bigint end, (select min(s_suppkey) from supplier where s_acctbal > 0)) as destino from orders left join customer on o_custkey = c_custkey")
def j12(spark, d):
    people = table(spark, d, "customer").select("c_custkey", F.when(col("c_custkey") % 3 == 0, (col("c_nationkey") + 10).cast("long")).alias("pref"))
    return Q.routed(orders(spark, d), people, "o_custkey", "c_custkey", "pref", table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey").select("o_orderkey", "destino")


@bound("j27_scoped", "select o_orderkey, o_orderstatus from orders where o_custkey = 77")
def j27(spark, d):
    return Q.scoped(orders(spark, d), "o_custkey", 77, F.desc("o_orderkey")).select("o_orderkey", "o_orderstatus")


@bound("u3_defaults", """with d(key, value) as (values ('radio', 7.0), ('bono', 3.0), ('espera', 60.0)), u as (select c_custkey as who, case c_custkey % 3 when 0 then 'radio' when 1 then 'bono' else 'otro' end as key, case when c_custkey % 2 = 0 then c_acctbal end as value from customer)
 select w.who, d.key, case when u.key is not null and d.key = 'bono' then u.value else coalesce(u.value, d.value) end as value from (select distinct who from u) w cross join d left join u on u.who = w.who and u.key = d.key""")
def u3(spark, d):
    k = col("c_custkey") % 3
    user = table(spark, d, "customer").select(col("c_custkey").alias("who"), F.when(k == 0, "radio").when(k == 1, "bono").otherwise("otro").alias("key"), F.when(col("c_custkey") % 2 == 0, col("c_acctbal")).alias("value"))
    return Q.with_defaults(user, spark.createDataFrame([("radio", 7.0), ("bono", 3.0), ("espera", 60.0)], "key string, value double"), ["bono"])
