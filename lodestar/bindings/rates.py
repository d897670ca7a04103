"""Rates and summaries (A, W6, T14) on the given tables: an event is a trial, its type the zone, a value over 50 a hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import bound, table
from lodestar.functions import columns as C
from lodestar.operators import rates as R

col = F.col
_T = "(epoch_us(ts)/1e6)"
_W = """n, k/n::double as p, greatest(0, (k/n::double + 1.9208/n)/(1+3.8416/n) - 1.96*sqrt(k/n::double*(1-k/n::double)/n + 3.8416/(4.0*n*n))/(1+3.8416/n)) as lo,
 least(1, (k/n::double + 1.9208/n)/(1+3.8416/n) + 1.96*sqrt(k/n::double*(1-k/n::double)/n + 3.8416/(4.0*n*n))/(1+3.8416/n)) as hi"""
_WR = "n, round(p, 6) as p, round(lo, 6) as lo, round(hi, 6) as hi"


def hit():
    return col("value") > 50


def seconds():
    return F.unix_micros("ts") / 1e6


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def events(spark, d):
    return table(spark, d, "events")


@bound("a1_wilson", f"with g as (select user_id, count_if(value > 50) as k, count(*) as n from events group by 1), w as (select user_id, k, {_W} from g) select user_id, k, {_WR} from w")
def a1(spark, d):
    return rounded(R.proportion(events(spark, d), ["user_id"], hit()), "p", "lo", "hi")


@bound("a2_median", "select user_id, round(quantile_cont(case when value > 100 then null else value end, 0.5), 6) as mediana from events group by 1")
def a2(spark, d):
    ev = events(spark, d).withColumn("v", F.when(col("value") > 200, None).when(col("value") > 100, F.lit(float("nan"))).otherwise(col("value")))
    return ev.groupBy("user_id").agg(F.round(R.med("v"), 6).alias("mediana"))


@bound("a3_percentiles", "select event_type, " + ", ".join(f"round(quantile_cont(value, 0.{q}), 6) as p{q}" for q in (10, 50, 90, 95)) + " from events group by 1")
def a3(spark, d):
    return rounded(R.exact_percentiles(events(spark, d), ["event_type"], {f"p{q}": ("value", q / 100) for q in (10, 50, 90, 95)}), "p10", "p50", "p90", "p95")


@bound("a4_target_summary", """select event_type, count(*) as intentos, round(100.0*avg((value>50)::int), 6) as acierto_pct, round(100.0*avg((value>30)::int), 6) as acierto_serie_pct,
 round(100.0*avg((user_id % 7 = 0)::int), 6) as sin_seleccion_pct, round(quantile_cont(value/10, 0.5), 6) as error_mediana, round(quantile_cont(value/10, 0.9), 6) as error_p90, round(quantile_cont(value*2, 0.5), 6) as jit_mediana
 from events where event_id % 5 > 0 group by 1""")
def a4(spark, d):
    ev = events(spark, d).select("event_type", (col("event_id") % 5).alias("frames"), hit().alias("hit"), (col("value") > 30).alias("serie"), F.when(col("user_id") % 7 != 0, col("user_id")).alias("sel"), (col("value") / 10).alias("err"), (col("value") * 2).alias("jit"))
    return rounded(R.target_summary(ev, ["event_type"], "frames", "hit", "serie", "sel", "err", "jit"), "acierto_pct", "acierto_serie_pct", "sin_seleccion_pct", "error_mediana", "error_p90", "jit_mediana")


_ZONE = "select unnest([event_type, event_type || '_' || (user_id % 3)]) as zona, value from events"


@bound("a5_zone_hit_rates", f"with z as ({_ZONE}), g as (select zona, count_if(value > 50) as k, count(*) as n from z group by 1), w as (select zona, k, {_W} from g) select zona, k, {_WR} from w")
def a5(spark, d):
    ev = events(spark, d).withColumn("clase", (col("user_id") % 3).cast("string"))
    return rounded(R.zone_rates(ev, "event_type", "clase", hit()), "p", "lo", "hi")


@bound("a6_bias", "select l_returnflag, round(avg(l_quantity-25), 6) as dx, round(avg(l_discount-l_tax), 6) as dy, round(sqrt(power(avg(l_quantity-25),2)+power(avg(l_discount-l_tax),2)), 6) as modulo from lineitem group by 1")
def a6(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", (col("l_quantity") - 25).alias("x"), (col("l_discount") - col("l_tax")).alias("y"))
    return rounded(R.bias(li, ["l_returnflag"], "x", "y"), "dx", "dy", "modulo")


@bound("a7_jitter", "select l_orderkey, case when count(*) >= 3 then round(sqrt(var_samp(l_quantity)+var_samp(l_tax)), 6) end as jitter from lineitem group by 1")
def a7(spark, d):
    return rounded(R.jitter(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_tax"), "jitter")


@bound("a8_vote_winner", """with v as (select user_id, case when value > 80 then null else event_type end as voto, count(*) as votos, min((ts, event_id)) as f from events group by 1, 2),
 r as (select *, row_number() over (partition by user_id order by votos desc, f) as k from v) select user_id, voto, votos from r where k = 1""")
def a8(spark, d):
    return R.winner(events(spark, d).withColumn("voto", F.when(~(col("value") > 80), col("event_type"))), ["user_id"], "voto", ["ts", "event_id"])


@bound("a9_confusions", """with v as (select o_orderpriority as objetivo, o_orderstatus || (o_custkey % 9) as elegido, count(*) as veces, min(o_orderkey) as f from orders where o_orderstatus <> 'F' group by 1, 2),
 r as (select *, row_number() over (partition by objetivo order by veces desc, f) as puesto from v) select objetivo, elegido, veces, puesto from r where puesto <= 15""")
def a9(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(col("o_orderpriority").alias("objetivo"), F.concat("o_orderstatus", (col("o_custkey") % 9).cast("string")).alias("elegido"), "o_orderkey")
    return R.confusions(o, ["objetivo"], "objetivo", "elegido", ["o_orderkey"])


@bound("a10_edges", f"""with w as (select user_id, {_T} as t, value > 50 as e, coalesce(lag(value > 50) over (partition by user_id order by ts, event_id), false) as a from events),
 g as (select user_id, count_if(e and not a) as subidas, count_if(not e and a) as bajadas, max(t)-min(t) as s from w group by 1)
 select user_id, subidas, bajadas, round(subidas/greatest(1e-6, s/60), 6) as subidas_min, round(bajadas/greatest(1e-6, s/60), 6) as bajadas_min from g""")
def a10(spark, d):
    ev = events(spark, d).withColumn("t", seconds())
    return rounded(R.edges(ev, ["user_id"], hit(), ["ts", "event_id"], F.max("t") - F.min("t")), "subidas_min", "bajadas_min")


@bound("a11_changes", """with w as (select user_id, row_number() over v as n, event_type is distinct from lag(event_type) over v as c from events window v as (partition by user_id order by ts, event_id)) select user_id, count_if(n > 1 and c) as cambios from w group by 1""")
def a11(spark, d):
    return R.changes(events(spark, d), ["user_id"], "event_type", ["ts", "event_id"])


@bound("a12_first_hit", f"select user_id, round(min({_T}) filter (where value > 200), 6) as t_primero from events group by 1")
def a12(spark, d):
    return rounded(R.first_hit(events(spark, d).withColumn("t", seconds()), ["user_id"], col("value") > 200, "t"), "t_primero")


@bound("a13_attempts", f"""with e as (select *, {_T} as t, user_id as s, event_type as c, value > 60 as leido from events),
 per as (select s, c, count(*) as n, count_if(leido) as k, min(case when leido then t end) as t1, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.95) as q, count(distinct user_id) as v, arg_max(event_id, t) as r from e group by 1, 2),
 al as (select e.s, null as c, count(*) as n, count_if(leido) as k, (select median(t1) from per where per.s = e.s) as t1, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.95) as q, count(distinct user_id) as v, arg_max(event_id, t) as r from e group by e.s),
 u as (select * from per union all select * from al), w as (select s, c, k, t1, m, q, v, r, {_W} from u)
 select s, c, n as intentos, k as lecturas, round(p, 6) as p, round(lo, 6) as lo, round(hi, 6) as hi, round(t1, 6) as t_primera, round(m, 6) as ms_mediana, round(q, 6) as ms_p95, v as variantes, r as resolucion from w""")
def a13(spark, d):
    ev = events(spark, d).select(col("user_id").alias("s"), col("event_type").alias("c"), "value", "user_id", "event_id", seconds().alias("t"))
    return rounded(R.attempt_summary(ev, ["s"], "c", col("value") > 60, "t", "value", "user_id", "event_id"), "p", "lo", "hi", "t_primera", "ms_mediana", "ms_p95")


@bound("a14_tracking", f"""with g as (select user_id, 100.0*avg((value > 20)::int) as deteccion_pct, case when max({_T}) > min({_T}) then (count(*)-1)/(max({_T})-min({_T})) end as fps, quantile_cont(value, 0.5) as ms_mediana, quantile_cont(value, 0.95) as ms_p95,
 quantile_cont(value/100, 0.1) as ratio_p10, quantile_cont(value/100, 0.5) as ratio_p50, quantile_cont(value/100, 0.9) as ratio_p90, 100.0*avg((value < 90)::int) as dentro_pct from events group by 1)
 select user_id, round(deteccion_pct, 6) as deteccion_pct, round(fps, 9) as fps, round(ms_mediana, 6) as ms_mediana, round(ms_p95, 6) as ms_p95, round(ratio_p10, 6) as ratio_p10, round(ratio_p50, 6) as ratio_p50, round(ratio_p90, 6) as ratio_p90, round(dentro_pct, 6) as dentro_pct, round(1000/fps+ms_p95, 2) as latencia_ms from g""")
def a14(spark, d):
    ev = events(spark, d).withColumn("t", seconds()).withColumn("ratio", col("value") / 100)
    out = R.tracking_summary(ev, ["user_id"], col("value") > 20, "value", "t", "ratio", col("value") < 90)
    return rounded(out, "deteccion_pct", "ms_mediana", "ms_p95", "ratio_p10", "ratio_p50", "ratio_p90", "dentro_pct").withColumns({"fps": F.round("fps", 9), "latencia_ms": F.round("latencia_ms", 2)})


@bound("a15_detection", "select l_suppkey, round(100.0*avg((l_quantity > 10)::int), 6) as exito_pct, round(100.0*avg((l_quantity > 30)::int), 6) as alta_pct, round(quantile_cont(abs(l_discount-0.05), 0.5), 6) as rotacion_mediana from lineitem group by 1")
def a15(spark, d):
    li = table(spark, d, "lineitem").withColumn("giro", col("l_discount") - 0.05)
    return rounded(R.detection_summary(li, ["l_suppkey"], col("l_quantity") > 10, col("l_quantity") > 30, "giro"), "exito_pct", "alta_pct", "rotacion_mediana")


@bound("a15_listed_counts", "select l_returnflag, v as valor, count(*) as veces from (select l_returnflag, unnest(list_filter([case when l_quantity > 40 then 'alto' end, case when l_discount > 0.08 then 'rebaja' end, case when l_tax = 0 then 'libre' end], lambda x: x is not null)) as v from lineitem) group by 1, 2")
def a15b(spark, d):
    marks = F.array_compact(F.array(F.when(col("l_quantity") > 40, "alto"), F.when(col("l_discount") > 0.08, "rebaja"), F.when(col("l_tax") == 0, "libre")))
    return R.listed_counts(table(spark, d, "lineitem").withColumn("marcas", marks), ["l_returnflag"], "marcas")


@bound("a16_two_level", """with r as (select l_suppkey, l_linenumber, sqrt(power(stddev_pop(l_quantity),2)+power(stddev_pop(l_discount*100),2)) as s, median(l_quantity) as mx, median(l_discount*100) as my from lineitem group by 1, 2),
 m as (select *, avg(mx) over (partition by l_suppkey) as ax, avg(my) over (partition by l_suppkey) as ay from r)
 select l_suppkey, round(max(s), 6) as dentro, round(sqrt(power(stddev_pop(mx),2)+power(stddev_pop(my),2)), 6) as entre, round(max(sqrt(power(mx-ax,2)+power(my-ay,2))), 6) as desvio_max from m group by 1""")
def a16(spark, d):
    return rounded(R.two_level_spread(table(spark, d, "lineitem").withColumn("y", col("l_discount") * 100), ["l_suppkey"], "l_linenumber", "l_quantity", "y"), "dentro", "entre", "desvio_max")


@bound("a17_residuals", "with e as (select l_suppkey, sqrt(power(l_quantity*1.01+0.3-l_quantity,2)+power(l_discount*99-l_discount*100,2)) as e from lineitem) select l_suppkey, round(median(e), 6) as mediana, round(max(e), 6) as maximo, round(sqrt(avg(e*e)), 6) as rms from e group by 1")
def a17(spark, d):
    li = table(spark, d, "lineitem").withColumn("y", col("l_discount") * 100)
    one, zero = F.lit(1.0), F.lit(0.0)
    px, py = C.project(col("l_quantity"), col("y"), [F.lit(1.01), zero, F.lit(0.3), zero, F.lit(0.99), zero, zero, zero, one])
    return rounded(R.residuals(li, ["l_suppkey"], px, py, "l_quantity", "y"), "mediana", "maximo", "rms")


@bound("a18_error_map", """with g as (select s_suppkey, s_nationkey, i*10.0 as x, j*10.0 as y from supplier, range(0, 11) a(i), range(0, 11) b(j)), e as (select s_suppkey, x, y, (x+0.01*s_nationkey*y+1)/(1+0.0001*y) as u, (y-0.02*x)/(1+0.0001*y) as v from g),
 d as (select *, sqrt(power(u-x,2)+power(v-y,2)) as d from e) select s_suppkey, round(quantile_cont(d, 0.5), 6) as mediana, round(quantile_cont(d, 0.95), 6) as p95, round(max(d), 6) as maximo, round(avg(u-x), 6) as dx, round(avg(v-y), 6) as dy, round(regr_slope(u, x), 6) as escala_x, round(regr_slope(v, y), 6) as escala_y from d group by 1""")
def a18(spark, d):
    from lodestar.operators.spatial import error_map

    s = table(spark, d, "supplier")
    zero, one = F.lit(0.0), F.lit(1.0)
    ident = [one, zero, zero, zero, one, zero, zero, zero, one]
    other = [one, 0.01 * col("s_nationkey"), one, F.lit(-0.02), one, zero, zero, F.lit(0.0001), one]
    return rounded(error_map(s, ["s_suppkey"], ident, other, 100.0, 100.0, 11), "mediana", "p95", "maximo", "dx", "dy", "escala_x", "escala_y")


@bound("a19_counts_by_type", "select o_custkey, count_if(o_orderstatus='F') as \"F\", count_if(o_orderstatus='O') as \"O\", count_if(o_orderstatus='P') as \"P\" from orders group by 1")
def a19(spark, d):
    return R.counts_by_type(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@bound("a20_box_fallback", """with g as (select p_brand, count_if(p_type = 'ECONOMY') > 0 as f, min(p_size) filter (where p_type = 'ECONOMY') as a, min(p_retailprice) filter (where p_type = 'ECONOMY') as b, max(p_size) filter (where p_type = 'ECONOMY') as c, max(p_retailprice) filter (where p_type = 'ECONOMY') as e, min(p_size) as a2, min(p_retailprice) as b2, max(p_size) as c2, max(p_retailprice) as e2 from part group by 1)
 select p_brand, case when f then a else a2 end as x0, case when f then b else b2 end as y0, case when f then c else c2 end as x1, case when f then e else e2 end as y1 from g""")
def a20(spark, d):
    return R.box_or_fallback(table(spark, d, "part"), ["p_brand"], col("p_type") == "ECONOMY", "p_size", "p_retailprice")


@bound("a23_task_score", "select o_orderpriority, round(100*avg(case o_orderstatus when 'F' then 1.0 when 'P' then 0.5 else 0.0 end), 6) as acierto_pct, round(median(o_totalprice), 6) as tiempo_mediana from orders where o_totalprice > 1000 group by 1")
def a23(spark, d):
    o = table(spark, d, "orders").withColumn("nota", F.when(col("o_orderstatus") == "F", "bien").when(col("o_orderstatus") == "P", "parcial").otherwise("mal"))
    return rounded(R.task_score(o, ["o_orderpriority"], "nota", "o_totalprice", col("o_totalprice") > 1000), "acierto_pct", "tiempo_mediana")


CRITERIA = (("hit", "seleccion", ">=", 38.0, None), ("median", "seleccion", "<=", None, 34.0), ("p95", "mano", "between", 140.0, 160.0), ("users", "mano", "=", 150.0, None))
_METRICS = """select event_type, unnest(['hit','median','p95','users','free']) as metric, unnest([100.0*avg((value>50)::int), median(value), quantile_cont(value, 0.95), count(distinct user_id)::double, 1.0]) as value from events group by 1"""
_JUDGED = f"""with m as ({_METRICS}), c(metric, grp, op, lo, hi) as (values ('hit','seleccion','>=',38.0,null),('median','seleccion','<=',null,34.0),('p95','mano','between',140.0,160.0),('users','mano','=',150.0,null)),
 j as (select event_type, m.metric, grp, value, case op when '>=' then value >= lo when '<=' then value <= hi when '=' then value = lo when 'between' then value between lo and hi end as ok from m left join c on m.metric = c.metric)"""


def metric_rows(spark, d):
    from lodestar.plans.report import unpivoted

    g = events(spark, d).groupBy("event_type").agg(R.share(hit()).alias("hit"), R.med("value").alias("median"), R.pct("value", 0.95).alias("p95"), F.count_distinct("user_id").cast("double").alias("users"), F.lit(1.0).alias("free"))
    return unpivoted(g, ["event_type"])


def criteria_rows(spark):
    return spark.createDataFrame(list(CRITERIA), "metric string, grp string, op string, lo double, hi double")


@bound("a25_criteria", _JUDGED + " select event_type, metric, grp, round(value, 6) as value, case when ok then 'si' when not ok then 'no' end as cumple from j")
def a25(spark, d):
    return rounded(R.judged(metric_rows(spark, d), criteria_rows(spark)).select("event_type", "metric", "grp", "value", "cumple"), "value")


@bound("a26_met_by_group", _JUDGED + " select grp, coalesce(count_if(ok), 0) as cumplidos, count(ok) as medidos, case when count(ok) > 0 then round(100.0*count_if(ok)/count(ok), 6) end as pct from j group by 1")
def a26(spark, d):
    return rounded(R.met_by_group(R.judged(metric_rows(spark, d), criteria_rows(spark)), "grp"), "pct")


@bound("a27_extremes", f"select user_id, max(value) as y_max, round(arg_min({_T}, (-value, {_T})), 6) as x_max, min(value) as y_min, round(arg_min({_T}, (value, {_T})), 6) as x_min from events group by 1")
def a27(spark, d):
    return rounded(R.extremes(events(spark, d).withColumn("x", seconds()), ["user_id"], "x", "value"), "x_max", "x_min")


@bound("a28_highlights", "select o_custkey, count(*) as n, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as mayor, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as menor, case when count(*) <= 12 then string_agg(o_orderkey::varchar, ', ' order by o_orderkey) end as todos from orders group by 1")
def a28(spark, d):
    return R.highlights(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", ["o_orderkey"])


@bound("a29_weighted_mode", "with g as (select lang, source, sum(length(text)) as w from documents group by 1, 2) select lang, arg_min(source, (-w, source)) as moda from g group by 1")
def a29(spark, d):
    return R.weighted_mode(table(spark, d, "documents"), ["lang"], "source", F.length("text"))


@bound("a31_first_of_hash", "with r as (select doc_id, source, row_number() over (partition by lang, md5(text) order by doc_id) as k from documents) select doc_id, source from r where k = 1")
def a31(spark, d):
    return R.first_of_hash(table(spark, d, "documents"), ["lang"], "text", ["doc_id"]).select("doc_id", "source")


@bound("a32_next_number", "select 1 + coalesce(max(try_cast(split_part(case when p_size % 5 = 0 then 'x' else '' end || p_partkey || '.' || p_size, '.', 1) as int)), 0) as siguiente from part")
def a32(spark, d):
    p = table(spark, d, "part").withColumn("l", F.concat(F.when(col("p_size") % 5 == 0, "x").otherwise(""), col("p_partkey").cast("string"), F.lit("."), col("p_size").cast("string")))
    return R.next_number(p, "l")


@bound("a38_circular_peaks", """with c as (select event_type, hour(ts) as h, count(*) as n from events group by 1, 2), s as (select event_type, (h + k + 24) % 24 as b, sum(n*(3 - abs(k)))::double as v from c, (values (-2), (-1), (0), (1), (2)) q(k) group by 1, 2),
 g as (select * from (select *, sum(v) over (partition by event_type) as total from s) where v >= 0.02*total), p1 as (select event_type, arg_min(b, (-v, b)) as b from g group by 1),
 g2 as (select g.* from g join p1 using (event_type) where least((g.b - p1.b + 24) % 24, (p1.b - g.b + 24) % 24) > 2), p2 as (select event_type, arg_min(b, (-v, b)) as b from g2 group by 1),
 g3 as (select g2.* from g2 join p2 using (event_type) where least((g2.b - p2.b + 24) % 24, (p2.b - g2.b + 24) % 24) > 2), p3 as (select event_type, arg_min(b, (-v, b)) as b from g3 group by 1),
 p as (select 1 as puesto, * from p1 union all select 2, * from p2 union all select 3, * from p3) select event_type, puesto, p.b::int as pico, v as altura from p join g using (event_type, b)""")
def a38(spark, d):
    return R.circular_peaks(events(spark, d).withColumn("franja", F.hour("ts")), ["event_type"], "franja", 24, 3, 2, 0.02)


@bound("a39_profile", "select event_type, hour(ts)::int as h, round(avg(value), 6) as y_media from events group by 1, 2")
def a39(spark, d):
    return rounded(R.profile(events(spark, d).withColumn("h", F.hour("ts")), ["event_type"], "h", "value"), "y_media")


@bound("a40_neighbourhood_mode", """with c as (select l_returnflag, l_quantity as v, count(*) as n from lineitem group by 1, 2), j as (select a.l_returnflag, a.v, sum(b.n) as vecinos from c a join c b on a.l_returnflag = b.l_returnflag and abs(a.v-b.v) <= 2.5 group by 1, 2),
 r as (select *, row_number() over (partition by l_returnflag order by vecinos desc, v) as k from j) select l_returnflag, v, vecinos::bigint as vecinos from r where k = 1""")
def a40(spark, d):
    return R.neighbourhood_mode(table(spark, d, "lineitem").withColumn("v", col("l_quantity")), ["l_returnflag"], "v", 2.5)


@bound("a41_cheapest_good", """with s as (select *, l_extendedprice*(1-l_discount) as s, max(l_extendedprice*(1-l_discount)) over (partition by l_orderkey) as b from lineitem where l_tax >= 0.02), r as (select *, row_number() over (partition by l_orderkey order by l_quantity, s desc) as k from s where s >= 0.85*b)
 select l_orderkey, l_quantity from r where k = 1""")
def a41(spark, d):
    return R.cheapest_good(table(spark, d, "lineitem"), ["l_orderkey"], col("l_tax") >= 0.02, col("l_extendedprice") * (1 - col("l_discount")), "l_quantity").select("l_orderkey", "l_quantity")


@bound("a44_warnings", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([case when l_quantity < 5 then 'poca' end, case when l_discount > 0.08 then 'rebaja' end, case when l_tax = 0 then 'libre' end], lambda x: x is not null), ', ') as avisos from lineitem""")
def a44(spark, d):
    from lodestar.operators.calibration import warnings

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(warnings([(col("l_quantity") < 5, "poca"), (col("l_discount") > 0.08, "rebaja"), (col("l_tax") == 0, "libre")]), ", ").alias("avisos"))


@bound("a45_border_outside", """with p as (select s_suppkey, s_nationkey, unnest(['arriba','abajo','izquierda','derecha']) as lado, k/20.0 as f from supplier, range(0, 21) r(k)),
 q as (select *, case lado when 'izquierda' then 0 when 'derecha' then 100 else f*100 end as x, case lado when 'arriba' then 0 when 'abajo' then 60 else f*60 end as y from p),
 g as (select s_suppkey, lado, avg((not (x*0.9 + s_nationkey - 5 between 0 and 100 and y + s_nationkey*0.5 - 3 between 0 and 62))::int) as fuera from q group by 1, 2), w as (select *, max(fuera) over (partition by s_suppkey) as m from g)
 select s_suppkey, lado, round(fuera, 6) as fuera from w where fuera > 0 and (fuera >= 0.5 or (m < 0.5 and fuera = m))""")
def a45(spark, d):
    return rounded(R.border_outside(table(spark, d, "supplier"), ["s_suppkey"], F.lit(100.0), F.lit(60.0), lambda x, y: (x * 0.9 + col("s_nationkey") - 5, y + col("s_nationkey") * 0.5 - 3), (100, 62)), "fuera")


@bound("w6_latest_session", "with r as (select *, count(*) over (partition by o_custkey) as sesiones, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) select o_custkey, o_orderkey, sesiones from r where k = 1")
def w6(spark, d):
    return R.latest_session(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "sesiones")


@bound("t14_baseline", f"""with e as (select user_id, {_T} as t, event_id, case when value > 40 then event_type end as r, case when value > 60 then 'view' end as s, lag(case when value > 40 then event_type end) over w as pr, lag(case when value > 60 then 'view' end) over w as ps, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
 select user_id, round(100.0*count_if(r = 'view')/count(*), 6) as r_objetivo_pct, round(100.0*count(r)/count(*), 6) as r_con_dato_pct, round(count_if(n > 1 and r is distinct from pr)/(max(t)-min(t)), 9) as r_cambios_s,
 round(100.0*count_if(s = 'view')/count(*), 6) as s_objetivo_pct, round(100.0*count(s)/count(*), 6) as s_con_dato_pct, round(count_if(n > 1 and s is distinct from ps)/(max(t)-min(t)), 9) as s_cambios_s from e group by 1""")
def t14(spark, d):
    ev = events(spark, d).select("user_id", "ts", "event_id", seconds().alias("t"), F.when(col("value") > 40, col("event_type")).alias("r"), F.when(col("value") > 60, "view").alias("s"), F.lit("view").alias("obj"))
    out = R.baseline_comparison(ev, ["user_id"], "r", "s", "obj", "t", ["ts", "event_id"])
    return rounded(rounded(out, *(f"{c}_{x}_pct" for c in "rs" for x in ("objetivo", "con_dato"))), "r_cambios_s", "s_cambios_s", digits=9)
