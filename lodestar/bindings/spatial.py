"""Joins by place and calibration on the given tables: events are touches (hour of day, value), parts are elements (size, price)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import bound, table
from lodestar.operators import calibration as K
from lodestar.operators import spatial as S

col = F.col


# Each range of ids has charts of its own, so their number grows with the tables and a chart stays small.
PARTS, TOUCHERS, USERS = 1000, 75, 60


def charts(key, n, size):
    """n charts for each range of size ids."""
    return key % n + F.floor(key / size) * n


def touches(spark, d):
    return table(spark, d, "events").select(charts(col("user_id"), 5, TOUCHERS).alias("chart"), col("event_id").alias("pid"), (F.hour("ts") * 4.0 + F.minute("ts") / 15.0).alias("px"), (col("value") / 4).alias("py"))


_TOUCH = "select user_id % 5 + 5*(user_id // 75) as chart, event_id as pid, hour(ts)*4.0::double + minute(ts)/15.0::double as px, value/4 as py from events"


def elements(spark, d):
    p, chart = table(spark, d, "part"), charts(col("p_partkey"), 5, PARTS)
    k = col("p_partkey") % 4
    shape = F.when(k == 0, "punto").when(k == 3, "rect").otherwise("segmento")
    return p.select(chart.alias("chart"), col("p_partkey").alias("n"), F.concat(F.lit("e"), col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("s"), (F.floor(col("p_partkey") / 10) % 3).cast("string")).alias("series"), shape.alias("shape"),
        (col("p_size") * 2.0).alias("x1"), ((col("p_partkey") * 37 % 100) * 1.0).alias("y1"), F.when(k > 0, col("p_size") * 2.0 + (col("p_partkey") * 13 % 17) - 8.0).alias("x2"), F.when(k > 0, (col("p_partkey") * 37 % 100) + (col("p_partkey") * 7 % 15) - 7.0).alias("y2"),
        F.when(k == 0, 3.5).when(k == 3, 2.0).otherwise(3.0).alias("radius"), F.when(k == 0, 0).when(k == 3, 10).otherwise(1).alias("priority"))


_ELEM = """select p_partkey % 5 + 5*(p_partkey // 1000) as chart, p_partkey as n, 'e' || p_partkey as id, 's' || ((p_partkey // 10) % 3) as series, case p_partkey % 4 when 0 then 'punto' when 3 then 'rect' else 'segmento' end as shape,
 p_size*2.0::double as x1, (p_partkey*37 % 100)*1.0::double as y1, case when p_partkey % 4 > 0 then p_size*2.0::double + (p_partkey*13 % 17) - 8.0 end as x2, case when p_partkey % 4 > 0 then (p_partkey*37 % 100) + (p_partkey*7 % 15) - 7.0::double end as y2,
 case p_partkey % 4 when 0 then 3.5::double when 3 then 2.0 else 3.0 end as radius, case p_partkey % 4 when 0 then 0 when 3 then 10 else 1 end as priority from part"""
_DIST = """case shape when 'punto' then sqrt(power(x1-px,2)+power(y1-py,2))
 when 'rect' then sqrt(power(greatest(least(x1,x2)-px,0,px-greatest(x1,x2)),2)+power(greatest(least(y1,y2)-py,0,py-greatest(y1,y2)),2))
 else case when x1=x2 and y1=y2 then sqrt(power(x1-px,2)+power(y1-py,2)) else sqrt(power(x1+greatest(0,least(1,((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))*(x2-x1)-px,2)+power(y1+greatest(0,least(1,((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))*(y2-y1)-py,2)) end end"""
_NEAR = f"t as ({_TOUCH}), e as ({_ELEM}), r as (select t.chart, pid, px, py, n, id, series, shape, radius, priority, {_DIST} as d from t join e on t.chart = e.chart), near as (select * from r where d <= radius)"
_WON = """best as (select chart, pid, arg_min(id, (d - case when shape='punto' then 3.0 else 0 end, priority, n)) filter (where priority < 10) as a, min(d - case when shape='punto' then 3.0 else 0 end) filter (where priority < 10) as w,
 arg_min(id, (d, priority, n)) filter (where priority >= 10) as b, min(d) filter (where priority >= 10) as k from near group by 1, 2),
 won as (select t.chart, t.pid, case when a is null then b when k + 3.0 < w then b else a end as id from t left join best on t.chart = best.chart and t.pid = best.pid)"""


@bound("j1_nearest_element", f"with {_NEAR}, {_WON} select chart, pid, id from won")
def j1(spark, d):
    return S.nearest_element(touches(spark, d), elements(spark, d), 8.0)


@bound("j2_candidates", f"with {_NEAR} select chart, pid, string_agg(id, ',' order by id) as ids from near group by 1, 2")
def j2(spark, d):
    return S.within_reach(touches(spark, d), elements(spark, d), 8.0).groupBy("chart", "pid").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


_CROSS = f"""e as ({_ELEM}), s as (select * from e where shape = 'segmento'),
 q as (select a.chart, a.n as na, b.n as nb, a.series as series_a, b.series as series_b, a.x1 as ax, a.y1 as ay, a.x2-a.x1 as rx, a.y2-a.y1 as ry, b.x2-b.x1 as sx, b.y2-b.y1 as sy, b.x1-a.x1 as qx, b.y1-a.y1 as qy from s a join s b on a.chart = b.chart and a.n < b.n and a.series <> b.series),
 u as (select *, (qx*sy-qy*sx)/(rx*sy-ry*sx) as t, (qx*ry-qy*rx)/(rx*sy-ry*sx) as u from q where abs(rx*sy-ry*sx) >= 1e-9), c as (select chart, na, nb, series_a, series_b, ax+t*rx as x, ay+t*ry as y from u where t between -1e-9 and 1+1e-9 and u between -1e-9 and 1+1e-9)"""


# what was chosen before: of all that a touch nearly reaches the last in the file; followed: the series of the first
_STICKY = f"""t as ({_TOUCH}), e as ({_ELEM}), q as (select t.chart, pid, n, id, series, shape, radius, priority, {_DIST} as d from t join e on t.chart = e.chart), w as (select * from q where d <= radius + 2), p as (select chart, pid, arg_max(id, n) as cur, arg_min(series, n) as fol from w group by 1, 2),
 s as (select w.*, fol, d - case when id = cur then 2 else 0 end as ds from w join p on w.chart = p.chart and w.pid = p.pid where d <= radius + case when id = cur then 2 else 0 end), k as (select *, ds - case when shape = 'punto' then 3 else 0 end as v from s),
 b as (select chart, pid, arg_min(id, (v, priority, n)) filter (where priority < 10) as a, min(v) filter (where priority < 10) as av, arg_min(id, (v, priority, n)) filter (where priority < 10 and series = fol) as o, min(v) filter (where priority < 10 and series = fol) as ov,
 arg_min(id, (ds, priority, n)) filter (where priority >= 10) as r, min(ds) filter (where priority >= 10) as rv from k group by 1, 2), c as (select chart, pid, case when ov - 3 <= av then o else a end as a, case when ov - 3 <= av then ov else av end as av, r, rv from b)"""


@bound("j3_sticky_nearest", f"with {_STICKY} select t.chart, t.pid, case when a is null then r when rv + 3.0 < av then r else a end as id from t left join c on t.chart = c.chart and t.pid = c.pid")
def j3(spark, d):
    t, e = touches(spark, d), elements(spark, d)
    past = S.within_reach(t, e.withColumn("radius", col("radius") + 2.0), 8.0).groupBy("chart", "pid").agg(F.max_by("id", "n").alias("current"), F.min_by("series", "n").alias("follow"))
    return S.sticky_nearest(t.join(past, ["chart", "pid"], "left"), e, 8.0)


@bound("j4_crossings", f"with {_CROSS} select chart, na, nb, series_a, series_b, round(x, 6) as x, round(y, 6) as y from c")
def j4(spark, d):
    c = S.crossings(elements(spark, d).where("shape = 'segmento'"), 12.0)
    return c.select("chart", "na", "nb", "series_a", "series_b", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@bound("j5_spaced_crossings", f"""with recursive {_CROSS}, k as (select *, least(series_a, series_b) as lo, greatest(series_a, series_b) as hi from c), n as (select *, row_number() over (partition by chart, lo, hi order by na, nb) as i from k),
 r as (select chart, lo, hi, na, nb, i, true as keep, [{{'x': x, 'y': y}}] as kept from n where i = 1
 union all select n.chart, n.lo, n.hi, n.na, n.nb, n.i, f.far, case when f.far then list_append(r.kept, {{'x': n.x, 'y': n.y}}) else r.kept end from r join n on n.chart = r.chart and n.lo = r.lo and n.hi = r.hi and n.i = r.i + 1,
 lateral (select len(list_filter(r.kept, lambda p: sqrt(power(p.x - n.x, 2) + power(p.y - n.y, 2)) < 3.0)) = 0 as far) f) select chart, na, nb from r where keep""")
def j5(spark, d):
    return S.spaced_crossings(S.crossings(elements(spark, d).where("shape = 'segmento'"), 12.0), 3.0).select("chart", "na", "nb")


_PTS = "p as (select event_type as series, user_id % 20 + 20*(user_id // 60) as chart, event_id as n, hour(ts)*4.0::double + minute(ts)/15.0::double as x, value/4 as y from events)"


def points(spark, d):
    return table(spark, d, "events").select(col("event_type").alias("series"), charts(col("user_id"), 20, USERS).alias("chart"), col("event_id").alias("n"), (F.hour("ts") * 4.0 + F.minute("ts") / 15.0).alias("x"), (col("value") / 4).alias("y"))


@bound("j6_point_radius", f"with {_PTS} select a.chart, a.n, round(coalesce(greatest(0.5, least(1.6, 0.4*min(sqrt(power(a.x-b.x,2)+power(a.y-b.y,2))))), 1.6), 6) as radius from p a left join p b on a.chart = b.chart and a.series = b.series and a.n <> b.n group by a.chart, a.n")
def j6(spark, d):
    return S.point_radius(points(spark, d), 1.6, 0.5).select("chart", "n", F.round("radius", 6).alias("radius"))


@bound("j7_separation", f"""with {_PTS}, q as (select a.chart, a.n as a, b.n as b, a.series = b.series as same, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) as d from p a join p b on a.chart = b.chart and a.n < b.n)
 select chart, round(min(d) filter (where not same), 6) as between, arg_min(a, (d, a, b)) filter (where not same) as a, arg_min(b, (d, a, b)) filter (where not same) as b, round(min(d) filter (where same), 6) as within from q where d < 6 group by 1""")
def j7(spark, d):
    return S.least_separation(points(spark, d), 6.0).withColumns({"between": F.round("between", 6), "within": F.round("within", 6)})


@bound("j8_near_flag", f"with {_PTS} select a.chart, a.n, case when exists (select 1 from p b where b.chart = a.chart and b.n % 10 = 0 and sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) <= 2.5) then 'cruce' else 'aislado' end as zona from p a")
def j8(spark, d):
    p = points(spark, d)
    return S.near_flag(p, p.where("n % 10 = 0").select("chart", col("x").alias("mx"), col("y").alias("my")), 2.5, ["chart"]).select("chart", "n", "zona")


@bound("j9_gaps", f"""with {_PTS}, q as (select *, lead(n) over w as n2, lead(x) over w as x2, lead(y) over w as y2 from p window w as (partition by chart, series order by n))
 select chart, series, n, n2, case when abs(x2-x) < 1 then 'salto' else 'sin datos' end as clase from q a where n2 is not null and not exists (select 1 from q s where s.n2 is not null and s.n % 3 > 0 and s.chart = a.chart and s.series = a.series
 and ((sqrt(power(s.x-a.x,2)+power(s.y-a.y,2)) < 0.6 and sqrt(power(s.x2+0.1-a.x2,2)+power(s.y2-a.y2,2)) < 0.6) or (sqrt(power(s.x2+0.1-a.x,2)+power(s.y2-a.y,2)) < 0.6 and sqrt(power(s.x-a.x2,2)+power(s.y-a.y2,2)) < 0.6)))""")
def j9(spark, d):
    from pyspark.sql.window import Window

    p = points(spark, d)
    w = Window.partitionBy("chart", "series").orderBy("n")
    s = p.select("chart", "series", "n", col("x").alias("x1"), col("y").alias("y1"), (F.lead("x").over(w) + 0.1).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null and n % 3 > 0")
    return S.gaps(p, s)


@bound("a21_grid_coverage", f"""with e as ({_ELEM}), t as (select c.chart, i*100000+j as pid, i*2.0::double as px, j*2.0::double as py from (select distinct chart from e) c, range(0, 51) a(i), range(0, 51) b(j)),
 near as (select t.chart, pid, n, id, series, shape, radius, priority, {_DIST} as d from t join e on t.chart = e.chart where {_DIST} <= radius), {_WON},
 reach as (select chart, pid, count(distinct series) filter (where priority < 10) as series, arg_min(series, (d, n)) filter (where priority < 10) as nearest from near group by 1, 2),
 j as (select won.chart, won.id, e.series as ws, e.priority as wp, coalesce(reach.series, 0) as series, nearest from won left join e on e.chart = won.chart and e.id = won.id left join reach on reach.chart = won.chart and reach.pid = won.pid)
 select chart, round(100.0*count_if(series > 0)/count(*), 6) as cubierta_pct, round(100.0*count_if(series > 1)/count(*), 6) as ambigua_pct, round(100.0*count_if(coalesce(wp < 10 and ws <> nearest, false))/count(*), 6) as conflicto_pct, round(100.0*count_if(coalesce(wp >= 10 and series > 0, false))/count(*), 6) as resto_pct from j group by 1""")
def a21(spark, d):
    e = elements(spark, d)
    out = S.grid_coverage(e.select("chart").distinct().withColumns({"width": F.lit(100.0), "height": F.lit(100.0)}), e, 2.0, 8.0)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "chart"})


@bound("a22_perturbed", f"""with e as ({_ELEM}), q as (select *, case when shape = 'punto' then x1 else (x1+x2)/2 end as x, case when shape = 'punto' then y1 else (y1+y2)/2 end as y from e where priority < 10),
 u as (select q.*, sigma, k, (('0x' || substr(md5(chart || ':' || id || ':' || sigma || ':' || k || ':1'), 1, 13))::bigint + 0.5)/4503599627370496 as u0, (('0x' || substr(md5(chart || ':' || id || ':' || sigma || ':' || k || ':2'), 1, 13))::bigint + 0.5)/4503599627370496 as u1 from q, (values (1.0::double), (2.0::double), (4.0::double)) s(sigma), range(1, 21) d(k)),
 t as (select chart, id || ':' || sigma || ':' || k as pid, id as tid, series as ts, shape as zona, sigma, x + sqrt(-2*ln(u0))*sigma*cos(2*pi()*u1) as px, y + sqrt(-2*ln(u0))*sigma*sin(2*pi()*u1) as py from u),
 near as (select t.chart, pid, n, id, series, shape, radius, priority, {_DIST} as d from t join e on t.chart = e.chart where {_DIST} <= radius), {_WON}
 select zona, sigma, count(*) as n, round(100.0*count_if(coalesce(won.id = tid, false))/count(*), 6) as exacto_pct, round(100.0*count_if(coalesce(e.series = ts, false))/count(*), 6) as serie_pct from t join won on won.chart = t.chart and won.pid = t.pid left join e on e.chart = won.chart and e.id = won.id group by 1, 2""")
def a22(spark, d):
    e = elements(spark, d)
    t = e.where("priority < 10").select("chart", "id", "series", col("shape").alias("zona"), F.when(col("shape") == "punto", col("x1")).otherwise((col("x1") + col("x2")) / 2).alias("x"), F.when(col("shape") == "punto", col("y1")).otherwise((col("y1") + col("y2")) / 2).alias("y"))
    return S.perturbed(t, e, [1.0, 2.0, 4.0], 20, 8.0).withColumns({c: F.round(c, 6) for c in ("exacto_pct", "serie_pct")})


@bound("a33_text_density", """with b as (select p_partkey as bid, p_brand, p_size::double as x0, p_retailprice/50 as y0, p_size+12.0 as x1, p_retailprice/50+4 as y1 from part where p_partkey % 3 = 0),
 w as (select p_brand, p_size+1.0 as wx0, p_retailprice/50+0.5 as wy0, p_size+3.0 as wx1, p_retailprice/50+1.5 as wy1 from part where p_partkey % 3 > 0)
 select b.bid, round(coalesce(sum((wx1-wx0)*(wy1-wy0)), 0)/48.0, 6) as densidad from b left join w on b.p_brand = w.p_brand and (wx0+wx1)/2 between x0 and x1 and (wy0+wy1)/2 between y0 and y1 group by 1""")
def a33(spark, d):
    p = table(spark, d, "part")
    b = p.where("p_partkey % 3 = 0").select(col("p_partkey").alias("bid"), "p_brand", col("p_size").cast("double").alias("x0"), (col("p_retailprice") / 50).alias("y0"), (col("p_size") + 12.0).alias("x1"), (col("p_retailprice") / 50 + 4).alias("y1"))
    w = p.where("p_partkey % 3 > 0").select("p_brand", (col("p_size") + 1.0).alias("wx0"), (col("p_retailprice") / 50 + 0.5).alias("wy0"), (col("p_size") + 3.0).alias("wx1"), (col("p_retailprice") / 50 + 1.5).alias("wy1"))
    return S.text_density(b, w, ["p_brand"]).select("bid", F.round("densidad", 6).alias("densidad"))


# labels of an axis for each order: pixel 100 * line number, value 7 times that but for some that are misread
_AXIS = "x as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, l_quantity as q, l_partkey as pk from lineitem), ax as (select k, n, n*100.0::double as px, case when pk % 7 = 0 then n*70.0 else n*700.0 + 20 end::double as v from x)"


def axis(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).select(col("l_orderkey").alias("k"), "n", (col("n") * 100.0).alias("px"), F.when(col("l_partkey") % 7 == 0, col("n") * 70.0).otherwise(col("n") * 700.0 + 20).alias("v"))


_FIT = f"""{_AXIS}, sp as (select *, 0.04*(max(v) over (partition by k)-min(v) over (partition by k)) as tol from ax),
 pr as (select a.k, a.n as n1, b.n as n2, (b.v-a.v)/(b.px-a.px) as m0, a.v-(b.v-a.v)/(b.px-a.px)*a.px as b0 from sp a join sp b on a.k = b.k and a.n < b.n),
 sc as (select pr.k, n1, n2, any_value(m0) as m0, any_value(b0) as b0, count(*) as c from pr join sp on pr.k = sp.k and abs(m0*px+b0-v) <= tol+1e-12 group by 1, 2, 3),
 bs as (select * from (select *, row_number() over (partition by k order by c desc, n1, n2) as r from sc) where r = 1),
 kp as (select sp.*, abs(m0*px+b0-v) <= tol+1e-12 as ok from sp join bs on sp.k = bs.k),
 ft as (select k, regr_slope(v, px) filter (where ok) as m, regr_intercept(v, px) filter (where ok) as b, regr_r2(v, px) filter (where ok) as r2, count_if(ok) as used, count(*) as total from kp group by 1 having count_if(ok) >= 2)"""


@bound("a34_robust_line", f"with {_FIT} select k, round(m, 6) + 0.0 as m, round(b, 3) + 0.0 as b, round(r2, 6) as r2, used, total from ft")
def a34(spark, d):
    return K.robust_line(axis(spark, d), ["k"], "n", "px", "v").withColumns({"m": F.round("m", 6) + 0.0, "b": F.round("b", 3) + 0.0, "r2": F.round("r2", 6)})


_SC = "g as (select k, case when count(*) >= 3 and min(v) > 0 and max(v) >= 20*min(v) and regr_r2(case when v > 0 then log10(v) end, px) > 0.999 and regr_r2(v, px) < 0.98 then 'log' else 'lineal' end as escala from lx group by 1)"
_LX = "lx as (select k, n, n*100.0::double as px, case when k % 2 = 0 then power(10.0::double, n) else v end as v from ax)"


def mixed_axis(spark, d):
    return axis(spark, d).withColumn("v", F.when(col("k") % 2 == 0, F.pow(F.lit(10.0), col("n"))).otherwise(col("v")))


@bound("a35_scale_type", f"with {_AXIS}, {_LX}, {_SC} select k, escala from g")
def a35(spark, d):
    return K.scale_type(mixed_axis(spark, d), ["k"], "px", "v")


@bound("a36_convert", f"with {_FIT} select ax.k, n, round(m*(px+50)+b, 3) as valor, array_to_string(list_filter([case when r2 < 0.995 then 'ajuste' end, case when used < total then 'descartadas' end], lambda x: x is not null), ',') as avisos from ax join ft on ax.k = ft.k")
def a36(spark, d):
    a = axis(spark, d)
    fit = K.robust_line(a, ["k"], "n", "px", "v").withColumn("escala", F.lit("lineal"))
    out = K.converted(a.withColumn("p", col("px") + 50), fit, ["k"], "p")
    return out.select("k", "n", F.round("valor", 3).alias("valor"), F.array_join("avisos", ",").alias("avisos"))


@bound("a37_repair", f"""with {_FIT}, j as (select ax.k, n, v, v::bigint::varchar as texto, m*px + b as p from ax join ft on ax.k = ft.k where used >= 3), w as (select *, abs(p - v) <= 0.04*(max(v) over (partition by k) - min(v) over (partition by k)) + 1e-12 as ok from j),
 g as (select *, 0.04*(max(case when ok then v end) over (partition by k) - min(case when ok then v end) over (partition by k)) as r, regexp_replace(texto, '[^0-9]', '', 'g') as d from w),
 c as (select k, n, p, r, unnest(list_distinct(list_concat(list_transform(range(1, length(d)), lambda q: substr(d, 1, q) || '.' || substr(d, q + 1)), ['0.' || d, d, d || '0'], case when length(d) > 1 then [substr(d, 1, length(d) - 1)] else [] end))) as t from g where not ok and d <> ''),
 e as (select *, abs(t::double - p) as e from c) select k, n, arg_min(t, (e, t)) as corregida, arg_min(t::double, (e, t)) as valor_nuevo from e group by 1, 2 having min(e) <= any_value(r)""")
def a37(spark, d):
    a = axis(spark, d).withColumn("texto", col("v").cast("long").cast("string"))
    return K.repaired(a, K.robust_line(a, ["k"], "n", "px", "v"), ["k"], "n", "px", "texto", "v")


@bound("a43_quantise", """with t as (select distinct l_orderkey as k, l_quantity as q from lineitem), s as (select k, median(d)/10 as r from (select k, q - lag(q) over (partition by k order by q) as d from t) group by 1)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when l_tax = 0 or r is null or r = 0 then l_quantity*1.037 else round_even(l_quantity*1.037/r, 0)*r end, 6) as valor from lineitem join s on l_orderkey = k""")
def a43(spark, d):
    li = table(spark, d, "lineitem").withColumn("v", col("l_quantity") * 1.037)
    return K.quantised(li, ["l_orderkey"], "l_quantity", "v", col("l_tax") == 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("valor", 6).alias("valor"))
