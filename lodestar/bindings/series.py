"""Series operators (W, P7, Z) on the given tables: a user's events in order of time, a customer's orders in order of key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.bindings.registry import bound, table
from lodestar.operators import series as W
from lodestar.operators.validity import bounded_edits, unique_ids

col = F.col
H = "(epoch_us(ts)/3600000000.0)"


def walk(spark, d):
    return table(spark, d, "events").select("user_id", (F.unix_micros("ts") / 3600000000.0).alias("x"), col("value").alias("y"), "event_id", "event_type")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_WALK = f"w as (select user_id, {H} as x, value as y, event_id, event_type from events)"


@bound("w1_segments", f"with {_WALK}, s as (select user_id, x as x1, y as y1, lead(x) over v as x2, lead(y) over v as y2 from w window v as (partition by user_id order by x)) select user_id, round(x1, 6) as x1, y1, round(x2, 6) as x2, y2, case when y2 > y1 then 'aumento' when y2 < y1 then 'disminucion' else 'estable' end as tendencia from s where x2 is not null")
def w1(spark, d):
    return rounded(W.segments(walk(spark, d), ["user_id"], "x", "y"), "x1", "x2")


@bound("w1_segments_log", f"with {_WALK}, s as (select user_id, x as x1, log10(y) as a, lead(log10(y)) over v as b, 0.01*(max(log10(y)) over u - min(log10(y)) over u) as t from w window v as (partition by user_id order by x), u as (partition by user_id)) select user_id, round(x1, 6) as x1, case when b-a > t then 'aumento' when b-a < -t then 'disminucion' else 'estable' end as tendencia from s where b is not null")
def w1b(spark, d):
    return rounded(W.segments(walk(spark, d), ["user_id"], "x", "y", 0.01, True).select("user_id", "x1", "tendencia"), "x1")


@bound("w2_moving_median", f"""with {_WALK}, n as (select *, row_number() over (partition by user_id order by x) as i, count(*) over (partition by user_id) as c from w), k as (select n.*, o from n, range(-2, 3) r(o))
 select k.user_id, k.event_id, case when k.c < 5 then any_value(k.y) else median(b.y) end as suave from k join n b on b.user_id = k.user_id and b.i = greatest(1, least(k.c, k.i + k.o)) group by k.user_id, k.event_id, k.c""")
def w2(spark, d):
    return W.moving_median(walk(spark, d), ["user_id"], "x", "y").select("user_id", "event_id", "suave")


@bound("w3_resample", f"""with {_WALK}, r as (select *, min(x) over u as a, max(x) over u as b, lead(x) over v as x2, lead(y) over v as y2 from w window u as (partition by user_id), v as (partition by user_id order by x)),
 g as (select user_id, i, min(a) + i*(max(b)-min(a))/49.0 as t from r, range(0, 50) q(i) group by user_id, i)
 select g.user_id, g.i::int as i, round(any_value(t), 6) as x, round(arg_min(r.y + (t-r.x)/(r.x2-r.x)*(r.y2-r.y), r.x), 6) as y from g join r on r.user_id = g.user_id and r.x2 is not null and t >= r.x - 1e-7 and t <= r.x2 + 1e-7 group by g.user_id, g.i""")
def w3(spark, d):
    return rounded(W.resampled(walk(spark, d), ["user_id"], "x", "y", 50), "x", "y")


@bound("w4_arc_length", f"with {_WALK}, s as (select user_id, event_id, x, coalesce(sqrt(power(x-lag(x) over v,2)+power(y-lag(y) over v,2)), 0) as d from w window v as (partition by user_id order by x)) select user_id, event_id, round(sum(d) over (partition by user_id order by x rows unbounded preceding), 5) as largo from s")
def w4(spark, d):
    return rounded(W.arc_length(walk(spark, d), ["user_id"], "x", "y").select("user_id", "event_id", "largo"), "largo", digits=5)


@bound("w5_densify", f"""with {_WALK}, s as (select user_id, x, y, lead(x) over v as x2, lead(y) over v as y2, count(*) over (partition by user_id) as n, row_number() over v as tramo from w window v as (partition by user_id order by x)),
 l as (select *, sqrt(power(x2-x,2)+power(y2-y,2)) as l from s), t as (select *, sum(l) over (partition by user_id) as t from l), e as (select *, case when n >= 100 or l is null or t = 0 or t is null then 0 else round_even((100-n)*l/t, 0) end::int as e from t)
 select user_id, tramo, k::int as k, round(case when k = 0 then x else x+k/(e+1.0)*(x2-x) end, 6) as x, round(case when k = 0 then y else y+k/(e+1.0)*(y2-y) end, 6) as y from e, range(0, 101) r(k) where k <= e""")
def w5(spark, d):
    return rounded(W.densified(walk(spark, d), ["user_id"], "x", "y", 100), "x", "y")


@bound("w7_gap_groups", f"with {_WALK}, s as (select user_id, event_id, x, coalesce((x - lag(x) over (partition by user_id order by x) > 12)::int, 0) as f from w) select user_id, event_id, (sum(f) over (partition by user_id order by x rows unbounded preceding))::bigint as grupo from s")
def w7(spark, d):
    return W.gap_groups(walk(spark, d), ["user_id"], "x", 12.0).select("user_id", "event_id", "grupo")


@bound("w7_anchored_groups", f"""with recursive {_WALK}, n as (select *, row_number() over (partition by user_id order by x, event_id) as i from w), r as (select user_id, event_id, i, 0 as grupo, x as mark, 1 as m from n where i = 1
 union all select n.user_id, n.event_id, n.i, case when n.x - mark > 48 then grupo + 1 else grupo end, case when n.x - mark > 48 then n.x else (mark*m + n.x)/(m + 1) end, case when n.x - mark > 48 then 1 else m + 1 end from r join n on n.user_id = r.user_id and n.i = r.i + 1)
 select user_id, event_id, grupo::bigint as grupo from r""")
def w7b(spark, d):
    return W.anchored_groups(walk(spark, d), ["user_id"], "x", 48.0, "mean").select("user_id", "event_id", "grupo")


@bound("w8_best_group", """with s as (select l_orderkey, l_returnflag, l_extendedprice, sign(lead(l_extendedprice) over (partition by l_orderkey, l_returnflag order by l_shipdate, l_partkey) - l_extendedprice) as s from lineitem),
 g as (select l_orderkey, l_returnflag, count(*) as n, avg(l_extendedprice) as m, min(s) as a, max(s) as b, max(l_extendedprice)-min(l_extendedprice) as w from s group by 1, 2), k as (select *, row_number() over (partition by l_orderkey order by n desc, m, l_returnflag) as r from g where n >= 2 and w >= 100 and a = b and a <> 0)
 select l_orderkey, l_returnflag, n from k where r = 1""")
def w8(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.struct("l_shipdate", "l_partkey"))
    return W.best_group(li, ["l_orderkey"], "l_returnflag", "l_extendedprice", "o", 2, 100.0)


_SHAPE = """g as (select {k} as k, min(x) as x0, max(x) as x1, arg_min(y, x) as y0, arg_max(y, x) as y1, max(y) as ymax, arg_min(x, (-y, x)) as xmax, min(y) as ymin, arg_min(x, (y, x)) as xmin from w group by 1),
 h as (select *, case when ymax > ymin then ymax-ymin else 1 end as s, 0.05*case when x1 > x0 then x1-x0 else 1 end as p from g),
 i as (select *, xmax > x0+p and xmax < x1-p and ymax-greatest(y0,y1) > 0.1*s as top, xmin > x0+p and xmin < x1-p and least(y0,y1)-ymin > 0.1*s as low from h),
 f as (select k, y0, y1, case when top and low then 'mixta' when top then 'sube-baja' when low then 'baja-sube' when abs(y1-y0) <= 0.05*s then 'estable' when y1 > y0 then 'aumenta' else 'disminuye' end as forma from i)"""


@bound("w9_curve_shape", "with w as (select o_custkey, o_orderkey as x, o_totalprice as y from orders), " + _SHAPE.format(k="o_custkey") + " select k as o_custkey, y0, y1, forma from f")
def w9(spark, d):
    return W.curve_shape(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "y0", "y1", "forma")


@bound("w10_thin", f"""with {_WALK}, n as (select *, row_number() over (partition by user_id order by x) - 1 as i, count(*) over (partition by user_id) as c from w), p as (select distinct user_id, round_even(k*(c-1)/19.0, 0)::bigint as i from n, range(0, 20) r(k) where c > 20)
 select n.user_id, n.event_id from n where c <= 20 or exists (select 1 from p where p.user_id = n.user_id and p.i = n.i)""")
def w10(spark, d):
    return W.thinned(walk(spark, d), ["user_id"], "x", 20).select("user_id", "event_id")


# each round halves the pieces whose farthest vertex is too far off
@bound("w11_simplify", f"""with recursive {_WALK}, n as (select user_id, x, y, row_number() over (partition by user_id order by x) as i, count(*) over (partition by user_id) as c from w), s as (select user_id, 1::bigint as a, max(c)::bigint as b from n group by 1
 union all select s.user_id, case when h.k = 0 then s.a else f.far end, case when h.k = 0 then f.far else s.b end from s, lateral (select arg_max(p.i, (d.off, -p.i)) as far, max(d.off) as m from n p join n u on u.user_id = s.user_id and u.i = s.a join n v on v.user_id = s.user_id and v.i = s.b,
 lateral (select case when v.x = u.x and v.y = u.y then sqrt(power(p.x-u.x, 2) + power(p.y-u.y, 2)) else abs((v.x-u.x)*(p.y-u.y) - (v.y-u.y)*(p.x-u.x))/sqrt(power(v.x-u.x, 2) + power(v.y-u.y, 2)) end as off) d where p.user_id = s.user_id and p.i > s.a and p.i < s.b) f, (values (0), (1)) h(k) where f.m > 20),
 e as (select distinct user_id, i from (select user_id, a as i from s union all select user_id, b from s)), r as (select *, row_number() over (partition by user_id order by i) - 1 as k, count(*) over (partition by user_id) as l from e)
 select n.user_id, x, y from r join n using (user_id, i) where l <= 30 or k in (select round_even(j*(l-1)/29.0, 0)::bigint from range(0, 30) t(j))""")
def w11(spark, d):
    return W.simplified(walk(spark, d).select("user_id", "x", "y"), ["user_id"], "x", "y", 20.0, 30)


# a rule that looks at what it did before: one row of each user at a time
_STEPS = f"{_WALK}, n as (select *, row_number() over (partition by user_id order by x, event_id) as i, count(*) over (partition by user_id) as c from w)"


@bound("w12_spacing", f"""with recursive {_STEPS}, r as (select user_id, event_id, x, y, i, c, true as kept, x as kx, y as ky from n where i = 1
 union all select n.user_id, n.event_id, n.x, n.y, n.i, n.c, k.far, case when k.far then n.x else r.kx end, case when k.far then n.y else r.ky end from r join n on n.user_id = r.user_id and n.i = r.i + 1, lateral (select sqrt(power(n.x - r.kx, 2) + power(n.y - r.ky, 2)) >= 60 as far) k)
 select user_id, event_id, x, y from r where kept or i = c""")
def w12(spark, d):
    return W.spaced(walk(spark, d).select("user_id", "event_id", "x", "y"), ["user_id"], "x", "x", "y", 60.0)


# charts of 40 parts: axes, a code, points of three series, on plates of three sizes with a cut corner
_PLATES = """e as (select p_partkey // 40 as chart, p_partkey as n, case p_partkey % 10 when 0 then 'eje' when 1 then 'eje' when 2 then 'codigo' else 'punto' end as tipo, case when p_partkey % 10 = 2 then 'QR' else 'e' || p_partkey end as id, 's' || p_partkey % 3 as serie, case when p_partkey % 20 = 12 then 'punto' else 'rect' end as shape,
 p_size*2.0::double as x1, (p_partkey*37 % 100)::double as y1, case p_partkey % 10 when 0 then p_size*2.0 + 60 - p_partkey*13 % 120 else p_size*2.0 + 8 end::double as x2, case p_partkey % 10 when 1 then p_partkey*37 % 100 + 50 - p_partkey*11 % 100 else p_partkey*37 % 100 + 8 end::double as y2 from part),
 h as (select chart, 100.0::double + chart % 3 * 50 as width, 100.0::double as height, case chart % 4 when 0 then 'superior izquierda' when 1 then 'superior derecha' when 2 then 'inferior izquierda' end as cut from (select distinct chart from e)),
 c0 as (select chart, k as o, 'esquina ' || nm || ' de la placa' as nombre, fx*width as x, fy*height as y from h, (values (0, 'superior izquierda', 0, 0), (1, 'superior derecha', 1, 0), (2, 'inferior izquierda', 0, 1), (3, 'inferior derecha', 1, 1)) v(k, nm, fx, fy) where cut is distinct from nm),
 ax as (select *, abs(x2-x1) >= abs(y2-y1) as hz, case when abs(x2-x1) >= abs(y2-y1) then x1 <= x2 else y1 >= y2 end as fw from e where tipo = 'eje'),
 c1 as (select chart, 1000000000000 + 2*n as o, 'origen de los ejes' as nombre, case when fw then x1 else x2 end as x, case when fw then y1 else y2 end as y from ax union all select chart, 1000000000001 + 2*n, case when hz then 'extremo derecho del eje horizontal' else 'extremo superior del eje vertical' end, case when fw then x2 else x1 end, case when fw then y2 else y1 end from ax),
 q as (select * from (select *, row_number() over (partition by chart order by n) as r from e where lower(id) = 'qr') where r = 1 and shape = 'rect'),
 c2 as (select chart, 2000000000000 as o, 'esquina superior izquierda del QR' as nombre, least(x1, x2) as x, least(y1, y2) as y from q union all select chart, 2000000000001, 'esquina inferior derecha del QR', greatest(x1, x2), greatest(y1, y2) from q),
 p as (select *, min(n) over (partition by chart, serie) as n0, row_number() over (partition by chart, serie order by x1, n) as a, row_number() over (partition by chart, serie order by x1 desc, n desc) as b from e where tipo = 'punto'),
 c3 as (select chart, 3000000000000 + 2*n0 as o, 'primer punto de ' || serie as nombre, x1 as x, y1 as y from p where a = 1 union all select chart, 3000000000001 + 2*n0, 'último punto de ' || serie, x1, y1 from p where b = 1),
 n as (select *, row_number() over (partition by chart order by o) as i from (select * from c0 union all select * from c1 union all select * from c2 union all select * from c3))"""


@bound("w13_reference_points", f"""with recursive {_PLATES}, r as (select chart, nombre, x, y, i, true as kept, [{{'x': x, 'y': y}}] as seen from n where i = 1
 union all select n.chart, n.nombre, n.x, n.y, n.i, f.far, case when f.far then list_append(r.seen, {{'x': n.x, 'y': n.y}}) else r.seen end from r join n on n.chart = r.chart and n.i = r.i + 1, lateral (select len(list_filter(r.seen, lambda v: sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) < 2.0)) = 0 as far) f)
 select chart, nombre, x, y from (select *, row_number() over (partition by chart order by i) as k from r where kept) where k <= 12""")
def w13(spark, d):
    k, n = col("p_partkey"), col("p_partkey") % 10
    x, y = col("p_size") * 2.0, (k * 37 % 100).cast("double")
    e = table(spark, d, "part").select(F.floor(k / 40).alias("chart"), k.alias("n"), F.when(n < 2, "eje").when(n == 2, "codigo").otherwise("punto").alias("tipo"), F.when(n == 2, "QR").otherwise(F.concat(F.lit("e"), k.cast("string"))).alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("serie"), F.when(k % 20 == 12, "punto").otherwise("rect").alias("shape"),
        x.alias("x1"), y.alias("y1"), F.when(n == 0, x + 60 - k * 13 % 120).otherwise(x + 8).alias("x2"), F.when(n == 1, y + 50 - k * 11 % 100).otherwise(y + 8).alias("y2"))
    cut = F.when(col("chart") % 4 == 0, "superior izquierda").when(col("chart") % 4 == 1, "superior derecha").when(col("chart") % 4 == 2, "inferior izquierda")
    plates = e.select("chart").distinct().select("chart", (100.0 + col("chart") % 3 * 50).alias("width"), F.lit(100.0).alias("height"), cut.alias("cut"))
    return W.reference_points(W.reference_candidates(plates, e), ["chart"], "orden", "x", "y").select("chart", "nombre", "x", "y")


@bound("w14_first_middle_last", "with n as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as c from orders) select o_custkey, o_orderkey from n where i = 1 or i = c // 2 + 1 or i = c")
def w14(spark, d):
    return W.first_middle_last(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@bound("w15_sample_targets", f"""with {_WALK}, k as (select *, y > 80 as near, row_number() over (partition by user_id, y > 80 order by md5(event_id || ':1'), event_id) as k from w), f as (select *, case when near and k <= 5 then 0 when not near then 1 else 2 end as f from k)
 select user_id, event_id from (select *, row_number() over (partition by user_id order by f, k) as r from f) where r <= 15""")
def w15(spark, d):
    return W.sampled_targets(walk(spark, d), ["user_id"], "event_id", col("y") > 80, 15).select("user_id", "event_id")


@bound("w16_grid_completion", """with b as (select p_brand, p_size // 5 as q, min(p_name) as nombre from part group by 1, 2), r as (select p_brand, q*10.0::double as x, nombre from b where (q + length(p_brand)) % 7 <> 3), d as (select *, lead(x) over (partition by p_brand order by x)-x as d from r),
 s as (select p_brand, median(d) as s, count(*) as n, min(d) as lo from d group by 1 having count(*) >= 3 and min(d) > 0), j as (select d.*, s, d/s as m from d join s using (p_brand)),
 ok as (select p_brand from j group by 1 having max(coalesce(abs(m-round_even(m,0)),0)) <= 0.2 and sum(coalesce(round_even(m,0)-1,0)) <= 2 and min(m) >= 0.75),
 f as (select j.*, k from j join ok using (p_brand), range(0, 4) q(k) where k <= coalesce(round_even(m,0)-1, 0)), n as (select p_brand, row_number() over (partition by p_brand order by x, k) as n, x+k*s as pos, k, nombre from f)
 select p_brand, n::int as n, round(pos, 6) as pos, case when k = 0 then nombre else 'Categoría ' || n end as rotulo from n""")
def w16(spark, d):
    b = table(spark, d, "part").groupBy("p_brand", F.floor(col("p_size") / 5).alias("q")).agg(F.min("p_name").alias("nombre"))
    r = b.where("(q + length(p_brand)) % 7 <> 3").select("p_brand", (col("q") * 10.0).alias("x"), "nombre")
    return rounded(W.grid_completed(r, ["p_brand"], "x", "nombre"), "pos")


@bound("w17_figure_numbers", """with f as (select l_orderkey as doc, l_linenumber % 3 as pag, l_returnflag as pie, l_suppkey % 4 as num, l_quantity*10.0::double as x, l_partkey % 90 as y, l_partkey, l_suppkey, l_linenumber from lineitem),
 q as (select *, round_even(y/20.0, 0) as b from f), g as (select *, min((b, x, l_partkey, l_suppkey)) over (partition by doc, pag, pie) as fy, count(*) over (partition by doc, pag, pie) as c, min(num) over (partition by doc, pag, pie) as num1 from q),
 r as (select *, dense_rank() over (partition by doc order by pag, num1, fy, pie) as figura, row_number() over (partition by doc, pag, pie order by b, x, l_partkey, l_suppkey) as panel from g)
 select doc, l_partkey, l_suppkey, l_linenumber, case when c > 1 then figura || '.' || panel else figura::varchar end as rotulo from r""")
def w17(spark, d):
    li = table(spark, d, "lineitem").select(col("l_orderkey").alias("doc"), (col("l_linenumber") % 3).alias("pag"), col("l_returnflag").alias("pie"), (col("l_suppkey") % 4).alias("num"), F.struct((col("l_quantity") * 10.0).alias("x"), "l_partkey", "l_suppkey").alias("x"), (col("l_partkey") % 90).alias("y"), "l_partkey", "l_suppkey", "l_linenumber")
    li = li.withColumn("num", F.min("num").over(Window.partitionBy("doc", "pag", "pie")))
    return W.numbered_figures(li, ["doc"], "pag", "pie", "num", "x", "y").select("doc", "l_partkey", "l_suppkey", "l_linenumber", "rotulo")


@bound("w18_token_runs", """with t as (select l_orderkey as k, l_linenumber*20.0 + l_tax*100 as x0, l_linenumber*20.0 + l_tax*100 + l_discount*100 as x1, l_returnflag || l_linenumber as s, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem), u as (select * from t where r = 1),
 g as (select *, x0 - lag(x1) over (partition by k order by x0) as g from u), p as (select k, g, lag(g) over (partition by k order by g) as p from g where g > 0), c as (select k, max(g/p) as rr, arg_min(sqrt(g*p), (-(g/p), sqrt(g*p))) as c from p group by 1),
 j as (select g.*, coalesce((g > case when rr >= 2 then c else 12.0 end)::int, 0) as f from g left join c using (k)), n as (select *, sum(f) over (partition by k order by x0 rows unbounded preceding) as grupo from j) select k, grupo::bigint as grupo, string_agg(s, ' ' order by x0) as rotulo from n group by 1, 2""")
def w18(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x0 = col("l_linenumber") * 20.0 + col("l_tax") * 100
    t = table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r = 1").select(col("l_orderkey").alias("k"), x0.alias("x0"), (x0 + col("l_discount") * 100).alias("x1"), F.lit(20.0).alias("h"), F.concat("l_returnflag", col("l_linenumber").cast("string")).alias("s"))
    return W.joined_tokens(t, ["k"], "x0", "x1", "h", "s")


# bars of an order's lines; equal middles are told apart by part and supplier
@bound("w19_bar_groups", """with recursive b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber*6.0 + l_quantity as c0, l_linenumber*6.0 + l_quantity + 12 as c1, l_returnflag as s from lineitem),
 n as (select *, row_number() over (partition by l_orderkey order by c0 + c1, l_linenumber, l_partkey, l_suppkey, s) as i, 0.5*median(c1 - c0) over (partition by l_orderkey) as near from b),
 r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, i, 0 as grupo, c0 as lo, c1 as hi, [s] as names from n where i = 1
 union all select n.l_orderkey, n.l_linenumber, n.l_partkey, n.l_suppkey, n.i, grupo + (not k.j)::int, case when k.j then least(lo, c0) else c0 end, case when k.j then greatest(hi, c1) else c1 end, case when k.j then list_append(names, s) else [s] end
 from r join n on n.l_orderkey = r.l_orderkey and n.i = r.i + 1, lateral (select least(c1, hi) - greatest(c0, lo) > 0.5*(c1 - c0) or (c0 - hi <= near and not list_contains(names, s)) as j) k)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, grupo::bigint as grupo from r""")
def w19(spark, d):
    c0 = col("l_linenumber") * 6.0 + col("l_quantity")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c0.alias("c0"), (c0 + 12).alias("c1"), "l_returnflag")
    return W.bar_groups(li, ["l_orderkey"], "c0", "c1", "l_returnflag", 3, ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grupo")


@bound("w20_axis_ticks", """with r as (select user_id, min(value) as lo, max(value) as hi from events group by 1 having max(value) > min(value)), s as (select *, (hi-lo)/4 as raw, power(10.0::double, floor(log10((hi-lo)/4))) as p from r),
 t as (select *, case when p >= raw then p when 2*p >= raw then 2*p when 2.5*p >= raw then 2.5*p when 5*p >= raw then 5*p else 10*p end as st from s) select user_id, k::int as k, round(ceil(lo/st)*st + k*st, 10) as marca from t, range(0, 12) q(k) where k <= floor((hi - ceil(lo/st)*st)/st + 1e-9)""")
def w20(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return W.axis_ticks(r, ["user_id"], "lo", "hi")


@bound("w22_short_codes", """with f as (select o_orderpriority as k, o_custkey as t, min(o_orderkey) as o from orders where o_totalprice > 400000 group by 1, 2), n as (select *, row_number() over (partition by k order by o) - 1 as i from f)
 select o_orderkey, case when i < 26 then chr((65 + i)::int) else chr((65 + i % 26)::int) || (i // 26) end as codigo from orders left join n on k = o_orderpriority and t = o_custkey""")
def w22(spark, d):
    o = table(spark, d, "orders")
    return W.short_codes(o, ["o_orderpriority"], "o_custkey", "o_orderkey", col("o_totalprice") > 400000).select("o_orderkey", "codigo")


@bound("p7_unique_ids", """with r as (select o_orderkey, case when o_orderkey % 6 = 0 then '' else o_orderstatus || o_custkey % 5 end as id, 'k' || o_custkey % 3 as tipo, o_custkey % 50 as g from orders), n as (select *, row_number() over (partition by g, id, case when id = '' then tipo end order by o_orderkey) as n from r)
 select o_orderkey, case when id = '' then tipo || '_' || n when n > 1 then id || '_' || n else id end as unique_id from n""")
def p7(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(col("o_orderkey") % 6 == 0, "").otherwise(F.concat("o_orderstatus", (col("o_custkey") % 5).cast("string"))).alias("id"), F.concat(F.lit("k"), (col("o_custkey") % 3).cast("string")).alias("tipo"), (col("o_custkey") % 50).alias("g"))
    return unique_ids(o, ["g"], "id", ["o_orderkey"], "tipo").select("o_orderkey", "unique_id")


@bound("p16_bounded_edits", """with r as (select event_id, user_id, event_type || '_' || user_id % 4 as clave, event_type || props as texto, value*3 - 150 as dx, case when value > 90 then 0 else 150 - value*2 end as dy from events where event_type <> 'error'),
 a as (select *, row_number() over (partition by user_id, clave order by event_id) as k from r where (dx <> 0 or dy <> 0) and regexp_matches(clave, '^(view|click)_')), b as (select *, row_number() over (partition by user_id order by event_id) as j from a where k = 1)
 select event_id, clave, substr(texto, 1, 12) as texto, round(greatest(-220, least(220, dx)), 6) as dx, round(greatest(-220, least(220, dy)), 6) as dy from b where j <= 2""")
def p16(spark, d):
    ev = table(spark, d, "events").where("event_type <> 'error'").select("event_id", "user_id", F.concat_ws("_", "event_type", (col("user_id") % 4).cast("string")).alias("clave"), F.concat("event_type", "props").alias("texto"), (col("value") * 3 - 150).alias("dx"), F.when(col("value") > 90, 0.0).otherwise(150 - col("value") * 2).alias("dy"))
    return rounded(bounded_edits(ev, ["user_id"], "clave", "texto", "dx", "dy", ["event_id"], "^(view|click)_", 2, 12).select("event_id", "clave", "texto", "dx", "dy"), "dx", "dy")


@bound("z1_newest_first", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as puesto from orders")
def z1(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("puesto"))


@bound("z2_first_registered", "select s_suppkey, s_name from supplier order by s_suppkey limit 1")
def z2(spark, d):
    return table(spark, d, "supplier").orderBy("s_suppkey").limit(1).select("s_suppkey", "s_name")


@bound("z3_top_k", "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) select o_custkey, o_orderkey, k from r where k <= 3")
def z3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 3")


@bound("z4_union_candidates", """with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > 25 as util from lineitem), f as (select o_orderkey, exists (select 1 from p where p.l_orderkey = o_orderkey and util) as reemplaza from orders)
 select o_orderkey as fig, 0 as panel, 0::bigint as parte, 0::bigint as prov from f where not reemplaza union all select l_orderkey, l_linenumber, l_partkey, l_suppkey from p join f on o_orderkey = l_orderkey where reemplaza and util""")
def z4(spark, d):
    from lodestar.operators.matching import figures_or_panels

    figs = table(spark, d, "orders").select(col("o_orderkey").alias("fig"), F.lit(0).alias("panel"), F.lit(0).cast("long").alias("parte"), F.lit(0).cast("long").alias("prov"))
    panels = table(spark, d, "lineitem").select(col("l_orderkey").alias("fig"), col("l_linenumber").alias("panel"), col("l_partkey").alias("parte"), col("l_suppkey").alias("prov"), (col("l_quantity") > 25).alias("util"))
    return figures_or_panels(figs, panels, "fig", "util")


@bound("z5_difference", "select distinct md5(text) as hash from documents where md5(text) not in (select md5(text) from documents where doc_id % 10 = 0)")
def z5(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    return h.select("hash").distinct().join(h.where("doc_id % 10 = 0").select("hash"), "hash", "left_anti")


@bound("z5_ordered_distinct", "select source, min(doc_id) as primero, row_number() over (order by min(doc_id)) as puesto from documents group by 1")
def z5b(spark, d):
    from lodestar.operators.matching import ordered_distinct

    return ordered_distinct(table(spark, d, "documents"), "source", "doc_id")


@bound("z6_reading_order", "select p_partkey, row_number() over (partition by p_brand order by p_size % 4, round_even(p_retailprice/20, 0), p_size, p_partkey) as puesto from part")
def z6(spark, d):
    w = Window.partitionBy("p_brand").orderBy(col("p_size") % 4, F.bround(col("p_retailprice") / 20, 0), "p_size", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).alias("puesto"))
