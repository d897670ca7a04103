"""Text and document operators (X, W21, A29-A30, J13-J26, P21, P28) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import bound, table
from lodestar.functions import text as X
from lodestar.operators import matching as M
from lodestar.operators import series as W

col = F.col


def docs(spark, d):
    return table(spark, d, "documents")


_WS = r"'[ \t\n\r\f\v]+'"


@bound("x1_normalise", r"""select doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace('ﬁ­' || text, 'ﬁ', 'fi'), '­', ''), '([a-záéíóúñ])- ([a-záéíóúñ])', '\1\2', 'g'), '\s+', ' ', 'g'))) as h from documents""")
def x1(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalised(F.concat(F.lit("ﬁ­"), col("text")))).alias("h"))


@bound("x1_normalise_full")
def x1b(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.fully_normalised("text")).alias("h"))


#: A word without the one mark that may end it; letters by case; a word, a number, a unit.
_BARE = lambda w, ends: f"case when contains('{ends}', right({w}, 1)) then left({w}, length({w}) - 1) else {w} end"
_LOW, _HIGH = "a-záéíóúñü", "A-ZÁÉÍÓÚÑ"
_NAME = lambda w: f"(regexp_matches({_BARE(w, '.,;:!?')}, '^[{_LOW}{_HIGH}Ü][{_LOW}’'']+\\z') or (length({_BARE(w, '.,;:')}) > 1 and trim({_BARE(w, '.,;:')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑ') = ''))"
_COUNT = lambda w: f"(regexp_matches(translate(regexp_replace({_BARE(w, '.,;:')}, '%\\z', ''), ',', '.'), '^[-−+]?[0-9]+([.][0-9]+)*\\z') or regexp_matches(ltrim({w}, '0123456789'), '^%?[A-Za-z]{{1,4}}\\z') and left({w}, 1) between '0' and '9')"
_GOOD = f"({_NAME('w')} or {_COUNT('w')} or (left(w, 1) = '(' and right({_BARE('w', '.,;:')}, 1) = ')' and length({_BARE('w', '.,;:')}) between 3 and 14 and not regexp_matches({_BARE('w', '.,;:')}[2:-2], '[()\\s]')))"


@bound("x3_legible", rf"""with s as (select doc_id, trim(text) as t from documents), w as (select doc_id, t, unnest(string_split_regex(t, '\s+')) as w from s), n as (select doc_id, any_value(t) as t, count(*) as n,
 sum(case when length(w) = 1 then (lower(w) in ('a','e','o','y','u','x','i'))::int*2 when regexp_full_match(w, '[\p{{L}}]+') and length(w) > 1 and replace(lower(w), substr(lower(w),1,1), '') = '' then 0 when {_GOOD} then 1
 when contains(w, '-') and not exists (select 1 from (select unnest(string_split(w, '-')) as v) where v <> '' and not {_NAME('v')} and not {_COUNT('v')}) then 1 else 0 end) filter (where length(w) > 1) as g1,
 count_if(length(w) = 1 and lower(w) in ('a','e','o','y','u','x','i')) as g2 from w group by 1),
 r as (select doc_id, max(c) as m from (select doc_id, w, count(*) as c from w group by 1, 2) group by 1)
 select doc_id, case when length(t) <= 3 and not contains(t, ' ') then regexp_full_match(t, '[A-Za-z0-9]+') else (coalesce(g1, 0) + case when n <= 6 then g2 else 0 end)/n >= 0.75 and not (n >= 4 and m/n > 0.3) end as legible from n join r using (doc_id)""")
def x3(spark, d):
    return docs(spark, d).select("doc_id", X.legible(col("text")).alias("legible"))


# names of one to three characters under the three rules for short texts
@bound("x3_legible_short", """with s as (select p_partkey, case p_partkey % 4 when 0 then substr(p_name, 1, 1) when 1 then upper(substr(p_name, 1, 1)) when 2 then substr(p_name, 1, 1) || p_size % 10 else 'Ω' end as t from part)
 select p_partkey, true as alguno, p_partkey % 4 > 0 as mayuscula, false as ninguno from s where t <> ''""")
def x3c(spark, d):
    first, k = F.substring("p_name", 1, 1), col("p_partkey") % 4
    t = F.when(k == 0, first).when(k == 1, F.upper(first)).when(k == 2, F.concat(first, (col("p_size") % 10).cast("string"))).otherwise("Ω")
    rows = table(spark, d, "part").select("p_partkey", t.alias("t")).where("t <> ''")
    return rows.select("p_partkey", *(X.legible(col("t"), short=s).alias(n) for s, n in (("any", "alguno"), ("capital", "mayuscula"), ("none", "ninguno"))))


@bound("x4_paragraph", r"""with w as (select doc_id, unnest(string_split_regex(trim(text), '\s+')) as w from documents) select doc_id, count(*) >= 15 and count_if(regexp_full_match(w, '[a-záéíóúñ]{3,}[.,;:]?'))/count(*) >= 0.45 as parrafo from w group by 1""")
def x4(spark, d):
    return docs(spark, d).select("doc_id", X.is_paragraph(col("text")).alias("parrafo"))


@bound("x5_cut", r"""select doc_id, case when length(text) <= 80 then text else regexp_replace(substr(text, 1, 80), ' [^ ]*$', '') || '…' end as corto from documents""")
def x5(spark, d):
    return docs(spark, d).select("doc_id", X.cut(col("text"), 80).alias("corto"))


@bound("x8_caption_assembly", """with l as (select l_orderkey, l_linenumber, min(l_partkey) as pk, bool_or(l_returnflag = 'R') as r from lineitem group by 1, 2), t as (select l_orderkey as k, l_linenumber as n, case when r then 'Fig. ' || l_linenumber else 'sigue ' || pk end as s, r, coalesce(l_linenumber - lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) = 1 and not r, false) as go from l),
 g as (select *, sum((not go)::int) over (partition by k order by n rows unbounded preceding) as g from t), a as (select k, g, string_agg(s, ' ' order by n) as pie, arg_min(r, n) as ok from g group by 1, 2) select k, pie from a where ok""")
def x8(spark, d):
    li = table(spark, d, "lineitem").groupBy(col("l_orderkey").alias("k"), col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("pk"), F.bool_or(col("l_returnflag") == "R").alias("r"))
    t = li.select("k", F.lit(10.0).alias("x0"), (col("n") * 10.0).alias("y0"), (col("n") * 10.0 + 8).alias("y1"), F.lit(8.0).alias("size"), F.when(col("r"), F.concat(F.lit("Fig. "), col("n").cast("string"))).otherwise(F.concat(F.lit("sigue "), col("pk").cast("string"))).alias("s"))
    return X.assembled_captions(t, ["k"], "x0", "y0", "y1", "size", "s")


@bound("x9_context", r"""with t as (select doc_id, case doc_id % 3 when 0 then text when 1 then '' else null end as a, case doc_id % 3 when 1 then text else ' ' end as b, source as c from documents), u as (select doc_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), '')) as t from t)
 select doc_id, case when length(t) <= 220 then t else regexp_replace(substr(t, 1, 220), ' [^ ]*$', '') || '…' end as contexto from u""")
def x9(spark, d):
    k = col("doc_id") % 3
    return docs(spark, d).select("doc_id", X.context(F.when(k == 0, col("text")).when(k == 1, ""), F.when(k == 1, col("text")).otherwise(" "), col("source")).alias("contexto"))


@bound("x11_located", "select p_partkey, case when p_size % 3 = 0 then 'Del documento «' || p_name || '», página ' || p_size || '.' when p_size % 3 = 1 then 'Del archivo a' || p_partkey || ', página ' || p_size || '.' else 'página ' || p_size || '.' end as lugar from part")
def x11(spark, d):
    k = col("p_size") % 3
    return table(spark, d, "part").select("p_partkey", X.located(F.when(k == 0, col("p_name")), F.when(k < 2, F.concat(F.lit("a"), col("p_partkey").cast("string"), F.lit(".pdf"))), col("p_size")).alias("lugar"))


_SHAPE = """w as (select o_custkey as c, o_orderpriority as s, o_orderkey as x, o_totalprice as y from orders), g as (select c, s, min(x) as x0, max(x) as x1, arg_min(y, x) as y0, arg_max(y, x) as y1, max(y) as ymax, arg_min(x, (-y, x)) as xmax, min(y) as ymin, arg_min(x, (y, x)) as xmin from w group by 1, 2),
 h as (select *, case when ymax > ymin then ymax-ymin else 1 end as sp, 0.05*case when x1 > x0 then x1-x0 else 1 end as p from g), i as (select *, xmax > x0+p and xmax < x1-p and ymax-greatest(y0,y1) > 0.1*sp as top, xmin > x0+p and xmin < x1-p and least(y0,y1)-ymin > 0.1*sp as low from h),
 f as (select *, case when top and low then 'mixta' when top then 'sube-baja' when low then 'baja-sube' when abs(y1-y0) <= 0.05*sp then 'estable' when y1 > y0 then 'aumenta' else 'disminuye' end as forma from i)"""


def _num(c):
    return f"rtrim(rtrim(printf('%.2f', {c}), '0'), '.')"


@bound("x12_series_text", f"with {_SHAPE} select c, string_agg(s || ': ' || forma || ', de ' || {_num('y0')} || ' a ' || {_num('y1')} || '; máximo ' || {_num('ymax')} || ', mínimo ' || {_num('ymin')} || '.', ' ' order by s) as texto from f group by 1")
def x12(spark, d):
    o = table(spark, d, "orders").select(col("o_custkey").alias("c"), col("o_orderpriority").alias("s"), col("o_orderkey").alias("x"), col("o_totalprice").alias("y"))
    return X.series_text(W.curve_shape(o, ["c", "s"], "x", "y"), ["c"], "s", col("s"))


@bound("x13_legend_text", "select n_regionkey, string_agg(chr(65 + n_nationkey % 26) || ' es ' || n_name, ', ' order by n_nationkey) as leyenda from nation group by 1")
def x13(spark, d):
    n = table(spark, d, "nation").withColumn("codigo", F.char((F.lit(65) + col("n_nationkey") % 26).cast("bigint")))
    return X.legend_text(n, ["n_regionkey"], "codigo", "n_name", "n_nationkey")


@bound("x14_questions", f"with {_SHAPE}, q as (select c, 'series' as tema, count(distinct s)::varchar as respuesta from w group by 1 union all select c, 'pico ' || s, xmax::varchar from f) select c, tema, respuesta from q")
def x14(spark, d):
    from lodestar.operators.rates import extremes

    o = table(spark, d, "orders").select(col("o_custkey").alias("c"), col("o_orderpriority").alias("s"), col("o_orderkey").alias("x"), col("o_totalprice").alias("y"))
    n = o.groupBy("c").agg(F.count_distinct("s").cast("string").alias("respuesta")).select("c", F.lit("series").alias("tema"), "respuesta")
    return n.unionByName(extremes(o, ["c", "s"], "x", "y").select("c", F.concat(F.lit("pico "), col("s")).alias("tema"), col("x_max").cast("string").alias("respuesta")))


@bound("w21_text_budget", r"""with c as (select conv_id, turn, role, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as u from conversations) select conv_id, turn, md5(case when length(text) <= 700-u then text else regexp_replace(regexp_replace(substr(text, 1, (700-u)::bigint), ' [^ ]*$', ''), '[,;:]+$', '') || '…' end) as h from c where u < 700""")
def w21(spark, d):
    return X.text_budget(table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", F.md5("leido").alias("h"))


@bound("a30_largest_title", """with l as (select l_orderkey as k, l_quantity as s, l_linenumber*10.0 as y0, l_linenumber*10.0 + 8 as y1, l_partkey as t, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem), u as (select * from l where r = 1),
 b as (select * from (select *, max(s) over (partition by k) as m from u) where s >= m - 10), c as (select *, coalesce((y0 - lag(y1) over (partition by k order by y0) > 0.5*s)::int, 0) as c from b), g as (select *, sum(c) over (partition by k order by y0 rows unbounded preceding) as g from c) select k, string_agg(t::varchar, ' ' order by y0) as titulo from g where g = 0 group by 1""")
def a30(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    y = col("l_linenumber") * 10.0
    li = table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r = 1").select(col("l_orderkey").alias("k"), col("l_quantity").alias("s"), y.alias("y0"), (y + 8).alias("y1"), col("l_partkey").cast("string").alias("t"))
    return X.largest_title(li, ["k"], "s", "y0", "y1", "t", 10.0, 0.5)


@bound("p21_figure_type", "select p_partkey, coalesce(case p_type when 'ECONOMY' then 'linea' when 'STANDARD' then 'barras' when 'PROMO' then 'otro' end, case when p_size > 25 then 'linea' else 'otro' end) as tipo from part")
def p21(spark, d):
    names = spark.createDataFrame([("ECONOMY", "linea"), ("STANDARD", "barras"), ("PROMO", "otro")], "p_type string, nombre string")
    rule = F.when(col("p_size") > 25, "linea").otherwise("otro")
    return table(spark, d, "part").join(F.broadcast(names), "p_type", "left").select("p_partkey", F.coalesce("nombre", rule).alias("tipo"))  # the list of kinds is fixed


# pages: a brand's parts, and a page more for every 400 part keys, so a page holds few boxes on any table
_BOX = "select p_partkey, p_brand, p_partkey // 400 as pag, p_size*8.0::double as x0, (p_partkey*37 % 600)*1.0::double as y0, p_size*8.0::double + 120 as x1, (p_partkey*37 % 600) + 60.0::double as y1 from part"


PAGE = ["p_brand", "pag"]


def boxes(spark, d, prefix=""):
    y = (col("p_partkey") * 37 % 600) * 1.0
    return table(spark, d, "part").select("p_partkey", "p_brand", F.floor(col("p_partkey") / 400).alias("pag"), (col("p_size") * 8.0).alias(f"{prefix}x0"), y.alias(f"{prefix}y0"), (col("p_size") * 8.0 + 120).alias(f"{prefix}x1"), (y + 60.0).alias(f"{prefix}y1"))


@bound("j14_captions", f"""with b as ({_BOX}), j as (select f.p_partkey as fig, c.p_partkey as cid, case when c.y0 >= f.y1-2 then c.y0-f.y1 when c.y1 <= f.y0+2 then f.y0-c.y1+10 else 5 end as s from b f join b c on f.p_brand = c.p_brand and f.pag = c.pag and f.p_partkey % 2 = 0 and c.p_partkey % 2 = 1 and least(c.x1, f.x1)-greatest(c.x0, f.x0) >= 0.3*120)
 select fig, arg_min(cid, (s, cid)) as cid, min(s) as puntaje from j where s - 10 <= 60 group by 1""")
def j14(spark, d):
    b = boxes(spark, d)
    caps = boxes(spark, d, "c").where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "cid")
    return M.captions(b.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "fig"), caps, PAGE, "fig").select("fig", "cid", "puntaje")


@bound("j15_mentions", """with f as (select o_orderkey as fig, o_custkey as doc, (o_orderkey % 4)::varchar as num from orders), p as (select l_orderkey*8 + l_linenumber as pid, l_suppkey as prov, l_partkey as pk, o_custkey as doc, l_linenumber % 4 as a, l_returnflag = 'R' as rng from lineitem join orders on l_orderkey = o_orderkey),
 c as (select distinct doc, pid, unnest(case when rng then [a::varchar, (a+1)::varchar] else [a::varchar] end) as n from p), r as (select f.doc, fig, pid, row_number() over (partition by f.doc, fig order by pid) as puesto from f join c on f.doc = c.doc and num = n) select doc, fig, pid, puesto from r where puesto <= 6""")
def j15(spark, d):
    figs = table(spark, d, "orders").select(col("o_orderkey").alias("fig"), col("o_custkey").alias("doc"), (col("o_orderkey") % 4).cast("string").alias("num"))
    a = col("l_linenumber") % 4
    owner = table(spark, d, "orders").select(col("o_orderkey").alias("l_orderkey"), "o_custkey")
    paras = table(spark, d, "lineitem").join(owner, "l_orderkey").select((col("l_orderkey") * 8 + col("l_linenumber")).alias("pid"), col("o_custkey").alias("doc"), F.when(col("l_returnflag") == "R", F.concat(F.lit("ver figs. "), a.cast("string"), F.lit("-"), (a + 1).cast("string"), F.lit(" abajo"))).otherwise(F.concat(F.lit("ver Figura "), a.cast("string"), F.lit(" abajo"))).alias("texto")).groupBy("pid", "doc").agg(F.array_join(F.array_sort(F.collect_set("texto")), "; ").alias("texto"))
    return M.mentions(figs, paras, "doc", "fig", "num", "pid", "texto", X.is_caption(col("texto")))


@bound("j16_around", f"""with b as ({_BOX}), j as (select f.p_partkey as fig, c.p_partkey as bid, c.y0, c.y1, c.y1 <= f.y0+2 as up, c.y0 >= f.y1-2 and not c.y1 <= f.y0+2 as down from b f join b c on f.p_brand = c.p_brand and f.pag = c.pag and f.p_partkey % 2 = 0 and c.p_partkey % 2 = 1 and c.x0 >= 64)
 select fig, arg_min(bid, (-y1, bid)) filter (where up) as antes, arg_min(bid, (y0, bid)) filter (where down) as despues from j group by 1""")
def j16(spark, d):
    blocks = boxes(spark, d, "b").where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "bid")
    return M.around(boxes(spark, d).where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "fig"), blocks, PAGE, "fig", "bid", F.floor(col("bx0") / 8)).select("fig", "antes", "despues")


@bound("j17_interval_labels", """with g as (select l_orderkey as k, l_linenumber as gid, l_linenumber*40.0::double as c0, l_linenumber*40.0::double + 15 as c1 from lineitem group by 1, 2), s as (select *, coalesce((lag(c1) over w + c0)/2, c0-15) as a, coalesce((c1 + lead(c0) over w)/2, c1+15) as b from g window w as (partition by k order by c0)),
 t as (select l_orderkey as k, l_orderkey*100000 + l_partkey as tid, l_quantity*6.1::double as cx, row_number() over (partition by l_orderkey, l_partkey order by l_suppkey, l_quantity, l_extendedprice) as r from lineitem) select s.k, gid, tid from t join s on t.k = s.k and cx between a and b where r = 1""")
def j17(spark, d):
    from pyspark.sql.window import Window

    li = table(spark, d, "lineitem")
    g = li.select(col("l_orderkey").alias("k"), col("l_linenumber").alias("gid")).distinct().select("k", "gid", (col("gid") * 40.0).alias("c0"), (col("gid") * 40.0 + 15).alias("c1"))
    t = li.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_suppkey", "l_quantity", "l_extendedprice"))).where("r = 1").select(col("l_orderkey").alias("k"), (col("l_orderkey") * 100000 + col("l_partkey")).alias("tid"), (col("l_quantity") * 6.1).alias("cx"))
    return M.interval_labels(g, t, ["k"], "gid", 40.0)


# even parts are bars, every third of them lying; odd parts are numbers; 16 by 10 pixels
_BARS = """b as (select p_brand, p_partkey // 400 as pag, p_partkey as bar, p_size*8.0::double as c0, p_size*8.0::double + 30 as c1, 400.0::double as cerca, (400 - p_partkey*37 % 300)::double as lejos, p_partkey % 3 > 0 as vertical from part where p_partkey % 2 = 0),
 t as (select p_brand, p_partkey // 400 as pag, p_partkey as tid, case when p_partkey % 5 > 0 then p_size*8.0::double + 11 else (400 - p_partkey*31 % 300)::double end as cx, case when p_partkey % 5 > 0 then (400 - p_partkey*31 % 300)::double else p_size*8.0::double + 11 end as cy from part where p_partkey % 2 = 1),
 j as (select b.*, tid, case when vertical then cx else cy end as c, case when vertical then cy else cx end as v, case when vertical then 10 else 16 end as h, abs(lejos - cerca) as largo from b join t on b.p_brand = t.p_brand and b.pag = t.pag),
 k as (select *, case when lejos < cerca then lejos - v else v - lejos end as d from j where c between c0 - 9 and c1 + 9),
 n as (select *, row_number() over (partition by p_brand, pag order by -largo, bar, abs(d), tid) as i from k where d <= 2.5*h and d >= -0.6*largo - h)"""
_GREEDY = """r as (select {keys}, {l}, {r}, i, true as kept, [{l}] as ul, [{r}] as ur from n where i = 1
 union all select {nkeys}, n.{l}, n.{r}, n.i, f.free, case when f.free then list_append(r.ul, n.{l}) else r.ul end, case when f.free then list_append(r.ur, n.{r}) else r.ur end from r join n on {on} and n.i = r.i + 1, lateral (select not list_contains(r.ul, n.{l}) and not list_contains(r.ur, n.{r}) as free) f)"""


@bound("j18_value_labels", f"with recursive {_BARS}, {_GREEDY.format(keys='p_brand, pag', l='bar', r='tid', nkeys='n.p_brand, n.pag', on='n.p_brand = r.p_brand and n.pag = r.pag')} select bar, tid from r where kept")
def j18(spark, d):
    p = table(spark, d, "part").withColumn("pag", F.floor(col("p_partkey") / 400))
    across, along = col("p_size") * 8.0, (400 - col("p_partkey") * 31 % 300).cast("double")
    bars = p.where("p_partkey % 2 = 0").select(*PAGE, col("p_partkey").alias("bar"), across.alias("c0"), (across + 30).alias("c1"), F.lit(400.0).alias("near"), (400 - col("p_partkey") * 37 % 300).cast("double").alias("far"), (col("p_partkey") % 3 > 0).alias("vertical"))
    upright = col("p_partkey") % 5 > 0
    tokens = p.where("p_partkey % 2 = 1").select(*PAGE, col("p_partkey").alias("tid"), F.when(upright, across + 11).otherwise(along).alias("cx"), F.when(upright, along).otherwise(across + 11).alias("cy"), F.lit(16.0).alias("pw"), F.lit(10.0).alias("ph"))
    return M.value_labels(bars, tokens, PAGE, 48.0).select("bar", "tid")


# groups: 20 suppliers and 300 customers each
@bound("j19_one_to_one", f"""with recursive s as (select s_suppkey // 20 as g, s_suppkey, s_acctbal from supplier), t as (select c_custkey // 300 as g, c_custkey, c_acctbal from customer), n as (select s.g, s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) as d, row_number() over (partition by s.g order by abs(s_acctbal - c_acctbal), s_suppkey, c_custkey) as i from s join t on s.g = t.g where abs(s_acctbal - c_acctbal) < 800),
 {_GREEDY.format(keys='g', l='s_suppkey', r='c_custkey', nkeys='n.g', on='n.g = r.g')} select s_suppkey, c_custkey, round(d, 6) as d from (select * from r where kept) join n using (g, s_suppkey, c_custkey)""")
def j19(spark, d):
    s = table(spark, d, "supplier").select(F.floor(col("s_suppkey") / 20).alias("g"), "s_suppkey", "s_acctbal")
    t = table(spark, d, "customer").select(F.floor(col("c_custkey") / 300).alias("g"), "c_custkey", "c_acctbal")
    return M.nearest_pairs(s, t, ["g"], "s_suppkey", "c_custkey", "s_acctbal", "c_acctbal", 800.0).select("s_suppkey", "c_custkey", F.round("d", 6).alias("d"))


@bound("j20_nearest_class", """with e as (select vec_id, embedding[1:3]::double[] as v from embeddings), p(c, w) as (values ('alto', [0.2::double, 0.1, 0.0]), ('bajo', [-0.2::double, -0.1, 0.0]), ('medio', [0.0::double, 0.0, 0.1])),
 d as (select vec_id, c, sqrt(power(v[1]-w[1],2)+power(v[2]-w[2],2)+power(v[3]-w[3],2)) as d from e, p) select vec_id, case when min(d) <= 0.2 then arg_min(c, (d, c)) end as clase, round(min(d), 6) as distancia from d group by 1""")
def j20(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice(col("embedding").cast("array<double>"), 1, 3).alias("v"))
    pal = spark.createDataFrame([("alto", [0.2, 0.1, 0.0]), ("bajo", [-0.2, -0.1, 0.0]), ("medio", [0.0, 0.0, 0.1])], "c string, w array<double>")
    return M.nearest_class(e, pal, "v", "c", "w", 0.2).select("vec_id", "clase", F.round("distancia", 6).alias("distancia"))


@bound("j21_by_position", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when abs(l_quantity/7.0 - round_even(l_quantity/7.0, 0)) <= 0.25 then n_name end as label from lineitem left join nation on n_nationkey = round_even(l_quantity/7.0, 0)::int and n_regionkey = n_nationkey % 5")
def j21(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (col("l_quantity") / 7.0).alias("x"), F.lit(1).alias("g"))
    labels = table(spark, d, "nation").where("n_regionkey = n_nationkey % 5").select(F.lit(1).alias("g"), col("n_nationkey").alias("pos"), col("n_name").alias("label"))
    return M.by_position(li, labels, ["g"], "x").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label")


@bound("j22_nearest_label", f"""with g as (select p_brand, p_partkey as gid, p_retailprice as gx from part where p_partkey % 2 = 0), l as (select p_brand, p_partkey as lid, p_retailprice + 1.3 as lx from part where p_partkey % 2 = 1), j as (select gid, lid, abs(gx-lx) as d from g join l on g.p_brand = l.p_brand where abs(gx-lx) <= 6)
 select g.gid, arg_min(lid, (d, lid)) as lid from g left join j on g.gid = j.gid group by 1""")
def j22(spark, d):
    p = table(spark, d, "part")
    g = p.where("p_partkey % 2 = 0").select("p_brand", col("p_partkey").alias("gid"), col("p_retailprice").alias("gx"))
    lab = p.where("p_partkey % 2 = 1").select("p_brand", col("p_partkey").alias("lid"), (col("p_retailprice") + 1.3).alias("lx"))
    return M.nearest_label(g, lab, ["p_brand"], "gid", 10.0).select("gid", "lid")


# boxes of several sizes in few places, so that some lie in others; strokes: four in a corner and some further off
_NESTED = """b as (select p_brand, p_partkey // 400 as pag, p_partkey, p_size // 17 * 200.0::double as x0, p_partkey*7 % 3 * 300.0::double as y0, p_size // 17 * 200.0::double + 60 + p_partkey*11 % 5*30 as x1, p_partkey*7 % 3 * 300.0::double + 50 + p_partkey*11 % 5*25 as y1, p_partkey % 3 = 0 as keep, case when p_partkey % 11 > 0 then 'Fig. ' || p_size // 17 else ' ' end as caption,
 list_transform(range(0, p_partkey % 7), lambda k: {'x0': p_size // 17 * 200.0::double + 115 + k*5, 'y0': p_partkey*7 % 3 * 300.0::double, 'x1': p_size // 17 * 200.0::double + 118 + k*5, 'y1': p_partkey*7 % 3 * 300.0::double + 9}) as strokes from part),
 q as (select a.p_brand, a.pag, a.p_partkey as i, b.p_partkey as j, case when (a.x1-a.x0)*(a.y1-a.y0) <= (b.x1-b.x0)*(b.y1-b.y0) then a else b end as s, case when (a.x1-a.x0)*(a.y1-a.y0) <= (b.x1-b.x0)*(b.y1-b.y0) then b else a end as l from b a join b b on a.p_brand = b.p_brand and a.pag = b.pag and a.p_partkey < b.p_partkey),
 w as (select *, (s.x1-s.x0)*(s.y1-s.y0) as sa, (l.x1-l.x0)*(l.y1-l.y0) as la from q where greatest(0, least(s.x1, l.x1)-greatest(s.x0, l.x0))*greatest(0, least(s.y1, l.y1)-greatest(s.y0, l.y0)) >= 0.85*(s.x1-s.x0)*(s.y1-s.y0)),
 o as (select w.*, (select count(*) from b where b.p_brand = w.p_brand and b.pag = w.pag and b.p_partkey <> w.i and b.p_partkey <> w.j and greatest(0, least(b.x1, w.l.x1)-greatest(b.x0, w.l.x0))*greatest(0, least(b.y1, w.l.y1)-greatest(b.y0, w.l.y0)) >= 0.85*(b.x1-b.x0)*(b.y1-b.y0)) as thirds from w),
 g as (select *, case when sa >= 0.6*la then s.p_partkey when trim(s.caption) <> '' and trim(s.caption) = trim(l.caption) and thirds = 0 and len(list_filter(l.strokes, lambda t: (t.x1 <= s.x0 or t.x0 >= s.x1 or t.y1 <= s.y0 or t.y0 >= s.y1) and (t.x1-t.x0)*(t.y1-t.y0) < 0.9*la)) <= 3 then l.p_partkey end as gone from o),
 n as (select p_brand, pag, i as a, j as b, case when case when gone = s.p_partkey then s.keep and not l.keep else l.keep and not s.keep end then i + j - gone else gone end as gone, row_number() over (partition by p_brand, pag order by i, j) as i from g where gone is not null)"""


def nested(spark, d):
    x0, y0 = F.floor(col("p_size") / 17) * 200.0, col("p_partkey") * 7 % 3 * 300.0
    stroke = lambda k: F.array(x0 + 115 + k * 5, y0, x0 + 118 + k * 5, y0 + 9)
    many = F.when(col("p_partkey") % 7 > 0, F.transform(F.sequence(F.lit(0), (col("p_partkey") % 7 - 1).cast("int")), stroke)).otherwise(F.array().cast("array<array<double>>"))
    return table(spark, d, "part").select("p_brand", F.floor(col("p_partkey") / 400).alias("pag"), "p_partkey", x0.alias("x0"), y0.alias("y0"), (x0 + 60 + col("p_partkey") * 11 % 5 * 30).alias("x1"), (y0 + 50 + col("p_partkey") * 11 % 5 * 25).alias("y1"), (col("p_partkey") % 3 == 0).alias("keep"), F.when(col("p_partkey") % 11 > 0, F.concat(F.lit("Fig. "), F.floor(col("p_size") / 17).cast("string"))).otherwise(" ").alias("caption"), many.alias("strokes"))


@bound("j23_without_overlaps", f"""with recursive {_NESTED}, r as (select p_brand, pag, 0::bigint as i, []::bigint[] as gone from (select distinct p_brand, pag from b) union all select n.p_brand, n.pag, n.i, case when list_contains(r.gone, n.a) or list_contains(r.gone, n.b) then r.gone else list_append(r.gone, n.gone) end from r join n on n.p_brand = r.p_brand and n.pag = r.pag and n.i = r.i + 1),
 e as (select p_brand, pag, arg_max(gone, i) as gone from r group by 1, 2) select p_partkey from b join e using (p_brand, pag) where not list_contains(gone, p_partkey)""")
def j23(spark, d):
    return M.without_overlaps(nested(spark, d), PAGE, "p_partkey").select("p_partkey")


# the first two that are near become one, until none are
@bound("j25_united_boxes", f"""with recursive q as ({_BOX}), r as (select p_brand, pag, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} order by p_partkey) as b, 0 as it from q group by 1, 2
 union all select r.p_brand, r.pag, list_append(list_filter(r.b, lambda v, k: k <> m.i and k <> m.j), {{'x0': least(r.b[m.i].x0, r.b[m.j].x0), 'y0': least(r.b[m.i].y0, r.b[m.j].y0), 'x1': greatest(r.b[m.i].x1, r.b[m.j].x1), 'y1': greatest(r.b[m.i].y1, r.b[m.j].y1)}}), it + 1
 from r, lateral (select min(i) as i, arg_min(j, (i, j)) as j from range(1, len(r.b) + 1) s(i), range(1, len(r.b) + 1) t(j) where i < j and r.b[i].x0 - 15 <= r.b[j].x1 and r.b[j].x0 - 15 <= r.b[i].x1 and r.b[i].y0 - 15 <= r.b[j].y1 and r.b[j].y0 - 15 <= r.b[i].y1) m where m.i is not null),
 e as (select p_brand, pag, list_sort(arg_max(b, it)) as b from r group by 1, 2) select p_brand, pag, k::bigint as n, b[k + 1].x0 as x0, b[k + 1].y0 as y0, b[k + 1].x1 as x1, b[k + 1].y1 as y1 from e, lateral (select unnest(range(0, len(e.b))) as k)""")
def j25(spark, d):
    return M.united_boxes(boxes(spark, d), PAGE, "p_partkey")


@bound("j26_known_hashes", "select doc_id from documents where md5(text) not in (select md5(text) from documents where doc_id % 7 = 3)")
def j26(spark, d):
    h = docs(spark, d).select("doc_id", F.md5("text").alias("hash"))
    return M.missing_elsewhere(h, h.where("doc_id % 7 = 3"), ["hash"]).select("doc_id")


@bound("j13_series_design", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name as textura from lineitem left join nation on n_nationkey = l_linenumber - 1 and n_regionkey < 3")
def j13(spark, d):
    design = table(spark, d, "nation").where("n_regionkey < 3").select((col("n_nationkey") + 1).alias("l_linenumber"), col("n_name").alias("textura"))
    return table(spark, d, "lineitem").join(design, "l_linenumber", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "textura")


@bound("s4_blocks", r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as h from documents where length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0")
def s4(spark, d):
    from lodestar.sources.blocks import clean_blocks

    return clean_blocks(docs(spark, d), "text").select("doc_id", F.md5("text").alias("h"))
