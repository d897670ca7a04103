"""Text rules that parse (P8, P28, X2, X6, X7, X10) on whole documents and on odd texts around their beginnings; the SQL parses the same texts in its own way. Texts are made by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import bound, table
from lodestar.functions import columns as C
from lodestar.functions import text as X
from lodestar.operators import matching as M

col = F.col

#: A text's beginning on one line, and a number.
_H, _N = "translate(substr(text, 1, 60), chr(9) || chr(10) || chr(13), '   ')", "cast(doc_id % 977 as varchar(9))"


def texts(*odd: str) -> str:
    """A case for each odd text, by the document's id; every fourth document is whole."""
    cases = " ".join(f"when {k} then {t}" for k, t in enumerate(odd))
    return f"case when doc_id % 4 = 3 then text else case cast(floor(doc_id / 4) as bigint) % {len(odd)} {cases} end end"


def made(spark, d, expression: str):
    return table(spark, d, "documents").select("doc_id", F.expr(expression).alias("c"))


_TICKS = texts(f"'Eje vertical (Unidades: miles): ' || {_N} || '.'", f"'Eje x: 10:' || {_N}", f"'Categoría, abreviada con la letra B: a: ' || {_H}", f"'EJE Y : ' || {_N} || ',5 % . '", f"' eje horizontal (a (b)) : ' || {_H}", f"'Eje vertical: −' || {_N}", f"'categoria abreviado con  la letra Q7:' || {_H}", f"'Eje x (sin cierre: ' || {_N}", f"'Eje de ordenadas: ' || {_N}", f"'Eje y:' || {_N} || '..'", "'Categoría abreviada con la letra C'", f"'Eje x10: ' || {_N}", f"'Categorías, abreviada con la letra B: ' || {_H}", f"'Eje x(' || {_H}", f"'eje y (' || {_H} || '): 1'")


@bound("p8_spoken_tick", rf"""with t as (select doc_id, {_TICKS} as c from documents), w as (select *, string_split_regex(ltrim(c, chr(32) || chr(9) || chr(10) || chr(13)), '\s+') as w, ltrim(regexp_replace(c, '^\s*\pL+\s+\pL+', '')) as after from t),
 p as (select *, lower(w[1]) as one, lower(regexp_extract(coalesce(w[2], ''), '^\pL+')) as two, length(regexp_extract(after, '^\(.*\)[ ]*:')) as noted from w), q as (select *, case when noted > 0 then substr(after, noted + 1) when after[1] = ':' then after[2:] end as said from p where not contains(c, chr(10))),
 s as (select *, case when trim(said) = '.' then '.' when right(trim(said), 1) = '.' then rtrim(left(trim(said), length(trim(said)) - 1)) else trim(said) end as v from q), n as (select *, case when left(v, 1) in ('-', '+', '−') then v[2:] else v end as u from s),
 m as (select *, case when right(u, 1) = '%' then u[:-2] else u end as z from n), k as (select *, strpos(c, ':') as colon from t where not contains(c, chr(10))), l as (select *, string_split(trim(regexp_replace(regexp_replace(left(c, colon - 1), '^(\s*\pL+),', '\1 '), '\s+', ' ', 'g')), ' ') as h, trim(substr(c, colon + 1)) as v from k where colon > 0),
 a as (select doc_id, v || '. Marca del eje ' || case when two in ('x', 'horizontal') then 'horizontal' else 'vertical' end || '.' as texto from m where one = 'eje' and two in ('x', 'y', 'horizontal', 'vertical') and v <> '' and (noted > 0 or (z <> '' and z[1] between '0' and '9' and translate(z, '0123456789., ', '') = ''))),
 b as (select doc_id, case when v = '.' then v when right(v, 1) = '.' then rtrim(left(v, length(v) - 1)) else v end || '. Letra ' || h[6] || '.' as texto from l where len(h) = 6 and list_transform(h[1:5], lambda x: lower(replace(x, 'í', 'i'))) in (['categoria', 'abreviada', 'con', 'la', 'letra'], ['categoria', 'abreviado', 'con', 'la', 'letra']) and v <> '')
 select t.doc_id, md5(coalesce(a.texto, b.texto, c)) as texto from t left join a using (doc_id) left join b using (doc_id)""")
def p8(spark, d):
    return made(spark, d, _TICKS).select("doc_id", F.md5(C.spoken_tick(col("c"))).alias("texto"))


_TITLES = texts("'Documento' || " + _N, f"'tesis_final_v' || {_N} || '.docx'", f"'Microsoft Word - ' || {_H} || '.docx'", "'slide ' || " + _N, "'SLIDE' || " + _N, "'Sin  Título'", "'Presentacíon de PowerPoint'", "'Presentación de powerpoint.pptx'", "'abc'", "'12 34'", f"'Microsoft PowerPoint - ' || {_H}", _H, "'microsoft word'", "'Un a b c'")


@bound("p28_generic_title", rf"""with t as (select doc_id, trim(regexp_replace({_TITLES}, '\s+', ' ', 'g')) as a from documents), b as (select doc_id, case when starts_with(lower(a), 'microsoft word - ') then a[18:] else a end as a from t), c as (select doc_id, case when starts_with(lower(a), 'microsoft powerpoint - ') then a[24:] else a end as a from b),
 e as (select doc_id, a, list_filter(['doc', 'docx', 'pdf', 'tex', 'odt', 'ppt', 'pptx'], lambda x: ends_with(lower(a), '.' || x)) as x from c), f as (select doc_id, case when len(x) > 0 then left(a, length(a) - length(x[1]) - 1) else a end as v from e), g as (select *, translate(lower(v), 'íó', 'io') as p from f)
 select doc_id, case when length(v) >= 4 and regexp_matches(v, '\pL\pL\pL') and not list_contains(['untitled', 'sin titulo', 'titulo', 'presentacion de powerpoint', 'powerpoint presentation', 'microsoft word'], p) and rtrim(p, '0123456789') not in ('documento', 'document') and not (starts_with(p, 'slide ') and rtrim(p, '0123456789') = 'slide ' and p <> 'slide ')
 and (contains(v, ' ') or not (contains(v, '_') or contains(v, '.'))) then md5(v) end as titulo from g""")
def p28(spark, d):
    return made(spark, d, _TITLES).select("doc_id", F.md5(X.generic_title(col("c"))).alias("titulo"))


_EDGES = texts(f"'gu e ' || {_H} || ' >'", f"'ω ab ' || {_H}", f"'x y Z of the ' || {_H}", f"' - ' || {_H} || ' ' || {_H} || ' ;'", "'a b'", "'ab cd'", f"'Ωω ñ é to ' || {_H}", "'of SPEED'", "'ǅ a b c'", "'1a b! q. cd ef'", "'Time (min) Time (min)'", "'of in'", f"'ªb ' || {_H}")
_SHORT, _ALONE = ("de", "la", "el", "en", "un", "of", "in", "to", "on", "by", "at", "an", "vs", "per", "and", "the"), ("a", "e", "o", "y", "u", "x", "i")
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
# how many leading words of l go by a rule, if so many must stay
_GONE = lambda rule, stay: f"least(coalesce(list_min([i - 1 for i in range(1, len(l) + 1) if not ({rule})]), len(l)), greatest(len(l) - {stay}, 0))"


_LONE = r"length(l[i]) = 1 and regexp_matches(l[i], '[\p{Ll}ªº]')"
_STRAY = rf"length(l[i]) <= 2 and not list_contains({_LIST((*_SHORT, *_ALONE))}, l[i]) and regexp_matches(l[i], '[\p{{Ll}}ªº]') and not regexp_matches(l[i], '[\p{{Lu}}\p{{Lt}}]')"
_LINK = f"list_contains({_LIST(_SHORT)}, l[i])"


@bound("x2_clean_edges", rf"""with t as (select doc_id, trim(regexp_replace(regexp_replace(translate(replace(replace(replace(replace(replace(replace({_EDGES}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(160), ' '), chr(8203) || chr(173), ''), '([a-záéíóúñ])- ([a-záéíóúñ])', '\1\2', 'g'), '\s+', ' ', 'g')) as c from documents),
 a as (select doc_id, string_split(trim(c, ' -—–_|•■●▪*>~=.,;:'), ' ') as l from t),
 b as (select doc_id, l[1 + {_GONE(_STRAY, 2)}:] as l from a),
 c as (select doc_id, l[1 + {_GONE(_LONE, 2)}:] as l from b), e as (select doc_id, l[1 + {_GONE(_LINK, 1)}:] as l from c)
 select doc_id, md5(array_to_string(case when len(l) % 2 = 0 and l[1:len(l)//2] = l[len(l)//2 + 1:] then l[1:len(l)//2] else l end, ' ')) as limpio from e""")
def x2(spark, d):
    return made(spark, d, _EDGES).select("doc_id", F.md5(X.clean_edges(col("c"))).alias("limpio"))


_CAPTIONS = texts(f"'Fig. ' || {_N} || ': ' || {_H}", f"' Gráfico nº ' || {_N} || 'b - ' || {_H}", f"'Figura IV. ' || {_H}", f"'Figura. ' || {_N} || ' algo'", f"'Figure. ' || {_N}", f"'Figuras. ' || {_N}", f"'FIGS.' || {_N} || 'ab'", f"'Ilustración n.' || {_N}", "'chart ivy'", "'diagrama xi_'", f"'Imagen. ' || {_N}", f"'graficas N° ' || {_N} || 'Z.'", f"'figurar ' || {_N}", "'FigIX b'", _H)


@bound("x6_caption", rf"""with t as (select doc_id, ltrim({_CAPTIONS}, ' ' || chr(9) || chr(10) || chr(13)) as c from documents), k as (select doc_id, c, translate(lower(c), 'áó', 'ao') as p from t),
 w as (select *, case when starts_with(p, 'figura') or starts_with(p, 'figure') then 6 when starts_with(p, 'fig') then 3 end as f, case when starts_with(p, 'grafico') or starts_with(p, 'grafica') then 7 end as g, case when starts_with(p, 'ilustracion') then 11 when starts_with(p, 'diagrama') then 8 when starts_with(p, 'imagen') then 6 when starts_with(p, 'chart') then 5 end as o from k),
 s as (select *, coalesce(f, g) + (substr(p, coalesce(f, g) + 1, 1) = 's')::int as fg from w), n as (select *, case when f is not null then fg + (substr(p, fg + 1, 1) = '.')::int when g is not null then fg else o end as n from s),
 r as (select *, regexp_replace(substr(c, n + 1), '^\s+', '') as r from n), u as (select *, case when lower(r[1]) = 'n' and r[2] in ('°', 'º', '.') then regexp_replace(r[3:], '^\s+', '') else r end as u from r), v as (select *, regexp_extract(u, '^[\pL\pN\pM_]+') as v from u),
 x as (select *, v <> '' and (trim(lower(v), 'ivx') = '' or (v[1] between '0' and '9' and (ltrim(v, '0123456789') = '' or regexp_matches(ltrim(v, '0123456789'), '^[A-Za-z]\z')))) as ok from v)
 select doc_id, case when ok then lower(left(c, n)) else '' end as tipo, case when ok then v else '' end as numero from x""")
def x6(spark, d):
    kind, number = X.caption_parts(col("c"))
    return made(spark, d, _CAPTIONS).select("doc_id", kind.alias("tipo"), number.alias("numero"))


_CITES = f"text || ' (Fig. ' || {_N} || ', figs. 2-4; FIGURA 5.1 – 6, figuras3- 8 fig) Figure 10-40 figure12–' || {_N} || {_H}"


@bound("x7_cited_figures", rf"""with m as (select doc_id, unnest(regexp_extract_all(lower({_CITES}), '\b(?:figur[ae]|fig)s?\.?\s*[0-9]+(?:\.[0-9]+)?(?:\s*[-–]\s*[0-9]+)?')) as m from documents), p as (select doc_id, regexp_extract_all(m, '[0-9]+(?:\.[0-9]+)?') as l, regexp_matches(m, '[0-9]\s*[-–]') as going from m),
 q as (select doc_id, l[1] as a, case when going then try_cast(regexp_extract(l[2], '^[0-9]+') as int) end as z from p), r as (select doc_id, case when z > try_cast(a as int) and z - try_cast(a as int) < 20 and not contains(a, '.') then list_transform(range(a::int, z + 1), lambda n: n::varchar) else [a] end as l from q), s as (select doc_id, unnest(l) as n from r)
 select doc_id, string_agg(distinct n, ',' order by n) as citas from s group by 1""")
def x7(spark, d):
    return made(spark, d, _CITES).select("doc_id", F.array_join(M.cited_numbers(col("c")), ",").alias("citas"))


_SPOKEN = f"'Figs. ' || {_N} || ' y Fig 7: xFig. 3 Fig.4 fig. 5 Fig. x ' || text || case doc_id % 3 when 0 then ' ' when 1 then '…  ' else ' fin?' end"


@bound("x10_spoken", rf"""with t as (select doc_id, trim(regexp_replace(regexp_replace({_SPOKEN}, '\bFigs?\.\s*([0-9])', 'Figura \1', 'g'), '\bFig\s+([0-9])', 'Figura \1', 'g')) as c from documents) select doc_id, md5(case when c = '' or right(c, 1) in ('.', '!', '?', '…') then c else c || '.' end) as dicho from t""")
def x10(spark, d):
    return made(spark, d, _SPOKEN).select("doc_id", F.md5(X.spoken(col("c"))).alias("dicho"))
