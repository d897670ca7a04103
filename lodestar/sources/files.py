"""Files: chart and point tables, session documents, content hashes, exports. Everything is read and parsed by tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.columns import header_key, parse_number
from lodestar.operators.spatial import dealt, once
from lodestar.sources.scratch import written

#: Fixed columns of an element table.
ELEMENTS = ("tipo", "id", "serie", "x1_mm", "y1_mm", "x2_mm", "y2_mm", "valor_x", "valor_y", "tendencia", "texto")
#: Fixed names that a point table's columns may have.
ALIASES = {"etiqueta": ("etiqueta", "nombre", "punto", "mes", "label", "categoria"), "x": ("x",), "y": ("y",), "valor": ("valor", "value", "v"), "info": ("info", "detalle", "nota")}


def _tables(spark: SparkSession, paths) -> DataFrame:
    """(file, notes, data): the lines (n, line) of each file that begin with "#" and the others, without a byte order mark and blank lines; n is the line's number in its file. However many steps read them, the files are listed and opened once."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    numbered = F.transform(F.split("text", r"\r?\n"), lambda line, i: F.struct(i.alias("n"), line.alias("line")))
    lines = dealt(text, "file").select("file", F.filter(numbered, lambda x: F.trim(x["line"]) != "").alias("_all"))
    note = lambda x: F.ltrim(x["line"]).startswith("#")
    return written(lines.select("file", F.filter("_all", note).alias("notes"), F.filter("_all", lambda x: ~note(x)).alias("data")))


def _cells(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, n, names, cells) of data lines and (file, key, value) of "#key: value" lines. A file's delimiter is the one that its header line has more of."""
    noted = tables.select("file", F.inline("notes")).withColumn("_at", F.array_min(F.filter(F.array(F.instr("line", ":"), F.instr("line", "=")), lambda p: p > 0)))
    key = F.ltrim(F.substring(F.ltrim(F.substring("line", F.lit(1), F.col("_at") - 1)), F.lit(2), F.col("_at")))
    # a note without a name is none
    meta = noted.where(F.length(F.trim(key)) > 0).select("file", header_key(key).alias("key"), F.trim(F.substring("line", F.col("_at") + 1, F.length("line"))).alias("value"))
    count = lambda c: F.length("_head") - F.length(F.replace("_head", F.lit(c), F.lit("")))
    split = lambda c: F.when(F.col("_sep") == ";", _csv(c, ";")).otherwise(_csv(c, ","))
    head = tables.select("*", F.size("data").alias("_lines"), F.get("data", F.lit(0))["line"].alias("_head")).withColumn("_sep", F.when(count(";") > count(","), ";").otherwise(","))
    named = head.withColumn("names", F.transform(split("_head"), header_key)).withColumn("_rest", F.slice("data", F.lit(2), F.greatest(F.col("_lines") - 1, F.lit(0))))
    rest = named.select("file", "_lines", "_sep", "names", F.inline("_rest"))
    return rest.select("file", "n", "_lines", "names", split("line").alias("cells")), meta


def _csv(c: str, sep: str) -> Column:
    """Cells of a line; quoted cells may hold the separator."""
    cell = rf'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'
    return F.transform(F.regexp_extract_all(c, F.lit(cell), F.lit(1)), lambda x: F.trim(F.when(x.rlike('^".*"$'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)))


def _named(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    get = lambda a: F.nullif(F.get("cells", F.array_position("names", F.lit(a)).cast("int") - 1), F.lit(""))
    safe = lambda a: F.when(F.array_contains("names", a), get(a))
    return df.select("file", "n", "_lines", "names", *(F.coalesce(*(safe(a) for a in options)).alias(c) for c, options in names.items()))


def read_elements(spark: SparkSession, paths, most: int = 3000) -> tuple[DataFrame, DataFrame]:
    """(elements, rejects). Many chart tables, one row for each element; rejects: (file, n, reason), n null where the whole file is refused."""
    tables = _tables(spark, paths)
    cells, _ = _cells(tables)
    rows = _named(cells, {c: (c, c.removesuffix("_mm")) for c in ELEMENTS})
    nums = [c for c in ELEMENTS if c.endswith("_mm") or c.startswith("valor")]
    typed = rows.withColumns({f"_bad_{c}": F.col(c).isNotNull() & parse_number(F.col(c)).isNull() for c in nums}).withColumns({c: parse_number(F.col(c)) for c in nums})
    w = Window.partitionBy("file")
    bad = F.array_compact(F.array(*(F.when(F.col(f"_bad_{c}"), F.lit(c)) for c in nums)))
    has = F.count_if(F.col("tipo").isin("punto", "curva", "tramo", "barra")).over(w)
    why = F.when(F.col("_lines") < 3, "corto").when(~F.array_contains("names", "tipo") | ~F.array_contains("names", "x1_mm"), "faltan columnas").when(has == 0, "sin datos").when(has > most, "demasiados")
    checked = typed.withColumn("_file_why", why).withColumn("_row_why", F.when(F.size(bad) > 0, F.concat(F.lit("no es numero: "), F.array_join(bad, ","))))
    short = tables.where(F.size("data").between(1, 2)).select("file", F.lit(None).cast("int").alias("n"), F.lit("corto").alias("reason"))
    files = checked.where("_file_why is not null and _lines >= 3").select("file", F.lit(None).cast("int").alias("n"), F.col("_file_why").alias("reason")).distinct()
    row = checked.where("_file_why is null and _row_why is not null").select("file", "n", F.col("_row_why").alias("reason"))
    return checked.where("_file_why is null and _row_why is null").select("file", "n", *ELEMENTS), short.unionByName(files).unionByName(row)


def read_points(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(points, charts). Point tables with several names for a column; charts has the "#" lines as columns and the axis ranges, by default the points' with a margin of 8 % (at least 10)."""
    cells, meta = _cells(_tables(spark, paths))
    pts = _named(cells, ALIASES)
    for c in ("x", "y", "valor"):
        pts = once(pts.withColumnRenamed(c, "_text").withColumn("_number", parse_number(F.col("_text"))), **{c: F.col("_number")}).drop("_text", "_number")
    pts = pts.select("file", "n", "etiqueta", "x", "y", "valor", "info").where("x is not null and y is not null")
    told = meta.groupBy("file").pivot("key", ["titulo", "unidad", "origen_x", "origen_y", "ancho", "alto"]).agg(F.first("value"))
    ext = pts.groupBy("file").agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))
    pad = lambda c: F.greatest(F.lit(10.0), 0.08 * (F.col(f"max_{c}") - F.col(f"min_{c}")))
    charts = ext.join(told, "file", "left").select("file", "titulo", "unidad", *(x for c in ("x", "y") for x in ((F.coalesce(parse_number(F.col(f"origen_{c}")), F.col(f"min_{c}") - pad(c))).alias(f"{c}0"), (F.col(f"max_{c}") + pad(c)).alias(f"{c}1"))))
    return pts, charts


SESSION = "prueba string, placa string, fecha string, version string, condiciones map<string,string>, metricas map<string,string>, detalle array<struct<objetivo:string,tipo:string,clase:string,serie:string,zona:string,frames:bigint,seleccionado:string,acierto_estricto:boolean,acierto_serie:boolean,error_mm:double,sesgo_mm:array<double>,jitter_mm:double,pinza_pct:double,mano_pct:double,t_primer_acierto_ms:double,cambios_sel:bigint,cambios_crudo:bigint,acierto_crudo:boolean>>, _corrupt_record string"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """S3: session documents; unreadable files are left out; the plate is named in the file, else by its folder."""
    raw = spark.read.schema(SESSION).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    named = raw.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return named.where("_corrupt_record is null").withColumn("placa", F.coalesce("placa", "_folder")).drop("_corrupt_record", "_folder")


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size, time and hash of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"))


#: Fixed order of kinds in an element export.
RANKS = {"placa": 0, "descripcion": 1, "serie": 2, "punto": 3, "curva": 4}


def element_rows(df: DataFrame) -> DataFrame:
    """The rows of an export, in order: plate, description, series, points, curves, the rest; numbers to 4 decimals."""
    rank = F.coalesce(*(F.when(F.col("tipo") == k, F.lit(v)) for k, v in RANKS.items()), F.lit(9))
    return df.select(*(F.bround(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).withColumn("_r", rank)


#: For a write of many small files: each task moves its own (the driver else moves all, one after another); on a local disk no checksum file lies beside each, for which Hadoop starts more processes to set its rights.
SMALL = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def in_folders(df: DataFrame, part: str, *order: str):
    """A writer of a folder with one file for each value of part, its rows in order. As many tasks as a shuffle has write, however small the rows are; names are the same when a task is repeated."""
    rows = dealt(df, part)
    rows = rows.sortWithinPartitions(part, *order) if order else rows
    return rows.select(*(c for c in df.columns if c not in order or c == part)).write.partitionBy(part).options(**SMALL)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A file for each row's text, in as many folders as a shuffle has tasks: a folder for each file takes longer to make and to list than the file."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("part"), key, F.col(text).alias("value"))
    dealt(rows, "part").sortWithinPartitions("part", key).select("part", "value").write.partitionBy("part").options(**SMALL).option("maxRecordsPerFile", 1).text(path)


def write_elements(df: DataFrame, path: str, part: str) -> None:
    """A folder of CSV for each chart; each chart's rows are sorted within one file."""
    in_folders(element_rows(df).select(part, *ELEMENTS, "_r", "n"), part, "_r", "n").option("header", True).option("emptyValue", "").option("escape", "\"").csv(path)


#: Fixed columns of a reading export.
READING = ("tipo", "elemento", "x1", "y1", "x2", "y2", "ancho_px", "alto_px", "valor_x", "valor_y", "texto", "descripcion")


def reading_rows(df: DataFrame, key: str) -> DataFrame:
    """A nested reading as long rows (key, READING). df: key, resumen (string), avisos (array of strings), ejes (array of nombre, x1, y1, x2, y2, escala), textos (array of x, y, ancho, alto, texto), curvas (array of serie and puntos: px, py, valor_x, valor_y), barras (array of serie, x1, y1, x2, y2, valor, categoria)."""

    def rows(kind: str, given: DataFrame, **named: Column) -> DataFrame:
        kinds = {c: "double" if c not in ("tipo", "elemento", "texto", "descripcion") else "string" for c in READING}
        return given.select(key, *((F.lit(kind) if c == "tipo" else named[c] if c in named else F.lit(None)).cast(kinds[c]).alias(c) for c in READING))

    each = lambda c: df.select(key, F.posexplode(c).alias("i", "v"))
    v, i = (lambda f: F.col(f"v.{f}")), F.col("i").cast("string")
    corners = {c: v(c) for c in ("x1", "y1", "x2", "y2")}
    points = each("curvas").select(key, F.col("v.serie").alias("serie"), F.posexplode("v.puntos").alias("i", "v"))
    parts = [
        rows("resumen", df.where("resumen is not null"), texto=F.col("resumen")),
        rows("advertencia", each("avisos"), elemento=i, texto=F.col("v")),
        rows("eje", each("ejes"), elemento=v("nombre"), descripcion=v("escala"), **corners),
        rows("texto", each("textos"), elemento=i, x1=v("x"), y1=v("y"), ancho_px=v("ancho"), alto_px=v("alto"), texto=v("texto")),
        rows("curva", points, elemento=F.concat_ws(":", "serie", i), x1=v("px"), y1=v("py"), valor_x=v("valor_x"), valor_y=v("valor_y")),
        rows("barra", each("barras"), elemento=v("serie"), valor_y=v("valor"), texto=v("categoria"), **corners),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plate_documents(points: DataFrame, key: str, series: str, x: str, y: str, most: int = 40, about: DataFrame | None = None) -> DataFrame:
    """(key, json): for each plate one document: its series with thinned values and extremes, its axes' ranges and, of about (key, contexto, leyenda), the context and the legend."""
    from lodestar.operators.rates import extremes
    from lodestar.operators.series import thinned

    few = thinned(points, [key, series], x, most).groupBy(key, series).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("valores"))
    full = few.join(extremes(points, [key, series], x, y), [key, series])
    one = F.struct(F.col(series).alias("serie"), "valores", "y_max", "x_max", "y_min", "x_min")
    axes = points.groupBy(key).agg(F.struct(*(F.struct(F.min(c).alias("min"), F.max(c).alias("max")).alias(n) for n, c in (("x", x), ("y", y)))).alias("ejes"))
    docs = full.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("series")).join(axes, key)
    docs = docs.join(about.select(key, "contexto", "leyenda"), key, "left") if about is not None else docs.withColumns({"contexto": F.lit(None).cast("string"), "leyenda": F.lit(None).cast("string")})
    return docs.select(key, F.to_json(F.struct("series", "ejes", "contexto", "leyenda")).alias("json"))
