"""File sources and exports on small files."""

import json

from pyspark.sql import functions as F

from lodestar.operators.rates import target_summary
from lodestar.sources import files as S

HEAD = "tipo,id,serie,x1_mm,y1_mm,x2_mm,y2_mm,valor_x,valor_y,tendencia,texto"


def write(path, name, text, encoding="utf-8"):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding=encoding)


def test_element_tables(spark, tmp_path):
    write(tmp_path, "a.csv", "﻿# Título: Prueba\n" + HEAD + '\npunto,p1,s,"1,5",2,,,3,4,,"uno, dos"\n\ncurva,c1,s,0,0,10,5,,,aumento,\npunto,p2,s,x,2,,,,,,\n')
    write(tmp_path, "b.csv", HEAD.replace(",", ";").replace("serie", "Sérié") + "\npunto;p1;s;1,5;2;;;3;4;;a\neje;e;;0;0;9;0;;;;b\n")
    write(tmp_path, "c.csv", HEAD + "\n")
    write(tmp_path, "d.csv", HEAD + "\neje,e,,0,0,9,0,,,,b\ntexto,t,,0,0,9,0,,,,b\n")
    rows, rejects = S.read_elements(spark, str(tmp_path))
    got = {(r["file"][-5:], r["id"]): r for r in rows.collect()}
    assert set(got) == {("a.csv", "p1"), ("a.csv", "c1"), ("b.csv", "p1"), ("b.csv", "e")}
    assert got["a.csv", "p1"]["x1_mm"] == got["b.csv", "p1"]["x1_mm"] == 1.5 and got["a.csv", "p1"]["texto"] == "uno, dos"
    assert got["b.csv", "p1"]["serie"] == "s"
    assert {(r["file"][-5:], r["reason"].split(":")[0]) for r in rejects.collect()} == {("a.csv", "no es numero"), ("c.csv", "corto"), ("d.csv", "sin datos")}


def test_point_tables(spark, tmp_path):
    write(tmp_path, "p.csv", "#titulo: Ventas\n#unidad = soles\nMes,x,y,Value\nEne,0,10,5\nFeb,100,20,\"7,5\"\n")
    pts, charts = S.read_points(spark, str(tmp_path))
    assert [(r["etiqueta"], r["valor"]) for r in pts.orderBy("n").collect()] == [("Ene", 5.0), ("Feb", 7.5)]
    c = charts.first()
    assert (c["titulo"], c["unidad"], c["x0"], c["x1"], c["y0"], c["y1"]) == ("Ventas", "soles", -10.0, 110.0, 0.0, 30.0)


def test_sessions_to_rates(spark, tmp_path):
    trial = {"objetivo": "p1", "zona": "aislado", "frames": 9, "seleccionado": "p1", "acierto_estricto": True, "acierto_serie": True, "error_mm": 2.0}
    write(tmp_path / "placa1", "a.json", json.dumps({"prueba": "objetivos", "fecha": "2026-01-01", "detalle": [trial, trial | {"acierto_estricto": False, "seleccionado": None, "error_mm": 4.0}, trial | {"frames": 0}]}, indent=1))
    write(tmp_path / "placa1", "b.json", "{ not json")
    s = S.read_sessions(spark, str(tmp_path / "*"))
    assert [r["placa"] for r in s.collect()] == ["placa1"]
    t = s.select("placa", F.explode("detalle").alias("d")).select("placa", "d.*")
    r = target_summary(t, ["placa"], "frames", "acierto_estricto", "acierto_serie", "seleccionado", "error_mm").first()
    assert (r["intentos"], r["acierto_pct"], r["sin_seleccion_pct"], r["error_mediana"]) == (2, 50.0, 50.0, 3.0)


def test_file_hashes(spark, tmp_path):
    write(tmp_path / "x", "a.bin", "same")
    write(tmp_path / "y", "b.bin", "same")
    rows = S.scan_files(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and len({r["md5"] for r in rows}) == 1 and {r["length"] for r in rows} == {4}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("c1", 2, "punto", "p", "s", 1.00004, 2.0, None, None, 1.0, 2.0, None, "t"), ("c1", 1, "placa", "", "", 0.0, 0.0, 9.0, 9.0, None, None, None, "")], "chart string, n int, " + ", ".join(f"{c} {'double' if c.endswith('_mm') or c.startswith('valor') else 'string'}" for c in S.ELEMENTS))
    S.write_elements(df, str(tmp_path / "out"), "chart")
    lines = next((tmp_path / "out" / "chart=c1").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(S.ELEMENTS) and lines[1].startswith("placa") and lines[2].startswith("punto,p,s,1.0,")
    reading = spark.sql("""select 1L as id, 'una curva' as resumen, array('ajuste') as avisos, array(named_struct('nombre', 'x', 'x1', 0.0D, 'y1', 9.0D, 'x2', 9.0D, 'y2', 9.0D, 'escala', 'log')) as ejes,
     array(named_struct('x', 1.0D, 'y', 2.0D, 'ancho', 3.0D, 'alto', 4.0D, 'texto', 'a')) as textos, array(named_struct('serie', 's', 'puntos', array(named_struct('px', 1.0D, 'py', 2.0D, 'valor_x', 3.0D, 'valor_y', 4.0D)))) as curvas,
     array(named_struct('serie', 'b', 'x1', 1.0D, 'y1', 2.0D, 'x2', 3.0D, 'y2', 4.0D, 'valor', 5.0D, 'categoria', 'c')) as barras""")
    rows = {r["tipo"]: r for r in S.reading_rows(reading, "id").collect()}
    assert sorted(rows) == ["advertencia", "barra", "curva", "eje", "resumen", "texto"] and list(rows["eje"].asDict())[1:] == list(S.READING)
    assert rows["barra"]["valor_y"] == 5.0 and rows["eje"]["descripcion"] == "log" and rows["texto"]["ancho_px"] == 3.0 and rows["curva"]["elemento"] == "s:0"
    pts = spark.range(100).selectExpr("1L as k", "'s' as serie", "cast(id as double) as x", "cast(id * id as double) as y")
    doc = json.loads(S.plate_documents(pts, "k", "serie", "x", "y", 10).first()["json"])
    assert len(doc["series"][0]["valores"]) == 10 and doc["series"][0]["y_max"] == 9801.0
