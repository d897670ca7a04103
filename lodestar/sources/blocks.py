"""Text blocks made upstream, and S9: relational tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, text string, size double"
ACCOUNTS = "id bigint, rol string, correo string, nombre string, codigo string, clave_hash string, revisor_id bigint, imprenta_id bigint, creado_en timestamp"
REQUESTS = "id bigint, alumno_id bigint, revisor_id bigint, imprenta_id bigint, estado string, estado_imprenta string, rechazo string, figuras_json string, creado_en timestamp, actualizado_en timestamp"
PLATES = "token string, datos_json string, creado_en timestamp"
FIGURES = "array<struct<archivo:string,titulo:string,error:string,correccion_id:string,quitada:boolean,revisada:boolean>>"


def clean_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """White space collapsed, empty blocks dropped."""
    return df.withColumn(text, F.trim(F.regexp_replace(text, r"\s+", " "))).where(F.length(text) > 0)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return clean_blocks(spark.read.schema(BLOCKS).parquet(path))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A relational table exported as parquet."""
    return spark.read.schema(schema).parquet(path)
