"""Scratch space in the folder that driver and executors share, removed when the driver ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that are still there, with the Hadoop file system that has them.
_held: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset and Spark runs in this process (tests) a local folder is made; on a cluster its absence is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, kind: str = "lodestar") -> str:
    """A path of its own, gone when the driver ends, or before by remove()."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(_remove_all)
    _held[path] = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes what scratch() named, once nothing reads it any more."""
    _held.pop(path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, read again: the lineage ends there. scratch_path names it for remove()."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _remove_all() -> None:
    from pyspark import SparkContext

    for path, files in _held.items():
        try:
            files.delete(SparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder is scratch
            return
