"""Tables that a plan computes once: Parquet below spark.checkpoint.dir, which driver and executors share.

They cut long lineages, survive lost executors and keep later plans small.
Only in local mode may the session name no such folder; a temporary one is used then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = shared.rstrip("/") if shared else f"file://{tempfile.mkdtemp(prefix='barlace-')}"
        _ROOTS[app] = f"{base}/barlace-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again; it stays until the session ends."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone, and with it the folder's owner
        return
