"""Intermediate tables that are computed once and read more than once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not held and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = held or _made(spark)
    return folder


def _made(spark: SparkSession) -> str:
    """One temporary folder a session, removed when the driver ends."""
    me = spark.sparkContext.applicationId
    if me not in _FOLDERS:
        _FOLDERS[me] = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, _FOLDERS[me], ignore_errors=True)
    return _FOLDERS[me]


_FOLDERS: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder and read back, so that no executor's loss recomputes it. It is there until discard(), or until the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a table of written(), which nothing that is still to be computed reads."""
    _remove(table.sparkSession, table._written)
