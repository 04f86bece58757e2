"""Intermediate tables in the folder that a cluster shares."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def _own(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        top = "file://" + _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="strandset-"))
    return f"{top.rstrip('/')}/strandset-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """A new name in the application's folder below spark.checkpoint.dir (a temporary one only where that is unset)."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the plan and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> bool:
    """Delete the application's folder, once no result that reads from it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
