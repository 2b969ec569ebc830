"""Planes that are used several times, kept in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it names nothing a temporary folder is set, but only in local mode: executors do not see the driver's."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def held(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: a short lineage that survives lost executors."""
    path = f"{folder(df.sparkSession)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
