"""Intermediate tables that several later plans read, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without it gets a temporary one, a cluster raises."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once as Parquet and read again: later plans neither recompute it nor depend on lost executors."""
    path = f"{shared_folder(df.sparkSession)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
