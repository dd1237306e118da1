"""Tables that several stages read: written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master without that setting a folder of the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """df written and read again, which cuts its lineage and survives lost executors. What is written goes
    when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/tributary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)
