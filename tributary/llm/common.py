"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document ids that are null take part as one document that sorts after all others.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, by position, so that other columns whose names clash
    (repeated, or equal but for case) do no harm."""
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"missing columns: {missing}")
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.select(*(flat[f"c{at[n]}"].alias(n) for n in names))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or on a local
    master without that setting a folder of the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/tributary-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def written(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Writes df to path, which goes when the driver ends; the shuffle files of the write go with it."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    fs, found = _hadoop_path(spark, path)
    fs.deleteOnExit(found)


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and what follows
    doesn't recompute it when executors are lost."""
    path = scratch(df.sparkSession)
    written(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Deletes tables made by stash that nothing reads any more."""
    for df in stashed:
        for file in df.inputFiles()[:1]:
            fs, found = _hadoop_path(df.sparkSession, file.rpartition("/")[0])
            fs.delete(found, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, a stored table, marked for broadcast if it has no more than so many rows, and left for
    Spark to join as it sees fit beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def long_id(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def real_id(name: str):
    return F.when(F.col(name) != NULL_ID, F.col(name))
