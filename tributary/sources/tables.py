"""Sources and sinks: files, catalog tables, rows in memory; versioned tables with upserts."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Spark types of the column types that configurations name.
TYPES = {
    "STRING": T.StringType(), "BYTES": T.BinaryType(), "INT64": T.LongType(), "INTEGER": T.LongType(), "FLOAT64": T.DoubleType(),
    "FLOAT": T.DoubleType(), "NUMERIC": T.DecimalType(38, 9), "DECIMAL": T.DecimalType(38, 9), "BOOL": T.BooleanType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampNTZType(), "DATE": T.DateType(),
    "TIME": T.StringType(), "JSON": T.StringType(),
}


def column_type(name: str) -> T.DataType:
    """BIGNUMERIC has more digits than a decimal here can have, and is refused."""
    base = re.sub(r"[(<].*", "", name.strip().upper())
    if base == "ARRAY":
        return T.ArrayType(column_type(name.strip()[6:-1]))
    if base not in TYPES:
        raise ValueError(f"column type {name!r} has no equivalent")
    return TYPES[base]


def schema_of(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, column_type(t)) for n, t in columns.items()])


def read_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header; all columns are strings unless types are given, and empty cells are null."""
    reader = spark.read.option("header", True).option("nullValue", "")
    return reader.schema(schema_of(columns)).csv(path) if columns else reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def rows(spark: SparkSession, data: Sequence[dict], columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in data], schema_of(columns))


def overwrite(df: DataFrame, table: str, partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """A catalog table, partitioned, or bucketed so that later joins on the keys need no shuffle."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(table)


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def create_if_missing(spark: SparkSession, table: str, schema: T.StructType) -> bool:
    if spark.catalog.tableExists(table):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(table)
    return True


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with new's rows in place of those of equal keys, and added where there are none."""
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*current.columns))


class Files:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder, with the second they were last touched."""
        at = self._path(folder)
        return {f.getPath().getName(): f.getModificationTime() / 1e3 for f in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def claim(self, path: str) -> bool:
        """Makes an empty file; False if it is there already. The file system decides who is first."""
        try:
            return bool(self._fs.createNewFile(self._path(path)))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def touch(self, path: str, second: float) -> None:
        self._fs.setTimes(self._path(path), int(second * 1e3), -1)


class VersionedTable:
    """A table whose versions are numbered folders below a path; the current one is the last that is
    whole. A writer first claims its number with a file that only one can make, so that of two
    writers one fails before it writes; a writer that dies leaves the last version current, and its
    claim counts no longer after `stale` seconds. Only Spark's file system is used."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 3600) -> None:
        self.spark, self.path, self.stale, self._files = spark, path.rstrip("/"), stale, Files(spark, path)

    def _numbers(self, folder: str) -> dict[int, float]:
        return {int(n): t for n, t in self._files.names(folder).items() if n.isdigit()}

    def version(self) -> int:
        return next((n for n in sorted(self._numbers(self.path), reverse=True) if self._files.exists(f"{self.path}/{n}/_SUCCESS")), 0)

    def read(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(f"{self.path}/{n}") if n else None

    def write(self, df: DataFrame, expected: int | None = None, note: str = "") -> int:
        """A new version. expected: the version it is made from; another one by now is an error. note: kept
        with the version."""
        now, claims = self.version(), self._numbers(f"{self.path}/_claims")
        if expected is not None and now != expected:
            raise RuntimeError(f"{self.path} is at version {now}, not {expected}")
        if any(n > now and t > time.time() - self.stale for n, t in claims.items()):
            raise RuntimeError(f"another writer makes a version of {self.path}")
        n = max([now, *claims]) + 1
        if not self._files.claim(f"{self.path}/_claims/{n}"):
            raise RuntimeError(f"another writer makes version {n} of {self.path}")
        if note:
            self._files.claim(f"{self.path}/_notes/{n}-{note}")
        df.write.parquet(f"{self.path}/{n}")
        return n

    def note(self) -> str:
        """What was kept with the current version."""
        n = self.version()
        return next((x.partition("-")[2] for x in self._files.names(f"{self.path}/_notes") if x.partition("-")[0] == str(n)), "")
