"""What a run leaves for the next: watermarks, checkpoints of stages, a lock with fencing tokens.

Watermarks and checkpoints are small append-only Parquet tables below a path; the latest row counts.
Writes that a fencing token guards raise when the lock has moved on, and carry the token, so that
one that slips through doesn't count.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Files

CURSORS = "source_name string, cursor_column string, cursor_value string, cursor_type string, run_id string, updated_at double, token long"
STAGES = "run_id string, stage_name string, completed_at double"
COMPLETE = "__run_complete__"

_TYPED = {
    "TIMESTAMP": (lambda v: v.isoformat(), datetime.fromisoformat), "DATE": (lambda v: v.isoformat(), date.fromisoformat),
    "INT64": (str, int), "FLOAT64": (repr, float), "NUMERIC": (str, Decimal), "STRING": (str, str),
}


def type_of(value: object) -> str:
    for kind, name in ((datetime, "TIMESTAMP"), (date, "DATE"), (int, "INT64"), (float, "FLOAT64"), (Decimal, "NUMERIC")):
        if isinstance(value, kind):
            return name
    return "STRING"


class _Log:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def add(self, rows: Sequence[tuple]) -> None:
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)


class Lock:
    """At most one run at a time: acquiring gives a token larger than any before, which only one can
    take, as it is a file that only one can make. A lock that its holder hasn't refreshed in time can be taken."""

    def __init__(self, spark: SparkSession, path: str, pipeline: str, seconds: float = 3600) -> None:
        self.folder, self.pipeline, self.seconds, self.token = f"{path}/locks/{pipeline}", pipeline, seconds, 0
        self._files = Files(spark, path)

    def _latest(self) -> tuple[int, float]:
        """The last token and the second from which on it can be taken."""
        names = self._files.names(self.folder)
        token = max((int(n) for n in names if n.isdigit()), default=0)
        return token, 0.0 if not token or f"{token}.released" in names else names[str(token)]

    def acquire(self) -> int:
        token, until = self._latest()
        if until > time.time() or not self._files.claim(f"{self.folder}/{token + 1}"):
            raise RuntimeError(f"{self.pipeline} is locked by another run")
        self.token = token + 1
        self.refresh()
        return self.token

    def refresh(self) -> None:
        """The token's file is dated with the second up to which the lock is held."""
        self.verify()
        self._files.touch(f"{self.folder}/{self.token}", time.time() + self.seconds)

    def verify(self) -> None:
        token, until = self._latest()
        if token != self.token or not until:
            raise RuntimeError(f"the lock on {self.pipeline} has gone to another run")

    def release(self) -> None:
        self.verify()
        self._files.claim(f"{self.folder}/{self.token}.released")


class Watermarks:
    """Of each cursor, the value that was written last under the largest token: what a run writes
    after its lock has gone to another is there, but never counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = _Log(spark, f"{path}/watermarks", CURSORS)

    def read(self, source: str) -> dict[str, object]:
        """The current value of each cursor."""
        rows = self.log.read().where(F.col("source_name") == source)
        latest = rows.groupBy("cursor_column").agg(F.max_by(F.struct("cursor_value", "cursor_type"), F.struct("token", "updated_at")).alias("v"))
        return {r.cursor_column: _TYPED[r.v.cursor_type][1](r.v.cursor_value) for r in latest.collect()}  # one row a cursor

    def write(self, source: str, cursors: dict[str, object], run_id: str, lock: Lock | None = None) -> None:
        if lock:
            lock.verify()
        self.log.add([(source, c, _TYPED[type_of(v)][0](v), type_of(v), run_id, time.time(), lock.token if lock else 0) for c, v in cursors.items()])

    def history(self, source: str) -> DataFrame:
        return self.log.read().where(F.col("source_name") == source).orderBy("updated_at")


def cursors_of(staged: DataFrame, columns: Sequence[str], independent_of: dict[str, object] | None = None) -> dict[str, object]:
    """The largest tuple of cursor values among staged rows; empty where there are none.
    independent_of: a watermark whose cursors advance each by itself."""
    if independent_of is None:
        r = staged.agg(F.max(F.struct(*columns)).alias("m")).first().m
        return {c: r[c] for c in columns} if r else {}
    r = staged.agg(F.count("*").alias("_n"), *(F.max(c).alias(c) for c in columns)).first()
    both = {c: [v for v in (r[c], independent_of.get(c)) if v is not None] for c in columns}
    return {c: max(v) if v else None for c, v in both.items()} if r["_n"] else {}


class Checkpoints:
    """Stages that a run has completed; a run with the final mark isn't resumed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = _Log(spark, f"{path}/checkpoints", STAGES)

    def done(self, run_id: str) -> set[str]:
        return {r.stage_name for r in self.log.read().where(F.col("run_id") == run_id).select("stage_name").distinct().collect()}

    def add(self, run_id: str, stage: str, lock: Lock | None = None) -> None:
        if lock:
            lock.verify()
        self.log.add([(run_id, stage, time.time())])

    def finish(self, run_id: str, lock: Lock | None = None) -> None:
        self.add(run_id, COMPLETE, lock)

    def resumable(self) -> str | None:
        """The last run that isn't complete."""
        per = self.log.read().groupBy("run_id").agg(F.max("completed_at").alias("at"), F.max((F.col("stage_name") == COMPLETE).cast("int")).alias("complete"))
        r = per.where("complete = 0").orderBy(F.desc("at")).limit(1).collect()
        return r[0].run_id if r else None
