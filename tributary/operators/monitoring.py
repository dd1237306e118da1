"""Logs of runs, comparisons of runs, quality gates and diagnoses."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import CLUSTER_ID

JOBS = "run_id string, stage_name string, query_index int, plan_hash string, duration_seconds double, rows_affected long, started_at double"
PLANS = "run_id string, stage_name string, query_index int, plan_hash string, plan_text string"
PLACEHOLDERS = "run_id string, source_name string, column_name string, pattern_type string, value string, occurrences long"


@dataclass
class JobLog:
    """What each stage of a run did: its plan, how long it took, how many rows it gave."""

    run_id: str
    jobs: list[tuple] = field(default_factory=list)
    plans: list[tuple] = field(default_factory=list)

    def timed(self, stage: str, df: DataFrame, action: Callable[[DataFrame], int]) -> int:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        key = hashlib.sha256(plan.encode()).hexdigest()[:16]
        began = time.time()
        rows = action(df)
        n = sum(j[1] == stage for j in self.jobs)
        self.jobs.append((self.run_id, stage, n, key, time.time() - began, rows, began))
        self.plans.append((self.run_id, stage, n, key, plan))
        return rows

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(self.jobs, JOBS), spark.createDataFrame(self.plans, PLANS)


def compare_runs(jobs: DataFrame, a: str, b: str) -> DataFrame:
    """Stage by stage: durations and rows of run a and b, and whether a query is NEW, REMOVED or MATCHED."""
    side = lambda r, x: jobs.where(F.col("run_id") == r).select("stage_name", "plan_hash", F.col("duration_seconds").alias(f"duration_{x}"), F.col("rows_affected").alias(f"rows_{x}"))
    both = side(a, "a").join(side(b, "b"), ["stage_name", "plan_hash"], "full")
    status = F.when(F.col("duration_a").isNull(), "NEW").when(F.col("duration_b").isNull(), "REMOVED").otherwise("MATCHED")
    return both.select("stage_name", "plan_hash", status.alias("status"), "duration_a", "duration_b", (F.col("duration_b") - F.col("duration_a")).alias("duration_delta"), (F.col("rows_b") - F.col("rows_a")).alias("rows_delta"))


@dataclass(frozen=True)
class Finding:
    severity: str
    what: str


def blocking_gate(candidates: DataFrame, tier: str) -> list[Finding]:
    return [Finding("error", f"{tier}: blocking gives no candidates")] if candidates.isEmpty() else []


def matching_gate(matches: DataFrame, tier: str) -> list[Finding]:
    return [Finding("warning", f"{tier}: no matches")] if matches.isEmpty() else []


def cluster_gate(clusters: DataFrame, max_size: int = 100) -> list[Finding]:
    top = clusters.groupBy(CLUSTER_ID).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return [Finding("error", f"the largest cluster has {top} records, over {max_size}")] if top > max_size else []


def quality_gate(score: int, least: int = 50) -> list[Finding]:
    return [Finding("error", f"data quality {score} is below {least}")] if score < least else []


def diagnose_blocking(records: DataFrame, keys: Sequence[str]) -> list[str]:
    """Why blocking gives nothing: per key, nulls and how many values occur twice."""
    out = []
    for k in keys:
        counts = records.groupBy(k).agg(F.count("*").alias("n"))
        r = counts.agg(F.sum(F.when(F.col(k).isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count_if(F.col(k).isNotNull() & (F.col("n") > 1)).alias("shared"), F.max(F.when(F.col(k).isNotNull(), F.col("n"))).alias("largest"), F.sum("n").alias("total")).first()
        if r.total and r.nulls == r.total:
            out.append(f"{k} is always null")
        elif not r.shared:
            out.append(f"no two records share a value of {k}")
        elif r.largest > 10_000:
            out.append(f"{k} has a value that {r.largest} records share")
    return out


def diagnose_matching(scored: DataFrame, score: str, threshold: float) -> list[str]:
    r = scored.agg(F.max(score).alias("top"), F.count("*").alias("n")).first()
    if not r.n:
        return ["no pairs were scored"]
    return [f"the best score {r.top:g} is below the threshold {threshold:g}"] if r.top < threshold else []


def diagnose_clusters(clusters: DataFrame, share: float = 0.1) -> list[str]:
    sizes = clusters.groupBy(CLUSTER_ID).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return [f"one cluster holds {sizes.top} of {sizes.total} records"] if sizes.total and sizes.top > max(2, share * sizes.total) else []
