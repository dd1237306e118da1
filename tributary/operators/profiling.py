"""Profiles of columns, weights, placeholders and cursors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import SCORE
from ..functions import features as N

FLOOR, CEILING = 0.001, 0.999


def column_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """A row for each column: rows, nulls, cardinality, frequencies, m, u, weight and how telling it
    is. The columns are taken apart once, so that it is one scan and one shuffle of value counts."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    long = df.select(pairs.alias("p")).select("p.column", "p.value")
    if approximate:
        per = long.groupBy("column").agg(F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"), F.approx_count_distinct("value").cast("long").alias("cardinality"), F.lit(None).cast("long").alias("max_frequency"))
    else:
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        some = F.when(F.col("value").isNotNull(), F.col("n"))
        per = counts.groupBy("column").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("value").alias("cardinality"), F.max(some).alias("max_frequency"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(FLOOR)), F.lit(CEILING))
    out = per.withColumn("avg_frequency", F.try_divide(F.col("row_count") - F.col("null_count"), F.col("cardinality")))
    out = out.withColumns({"u": clamp(F.coalesce(F.try_divide(F.lit(1.0), F.col("cardinality")), F.lit(CEILING))), "m": clamp(1 - F.try_divide(F.col("null_count"), F.col("row_count")))})
    out = out.withColumn("weight", F.log2(F.col("m") / F.col("u")))
    return out.withColumn("power", F.when(F.col("weight") >= 10, "HIGH").when(F.col("weight") >= 5, "MEDIUM").otherwise("LOW"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "value").limit(k)


def suggest(profile: dict) -> dict[str, object]:
    """A comparison for a profiled column, and a warning where many values are missing."""
    card = profile["cardinality"]
    method = "exact" if card > 10_000 else "jaro_winkler" if card > 100 else "exact"
    share = profile["null_count"] / profile["row_count"] if profile["row_count"] else 0.0
    return {"column": profile["column"], "method": method, "warning": f"{share:.0%} of the values are null" if share > 0.3 else None}


def weight_contribution(matches: DataFrame, comparisons: Sequence[str], prefix: str = "match_score_") -> DataFrame:
    """How often and how much each comparison adds: CRITICAL from half of the score, HIGH from a quarter, MEDIUM from a tenth, else LOW."""
    parts = F.array(*(F.struct(F.lit(c).alias("comparison"), F.col(f"{prefix}{c}").alias("part")) for c in comparisons))
    rows = matches.select(F.col(SCORE).alias("s"), F.explode(parts).alias("p")).select("s", "p.*")
    out = rows.groupBy("comparison").agg(F.avg((F.col("part") > 0).cast("int")).alias("fire_rate"), F.avg("part").alias("avg_contribution"), F.try_divide(F.sum("part"), F.sum("s")).alias("share"))
    return out.withColumn("importance", F.when(F.col("share") >= 0.5, "CRITICAL").when(F.col("share") >= 0.25, "HIGH").when(F.col("share") >= 0.1, "MEDIUM").otherwise("LOW"))


def threshold_sweep(matches: DataFrame, threshold: float) -> DataFrame:
    """Matches that are left at 10 % to 190 % of the threshold, counted in one pass."""
    steps = [p / 100 for p in range(10, 200, 20)]
    counts = F.array(*(F.struct(F.lit(p).alias("multiplier"), F.lit(p * threshold).alias("threshold"), F.count_if(F.col(SCORE) >= p * threshold).alias("matches")) for p in steps))
    return matches.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def weight_impact(matches: DataFrame, comparisons: Sequence[str], threshold: float, prefix: str = "match_score_") -> DataFrame:
    """Matches that are left when one comparison's weight is halved or doubled."""
    tests = [F.struct(F.lit(c).alias("comparison"), F.lit(f).alias("factor"), F.count_if(F.col(SCORE) + (f - 1) * F.col(f"{prefix}{c}") >= threshold).alias("matches")) for c in comparisons for f in (0.5, 2.0)]
    return matches.agg(F.count_if(F.col(SCORE) >= threshold).alias("now"), F.array(*tests).alias("t")).select("now", F.explode("t").alias("t")).select("t.comparison", "t.factor", "t.matches", (F.col("t.matches") - F.col("now")).alias("change"))


PLACEHOLDERS = {"phone": N.is_placeholder_phone, "email": N.is_placeholder_email, "name": N.is_placeholder_name, "address": N.is_placeholder_address, "ssn": N.is_placeholder_ssn}


def placeholder_scan(df: DataFrame, columns: dict[str, str], run_id: str, source: str, min_count: int = 2) -> DataFrame:
    """Known placeholders: column, pattern type, value and count, where a value comes often enough.
    columns: pattern type by column."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("pattern_type"), F.col(c).cast("string").alias("value"), PLACEHOLDERS[kind](F.col(c)).alias("hit")) for c, kind in columns.items()))
    found = df.select(F.explode(rows).alias("r")).where("r.hit = 1").groupBy("r.column_name", "r.pattern_type", "r.value").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= min_count)
    return found.select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source_name"), "column_name", "pattern_type", "value", "occurrences")


def suspected_placeholders(df: DataFrame, columns: Sequence[str], min_count: int = 10, min_share: float = 0.001) -> DataFrame:
    """Values that are suspiciously frequent."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("occurrences"))
    totals = counts.groupBy("column_name").agg(F.sum("occurrences").alias("total"))
    return counts.where("value IS NOT NULL").join(totals, "column_name").withColumn("share", F.col("occurrences") / F.col("total")).where((F.col("occurrences") >= min_count) & (F.col("share") > min_share)).drop("total")


def cursor_profile(df: DataFrame, columns: Sequence[str], batches: int = 10) -> DataFrame:
    """How well each column serves as a cursor: six tenths for enough distinct values, four for even ones."""
    out = []
    for c in columns:
        counts = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        one = counts.agg(F.count("v").alias("distinct_values"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
        even = 1 / (1 + F.coalesce(F.try_divide("sd", "mean"), F.lit(0.0)))
        spread = F.least(F.lit(1.0), F.col("distinct_values") / (2.0 * batches))
        out.append(one.select(F.lit(c).alias("column_name"), "distinct_values", even.alias("uniformity"), (0.6 * spread + 0.4 * even).alias("score")))
    return reduce(lambda a, b: a.unionByName(b), out)


def hash_cursor_profile(df: DataFrame, column: str, modulus: int = 1000) -> DataFrame:
    parts = df.groupBy(F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(modulus)).alias("v")).agg(F.count("*").alias("n"))
    return parts.agg(F.lit(column).alias("column_name"), F.count("*").alias("partitions"), F.max("n").alias("largest"), F.avg("n").alias("mean")).withColumn("uniformity", F.try_divide("mean", "largest"))


def weight_of(cardinality: int, null_share: float) -> float:
    clamp = lambda x: min(max(x, FLOOR), CEILING)
    return log2(clamp(1 - null_share) / clamp(1 / max(cardinality, 1)))


def data_quality_score(placeholder_share: float, null_share: float, reduction_ratio: float, largest_bucket: int) -> tuple[int, list[str]]:
    """100 less what is wrong, and what that is."""
    checks = [
        (25 if placeholder_share > 0.2 else 10 if placeholder_share > 0.05 else 0, f"placeholders {placeholder_share:.1%}"),
        (15 if null_share > 0.5 else 5 if null_share > 0.1 else 0, f"nulls {null_share:.1%}"),
        (25 if reduction_ratio < 0.5 else 10 if reduction_ratio < 0.9 else 0, f"reduction ratio {reduction_ratio:.3f}"),
        (15 if largest_bucket > 10_000 else 5 if largest_bucket > 1_000 else 0, f"largest bucket {largest_bucket}"),
    ]
    return max(0, 100 - sum(n for n, _ in checks)), [what for n, what in checks if n]
