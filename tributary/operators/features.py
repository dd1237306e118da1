"""Feature engineering: sources side by side, look-ups joined, features by dependency, blocking keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comparisons, features  # noqa: F401  they register themselves
from ..functions.registry import FEATURES


@dataclass(frozen=True)
class Feature:
    """A named expression: a registered function of columns or earlier features, or SQL."""

    name: str
    function: str | None = None
    inputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    sql: str | None = None

    def expression(self) -> Column:
        if self.sql is not None:
            return F.expr(self.sql)
        if not self.function:
            raise ValueError(f"feature {self.name!r} has neither function nor sql")
        return FEATURES.call(self.function, *(F.col(c) for c in self.inputs), **self.params)


@dataclass(frozen=True)
class Enrichment:
    """A look-up by a feature of the records: columns come with a prefix, match_flag says whether a row was found."""

    table: DataFrame
    key: Feature
    lookup_key: str
    columns: tuple[str, ...]
    prefix: str = ""
    match_flag: str = ""
    how: str = "left"


def levels(wanted: Sequence[Feature], known: set[str]) -> list[list[Feature]]:
    """Features in rounds: each round uses columns and features of earlier rounds only."""
    left, out = list(wanted), []
    names = {f.name for f in wanted}
    while left:
        ready = [f for f in left if all(c not in names or c in known for c in f.inputs) and (f.sql is None or not any(g is not f and g.name in f.sql and g.name not in known for g in left))]
        if not ready:
            raise ValueError(f"features depend on each other: {', '.join(f.name for f in left)}")
        out.append(ready)
        known = known | {f.name for f in ready}
        left = [f for f in left if f not in ready]
    return out


def engineer(sources: Sequence[DataFrame], wanted: Sequence[Feature] = (), enrichments: Sequence[Enrichment] = (), blocking_keys: Sequence[Feature] = (), composite_keys: Sequence[Feature] = ()) -> DataFrame:
    df = reduce(lambda a, b: a.unionByName(b), sources)
    for e in enrichments:
        rows = e.table.select(F.col(e.lookup_key).alias("_key"), *(F.col(c).alias(f"{e.prefix}{c}") for c in e.columns)).dropDuplicates(["_key"])
        df = df.withColumn("_own", e.key.expression()).join(rows, F.col("_own") == F.col("_key"), e.how)
        if e.match_flag:
            df = df.withColumn(e.match_flag, F.col("_key").isNotNull().cast("int"))
        df = df.drop("_own", "_key")
    known = set(df.columns)
    for group in levels([*wanted, *blocking_keys, *composite_keys], known - {f.name for f in wanted}):
        df = df.withColumns({f.name: f.expression() for f in group})
    return df


def term_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """term_frequency_column, _value, _count and _ratio of every value: one pass over df, and the
    totals from a second aggregation of the few partial counts, not from a window over all values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    joined = counts.join(totals, "column")
    return joined.select(
        F.col("column").alias("term_frequency_column"), F.col("value").alias("term_frequency_value"),
        F.col("n").alias("term_frequency_count"), (F.col("n") / F.col("total")).alias("term_frequency_ratio"))
