"""Canonical records and merged golden records of clusters.

All fields of a cluster come from one aggregation: the value with the largest sort key among its
non-null values. No window over a cluster is needed, and a large cluster is summed up before
its rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import CLUSTER_ID, CONFIDENCE, ENTITY_UID, LEFT, RIGHT, SCORE, SOURCE_NAME, SOURCE_UPDATED_AT, TIER_NAME, TIER_PRIORITY
from ..storage import materialize


@dataclass(frozen=True)
class FieldStrategy:
    """strategy: most_complete, most_recent, source_priority, most_common or weighted_vote."""

    column: str
    strategy: str = "most_complete"
    source_priority: tuple[str, ...] = ()
    decay_rate: float = 0.01


@dataclass(frozen=True)
class Golden:
    """canonical_method: completeness, recency, source_priority, or field_merge for one merged row a cluster."""

    source_columns: tuple[str, ...]
    canonical_method: str = "completeness"
    scoring_columns: tuple[str, ...] = ()
    passthrough_columns: tuple[str, ...] = ()
    source_priority: tuple[str, ...] = ()
    field_strategies: tuple[FieldStrategy, ...] = ()
    default_field_strategy: str = "most_complete"
    include_match_metadata: bool = True
    entity_id_prefix: str = ""
    reconciliation_strategy: str = "tier_priority"


def completeness(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def recency(c: str = SOURCE_UPDATED_AT) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _rank(sources: Sequence[str], missing: int) -> Column:
    out = F.lit(missing)
    for i, s in reversed(list(enumerate(sources))):
        out = F.when(F.col(SOURCE_NAME) == s, i).otherwise(out)
    return out


def canonical_key(p: Golden) -> Column:
    if p.canonical_method == "recency":
        return recency()
    if p.canonical_method == "source_priority":
        rank = _rank(p.source_priority, -1)
        return F.when(rank >= 0, 1000 - rank).otherwise(0)
    return completeness(p.scoring_columns or p.source_columns)


def _key(s: FieldStrategy, p: Golden) -> Column:
    latest, first = F.coalesce(recency(), F.lit(-(2**62))), -F.col(ENTITY_UID)
    if s.strategy == "most_recent":
        return F.struct(latest, first)
    if s.strategy == "source_priority":
        return F.struct(-_rank(s.source_priority or p.source_priority, 999), latest, first)
    return F.struct(completeness(p.scoring_columns or p.source_columns), latest, first)


def _votes(df: DataFrame, s: FieldStrategy, as_of: Column) -> DataFrame:
    """cluster_id and the winning value of a column; ties: the smaller value."""
    weight = F.count("*")
    if s.strategy == "weighted_vote":
        age = F.datediff(as_of, F.col(SOURCE_UPDATED_AT).cast("date"))
        weight = F.round(F.sum(F.exp(-F.lit(s.decay_rate) * F.coalesce(age, F.lit(0)))), 12)
    votes = df.where(F.col(s.column).isNotNull()).groupBy(CLUSTER_ID, F.col(s.column).alias("v")).agg(weight.alias("n"))
    # The smaller value wins a tie: it is kept from the values of the largest count.
    top = votes.groupBy(CLUSTER_ID).agg(F.max("n").alias("n"))
    return votes.join(top, [CLUSTER_ID, "n"]).groupBy(CLUSTER_ID).agg(F.min("v").alias(s.column))


def golden_fields(records: DataFrame, p: Golden, as_of: Column | None = None, **more: Column) -> DataFrame:
    """cluster_id and the merged value of every source column, and more aggregates of the clusters. All
    but votes come from one aggregation."""
    named = {s.column: s for s in p.field_strategies}
    every = [named.get(c, FieldStrategy(c, p.default_field_strategy)) for c in p.source_columns]
    voted = [s for s in every if s.strategy in ("most_common", "weighted_vote")]
    picked = [s for s in every if s not in voted]
    if voted:
        records = materialize(records)  # each vote reads it again
    out = records.groupBy(CLUSTER_ID).agg(*(v.alias(k) for k, v in more.items()), F.count("*").alias("_n"), *(F.max_by(F.col(s.column), F.when(F.col(s.column).isNotNull(), _key(s, p))).alias(s.column) for s in picked))
    for s in voted:
        out = out.join(_votes(records, s, as_of if as_of is not None else F.current_date()), CLUSTER_ID, "left")
    return out.select(CLUSTER_ID, *p.source_columns, *more)


def match_metadata(matches: DataFrame, strategy: str = "tier_priority") -> DataFrame:
    """The best match of each record: by tier and then score, or the other way round."""
    tier, top = -F.col(TIER_PRIORITY), F.col(SCORE)
    key = F.struct(top, tier, -F.col("w")) if strategy == "highest_score" else F.struct(tier, top, -F.col("w"))
    ends = [matches.select(F.col(a).alias(ENTITY_UID), F.col(b).alias("w"), TIER_PRIORITY, TIER_NAME, SCORE, CONFIDENCE) for a, b in ((LEFT, RIGHT), (RIGHT, LEFT))]
    # The smallest partner of each score first: a long in place, where structs would be sorted.
    few = ends[0].unionByName(ends[1]).groupBy(ENTITY_UID, TIER_PRIORITY, TIER_NAME, SCORE, CONFIDENCE).agg(F.min("w").alias("w"))
    best = few.groupBy(ENTITY_UID).agg(F.max_by(F.struct(TIER_NAME, SCORE, CONFIDENCE), key).alias("m"))
    return best.select(ENTITY_UID, F.col(f"m.{TIER_NAME}").alias("matched_by_tier"), F.col(f"m.{SCORE}").alias("match_score"), F.col(f"m.{CONFIDENCE}").alias("match_confidence"))


def resolve(records: DataFrame, clusters: DataFrame, matches: DataFrame | None, p: Golden, as_of: Column | None = None) -> DataFrame:
    """resolved_entity_id, cluster_id, canonical_entity_uid, is_canonical, the columns. field_merge:
    one row a cluster, with merged values; otherwise all records, one of each cluster canonical."""
    joined = records.join(clusters, ENTITY_UID)
    best = F.max_by(ENTITY_UID, F.struct(canonical_key(p), -F.col(ENTITY_UID)))
    name = F.concat(F.lit(f"{p.entity_id_prefix}_"), F.col(CLUSTER_ID).cast("string")) if p.entity_id_prefix else F.col(CLUSTER_ID)
    if p.canonical_method == "field_merge":
        out = golden_fields(joined, p, as_of, canonical_entity_uid=best).withColumn(ENTITY_UID, F.col("canonical_entity_uid"))
        if p.passthrough_columns:
            out = out.join(records.select(ENTITY_UID, *p.passthrough_columns), ENTITY_UID)
        out = out.withColumn("is_canonical", F.lit(True))
    else:
        out = joined.join(joined.groupBy(CLUSTER_ID).agg(best.alias("canonical_entity_uid")), CLUSTER_ID).withColumn("is_canonical", F.col(ENTITY_UID) == F.col("canonical_entity_uid"))
    cols = [name.alias("resolved_entity_id"), CLUSTER_ID, "canonical_entity_uid", "is_canonical", ENTITY_UID, *dict.fromkeys([*p.source_columns, *p.passthrough_columns])]
    if p.include_match_metadata and matches is not None:
        out = out.join(match_metadata(matches, p.reconciliation_strategy), ENTITY_UID, "left")
        cols += ["matched_by_tier", "match_score", "match_confidence"]
    return out.select(*cols)


def top_by(df: DataFrame, group: str, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
