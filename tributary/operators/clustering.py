"""Clusters of matched records, and measures of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CLUSTER_ID, CONFIDENCE, ENTITY_UID, LEFT, RIGHT, SOURCE_NAME
from ..storage import materialize
from .blocking import Blocking, block, streams
from .pairs import carries


def _labels(edges: DataFrame, labels: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """v, label after every label has become the smallest of its component. edges: v, w both ways.
    Each round takes the neighbours' smallest label and then that label's own label, so that the
    rounds grow with the logarithm of the diameter; a round is written, not kept in lineage."""
    done = 0
    while max_rounds is None or done < max_rounds:
        near = edges.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        hop = stepped.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = stepped.join(hop, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = materialize(new)
        labels, done = new.select("v", "label"), done + 1
        if new.where("label != old").isEmpty():
            break
    return labels


def _both_ways(matches: DataFrame) -> DataFrame:
    one = matches.select(F.col(LEFT).alias("v"), F.col(RIGHT).alias("w"))
    return one.unionByName(one.select(F.col("w").alias("v"), F.col("v").alias("w"))).dropDuplicates()


def blocked_components(records: DataFrame, p: Blocking, match: Callable[[DataFrame], DataFrame], columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """entity_uid, cluster_id: the components of the matches of all blocked pairs, of which few are made. Each
    record is matched with the first of its key; after that, only pairs of different components can
    join any, so that keys of one component make no further pairs. match: the matches among pairs
    that carry the columns, l and r kept. where: which pairs count."""
    keep = lambda df: df if where is None else df.where(where)
    if not streams(records, p):
        return connected_components(match(keep(block(records, p, columns=columns))).select(LEFT, RIGHT), records)
    part = connected_components(match(keep(block(records, p, columns=columns, seeds=True))), records).withColumnRenamed(CLUSTER_ID, "_part")
    parted = materialize(records.select(ENTITY_UID, *sorted({*columns, *_blocked_by(p)} - {ENTITY_UID})).join(part, ENTITY_UID))
    across = match(keep(block(parted, p, columns=columns, apart="_part")))
    edges = materialize(_both_ways(across.select(F.col("l._part").alias(LEFT), F.col("r._part").alias(RIGHT))))
    start = edges.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label"))
    joined = _labels(edges, start).select(F.col("v").alias("_part"), "label")
    return parted.select(ENTITY_UID, "_part").join(joined, "_part", "left").select(ENTITY_UID, F.coalesce("label", "_part").alias(CLUSTER_ID))


def spanning_links(components: DataFrame) -> DataFrame:
    """left_entity_uid, right_entity_uid: each record of a component with its first, which connect what its matches do."""
    return components.where(F.col(ENTITY_UID) != F.col(CLUSTER_ID)).select(F.col(CLUSTER_ID).alias(LEFT), F.col(ENTITY_UID).alias(RIGHT))


def _blocked_by(p: Blocking) -> list[str]:
    return [SOURCE_NAME, *(k for x in p.paths for k in (*x.keys, *x.lsh_keys))]


def connected_components(matches: DataFrame, records: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """entity_uid, cluster_id: the smallest uid that matches reach. Only records with matches take
    part in the rounds."""
    edges = materialize(_both_ways(matches))
    start = edges.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label"))
    labels = _labels(edges, start, max_rounds).select(F.col("v").alias(ENTITY_UID), "label")
    return records.select(ENTITY_UID).dropDuplicates().join(labels, ENTITY_UID, "left").select(ENTITY_UID, F.coalesce("label", ENTITY_UID).alias(CLUSTER_ID))


def incremental_labels(matches: DataFrame, records: DataFrame, canonical: DataFrame) -> DataFrame:
    """cluster_id, label: the clusters that new matches join with others, and the smallest of those. Before,
    a new record is a cluster of its own, an earlier one is in that of the canonical index. Only
    clusters that a match touches take part."""
    ends = materialize(matches.select(F.col(LEFT).alias("u")).unionByName(matches.select(F.col(RIGHT).alias("u"))).dropDuplicates())
    prior = canonical.select(F.col(ENTITY_UID).alias("u"), F.col(CLUSTER_ID).alias("c"))
    uid = materialize(ends.join(prior, "u", "left").select("u", F.coalesce("c", "u").alias("c")))
    between = matches.select(LEFT, RIGHT).join(uid.toDF(LEFT, "v"), LEFT).join(uid.toDF(RIGHT, "w"), RIGHT).where("v != w").select("v", "w")
    edges = materialize(between.unionByName(between.select(F.col("w").alias("v"), F.col("v").alias("w"))).dropDuplicates())
    start = edges.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label"))
    return _labels(edges, start).select(F.col("v").alias(CLUSTER_ID), "label")


def incremental_components(matches: DataFrame, records: DataFrame, canonical: DataFrame) -> DataFrame:
    """The same, starting from the canonical index: earlier clusters and new records are joined by
    the new matches. Clusters that a match joins get one label for all their records, old ones too."""
    prior = canonical.select(ENTITY_UID, CLUSTER_ID)
    new = records.select(ENTITY_UID).dropDuplicates().join(prior.select(ENTITY_UID), ENTITY_UID, "left_anti").withColumn(CLUSTER_ID, F.col(ENTITY_UID))
    labels = incremental_labels(matches, records, canonical)
    return prior.unionByName(new).join(labels, CLUSTER_ID, "left").select(ENTITY_UID, F.coalesce("label", CLUSTER_ID).alias(CLUSTER_ID))


def star_clusters(matches: DataFrame, records: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Each match goes to its end of larger summed confidence (ties: the left), and each record to
    the smallest centre of its matches. One pass; not transitive."""
    good = matches.where(F.col(CONFIDENCE) >= min_confidence).select(LEFT, RIGHT, CONFIDENCE)
    ends = good.select(F.col(LEFT).alias("u"), CONFIDENCE).unionByName(good.select(F.col(RIGHT).alias("u"), CONFIDENCE))
    power = ends.groupBy("u").agg(F.sum(CONFIDENCE).alias("p"))
    scored = good.join(power.toDF(LEFT, "pl"), LEFT).join(power.toDF(RIGHT, "pr"), RIGHT)
    centred = scored.withColumn("centre", F.when(F.col("pl") >= F.col("pr"), F.col(LEFT)).otherwise(F.col(RIGHT)))
    each = centred.select(F.col(LEFT).alias(ENTITY_UID), "centre").unionByName(centred.select(F.col(RIGHT).alias(ENTITY_UID), "centre"))
    centres = each.groupBy(ENTITY_UID).agg(F.min("centre").alias("centre"))
    return records.select(ENTITY_UID).dropDuplicates().join(centres, ENTITY_UID, "left").select(ENTITY_UID, F.coalesce("centre", ENTITY_UID).alias(CLUSTER_ID))


def best_match_clusters(matches: DataFrame, records: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Each record with its partner of largest confidence (ties: the smaller uid); the smaller uid names the cluster."""
    good = matches.where(F.col(CONFIDENCE) >= min_confidence)
    each = good.select(F.col(LEFT).alias("u"), F.col(RIGHT).alias("w"), CONFIDENCE).unionByName(good.select(F.col(RIGHT).alias("u"), F.col(LEFT).alias("w"), CONFIDENCE))
    # The smallest partner of each confidence first: a long in place, where structs would be sorted.
    few = each.groupBy("u", CONFIDENCE).agg(F.min("w").alias("w"))
    best = few.groupBy("u").agg(F.max_by("w", F.struct(CONFIDENCE, -F.col("w"))).alias("w"))
    own = records.select(ENTITY_UID).dropDuplicates()
    return own.join(best, own[ENTITY_UID] == best["u"], "left").select(ENTITY_UID, F.least(ENTITY_UID, F.coalesce("w", ENTITY_UID)).alias(CLUSTER_ID))


def cluster(method: str, matches: DataFrame, records: DataFrame, min_confidence: float = 0.0, max_rounds: int | None = None) -> DataFrame:
    if method == "connected_components":
        return connected_components(matches, records, max_rounds)
    if method in ("star", "best_match"):
        return {"star": star_clusters, "best_match": best_match_clusters}[method](matches, records, min_confidence)
    raise ValueError(f"unknown clustering method {method!r}")


def canonical_index(records: DataFrame) -> DataFrame:
    """The empty index for records like these."""
    return records.withColumn(CLUSTER_ID, F.lit(None).cast("long")).limit(0)


def merge_canonical_index(index: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """The index with the records' rows added or renewed, and the new cluster of every row, also of
    earlier records that aren't in this batch. labels: as of incremental_labels, which names only
    the clusters that change."""
    rest = [c for c in index.columns if c != CLUSTER_ID]
    old = index.select(F.col(ENTITY_UID).alias("_u"), F.col(CLUSTER_ID).alias("_old"))
    new = records.select(*rest).join(old, F.col(ENTITY_UID) == F.col("_u"), "left").select(*rest, F.coalesce("_old", ENTITY_UID).alias(CLUSTER_ID))
    rows = index.join(records.select(ENTITY_UID), ENTITY_UID, "left_anti").select(*rest, CLUSTER_ID).unionByName(new)
    return rows.join(labels, CLUSTER_ID, "left").withColumn(CLUSTER_ID, F.coalesce("label", CLUSTER_ID)).select(*index.columns)


def cluster_quality(clusters: DataFrame, matches: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row on sizes, sources and confidence. The median size is exact, from counts of sizes."""
    own = clusters if records is None else clusters.join(records.select(ENTITY_UID, SOURCE_NAME), ENTITY_UID)
    sources = F.lit(None).cast("long") if records is None else F.count_distinct(SOURCE_NAME)
    per = own.groupBy(CLUSTER_ID).agg(F.count("*").alias("size"), sources.alias("sources"))
    sizes = per.agg(
        F.count("*").alias("cluster_count"), F.count_if(F.col("size") == 1).alias("singleton_count"), F.max("size").alias("max_size"),
        F.avg("size").alias("avg_size"), F.expr("median(size)").alias("median_size"), F.avg("sources").alias("avg_source_diversity"))
    confidence = matches.agg(F.avg(CONFIDENCE).alias("avg_confidence"), F.min(CONFIDENCE).alias("min_confidence"))
    return sizes.crossJoin(confidence).withColumn("singleton_ratio", F.try_divide("singleton_count", "cluster_count"))  # one row each


def shaping_columns(matches: DataFrame, clusters: DataFrame, hub_degree: int | None = 20) -> DataFrame:
    """entity_uid, cluster_size, is_hub of each record, which matches can carry to shape_confidence."""
    sizes = clusters.groupBy(CLUSTER_ID).agg(F.count("*").alias("cluster_size"))
    own = clusters.join(sizes, CLUSTER_ID).select(ENTITY_UID, "cluster_size")
    if hub_degree is None:
        return own.withColumn("is_hub", F.lit(False))
    ends = [matches.groupBy(F.col(c).alias(ENTITY_UID)).agg(F.count("*").alias("degree")) for c in (LEFT, RIGHT)]
    hubs = ends[0].unionByName(ends[1]).groupBy(ENTITY_UID).agg(F.sum("degree").alias("degree")).where(F.col("degree") > hub_degree)
    return own.join(hubs.select(ENTITY_UID, F.lit(True).alias("is_hub")), ENTITY_UID, "left").withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))


def shape_confidence(matches: DataFrame, clusters: DataFrame | None, group_size_threshold: int | None = 10, penalty_rate: float = 0.02, hub_degree: int | None = 20) -> DataFrame:
    """Confidence lowered in large clusters, at most by half, and a flag for records with many
    matches; the confidence before stays in original_confidence. None switches a part off. Matches that
    carry the shaping columns need no clusters."""
    if carries(matches):
        out = matches.withColumns({"cluster_size": F.col("l.cluster_size"), "original_confidence": F.col(CONFIDENCE)})
        out = _lowered(out, group_size_threshold, penalty_rate)
        return out if hub_degree is None else out.withColumn("is_hub", F.col("l.is_hub") | F.col("r.is_hub"))
    sizes = clusters.groupBy(CLUSTER_ID).agg(F.count("*").alias("cluster_size"))
    own = clusters.join(sizes, CLUSTER_ID).select(F.col(ENTITY_UID).alias(LEFT), "cluster_size")
    out = _lowered(matches.join(own, LEFT, "left").withColumn("original_confidence", F.col(CONFIDENCE)), group_size_threshold, penalty_rate)
    if hub_degree is not None:
        ends = matches.select(F.col(LEFT).alias("u")).unionByName(matches.select(F.col(RIGHT).alias("u")))
        hubs = ends.groupBy("u").agg(F.count("*").alias("degree")).where(F.col("degree") > hub_degree).select("u")
        out = out.join(hubs.select(F.col("u").alias(LEFT), F.lit(True).alias("_a")), LEFT, "left").join(hubs.select(F.col("u").alias(RIGHT), F.lit(True).alias("_b")), RIGHT, "left")
        out = out.withColumn("is_hub", F.coalesce(F.col("_a") | F.col("_b"), F.col("_a"), F.col("_b"), F.lit(False))).drop("_a", "_b")
    return out


def _lowered(matches: DataFrame, group_size_threshold: int | None, penalty_rate: float) -> DataFrame:
    if group_size_threshold is None:
        return matches
    over = F.col("cluster_size") - group_size_threshold
    return matches.withColumn(CONFIDENCE, F.when(over > 0, F.col(CONFIDENCE) * F.greatest(F.lit(0.5), 1 - over * penalty_rate)).otherwise(F.col(CONFIDENCE)))


def cluster_stability(clusters: DataFrame, prior: DataFrame) -> DataFrame:
    """entity_uid, prior and current cluster, and change: new_entity, reassigned, removed or unchanged."""
    now = clusters.select(ENTITY_UID, F.col(CLUSTER_ID).alias("current_cluster_id"))
    then = prior.select(ENTITY_UID, F.col(CLUSTER_ID).alias("prior_cluster_id"))
    both = now.join(then, ENTITY_UID, "full")
    change = F.when(F.col("prior_cluster_id").isNull(), "new_entity").when(F.col("current_cluster_id").isNull(), "removed")
    return both.withColumn("change", change.when(F.col("prior_cluster_id") != F.col("current_cluster_id"), "reassigned").otherwise("unchanged"))
