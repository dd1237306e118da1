"""Candidate pairs by equal blocking keys, on several paths, with caps on hot keys.

A key's number of pairs is known from its number of records, so keys over the cap are left out
before the self-join: the pairs of a hot key are never made. Whether an earlier path finds a pair
too shows from the keys of its two records, so that no pair is shuffled to find those made twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ENTITY_UID, LEFT, RIGHT, SOURCE_NAME
from .pairs import RECORDS, paired


@dataclass(frozen=True)
class BlockingPath:
    """Records pair when all keys are equal. Limits: pairs of a key, candidates of a left record; 0: none."""

    keys: tuple[str, ...] = ()
    lsh_keys: tuple[str, ...] = ()
    candidate_limit: int = 0
    bucket_size_limit: int = 0


@dataclass(frozen=True)
class Blocking:
    paths: tuple[BlockingPath, ...]
    link_type: str = "link_and_dedupe"
    lsh_min_bands: int = 0
    warnings: tuple[str, ...] = field(default=())


def check_paths(p: Blocking) -> list[str]:
    out = [f"path {i} has no keys" for i, x in enumerate(p.paths) if not (*x.keys, *x.lsh_keys)]
    out += [f"path {i}: candidate limit over 10000" for i, x in enumerate(p.paths) if x.candidate_limit > 10_000]
    return out + [f"path {i}: a limit is negative" for i, x in enumerate(p.paths) if x.candidate_limit < 0 or x.bucket_size_limit < 0]


def collision_probability(similarity: float, functions: int, tables: int) -> float:
    """Of vectors of this cosine similarity meeting in at least one of the tables."""
    from math import acos, pi

    return 1 - (1 - (1 - acos(max(-1.0, min(1.0, similarity))) / pi) ** functions) ** tables


def _link(link_type: str) -> Column:
    same = F.col("_ls") == F.col("_rs")
    kinds = {"dedupe_only": same, "link_only": ~same, "link_and_dedupe": F.lit(True)}
    return kinds[link_type]


def _path(left: DataFrame, right: DataFrame, path: BlockingPath, link_type: str, intra: bool) -> DataFrame:
    keys = [*path.keys, *path.lsh_keys]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    side = lambda df, uid, src: df.where(whole).select(*(F.col(k).alias(n) for k, n in named.items()), F.col(ENTITY_UID).alias(uid), F.col(SOURCE_NAME).alias(src))
    a, b = side(left, LEFT, "_ls"), side(right, RIGHT, "_rs")
    on = list(named.values())
    if path.bucket_size_limit:
        a = a.join(_small_keys(a, b, on, path.bucket_size_limit, link_type, intra), on, "left_semi")
    order = F.col(LEFT) < F.col(RIGHT) if intra else F.col(LEFT) != F.col(RIGHT)
    pairs = a.join(b, on).where(order & _link(link_type)).select(LEFT, RIGHT)
    if path.candidate_limit:
        by = Window.partitionBy(LEFT).orderBy(RIGHT)
        pairs = pairs.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= path.candidate_limit).drop("_n")
    return pairs


def _small_keys(a: DataFrame, b: DataFrame, on: list[str], limit: int, link_type: str, intra: bool) -> DataFrame:
    """Keys whose number of pairs, told from counts by source, is within the limit."""
    left = a.groupBy(*on, F.col("_ls").alias("_s")).agg(F.count("*").alias("n"))
    if intra:
        per = left.groupBy(*on).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("own"))
        total = F.col("n") * (F.col("n") - 1) / 2
        pairs = {"dedupe_only": F.col("own"), "link_only": total - F.col("own"), "link_and_dedupe": total}[link_type]
        return per.where(pairs <= limit).select(*on)
    right = b.groupBy(*on, F.col("_rs").alias("_s")).agg(F.count("*").alias("m"))
    l_all = left.groupBy(*on).agg(F.sum("n").alias("n"))
    r_all = right.groupBy(*on).agg(F.sum("m").alias("m"))
    same = left.join(right, [*on, "_s"]).groupBy(*on).agg(F.sum(F.col("n") * F.col("m")).alias("own"))
    per = l_all.join(r_all, on).join(same, on, "left")
    own, total = F.coalesce("own", F.lit(0)), F.col("n") * F.col("m")
    pairs = {"dedupe_only": own, "link_only": total - own, "link_and_dedupe": total}[link_type]
    return per.where(pairs <= limit).select(*on)


def _keys(path: BlockingPath, link_type: str) -> list[str]:
    """The columns whose equality makes a pair, as it shows from two records alone."""
    return [*path.keys, *path.lsh_keys, *([SOURCE_NAME] if link_type == "dedupe_only" else [])]


def _binding(path: BlockingPath) -> int:
    """The candidate limit, or 0 where keys within the bucket limit have no more partners for a record."""
    most = (1 + isqrt(1 + 8 * path.bucket_size_limit)) // 2 - 1
    return 0 if path.bucket_size_limit and most <= path.candidate_limit else path.candidate_limit


def streams(records: DataFrame, p: Blocking, canonical: DataFrame | None = None) -> bool:
    """Whether each pair is made once without a look at other pairs: at most one path has limits, and
    a uid is in one row only."""
    limited = [x for x in p.paths if x.candidate_limit or x.bucket_size_limit]
    if len(limited) > 1 or p.lsh_min_bands > 1:
        return False
    if any(x.candidate_limit for x in limited) and (canonical is not None or p.link_type == "link_only"):
        return False
    uids = records.select(ENTITY_UID) if canonical is None else records.select(ENTITY_UID).unionByName(canonical.select(ENTITY_UID))
    return uids.groupBy(ENTITY_UID).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _by_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows dealt out by key, in several parts for each core: pairs are many more than the records, of
    which Spark would make few parts."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(3 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *on)


def _stream(left: DataFrame, right: DataFrame, path: BlockingPath, earlier: Sequence[BlockingPath], gone: Blocking | None, link_type: str, intra: bool, columns: Sequence[str] | None, seeds: bool, apart: str | None) -> DataFrame:
    keys = _keys(path, link_type)
    others = [(x, link_type) for x in earlier] + [(x, gone.link_type) for x in (gone.paths if gone else ())]
    names = {*(columns or ()), *(k for x, link in others for k in _keys(x, link) if k not in keys), *([apart] if apart else ())}
    names |= {SOURCE_NAME} if "link_only" in (link_type, *(link for _, link in others)) or path.bucket_size_limit else set()
    names = sorted(names - {ENTITY_UID})
    on = [f"_k{i}" for i in range(len(keys))]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    side = lambda df, s: df.where(whole).select(*(F.col(k).alias(n) for k, n in zip(keys, on, strict=True)), *(F.col(c).alias(f"_{s}_{c}") for c in (ENTITY_UID, *names)))
    a, b = side(left, "l"), side(right, "r")
    l_, r_ = (lambda c: F.col(f"_l_{c}")), (lambda c: F.col(f"_r_{c}"))
    if path.bucket_size_limit:
        own = on[: len(path.keys) + len(path.lsh_keys)]
        small = _small_keys(a.withColumnRenamed(f"_l_{SOURCE_NAME}", "_ls"), b.withColumnRenamed(f"_r_{SOURCE_NAME}", "_rs"), own, path.bucket_size_limit, link_type, intra)
        a, b = a.join(small, own, "left_semi"), b.join(small, own, "left_semi")
    limit = _binding(path)
    if limit or seeds:
        at = lambda df, s: df.withColumn(f"_{s}_at", F.row_number().over(Window.partitionBy(*on).orderBy(f"_{s}_{ENTITY_UID}")) - 1)
        a, b = at(a, "l"), at(b, "r")
    if apart:
        several = b.groupBy(*on).agg(F.min(r_(apart)).alias("_a"), F.max(r_(apart)).alias("_b")).where("_a != _b").select(*on)
        a, b = a.join(several, on, "left_semi"), b.join(several, on, "left_semi")
    test = l_(ENTITY_UID) < r_(ENTITY_UID) if intra else F.lit(True)
    if seeds:
        a = a.where(l_("at") % limit == 0) if limit else a.where(l_("at") == 0)
    if limit:
        # A record's candidates are the next records of its key: a run of them, or the run after that.
        a, b = a.withColumn("_run", F.explode(F.array(F.floor(l_("at") / limit), F.floor(l_("at") / limit) + 1))), b.withColumn("_run", F.floor(r_("at") / limit))
        on, test = [*on, "_run"], (r_("at") > l_("at")) & (r_("at") - l_("at") <= limit)
    if link_type == "link_only":
        test = test & (l_(SOURCE_NAME) != r_(SOURCE_NAME))
    if apart:
        test = test & (l_(apart) != r_(apart))
    for x, link in others:
        same = [l_(k) == r_(k) for k in _keys(x, link) if k not in keys] + ([l_(SOURCE_NAME) != r_(SOURCE_NAME)] if link == "link_only" else [])
        test = test & ~F.coalesce(reduce(lambda a, b: a & b, same, F.lit(True)), F.lit(False))
    pairs = _by_keys(a, on).join(_by_keys(b, on).hint("merge"), on).where(test)
    own = [ENTITY_UID, *sorted({*(columns or ()), *([apart] if apart else [])} - {ENTITY_UID})]
    carried = [F.struct(*(F.col(f"_{s}_{c}").alias(c) for c in own)).alias(s) for s in RECORDS] if columns is not None else []
    return pairs.select(l_(ENTITY_UID).alias(LEFT), r_(ENTITY_UID).alias(RIGHT), *carried)


def block(records: DataFrame, p: Blocking, canonical: DataFrame | None = None, excluded: DataFrame | Blocking | None = None, columns: Sequence[str] | None = None, seeds: bool = False, apart: str | None = None) -> DataFrame:
    """left_entity_uid, right_entity_uid: each pair once, left below right among records, and
    new record left, canonical record right across batches. excluded: pairs to leave out, in either
    order, or what blocks them among all these records. columns: pairs carry these columns of their
    records in structs l and r. seeds: of each key only pairs with its first record, or with the first
    of each run as long as the candidate limit. apart: pairs of equal values in this column are left out."""
    if bad := check_paths(p):
        raise ValueError("; ".join(bad))
    gone = excluded if isinstance(excluded, Blocking) else None
    if gone is not None:
        if bad := check_paths(gone):
            raise ValueError("; ".join(bad))
        if gone.lsh_min_bands > 1 or any(x.candidate_limit or x.bucket_size_limit for x in gone.paths):
            everyone = records if canonical is None else records.unionByName(canonical, allowMissingColumns=True)
            gone, excluded = None, block(everyone, gone)
    if streams(records, p, canonical):
        paths = sorted(p.paths, key=lambda x: bool(x.candidate_limit or x.bucket_size_limit))
        sides = [(records, True), *([(canonical, False)] if canonical is not None else [])]
        found = [_stream(records, right, x, paths[:i], gone, p.link_type, intra, columns, seeds, apart) for i, x in enumerate(paths) for right, intra in sides]
        pairs = reduce(lambda a, b: a.unionByName(b), found)
    elif seeds or apart:
        raise ValueError("seeds and apart need paths of which at most one has limits, and unique uids")
    else:
        pairs = _shuffled(records, p, canonical)
        if gone is not None:
            excluded = block(records if canonical is None else records.unionByName(canonical, allowMissingColumns=True), gone)
    if isinstance(excluded, DataFrame):
        # One orientation on both sides makes this an equi-join.
        low, high = F.least(LEFT, RIGHT), F.greatest(LEFT, RIGHT)
        out = excluded.select(low.alias("_lo"), high.alias("_hi")).dropDuplicates()
        pairs = pairs.withColumns({"_lo": low, "_hi": high}).join(out, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")
    return pairs if columns is None or "l" in pairs.columns else _carried(pairs, records, canonical, columns)


def _carried(pairs: DataFrame, records: DataFrame, canonical: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    names = sorted({*columns} - {ENTITY_UID})
    own = records.select(ENTITY_UID, *names)
    if canonical is not None:
        own = own.unionByName(canonical.select(ENTITY_UID, *names)).dropDuplicates([ENTITY_UID])
    structs = [F.struct(*(F.col(f"{s}.{c}").alias(c) for c in (ENTITY_UID, *names))).alias(s) for s in RECORDS]
    return paired(pairs, own, names).select(F.col(LEFT), F.col(RIGHT), *structs)


def _shuffled(records: DataFrame, p: Blocking, canonical: DataFrame | None) -> DataFrame:
    """The pairs where several paths have limits or uids repeat: those made twice meet by their uids."""
    found = [_path(records, records, x, p.link_type, True) for x in p.paths]
    if canonical is not None:
        found += [_path(records, canonical, x, p.link_type, False) for x in p.paths]
    pairs = reduce(lambda a, b: a.unionByName(b), found)
    if p.lsh_min_bands > 1:
        return pairs.groupBy(LEFT, RIGHT).agg(F.count("*").alias("_n")).where(F.col("_n") >= p.lsh_min_bands).drop("_n")
    return pairs.dropDuplicates([LEFT, RIGHT])


def blocking_metrics(records: DataFrame, candidates: DataFrame, matches: DataFrame, tier: str) -> DataFrame:
    """One row: totals, share of candidates that match, and the part of all pairs that blocking saves."""
    n = records.agg(F.count("*").alias("total_entities"))
    c = candidates.agg(F.count("*").alias("candidate_pairs"))
    m = matches.agg(F.count("*").alias("matched_pairs"))
    every = F.col("total_entities") * (F.col("total_entities") - 1) / 2
    one = n.crossJoin(c).crossJoin(m)  # three rows of one
    return one.select(F.lit(tier).alias("tier_name"), "total_entities", "candidate_pairs", "matched_pairs",
        F.try_divide("matched_pairs", "candidate_pairs").alias("precision"),
        (1 - F.try_divide(F.col("candidate_pairs"), every)).alias("reduction_ratio"))


def blocking_effectiveness(tiers: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Of (tier, records, candidates): all pairs, saving, candidates for each left record."""
    out = []
    for name, records, candidates in tiers:
        n = records.agg(F.count("*").alias("n"))
        per = candidates.groupBy(LEFT).agg(F.count("*").alias("c"))
        c = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("candidate_pairs"), F.avg("c").alias("avg_candidates"), F.max("c").alias("max_candidates"))
        every = F.col("n") * (F.col("n") - 1) / 2
        out.append(n.crossJoin(c).select(F.lit(name).alias("tier_name"), every.cast("long").alias("cartesian_pairs"), "candidate_pairs", (1 - F.try_divide(F.col("candidate_pairs"), every)).alias("reduction_ratio"), "avg_candidates", "max_candidates"))
    return reduce(lambda a, b: a.unionByName(b), out)
