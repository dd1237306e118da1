"""Match probabilities of comparison levels: from labels, or by expectation-maximisation.

EM runs on the counts of distinct patterns of levels, one aggregation over the pairs; their
number depends on the levels, not on the pairs, so that the iterations need no Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ENTITY_UID, LEFT, RIGHT
from .pairs import paired
from .scoring import Comparison, Level

FLOOR, CEILING = 0.001, 0.999


@dataclass(frozen=True)
class Parameters:
    """m and u of (comparison, level), and the share of matches."""

    m: dict[tuple[str, str], float]
    u: dict[tuple[str, str], float]
    match_rate: float
    iterations: int = 0

    @property
    def log_prior_odds(self) -> float:
        p = min(max(self.match_rate, FLOOR), CEILING)
        return log2(p / (1 - p))

    def frame(self) -> pd.DataFrame:
        rows = [(c, lv, self.m[c, lv], self.u[c, lv], log2(self.m[c, lv] / self.u[c, lv])) for c, lv in self.m]
        return pd.DataFrame(rows, columns=["comparison", "level", "m", "u", "log_weight"])


def _levels(c: Comparison) -> tuple[Level, ...]:
    return c.levels or (Level("match", c.test), Level("else"))


def level_patterns(pairs: DataFrame, records: DataFrame, comparisons: Sequence[Comparison], extra: Sequence[str] = ()) -> DataFrame:
    """Each pair's level index by comparison (columns g0, g1, ...), with the extra columns."""
    names = {x for c in comparisons for lv in _levels(c) if lv.test for x in lv.test.columns()}
    df = paired(pairs.select(*(c for c in pairs.columns if c not in names)), records, names)
    cols = []
    for i, c in enumerate(comparisons):
        out, rest = None, len(_levels(c)) - 1
        for k, lv in enumerate(_levels(c)):
            if lv.test is None:
                rest = k
                continue
            hit = F.coalesce(lv.test.value(), F.lit(False))
            out = F.when(hit, k) if out is None else out.when(hit, k)
        cols.append((out.otherwise(rest) if out is not None else F.lit(rest)).cast("int").alias(f"g{i}"))
    return df.select(*cols, *extra)


def sample_pairs(pairs: DataFrame, size: int) -> DataFrame:
    """A sample that is the same in every run: the pairs of smallest hash."""
    return pairs.orderBy(F.xxhash64(LEFT, RIGHT), LEFT, RIGHT).limit(size)


def estimate_em(pairs: DataFrame, records: DataFrame, comparisons: Sequence[Comparison], max_iterations: int = 25, tolerance: float = 0.001, sample_size: int | None = None, initial_match_rate: float = 0.1) -> Parameters:
    if sample_size:
        pairs = sample_pairs(pairs, sample_size)
    names = [f"g{i}" for i in range(len(comparisons))]
    counted = level_patterns(pairs, records, comparisons).groupBy(*names).agg(F.count("*").alias("n")).toPandas().sort_values(names)
    patterns, n = counted[names].to_numpy(int), counted["n"].to_numpy(float)
    sizes = [len(_levels(c)) for c in comparisons]
    m = [np.clip(np.r_[0.9, np.full(s - 1, 0.1 / max(s - 1, 1))], FLOOR, CEILING) for s in sizes]
    u = [np.clip(np.r_[0.1, np.full(s - 1, 0.9 / max(s - 1, 1))], FLOOR, CEILING) for s in sizes]
    rate, before, done = initial_match_rate, -np.inf, 0
    for done in range(1, max_iterations + 1):
        if not len(n):
            break
        a = rate * np.prod([m[i][patterns[:, i]] for i in range(len(sizes))], axis=0)
        b = (1 - rate) * np.prod([u[i][patterns[:, i]] for i in range(len(sizes))], axis=0)
        w = a / (a + b)
        likelihood = float((n * np.log(a + b)).sum())
        old = np.concatenate([*m, *u, [rate]])
        for i, s in enumerate(sizes):
            hit = np.array([(n * w * (patterns[:, i] == k)).sum() for k in range(s)])
            miss = np.array([(n * (1 - w) * (patterns[:, i] == k)).sum() for k in range(s)])
            m[i] = np.clip(hit / max((n * w).sum(), 1e-12), FLOOR, CEILING)
            u[i] = np.clip(miss / max((n * (1 - w)).sum(), 1e-12), FLOOR, CEILING)
        rate = float(np.clip((n * w).sum() / n.sum(), FLOOR, CEILING))
        if np.abs(np.concatenate([*m, *u, [rate]]) - old).max() < tolerance or abs(likelihood - before) < tolerance:
            break
        before = likelihood
    key = [(c.label, lv.label) for c in comparisons for lv in _levels(c)]
    return Parameters(dict(zip(key, np.concatenate(m).tolist(), strict=True)), dict(zip(key, np.concatenate(u).tolist(), strict=True)), rate, done)


def estimate_from_labels(labelled: DataFrame, records: DataFrame, comparisons: Sequence[Comparison], label: str = "is_match", empty: float | None = None) -> DataFrame:
    """comparison, level, m, u, match_rate, from pairs with a boolean label, in one pass. empty: the
    shares of a kind of which there are no pairs."""
    names = [f"g{i}" for i in range(len(comparisons))]
    rows = level_patterns(labelled, records, comparisons, [label]).groupBy(label, *names).agg(F.count("*").alias("n"))
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    yes, no = many(F.col(label)), many(~F.col(label))
    counts = [F.struct(F.lit(c.label).alias("comparison"), F.lit(lv.label).alias("level"), many(F.col(label) & (F.col(f"g{i}") == k)).alias("a"), many(~F.col(label) & (F.col(f"g{i}") == k)).alias("b")) for i, c in enumerate(comparisons) for k, lv in enumerate(_levels(c))]
    one = rows.agg(yes.alias("yes"), no.alias("no"), F.array(*counts).alias("c")).select("yes", "no", F.explode("c").alias("x"))
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(FLOOR)), F.lit(CEILING))).otherwise(F.lit(empty).cast("double"))
    return one.select("x.comparison", "x.level", clamp(F.try_divide(F.col("x.a"), F.col("yes"))).alias("m"), clamp(F.try_divide(F.col("x.b"), F.col("no"))).alias("u"), F.try_divide(F.col("yes"), F.col("yes") + F.col("no")).alias("match_rate"))


def reestimate(patterns: DataFrame, comparisons: Sequence[Comparison], weight: str = "w") -> DataFrame:
    """comparison, level, m, u: the maximisation step from level patterns with match weights."""
    w = F.col(weight)
    parts = []
    for i, c in enumerate(comparisons):
        for k, lv in enumerate(_levels(c)):
            hit = (F.col(f"g{i}") == k).cast("double")
            parts.append(F.struct(F.lit(c.label).alias("comparison"), F.lit(lv.label).alias("level"), F.try_divide(F.sum(w * hit), F.sum(w)).alias("m"), F.try_divide(F.sum((1 - w) * hit), F.sum(1 - w)).alias("u")))
    return patterns.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def with_parameters(comparisons: Sequence[Comparison], p: Parameters) -> tuple[Comparison, ...]:
    """The comparisons with estimated m and u in their levels."""
    from dataclasses import replace

    return tuple(replace(c, levels=tuple(replace(lv, m=p.m[c.label, lv.label], u=p.u[c.label, lv.label]) for lv in _levels(c))) for c in comparisons)


