"""Scoring of candidate pairs: weighted sums and Fellegi-Sunter, with signals, bands and audit.

The cheap tests come first: pairs that a hard negative disqualifies are gone before anything is
scored, and of the records only the columns that the tests name are joined to the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import AUTO, BAND, CONFIDENCE, DETAIL, ENTITY_UID, LEFT, RIGHT, SCORE, TIER_NAME, TIER_PRIORITY, score_column, weight_column
from ..functions import comparisons as C
from ..functions.registry import COMPARISONS
from .pairs import RECORDS, carries, paired

#: Parameters of comparisons that name a column of the left or right record.
COLUMN_PARAMS = {"left_end": "l", "right_end": "r", "left_lon": "l", "right_lon": "r"}


@dataclass(frozen=True)
class Test:
    """A comparison of two columns, or SQL over the aliases l and r."""

    left: str = ""
    right: str = ""
    method: str = "exact"
    params: dict = field(default_factory=dict)
    sql: str | None = None

    @property
    def name(self) -> str:
        return f"{self.left}_{self.method}" if self.sql is None else "sql_" + re.sub(r"\W+", "_", self.sql).strip("_").lower()

    def columns(self) -> set[str]:
        if self.sql is not None:
            return set(re.findall(r"\b[lr]\.(\w+)", self.sql))
        return {self.left, self.right or self.left, *(self.params[k] for k in COLUMN_PARAMS if k in self.params), *({f"{self.left}_end", f"{self.right or self.left}_end"} if "overlap" in self.method else ())}

    def value(self, strict: bool = False) -> Column:
        if self.sql is not None:
            return F.expr(self.sql)
        left, right = F.col(f"l.{self.left}"), F.col(f"r.{self.right or self.left}")
        if self.method == "both_null":
            return left.isNull() & right.isNull()
        if self.method == "different" and strict:
            return ~left.eqNullSafe(right)
        params = {k: F.col(f"{COLUMN_PARAMS[k]}.{v}") if k in COLUMN_PARAMS else v for k, v in self.params.items()}
        if self.method.startswith("date_overlap"):
            params = {"left_end": F.col(f"l.{self.left}_end"), "right_end": F.col(f"r.{self.right or self.left}_end")} | params
        return COMPARISONS.call(self.method, left, right, **params)

    @property
    def graded(self) -> bool:
        return self.sql is None and self.method.endswith("_score")

    @property
    def cost(self) -> int:
        return C.COST.get(self.method, 1)


@dataclass(frozen=True)
class TermFrequency:
    column: str
    minimum_u: float = 0.01


@dataclass(frozen=True)
class Level:
    """An outcome of a comparison; a level without a test is what is left."""

    label: str
    test: Test | None = None
    m: float = 0.9
    u: float = 0.1
    log_weight: float = 0.0
    tf_adjusted: bool = False

    @property
    def weight(self) -> float:
        return self.log_weight or log2(self.m / self.u)


@dataclass(frozen=True)
class Comparison:
    test: Test
    weight: float = 1.0
    name: str = ""
    levels: tuple[Level, ...] = ()
    tf: TermFrequency | None = None

    @property
    def label(self) -> str:
        return self.name or self.test.name


@dataclass(frozen=True)
class Signal:
    """kind: disqualify, penalize, bonus, boost, auto_match or elevate_band. entity_type: both
    records' entity_type must be that. strict: null differs from a value."""

    test: Test
    kind: str
    value: float = 0.0
    band: str = "HIGH"
    entity_type: str | None = None
    strict: bool = False
    requires_overrides: int = 0

    def condition(self) -> Column:
        hit = F.coalesce(self.test.value(self.strict), F.lit(False))
        if self.entity_type:
            hit = F.coalesce((F.col("l.entity_type") == self.entity_type) & (F.col("r.entity_type") == self.entity_type), F.lit(False)) & hit
        return hit


@dataclass(frozen=True)
class Band:
    name: str
    min_score: float
    max_score: float = 999_999.0
    action: str = "accept"


@dataclass(frozen=True)
class Scoring:
    """method: sum, min_all (every comparison must hold) or fellegi_sunter."""

    tier_name: str
    comparisons: tuple[Comparison, ...]
    method: str = "sum"
    tier_index: int = 0
    min_score: float = 0.0
    match_threshold: float | None = None
    min_matching_comparisons: int = 0
    log_prior_odds: float = 0.0
    signals: tuple[Signal, ...] = ()
    bands: tuple[Band, ...] = ()
    confidence: float | None = None
    confidence_method: str = "ratio"
    audit: bool = False


def columns(p: Scoring) -> list[str]:
    """The columns of the records that scoring reads."""
    names = {c for x in p.comparisons for c in x.test.columns()} | {c for x in p.comparisons for lv in x.levels if lv.test for c in lv.test.columns()}
    names |= {c for s in p.signals for c in s.test.columns()} | {x.tf.column for x in p.comparisons if x.tf}
    names |= {"entity_type"} if any(s.entity_type for s in p.signals) else set()
    return sorted(names - {ENTITY_UID, ""})


def _pairs(candidates: DataFrame, records: DataFrame, p: Scoring, tf: DataFrame | None) -> DataFrame:
    df = paired(candidates.select(LEFT, RIGHT, *(RECORDS if carries(candidates) else ())), records, columns(p))
    for i, x in enumerate(p.comparisons):
        if x.tf and tf is not None:
            own_tf = tf.where(F.col("term_frequency_column") == x.tf.column).select(F.col("term_frequency_value").alias(f"_v{i}"), F.col("term_frequency_ratio").alias(f"_tf{i}"))
            df = df.join(own_tf, F.col(f"l.{x.tf.column}").cast("string") == F.col(f"_v{i}"), "left")
    return df


def _ratio(i: int, x: Comparison, tf: DataFrame | None) -> Column:
    floor = F.lit(x.tf.minimum_u)
    return F.greatest(F.coalesce(F.col(f"_tf{i}"), floor), floor) if tf is not None else floor


def _sum_part(i: int, x: Comparison, tf: DataFrame | None) -> Column:
    weight = F.lit(float(x.weight))
    if x.tf:
        weight = weight * F.log(1 / _ratio(i, x, tf))
    value = x.test.value()
    return weight * F.coalesce(value, F.lit(0.0)) if x.test.graded else F.when(value, weight).otherwise(F.lit(0.0))


def _level_part(i: int, x: Comparison, tf: DataFrame | None) -> Column:
    out, rest = None, 0.0
    for lv in x.levels or (Level("match", x.test), Level("else", None, 0.1, 0.9)):
        if lv.test is None:
            rest = lv.weight
            continue
        weight = F.lit(log2(lv.m)) - F.log2(F.greatest(F.lit(lv.u), _ratio(i, x, tf))) if lv.tf_adjusted and x.tf else F.lit(lv.weight)
        hit = F.coalesce(lv.test.value(), F.lit(False))
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return F.coalesce(out.otherwise(F.lit(rest)) if out is not None else F.lit(rest), F.lit(0.0))


def _ratio_confidence(p: Scoring, weights: Sequence[float]) -> Column:
    """The score's share of the largest one, to four digits. Few tests that hold or don't give few scores:
    those are rounded here, as rounding takes longer than making and scoring a pair."""
    most, s = sum(x.weight for x in p.comparisons) or 1.0, F.col(SCORE)
    out = F.round(s / most, 4)
    if len(weights) > 4 or any(x.test.graded or x.tf for x in p.comparisons):
        return out
    totals = {0.0}
    for w in weights:
        totals |= {t + float(w) for t in totals}
    known = None
    for t in sorted(totals, reverse=True):
        if t >= p.min_score:
            share = F.lit(float(Decimal(repr(t / most)).quantize(Decimal("0.0001"), ROUND_HALF_UP)))
            known = F.when(s == t, share) if known is None else known.when(s == t, share)
    return out if known is None else known.otherwise(out)


def score_pairs(candidates: DataFrame, records: DataFrame, p: Scoring, tf: DataFrame | None = None, carry: bool = False) -> DataFrame:
    """The pairs that reach the threshold, with score, confidence, a column for each comparison,
    and, where asked for, band, automatic match and the comparisons as JSON. carry: structs l and r
    that the candidates carry stay."""
    carried = RECORDS if carry and carries(candidates) else ()
    fs = p.method == "fellegi_sunter"
    ordered = sorted(range(len(p.comparisons)), key=lambda i: p.comparisons[i].test.cost)
    column = weight_column if fs else score_column
    df = _pairs(candidates, records, p, tf)
    # What a hard negative disqualifies goes first, the cheapest test before the others.
    hard = sorted((s for s in p.signals if s.kind == "disqualify" and not s.requires_overrides), key=lambda s: s.test.cost)
    for s in hard:
        df = df.where(~s.condition())
    parts = {column(p.comparisons[i].label): (_level_part if fs else _sum_part)(i, p.comparisons[i], tf) for i in ordered}
    soft = {f"_signal{i}": s.condition() for i, s in enumerate(p.signals) if s not in hard}
    df = df.select(LEFT, RIGHT, *carried, *(v.alias(k) for k, v in parts.items()), *(v.alias(k) for k, v in soft.items()))
    total = F.lit(float(p.log_prior_odds) if fs else 0.0)
    for k in parts:
        total = total + F.col(k)
    auto, elevated = F.lit(False), []
    for i, s in enumerate(p.signals):
        if s in hard:
            continue
        hit = F.col(f"_signal{i}")
        if s.kind in ("penalize", "bonus", "boost"):
            total = total + F.when(hit, F.lit(float(s.value))).otherwise(F.lit(0.0))
        elif s.kind == "auto_match":
            auto = auto | hit
        elif s.kind == "elevate_band":
            elevated.append((hit, s.band))
        elif s.kind == "disqualify":
            # Enough agreeing comparisons override it.
            agree = reduce(lambda a, b: a + b, [(F.col(k) > 0).cast("int") for k in parts])
            df = df.where(~(hit & (agree < s.requires_overrides)))
    df = df.withColumn(SCORE, total).withColumn(AUTO, auto)
    agreeing = reduce(lambda a, b: a + b, [(F.col(k) > 0).cast("int") for k in parts])
    least = p.match_threshold if fs and p.match_threshold is not None else p.min_score
    df = df.where((F.col(SCORE) >= least) | F.col(AUTO))
    if p.method == "min_all":
        df = df.where(agreeing == len(parts))
    if p.min_matching_comparisons:
        df = df.where(agreeing >= p.min_matching_comparisons)
    s = F.col(SCORE)
    if fs:
        confidence = F.when(s > 50, 1.0).when(s < -50, 0.0).otherwise(F.round(F.pow(F.lit(2.0), s) / (1 + F.pow(F.lit(2.0), s)), 4))
    elif p.confidence is not None:
        confidence = F.lit(float(p.confidence))
    elif p.confidence_method == "sigmoid":
        confidence = 1 / (1 + F.exp(-s))
    else:
        confidence = _ratio_confidence(p, [p.comparisons[i].weight for i in ordered])
    cols = {CONFIDENCE: confidence, TIER_NAME: F.lit(p.tier_name), TIER_PRIORITY: F.lit(p.tier_index)}
    if p.bands:
        band = None
        for hit, name in elevated:
            band = F.when(hit, name) if band is None else band.when(hit, name)
        for b in sorted(p.bands, key=lambda b: -b.min_score):
            test = (s >= b.min_score) & (s < b.max_score)
            band = F.when(test, b.name) if band is None else band.when(test, b.name)
        cols[BAND] = band.otherwise("UNCLASSIFIED")
    if p.audit:
        cols[DETAIL] = F.to_json(F.struct(*(F.col(column(x.label)) for x in p.comparisons)))
    df = df.withColumns(cols)
    kept = [LEFT, RIGHT, SCORE, CONFIDENCE, TIER_PRIORITY, TIER_NAME, *(column(x.label) for x in p.comparisons)]
    kept += [*(c for c in (DETAIL, BAND) if c in cols), *carried]
    return df.select(*kept, *([AUTO] if any(s.kind == "auto_match" for s in p.signals) else []))


MATCH_COLUMNS = [LEFT, RIGHT, SCORE, CONFIDENCE, TIER_PRIORITY, TIER_NAME]


def common_schema(matches: DataFrame) -> DataFrame:
    """Matches of any tier in one schema: the comparisons' columns become a map."""
    own = [c for c in matches.columns if c.startswith(("match_score_", "match_log_weight_"))]
    pairs = [x for c in own for x in (F.lit(c), F.col(c).cast("double"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    band = F.col(BAND) if BAND in matches.columns else F.lit(None).cast("string")
    auto = F.col(AUTO) if AUTO in matches.columns else F.lit(False)
    return matches.select(*MATCH_COLUMNS, band.alias(BAND), auto.alias(AUTO), details.alias("comparisons"), *(RECORDS if carries(matches) else ()))


def accumulate(earlier: DataFrame | None, matches: DataFrame) -> DataFrame:
    """All matches so far: pairs of a later tier that are there already, in either order, are left out.
    What is carried of the records, all tiers carry or none."""
    new = common_schema(matches)
    if earlier is None:
        return new
    low, high = F.least(LEFT, RIGHT), F.greatest(LEFT, RIGHT)
    seen = earlier.select(low.alias("_lo"), high.alias("_hi"))
    fresh = new.withColumns({"_lo": low, "_hi": high}).join(seen, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")
    return earlier.unionByName(fresh)
