"""Staging: one source table to records with a uid, filtered to what is new."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ENTITY_UID, PIPELINE_LOADED_AT, SOURCE_NAME, SOURCE_UPDATED_AT


@dataclass(frozen=True)
class SourceJoin:
    """on: an SQL condition over the aliases `src` and this one."""

    table: DataFrame
    on: str
    alias: str
    how: str = "left"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class PartitionCursor:
    """strategy: range (from value on), equality, or in (value is a list)."""

    column: str
    value: object
    strategy: str = "range"


@dataclass(frozen=True)
class HashCursor:
    column: str
    modulus: int = 1000
    alias: str = "_hash_partition"


@dataclass(frozen=True)
class Staging:
    """batch_size: rows from the first on, and those whose cursors equal the last one's, so that what a
    watermark cuts off is a whole batch. watermark: values by cursor column, in order. cursors: their columns while there is no value. grace_period_hours: read again what is that
    much older. cursor_mode: ordered (tuples beyond the watermark) or independent (any column)."""

    source_name: str
    unique_key: str
    updated_at: str
    columns: tuple[str, ...] = ()
    passthrough_columns: tuple[str, ...] = ()
    joins: tuple[SourceJoin, ...] = ()
    filter: str | None = None
    watermark: dict[str, object] = field(default_factory=dict)
    grace_period_hours: int = 0
    full_refresh: bool = False
    partition_column: str | None = None
    batch_size: int | None = None
    partition_cursors: tuple[PartitionCursor, ...] = ()
    cursor_mode: str = "ordered"
    hash_cursor: HashCursor | None = None
    cursors: tuple[str, ...] = ()


def record_uid(source_name: str, key: Column) -> Column:
    return F.xxhash64(F.concat(F.lit(source_name), F.lit("||"), key.cast("string")))


def beyond(watermark: dict[str, object], mode: str, grace_hours: int) -> Column:
    """Rows after the watermark. Late rows: the first cursor in ordered mode, every cursor in
    independent mode, is compared with a value that many hours before."""

    def late(value: object) -> Column:
        c = F.lit(value)
        return c - F.expr(f"INTERVAL {int(grace_hours)} HOURS") if grace_hours else c

    if mode == "independent":
        return reduce(lambda a, b: a | b, (F.col(c) > late(v) for c, v in watermark.items()))
    if mode != "ordered":
        raise ValueError(f"cursor mode {mode!r} is neither ordered nor independent")
    branches, equal = [], F.lit(True)
    for depth, (c, v) in enumerate(watermark.items()):
        branches.append(equal & (F.col(c) > (late(v) if depth == 0 else F.lit(v))))
        equal = equal & (F.col(c) == F.lit(v))
    return reduce(lambda a, b: a | b, branches)


def stage(source: DataFrame, p: Staging) -> DataFrame:
    df = source.alias("src")
    for j in p.joins:
        # The joined table is a look-up; whether it is broadcast is for its size to say.
        df = df.join(j.table.alias(j.alias), F.expr(j.on), j.how)
    if p.joins:
        df = df.select("src.*", *(F.col(f"{j.alias}.{c}").alias(c) for j in p.joins for c in j.columns))
    if p.filter:
        df = df.where(p.filter)
    for c in p.partition_cursors:
        test = {"range": lambda: F.col(c.column) >= F.lit(c.value), "equality": lambda: F.col(c.column) == F.lit(c.value), "in": lambda: F.col(c.column).isin(*c.value)}
        df = df.where(test[c.strategy]())
    if p.watermark and not p.full_refresh:
        df = df.where(beyond(p.watermark, p.cursor_mode, p.grace_period_hours))
    if p.partition_column:
        df = df.where(F.col(p.partition_column) < F.current_date())
    if p.hash_cursor:
        df = df.withColumn(p.hash_cursor.alias, F.pmod(F.xxhash64(F.col(p.hash_cursor.column).cast("string")), F.lit(p.hash_cursor.modulus)))
    joined = [c for j in p.joins for c in j.columns]
    kept = dict.fromkeys([*p.columns, *p.passthrough_columns, *joined, *([p.hash_cursor.alias] if p.hash_cursor else [])]) or dict.fromkeys(df.columns)
    cursors = [F.col(c) for c in p.watermark or p.cursors] or [F.col(p.updated_at)]
    out = df.select(
        record_uid(p.source_name, F.col(p.unique_key)).alias(ENTITY_UID),
        F.lit(p.source_name).alias(SOURCE_NAME),
        *(F.col(c) for c in kept),
        F.col(p.updated_at).alias(SOURCE_UPDATED_AT),
        F.current_timestamp().alias(PIPELINE_LOADED_AT),
        *(c.alias(f"_cursor_{i}") for i, c in enumerate(cursors)),
    )
    if p.batch_size:
        # Only cursors are sorted. A struct's order has nulls first, as theirs has.
        mark = F.struct(*(f"_cursor_{i}" for i in range(len(cursors))))
        last = out.select(mark.alias("mark")).orderBy("mark").limit(p.batch_size).agg(F.max("mark").alias("mark")).first().mark
        if last:
            kinds = dict(out.dtypes)
            out = out.where(mark <= F.struct(*(F.lit(v).cast(kinds[f"_cursor_{i}"]).alias(f"_cursor_{i}") for i, v in enumerate(last))))
    return out.drop(*(f"_cursor_{i}" for i in range(len(cursors))))
