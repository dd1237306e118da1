"""Pairs of records and the records' columns: carried by blocking in structs l and r, or joined.

Pairs that carry their columns need no join with the records, whose shuffles would grow with the
pairs: they are made, compared and used in the task that has the records of their blocking key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ENTITY_UID, LEFT, RIGHT
from ..storage import materialize

RECORDS = ("l", "r")


def carries(pairs: DataFrame) -> bool:
    return set(RECORDS) <= set(pairs.columns)


def paired(pairs: DataFrame, records: DataFrame, names: Iterable[str]) -> DataFrame:
    """The pairs with the named columns of their records as l.<name> and r.<name>."""
    if carries(pairs):
        return pairs
    own = records.select(ENTITY_UID, *sorted(set(names) - {ENTITY_UID, ""}))
    return pairs.alias("c").join(own.alias("l"), F.col(f"c.{LEFT}") == F.col(f"l.{ENTITY_UID}")).join(own.alias("r"), F.col(f"c.{RIGHT}") == F.col(f"r.{ENTITY_UID}"))


#: So many pairs of values are compared before the pairs of records are made, and then broadcast.
MOST = 250_000


def compare(records: DataFrame, names: Sequence[str], outputs: Sequence[Column], pair: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """left_entity_uid, right_entity_uid and the outputs, which are columns over l.<name> and r.<name>.
    pair: pairs of these records that carry the named columns. Where the names have few values, each
    pair of values is compared once, and pairs of records look it up."""
    values = materialize(records.select(*names).distinct())
    n = values.count()
    if n * n > min(MOST, 10 * records.count()):
        return pair(records, names).select(LEFT, RIGHT, *outputs)
    numbered = materialize(values.withColumn("_value", F.row_number().over(Window.orderBy(*names)).cast("long") - 1))  # few rows
    parts = records.sparkSession.sparkContext.defaultParallelism
    both = numbered.repartition(parts, "_value").select(F.struct("_value", *names).alias("l")).crossJoin(F.broadcast(numbered.select(F.struct("_value", *names).alias("r"))))
    key = F.col("l._value") * n + F.col("r._value")
    known = materialize(both.select(key.alias("_key"), *outputs))
    v, o = numbered.alias("v"), records.alias("o")
    valued = o.join(F.broadcast(v), reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"v.{c}")) for c in names))).select("o.*", "v._value")
    return pair(valued, ["_value"]).withColumn("_key", key).join(F.broadcast(known), "_key").select(LEFT, RIGHT, *(c for c in known.columns if c != "_key"))
