"""Records that stand for several people: found, and split into one record each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ENTITY_UID
from ..functions import features as N


def detection(name: str, custom_patterns: Sequence[str] = ()) -> Column:
    """1 for a compound name, or where one of the patterns is found."""
    flag = N.is_compound_name(F.col(name)) == 1
    for p in custom_patterns:
        flag = flag | F.coalesce(F.upper(name).rlike(p), F.lit(False))
    return F.when(flag, 1).otherwise(0)


def flag_compounds(df: DataFrame, name: str, custom_patterns: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({"is_compound": detection(name, custom_patterns), "compound_pattern": N.compound_pattern(F.col(name))})


def without_compounds(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("is_compound", F.lit(0)) == 0)


def split_compounds(df: DataFrame, name: str) -> DataFrame:
    """Compound records as two, with the parts of the name, a uid of their own, the uid they come
    from and their number; others stay, with number 0. The second part keeps the last name."""
    first, second = N.extract_compound_first(F.col(name)), N.extract_compound_second(F.col(name))
    last = F.when(F.size(N.words(F.col(name))) > 3, F.upper(N.last_word(F.col(name))))
    whole = lambda c: F.when(last.isNotNull() & (last != c), F.concat_ws(" ", c, last)).otherwise(c)
    parts = F.when((detection(name) == 1) & first.isNotNull() & second.isNotNull(), F.array(
        F.struct(F.lit(1).alias("index"), whole(first).alias("name")), F.struct(F.lit(2).alias("index"), whole(second).alias("name")),
    )).otherwise(F.array(F.struct(F.lit(0).alias("index"), F.col(name).alias("name"))))
    out = df.withColumn("_part", F.explode(parts)).withColumn("_original_entity_uid", F.col(ENTITY_UID)).withColumn("_split_index", F.col("_part.index"))
    uid = F.when(F.col("_split_index") > 0, F.xxhash64(F.concat_ws("_", F.col(ENTITY_UID).cast("string"), F.col("_split_index").cast("string")))).otherwise(F.col(ENTITY_UID))
    return out.withColumn(ENTITY_UID, uid).withColumn(name, F.col("_part.name")).drop("_part")
