"""Embeddings of records, and random-hyperplane hashing of vectors into buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ENTITY_UID

EMBEDDING = "bqml_predicted_embedding"


def hashed_ngrams(dimensions: int, n: int = 3) -> Callable[[pd.Series], pd.Series]:
    """The default embedder: signed counts of hashed character n-grams, of length one. Any function
    of a series of texts to a series of vectors can take its place."""
    from zlib import crc32

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dimensions)
            padded = f" {(text or '').lower()} "
            for i in range(len(padded) - n + 1):
                h = crc32(padded[i : i + n].encode())
                v[h % dimensions] += 1 if h & 0x80000000 else -1
            size = np.linalg.norm(v)
            out.append((v / size if size else v).tolist())
        return pd.Series(out)

    return embed


def embed(records: DataFrame, columns: Sequence[str], dimensions: int = 128, embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """entity_uid and the vector of the columns' text, joined by spaces."""
    from pyspark.sql import types as T

    f = F.pandas_udf(embedder or hashed_ngrams(dimensions), T.ArrayType(T.DoubleType()))
    joined = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    return records.select(ENTITY_UID, f(joined).alias(EMBEDDING))


def with_lsh(records: DataFrame, columns: Sequence[str], dimensions: int = 64, tables: int = 8, functions: int = 4, seed: int = 42, embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """records with a bucket column for each table, from the text of columns; no join is needed."""
    from pyspark.sql import types as T

    f = F.pandas_udf(embedder or hashed_ngrams(dimensions), T.ArrayType(T.DoubleType()))
    df = records.withColumn(EMBEDDING, f(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))))
    return df.withColumns(dict(_buckets(F.col(EMBEDDING), dimensions, tables, functions, seed, "lsh_bucket"))).drop(EMBEDDING)


def hyperplanes(tables: int, functions: int, dimensions: int, seed: int) -> np.ndarray:
    """The normal vectors, the same for a seed on any machine: numbers in [-1, 1) from a hash of
    seed, table, function and dimension."""
    import hashlib

    def number(*at: int) -> float:
        raw = hashlib.sha256(":".join(map(str, (seed, *at))).encode()).digest()[:8]
        return int.from_bytes(raw, "big", signed=True) / 2**63

    return np.array([[[number(t, f, d) for d in range(dimensions)] for f in range(functions)] for t in range(tables)])


def _buckets(v: Column, dimensions: int, tables: int, functions: int, seed: int, prefix: str) -> list[tuple[str, Column]]:
    planes = hyperplanes(tables, functions, dimensions, seed)

    def sign(normal: np.ndarray) -> Column:
        weights = F.array(*(F.lit(float(x)) for x in normal))
        dot = F.aggregate(F.zip_with(v, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        return F.when(dot >= 0, 1).otherwise(0)

    cols = []
    for t in range(tables):
        bucket = F.lit(0)
        for f in range(functions):
            bucket = bucket + sign(planes[t, f]) * (1 << f)
        cols.append((f"{prefix}_{t}", F.when(v.isNotNull(), bucket.cast("long"))))
    return cols


def lsh_buckets(vectors: DataFrame, dimensions: int, tables: int = 8, functions: int = 4, seed: int = 42, vector: str = EMBEDDING, uid: str = ENTITY_UID, prefix: str = "lsh_bucket") -> DataFrame:
    """uid and a bucket for each table: the signs of the projections, as bits. All in the JVM."""
    return vectors.select(uid, *(c.alias(n) for n, c in _buckets(F.col(vector), dimensions, tables, functions, seed, prefix)))
