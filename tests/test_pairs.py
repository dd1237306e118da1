"""Pairs as a stream: the same pairs as by brute force, without a shuffle of pairs."""

import os
import random

import duckdb
import pytest
from helpers import TABLES, check_query
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tributary.columns import LEFT, RIGHT
from tributary.operators import blocking as B
from tributary.operators import learning
from tributary.operators import pairs as P
from tributary.operators import scoring as S
from tributary.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(i * 3 % 101, rng.choice("ab"), rng.choice("xyz"), rng.choice([None, 1, 2, 3, 4]), rng.randrange(6)) for i in range(101)]


@pytest.fixture(scope="module")
def records(spark, rows):
    return spark.createDataFrame(rows, "entity_uid long, source_name string, name string, size int, kind int").coalesce(2).cache()


def pairs(df):
    return sorted((r[LEFT], r[RIGHT]) for r in df.collect())


def both(rows, test):
    return sorted((l[0], r[0]) for l in rows for r in rows if l[0] < r[0] and test(l, r))


def shuffles(df):
    """The keys by which the plan deals out rows."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_pairs_of_several_paths_come_once_and_are_not_shuffled(rows, records):
    paths = (B.BlockingPath(("name", "source_name"), bucket_size_limit=150), B.BlockingPath(("name", "size")), B.BlockingPath(("kind",)))
    got = B.block(records, B.Blocking(paths), columns=("size",))
    n = {k: sum((r[2], r[1]) == k for r in rows) for k in {(r[2], r[1]) for r in rows}}
    small = {k for k, v in n.items() if v * (v - 1) / 2 <= 150}
    assert 0 < len(small) < len(n)
    want = both(rows, lambda l, r: (l[2], l[1]) == (r[2], r[1]) and (l[2], l[1]) in small or l[2] == r[2] and l[3] == r[3] is not None or l[4] == r[4])
    assert pairs(got) == want
    size = {r[0]: r[3] for r in rows}
    assert all((x.l["size"], x.r["size"]) == (size[x[LEFT]], size[x[RIGHT]]) for x in got.collect())
    assert not any(LEFT in x or "_l_entity_uid" in x for x in shuffles(got))


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_candidate_limits_bind_by_position(rows, records, limit):
    got = pairs(B.block(records, B.Blocking((B.BlockingPath(("name",), candidate_limit=limit),))))
    want = []
    for l in rows:
        want += sorted((l[0], r[0]) for r in rows if l[0] < r[0] and l[2] == r[2])[:limit]
    assert got == sorted(want)


def test_exclusion_by_keys_equals_exclusion_by_pairs(rows, records):
    p, seen = B.Blocking((B.BlockingPath(("name", "size")),)), B.Blocking((B.BlockingPath(("name", "kind")),))
    new, old = records.where("size >= 2"), records.where("size < 2 OR size IS NULL")
    got = B.block(new, p, old, seen)
    assert pairs(got) == pairs(B.block(new, p, old, B.block(records, seen))) == both(rows, lambda l, r: l[2] == r[2] and l[3] == r[3] and (l[3] or 0) >= 2 and l[4] != r[4])
    assert not any("_lo" in x or LEFT in x for x in shuffles(got))


def test_repeated_uids_still_give_a_pair_once(records):
    twice = records.unionByName(records.where("entity_uid < 20").withColumn("kind", F.lit(9)))
    p = B.Blocking((B.BlockingPath(("name",)),))
    got = pairs(B.block(twice, p).where(F.col(LEFT) != F.col(RIGHT)))
    assert got == pairs(B.block(records, p))


def test_values_are_compared_once(spark, rows, records):
    many = records.crossJoin(spark.range(40).toDF("copy")).withColumn("entity_uid", F.col("entity_uid") + 1000 * F.col("copy")).drop("copy").where("entity_uid % 7 = 0")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(a, b):
        calls.add(1)
        return a == b

    pair = lambda df, columns: B.block(df, B.Blocking((B.BlockingPath(("name",)),)), columns=columns)
    got = P.compare(many, ["size"], [same("l.size", "r.size").alias("same")], pair).cache()
    assert got.count() == pair(many, ["size"]).count() and calls.value == 25
    plain = pair(many, ["size"]).select(LEFT, RIGHT, F.expr("l.size <=> r.size").alias("same"))
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


@pytest.fixture(scope="module")
def one_name(spark, sf_dir, tmp_path_factory):
    """The test tables with a part table of one name and brand, whose key has too many pairs."""
    folder = tmp_path_factory.mktemp("one-name")
    for t in TABLES:
        if t != "part":
            os.symlink(f"{sf_dir}/{t}.parquet", f"{folder}/{t}.parquet")
    part = "SELECT i * 7 % 300 AS p_partkey, 'red ring' AS p_name, 'Brand#1' AS p_brand, (['LARGE', 'SMALL', 'PROMO'])[1 + i % 3] AS p_type, (1 + i % 5)::INT AS p_size, (900 + i / 10.0)::DOUBLE AS p_retailprice FROM range(300) t(i)"
    duckdb.sql(f"COPY ({part}) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["er_estimate_from_labels", "er_connected_components", "er_incremental_components", "er_confidence_shaping", "er_best_match_clusters", "er_match_metadata", "er_cluster_quality"])
def test_queries_on_hot_keys(spark, one_name, name):
    check_query(spark, one_name, QUERIES[name], SQL[name])


def test_known_scores_are_rounded_as_by_spark(spark):
    tests = tuple(S.Comparison(S.Test(c), w) for c, w in (("a", 2.0), ("b", 1.3), ("c", 0.7), ("d", 0.1)))
    rec = spark.createDataFrame([(i, "s", 1, *(i >> k & 1 for k in range(4))) for i in range(16)], "entity_uid long, source_name string, k int, a int, b int, c int, d int")
    out = S.score_pairs(B.block(rec, B.Blocking((B.BlockingPath(("k",)),)), columns="abcd"), rec, S.Scoring("t", tests))
    assert "round" in str(out._jdf.queryExecution().optimizedPlan()) and out.select("match_confidence").distinct().count() > 8
    assert out.where(F.col("match_confidence") != F.round(F.col("match_total_score") / sum(x.weight for x in tests), 4)).isEmpty()


def test_training_reads_counts_of_equal_rows(spark):
    m = spark.range(3000).select(F.col("id").alias(LEFT), (F.col("id") + 1).alias(RIGHT), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3 > 0).cast("double").alias("y"), (F.col("id") % 5 > 1).cast("int").alias("is_match"))
    model = learning.train(m, ["x", "y"])
    assert model.stages[-1].summary.predictions.count() == 8
    said = learning.predict(model, m)
    plain = model.transform(m).select(LEFT, RIGHT, vector_to_array("probability")[1].alias("p"))
    assert said.count() == 3000 and said.join(plain, [LEFT, RIGHT]).where("abs(ml_probability - p) > 1e-12").isEmpty()
