"""Invariants and hand-made cases of the operators."""

import dataclasses
import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tributary.columns import CLUSTER_ID, ENTITY_UID, LEFT, RIGHT
from tributary.operators import clustering, compound, estimation, features, golden, learning, monitoring, profiling, review, scoring, staging, vectors
from tributary.operators.blocking import Blocking, BlockingPath, block, check_paths, collision_probability
from tributary.plans import config as C
from tributary.plans import roles as R
from tributary.plans.pipeline import GateError, Pipeline, Stage, order
from tributary.sources import tables
from tributary.streaming.incremental import drain, resolve_batch, stream
from tributary.streaming.state import Checkpoints, Lock, Watermarks, cursors_of

MATCH = f"{LEFT} long, {RIGHT} long, match_total_score double, match_confidence double, match_tier_priority int, match_tier_name string"


@pytest.fixture
def folder():
    return f"/tmp/checkpoints/test-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", "Smith", "John", "k1"), (2, "b", "Smith", "Jon", "k1"), (3, "a", "Smith", "Jane", "k2"), (4, "a", "Doe", "Jane", None), (5, "b", "Doe", "J", None)]
    df = spark.createDataFrame(rows, "entity_uid long, source_name string, last string, first string, bk string")
    return df.withColumn("source_updated_at", F.timestamp_seconds(F.col("entity_uid"))).withColumn("last_sx", F.soundex("last"))


def pairs(df):
    return sorted((r[LEFT], r[RIGHT]) for r in df.collect())


def union_find(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_blocking_orders_dedupes_and_ignores_nulls(people):
    got = pairs(block(people, Blocking((BlockingPath(("last_sx",)), BlockingPath(("bk",))))))
    assert got == [(1, 2), (1, 3), (2, 3), (4, 5)]
    assert pairs(block(people, Blocking((BlockingPath(("last_sx",)),), "link_only"))) == [(1, 2), (2, 3), (4, 5)]
    assert pairs(block(people, Blocking((BlockingPath(("last_sx",)),), "dedupe_only"))) == [(1, 3)]
    assert pairs(block(people, Blocking((BlockingPath(("last_sx",), bucket_size_limit=2),)))) == [(4, 5)]
    assert pairs(block(people, Blocking((BlockingPath(("last_sx",), candidate_limit=1),)))) == [(1, 2), (2, 3), (4, 5)]


def test_blocking_exclusion_takes_both_orders(spark, people):
    seen = spark.createDataFrame([(2, 1), (1, 3)], f"{LEFT} long, {RIGHT} long")
    assert pairs(block(people, Blocking((BlockingPath(("last_sx",)),)), excluded=seen)) == [(2, 3), (4, 5)]


def test_blocking_paths_are_checked():
    assert check_paths(Blocking((BlockingPath(), BlockingPath(("a",), candidate_limit=20_000)))) != []
    with pytest.raises(ValueError):
        block(None, Blocking((BlockingPath(),)))
    assert collision_probability(1.0, 4, 2) == pytest.approx(1.0)


def test_term_frequencies(people):
    got = {(r[0], r[1]): r[3] for r in features.term_frequencies(people, ["last"]).collect()}
    assert got == {("last", "Smith"): 0.6, ("last", "Doe"): 0.4}


def test_features_depend_on_features(people):
    wanted = [features.Feature("b", "upper_trim", ("a",)), features.Feature("a", "first_letter", ("last",)), features.Feature("c", sql="concat(b, '!')")]
    assert {r.c for r in features.engineer([people], wanted).collect()} == {"S!", "D!"}
    with pytest.raises(ValueError):
        features.engineer([people], [features.Feature("x", "identity", ("y",)), features.Feature("y", "identity", ("x",))])


def test_components_equal_union_find(spark):
    rng, n = random.Random(4), 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(i, i + 1) for i in range(200, 260)]
    edges = [(a, b) for a, b in edges if a != b]
    m = spark.createDataFrame([(a, b, 1.0, 1.0, 0, "t") for a, b in edges], MATCH)
    rec = spark.range(n).toDF(ENTITY_UID)
    got = {r[0]: r[1] for r in clustering.connected_components(m, rec).collect()}
    assert [got[i] for i in range(n)] == union_find(n, edges)
    half = [e for e in edges if e[0] < 150 and e[1] < 150]
    index = clustering.connected_components(spark.createDataFrame([(a, b, 1.0, 1.0, 0, "t") for a, b in half], MATCH), rec.where("entity_uid < 150"))
    inc = {r[0]: r[1] for r in clustering.incremental_components(m, rec.where("entity_uid >= 150"), index).collect()}
    assert inc == got


def test_components_of_no_matches(spark):
    m = spark.createDataFrame([], MATCH)
    assert clustering.connected_components(m, spark.range(3).toDF(ENTITY_UID)).where(f"{ENTITY_UID} = {CLUSTER_ID}").count() == 3


def test_star_and_best_match(spark):
    m = spark.createDataFrame([(1, 2, 1.0, 0.9, 0, "t"), (2, 3, 1.0, 0.8, 0, "t"), (3, 4, 1.0, 0.3, 0, "t")], MATCH)
    rec = spark.range(1, 6).toDF(ENTITY_UID)
    star = {r[0]: r[1] for r in clustering.cluster("star", m, rec).collect()}
    assert star == {1: 2, 2: 2, 3: 2, 4: 3, 5: 5}
    best = {r[0]: r[1] for r in clustering.cluster("best_match", m, rec, 0.5).collect()}
    assert best == {1: 1, 2: 1, 3: 2, 4: 4, 5: 5}
    with pytest.raises(ValueError):
        clustering.cluster("other", m, rec)


def test_scoring_null_signal_keeps_the_pair(spark, people):
    cand = block(people, Blocking((BlockingPath(("last_sx",)),)))
    tests = (scoring.Comparison(scoring.Test("last"), 2.0), scoring.Comparison(scoring.Test("first", method="jaro_winkler", params={"threshold": 0.8}), 1.0))
    gone = scoring.Signal(scoring.Test("bk", method="different"), "disqualify")
    assert pairs(scoring.score_pairs(cand, people, scoring.Scoring("t", tests, signals=(gone,)))) == [(1, 2), (4, 5)]
    strict = scoring.Signal(scoring.Test("bk", method="different"), "disqualify", requires_overrides=1)
    assert len(pairs(scoring.score_pairs(cand, people, scoring.Scoring("t", tests, signals=(strict,))))) == 4
    audit = scoring.score_pairs(cand, people, scoring.Scoring("t", tests, audit=True, confidence=0.7)).first()
    assert "match_score_last_exact" in audit.match_detail and audit.match_confidence == 0.7


def test_graded_scores_count_by_degree(people):
    cand = block(people, Blocking((BlockingPath(("last_sx",)),)))
    test = scoring.Comparison(scoring.Test("first", method="levenshtein_score"), 2.0)
    got = {(r[LEFT], r[RIGHT]): r.match_total_score for r in scoring.score_pairs(cand, people, scoring.Scoring("t", (test,))).collect()}
    assert got[1, 2] == pytest.approx(1.5)


def test_accumulate_takes_tiers_with_other_columns(people):
    cand = block(people, Blocking((BlockingPath(("last_sx",)),)))
    one = scoring.accumulate(None, scoring.score_pairs(cand.limit(2), people, scoring.Scoring("a", (scoring.Comparison(scoring.Test("last")),))))
    two = scoring.accumulate(one, scoring.score_pairs(cand, people, scoring.Scoring("b", (scoring.Comparison(scoring.Test("first")),), tier_index=1)))
    assert two.count() == 4 and two.select(LEFT, RIGHT).distinct().count() == 4


def test_em_finds_the_parameters(spark):
    rng = random.Random(3)
    rows, cand = [], []
    for i in range(2000):
        match = rng.random() < 0.3
        a = (1 if rng.random() < (0.9 if match else 0.1) else 0, 1 if rng.random() < (0.8 if match else 0.2) else 0, 1 if rng.random() < (0.95 if match else 0.05) else 0)
        rows += [(2 * i, 1, 1, 1), (2 * i + 1, *a)]
        cand.append((2 * i, 2 * i + 1))
    rec = spark.createDataFrame(rows, "entity_uid long, x int, y int, z int")
    tests = [scoring.Comparison(scoring.Test(c), name=c) for c in "xyz"]
    p = estimation.estimate_em(spark.createDataFrame(cand, f"{LEFT} long, {RIGHT} long"), rec, tests, max_iterations=200, tolerance=1e-6)
    assert p.match_rate == pytest.approx(0.3, abs=0.05) and p.m["x", "match"] == pytest.approx(0.9, abs=0.05) and p.u["z", "match"] == pytest.approx(0.05, abs=0.05)
    assert estimation.with_parameters(tests, p)[0].levels[0].m == p.m["x", "match"]


def test_em_of_no_pairs(spark, people):
    p = estimation.estimate_em(spark.createDataFrame([], f"{LEFT} long, {RIGHT} long"), people, [scoring.Comparison(scoring.Test("last"))])
    assert 0 < p.match_rate < 1


def test_golden_has_one_canonical_record_a_cluster(spark, people):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], f"{ENTITY_UID} long, {CLUSTER_ID} long")
    out = golden.resolve(people, c, None, golden.Golden(("last", "first", "bk"), "recency"))
    assert {(r[CLUSTER_ID], r.canonical_entity_uid) for r in out.collect()} == {(1, 3), (4, 5)} and out.where("is_canonical").count() == 2
    merged = golden.resolve(people, c, None, golden.Golden(("last", "first", "bk"), "field_merge", field_strategies=(golden.FieldStrategy("first", "most_common"), golden.FieldStrategy("bk", "source_priority", ("b",)))))
    assert sorted((r[CLUSTER_ID], r["last"], r["first"], r["bk"]) for r in merged.collect()) == [(1, "Smith", "Jane", "k1"), (4, "Doe", "J", None)]


def test_staging_refuses_unknown_modes_and_hashes_keys(spark):
    src = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 3))], "id long, at timestamp")
    p = staging.Staging("s", "id", "at", ("id",), watermark={"at": datetime.datetime(2024, 1, 2)})
    assert [r.id for r in staging.stage(src, p).collect()] == [2]
    assert staging.stage(src, staging.Staging("s", "id", "at", watermark=p.watermark, grace_period_hours=48)).count() == 2
    assert staging.stage(src, staging.Staging("s", "id", "at", watermark=p.watermark, full_refresh=True)).count() == 2
    with pytest.raises(ValueError):
        staging.stage(src, staging.Staging("s", "id", "at", watermark=p.watermark, cursor_mode="x"))


def test_compounds_split_into_two(spark):
    df = spark.createDataFrame([(1, "Jane and Joe Smith"), (2, "Mr. and Mrs. Smith"), (3, None), (4, "A/B")], "entity_uid long, name string")
    got = sorted((r._original_entity_uid, r._split_index, r.name or "") for r in compound.split_compounds(df, "name").collect())
    assert got == [(1, 1, "JANE SMITH"), (1, 2, "JOE SMITH"), (2, 0, "Mr. and Mrs. Smith"), (3, 0, ""), (4, 1, "A"), (4, 2, "B")]
    assert compound.without_compounds(compound.flag_compounds(df, "name")).count() == 1


def test_vectors(spark, people):
    e = vectors.embed(people, ["last", "first"], 16)
    b = vectors.lsh_buckets(e, 16, tables=3, functions=5)
    assert b.columns == [ENTITY_UID, "lsh_bucket_0", "lsh_bucket_1", "lsh_bucket_2"] and b.where("lsh_bucket_0 >= 32").count() == 0


def test_review_and_labels(spark):
    m = spark.createDataFrame([(1, 2, 1.0, 0.95, 0, "t"), (2, 4, 0.2, 0.55, 0, "t"), (3, 4, 0.1, 0.05, 0, "t")], MATCH)
    q = review.review_queue(m, 1, 0.3, True)
    assert pairs(q) == [(2, 4)]
    labels = review.ingest_labels(None, q.withColumn("human_label", F.lit("match")), "t")
    again = review.ingest_labels(labels, q.withColumn("human_label", F.lit("non_match")), "t")
    assert [r.is_match for r in again.collect()] == [False]


@pytest.mark.parametrize("kind", learning.MODELS)
def test_models(spark, kind):
    rng = random.Random(1)
    rows = [(i, i + 1000, float(y := rng.random() < 0.5), rng.random(), int(y)) for i in range(200)]
    matrix = spark.createDataFrame(rows, f"{LEFT} long, {RIGHT} long, a double, b double, is_match int")
    model = learning.train(matrix, ["a", "b"], kind, max_iterations=5 if kind != "DNN_CLASSIFIER" else 60)
    assert learning.evaluate(model, matrix)["roc_auc"] > 0.9
    assert learning.predict(model, matrix).count() == 200
    if kind == "LOGISTIC_REG":
        assert learning.model_weights(model)["a"] > 0
    elif kind != "DNN_CLASSIFIER":
        assert learning.feature_importance(model)["a"] > 0.5


def test_profiles_and_gates(spark, people):
    prof = {r["column"]: r for r in profiling.column_profile(people, ["bk", "last"]).collect()}
    assert (prof["bk"].null_count, prof["bk"].cardinality, prof["last"].max_frequency) == (2, 2, 3)
    assert profiling.column_profile(people, ["bk"], approximate=True).first().cardinality == 2
    assert profiling.suggest(prof["bk"].asDict())["warning"] is not None
    assert profiling.data_quality_score(0.3, 0.6, 0.4, 20_000)[0] == 20 and profiling.data_quality_score(0, 0, 1, 0) == (100, [])
    assert monitoring.blocking_gate(people.limit(0), "t")[0].severity == "error"
    assert monitoring.diagnose_blocking(people, ["bk", "entity_uid"]) == ["no two records share a value of entity_uid"]


def test_state(spark, folder):
    marks = Watermarks(spark, folder)
    marks.write("s", {"at": datetime.datetime(2024, 1, 1), "id": 5}, "r1")
    marks.write("s", {"at": datetime.datetime(2024, 2, 1), "id": 7}, "r2")
    assert marks.read("s") == {"at": datetime.datetime(2024, 2, 1), "id": 7} and marks.read("other") == {}
    one, two = Lock(spark, folder, "p", 1000), Lock(spark, folder, "p", 1000)
    first = one.acquire()
    with pytest.raises(RuntimeError):
        two.acquire()
    one.release()
    assert two.acquire() > first
    with pytest.raises(RuntimeError):
        marks.write("s", {"id": 9}, "r3", one)
    assert marks.read("s")["id"] == 7
    c = Checkpoints(spark, folder)
    c.add("r", "a")
    assert c.done("r") == {"a"} and c.resumable() == "r"
    c.finish("r")
    assert c.resumable() is None
    assert cursors_of(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), ["a", "b"]) == {"a": 1, "b": 3}


def test_versions(spark, folder):
    t = tables.VersionedTable(spark, folder)
    assert t.read() is None and t.write(spark.range(3)) == 1
    assert t.write(tables.upsert(t.read(), spark.range(2, 5).toDF("id"), ["id"]), expected=1) == 2
    assert t.read().count() == 5
    with pytest.raises(RuntimeError):
        t.write(spark.range(1), expected=1)


def test_types_and_rows(spark):
    assert tables.column_type("ARRAY<INT64>").simpleString() == "array<bigint>"
    with pytest.raises(ValueError):
        tables.column_type("BIGNUMERIC")
    assert tables.rows(spark, [{"a": 1}, {}], {"a": "INT64"}).count() == 2


@pytest.fixture(scope="module")
def customers(spark):
    names = [("John", "Smith"), ("Jon", "Smith"), ("Jane", "Doe"), ("Janet", "Doe"), ("Bob", "Jones"), ("Zed", "Zu")]
    rows = [(i, f, last, f"{last.lower()}{i // 2}@x.org", f"555010{1000 + i // 2}", datetime.datetime(2024, 1, 1 + i)) for i, (f, last) in enumerate(names)]
    return spark.createDataFrame(rows, "id long, first_name string, last_name string, email string, phone string, updated_at timestamp")


def quick(spark):
    src = C.Source("customers", "customers", "id", "updated_at", dict.fromkeys(["first_name", "last_name", "email", "phone"], "STRING"))
    return C.quick_config("quick", src)


def test_pipeline_from_column_names(spark, customers, folder):
    p = Pipeline(quick(spark))
    assert p.validate() == []
    out = p.run({"customers": customers}, run_id="r", state=folder, lock=True)
    sizes = sorted(r["count"] for r in out["entity_clusters"].groupBy(CLUSTER_ID).count().collect())
    assert sizes == [1, 1, 2, 2]
    again = Pipeline(quick(spark)).run({"customers": customers}, run_id="r", state=folder)
    assert again["resolved_entities"].count() == 6 and out.log.jobs
    assert "candidates_exact" in p.plan({"customers": customers})


@pytest.mark.parametrize("training", ["em", "labeled"])
def test_pipeline_trains_and_blocks_on_vectors(spark, customers, training):
    d = {
        "project": {"name": "t"}, "sources": [{"name": "customers", "table": "c", "unique_key": "id", "updated_at": "updated_at", "columns": [{"name": n} for n in ("first_name", "last_name", "email")]}],
        "embeddings": {"enabled": True, "source_columns": ["last_name"], "dimensions": 16, "lsh": {"num_hash_tables": 2, "num_hash_functions_per_table": 3}},
        "matching_tiers": [{"name": "fs", "blocking": {"paths": [{"lsh_keys": ["lsh_bucket_0"]}, {"lsh_keys": ["lsh_bucket_1"]}]}, "training": {"method": training}, "threshold": {"method": "fellegi_sunter", "match_threshold": -20},
                            "comparisons": [{"left": "last_name", "method": "exact"}, {"left": "email", "method": "exact", "levels": [{"label": "same", "method": "exact"}, {"label": "else"}]}]}],
    }
    c = C.from_dict(d)
    assert C.validate(c) == []
    sources = {"customers": customers}
    if training == "labeled":
        uid = staging.record_uid("customers", F.col("id"))
        ids = customers.select("id", uid.alias("u"))
        a, b = ids.toDF("i", LEFT), ids.toDF("j", RIGHT)
        sources["labels"] = a.join(b, (F.col("j") == F.col("i") + 1)).select(LEFT, RIGHT, (F.col("i") % 2 == 0).alias("is_match"))
    out = Pipeline(c).run(sources)
    assert out["matches_fs"].count() >= 2 and "match_log_weight_email_exact" in out["matches_fs"].columns


def test_pipeline_stages_are_ordered_and_gated(spark, customers):
    stages = [Stage("b", ("a",), lambda t: t["a"]), Stage("a", ("source_customers",), lambda t: t["source_customers"], lambda d: [monitoring.Finding("error", "no")])]
    assert [s.name for s in order(stages, {"source_customers"})] == ["a", "b"]
    with pytest.raises(GateError):
        Pipeline.from_stages(quick(spark), stages).run({"customers": customers})
    with pytest.raises(ValueError):
        order([Stage("a", ("b",), None), Stage("b", ("a",), None)])


def test_batches_give_what_one_run_gives(spark, customers, folder):
    c = quick(spark)
    tiers, blocking = [t.scoring for t in c.tiers[:1]], c.tiers[0].blocking
    featurize = lambda df: features.engineer([df], c.features)
    p = staging.Staging("customers", "id", "updated_at", tuple(c.sources[0].columns), batch_size=2)
    index, marks = tables.VersionedTable(spark, f"{folder}/index"), Watermarks(spark, folder)
    n = drain(customers, p, ["updated_at", "id"], featurize, blocking, tiers, index, marks, "r")
    assert n == 3
    whole = resolve_batch(None, featurize(staging.stage(customers, staging.Staging("customers", "id", "updated_at", p.columns, ("id",)))), blocking, tiers)
    key = lambda df: sorted((r[ENTITY_UID], r[CLUSTER_ID]) for r in df.collect())
    assert key(index.read()) == key(whole)
    assert drain(customers, p, ["updated_at", "id"], featurize, blocking, tiers, index, marks, "r2") == 0


def test_pipeline_drains_joins_enriches_and_learns(spark, folder):
    rows = [(i, f"Ann Lee{i // 2}", f"a{i // 2}@x.org", "us", datetime.datetime(2024, 1, 1 + i % 3)) for i in range(12)]
    people = spark.createDataFrame(rows, "id long, name string, email string, code string, at timestamp")
    nations = spark.createDataFrame([("US", "America"), ("DE", "Germany")], "code string, nation string")
    orders = spark.createDataFrame([(i, 10 * i) for i in range(12)], "person long, total long")
    d = {
        "sources": [{"name": "p", "table": "people", "unique_key": "id", "updated_at": "at", "batch_size": 3, "columns": [{"name": "name"}, {"name": "email"}, {"name": "code"}], "cursors": ["at"],
                     "joins": [{"table": "orders", "on": "src.id = o.person", "alias": "o", "columns": ["total"]}]}],
        "feature_engineering": {"features": [{"name": "email_clean", "function": "lower_trim", "input": "email"}], "composite_keys": [{"name": "both", "inputs": ["email_clean", "code"]}],
                                "enrichment_joins": [{"table": "nations", "function": "upper_trim", "input": "code", "lookup_key": "code", "columns": ["nation"], "prefix": "in_", "flag": "found"}]},
        "matching_tiers": [{"name": "t", "blocking": {"paths": [{"keys": ["code"]}]}, "comparisons": [{"left": "both", "method": "exact", "weight": 2}, {"left": "total", "method": "numeric_within", "params": {"tolerance": 15}}], "threshold": {"min_score": 2}}],
        "models": [{"tier": "t", "held_out": 0.3}],
    }
    c = C.from_dict(d)
    assert C.validate(c) == []
    lookups, p = {"orders": orders, "nations": nations}, Pipeline(c)
    assert p.drain({"p": people}, folder, lookups)["p"] == 3 and p.drain({"p": people}, folder, lookups)["p"] == 0
    index = Pipeline.index(spark, folder)
    assert index.where("in_nation = 'America' AND found = 1 AND total IS NOT NULL").count() == 12
    assert sorted(r["count"] for r in index.groupBy(CLUSTER_ID).count().collect()) == [2] * 6
    d["sources"][0] |= {"batch_size": None}
    c = C.from_dict(d)
    staged = staging.stage(people, staging.Staging("p", "id", "at", ("email",))).select(ENTITY_UID, "email")
    labels = staged.toDF(LEFT, "a").join(staged.toDF(RIGHT, "b"), F.col(LEFT) < F.col(RIGHT)).select(LEFT, RIGHT, (F.col("a") == F.col("b")).alias("is_match"))
    out = Pipeline(c).run({"p": people, "labels": labels}, lookups=lookups)
    seen = {r.metric: r.value for r in out["evaluation_t"].collect()}
    assert seen["accuracy"] == 1.0 and out["predictions_t"].where("ml_is_match").count() == 6 and out["matrix_t"].count() == labels.count()


def test_validators():
    good = {"sources": [{"name": "s", "table": "t", "unique_key": "id", "updated_at": "at", "columns": [{"name": "a"}]}], "matching_tiers": [{"name": "t", "blocking": {"paths": [{"keys": ["a"]}]}, "comparisons": [{"left": "a"}], "threshold": {"min_score": 1}}]}
    assert C.validate(C.from_dict(good)) == []
    with pytest.raises(ValueError, match="unknown key 'matching_tier'"):
        C.from_dict(good | {"matching_tier": []})
    source = lambda **k: good | {"sources": [good["sources"][0] | k]}
    tier = lambda **k: good | {"matching_tiers": [good["matching_tiers"][0] | k]}
    level = {"label": "x", "method": "exact", "m": 0.9, "u": 0.1}
    wrong = {
        "unknown cursor mode": source(cursor_mode="both"), "batch size": source(batch_size=0), "grace period": source(grace_period_hours=-1), "hash cursor": source(hash_cursor={"column": "a", "modulus": 1}), "partition cursor": source(partition_cursors=[{"column": "a", "value": 1, "strategy": "near"}]),
        "unknown type": source(columns=[{"name": "a", "type": "BIGNUMERIC"}]), "unknown join": source(joins=[{"table": "x", "on": "true", "type": "outer"}]), "unknown method": tier(threshold={"method": "guess"}), "no last one": tier(threshold={"method": "fellegi_sunter"}, comparisons=[{"left": "a", "levels": [level]}]),
        "only fellegi_sunter": tier(comparisons=[{"left": "a", "levels": [level, {"label": "else"}]}]), "negative weight": tier(comparisons=[{"left": "a", "weight": -1}]), "comparison 'a_exact' twice": tier(comparisons=[{"left": "a"}, {"left": "a"}]), "more agreeing": tier(threshold={"min_matching_comparisons": 3}),
        "overlap": tier(score_banding={"enabled": True, "bands": [{"name": "L", "min_score": 1, "max_score": 3}, {"name": "H", "min_score": 2}]}), "outside 0 to 1": tier(confidence=2), "unknown clustering": good | {"reconciliation": {"clustering": {"method": "k"}}},
        "which no source has": good | {"reconciliation": {"canonical_selection": {"field_strategies": [{"column": "z"}]}}}, "unknown tier": good | {"models": [{"tier": "z"}]}, "holds out": good | {"models": [{"tier": "t", "held_out": 1}]},
    }
    for said, d in wrong.items():
        assert any(said in x for x in C.validate(C.from_dict(d))), said


def test_drain_loses_no_tied_rows(spark, folder):
    rows = spark.createDataFrame([(i, f"n{i // 2}", datetime.datetime(2024, 1, 1 + i % 2)) for i in range(12)], "id long, name string, at timestamp")
    comparison = scoring.Comparison(scoring.Test("name", "name", "exact"))
    index, marks = tables.VersionedTable(spark, f"{folder}/index"), Watermarks(spark, folder)
    p = staging.Staging("s", "id", "at", ("id", "name"), batch_size=3)
    args = (lambda df: df.drop("pipeline_loaded_at"), Blocking((BlockingPath(("name",)),)), [scoring.Scoring("t", (comparison,), min_score=1.0)], index, marks)
    assert drain(rows, p, ["at"], *args, "r") == 2 and drain(rows, p, ["at"], *args, "r") == 0
    per = index.read().groupBy(CLUSTER_ID).count().collect()
    assert sorted(r["count"] for r in per) == [2] * 6
    late = staging.Staging("s", "id", "at", ("id", "name"), batch_size=3, grace_period_hours=48)
    more = rows.union(spark.createDataFrame([(50, "n0", datetime.datetime(2024, 1, 1))], rows.schema))
    assert drain(more, late, ["at"], *args, "r") == 1 and index.read().count() == 13


def test_one_of_two_writers_wins(spark, folder):
    a, b = tables.VersionedTable(spark, folder), tables.VersionedTable(spark, folder, stale=0)
    a.write(spark.range(1), note="7")
    assert a._files.claim(f"{folder}/_claims/2") and a.note() == "7"
    with pytest.raises(RuntimeError):
        a.write(spark.range(2), expected=1)
    assert b.write(spark.range(3), expected=1) == 3 and a.read().count() == 3  # the claim was stale
    locks = [Lock(spark, folder, "p", 1000) for _ in range(2)]
    assert locks[0].acquire() == 1 and not locks[1]._files.claim(f"{folder}/locks/p/1")
    old = Lock(spark, folder, "q", -1)
    old.acquire()
    new = Lock(spark, folder, "q", 1000)
    assert new.acquire() == 2
    marks = Watermarks(spark, folder)
    marks.write("s", {"id": 5}, "r", new)
    marks.log.add([("s", "id", "4", "INT64", "old", 9e9, 1)])  # slipped through after its lock was taken
    assert marks.read("s") == {"id": 5}


def test_stream_resolves_micro_batches(spark, customers, folder):
    c = quick(spark)
    staged = staging.stage(customers, staging.Staging("customers", "id", "updated_at", tuple(c.sources[0].columns)))
    staged.write.parquet(f"{folder}/in")
    index = tables.VersionedTable(spark, f"{folder}/index")
    source = spark.readStream.schema(staged.schema).parquet(f"{folder}/in")
    q = stream(source, lambda df: features.engineer([df], c.features), c.tiers[0].blocking, [c.tiers[0].scoring], index, f"{folder}/marks")
    q.awaitTermination(120)
    assert q.exception() is None and index.read().count() == 6


def test_configurations(tmp_path):
    pytest.importorskip("yaml")
    from tributary import cli

    (tmp_path / "base.yml").write_text("allow_udfs: false\nproject: {name: base}\n")
    cli.main(["init", str(tmp_path / "c.yml")])
    text = (tmp_path / "c.yml").read_text()
    (tmp_path / "c.yml").write_text("include: [base.yml]\n" + text)
    c = C.load(str(tmp_path / "c.yml"), env={"CUSTOMERS": "t"})
    assert c.name == "customers" and c.sources[0].table == "t" and c.allow_udfs is False and "exact" in C.describe(c)
    d = C.read_yaml(str(tmp_path / "c.yml"), {"matching_tiers": [{"name": "x", "comparisons": [{"left": "no", "method": "jaro_winkler"}], "blocking": {"paths": [{"keys": []}]}}], "feature_engineering": {"features": [{"name": "f", "sql": "1; drop table x"}]}}, {})
    bad = C.validate(C.from_dict(d))
    assert len(bad) >= 4
    with pytest.raises(ValueError):
        C.interpolate("${NOT_SET_AT_ALL}", {})


@pytest.mark.parametrize("name", sorted(C.PRESETS))
def test_presets_are_valid(name):
    src = C.Source("s", "t", "id", "updated_at", dict.fromkeys(R.ROLES, "STRING"))
    preset = C.PRESETS[name]
    c = preset("p", [dataclasses.replace(src, name=f"s{i}") for i in range(2)] if preset.least_sources > 1 else src)
    assert C.validate(c) == [] and {t.blocking.link_type for t in c.tiers} == {preset.link_type}
    assert (c.tiers[0].name == "identifier") == bool(preset.identifiers)


def test_roles():
    assert R.detect_role("customer_first_name") == "first_name" and R.detect_role("birthDate") == "date_of_birth" and R.detect_role("postalCode") == "zip_code" and R.detect_role("zzz") is None
    assert "mrn" in R.roles_of("Patient") and "first_name" in R.roles_of("patient") and R.entity_type("Company").name == "Corporation"
    with pytest.raises(KeyError):
        R.entity_type("Nothing")
