"""The pipeline: stages in order of what they read, lazily planned, run with gates and checkpoints.

    sources -> staged -> featured [-> term frequencies]
      -> per tier: candidates -> matches -> all matches [-> review queue]
      -> clusters -> resolved entities [-> quality, placeholders]

Stages are functions of earlier tables. A table that several stages read is written once; one
that a single stage reads stays part of that stage's plan, for the optimizer to see through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import CLUSTER_ID, LEFT, RIGHT
from ..operators import clustering, compound, estimation, features, golden, learning, monitoring, profiling, review, vectors
from ..operators.blocking import block, blocking_effectiveness
from ..operators.scoring import Scoring, accumulate, score_pairs
from ..operators.staging import SourceJoin, Staging, stage
from ..sources.tables import VersionedTable
from ..storage import materialize
from ..streaming.incremental import drain
from ..streaming.state import Checkpoints, Lock, Watermarks
from . import roles as R
from .config import Config, Source, Tier, quick_config, validate


@dataclass(frozen=True)
class Stage:
    """gate: looks at the stage's table and tells what is wrong with it."""

    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    gate: Callable[[DataFrame], list[monitoring.Finding]] | None = None
    shared: bool = False


class GateError(RuntimeError):
    pass


@dataclass
class Result:
    tables: dict[str, DataFrame]
    findings: list[monitoring.Finding] = field(default_factory=list)
    run_id: str = ""
    log: monitoring.JobLog | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def order(stages: list[Stage], given: set[str] = frozenset()) -> list[Stage]:
    """Stages so that each comes after those it reads; ties in the order given."""
    by = {s.name: s for s in stages}
    if missing := {x for s in stages for x in s.reads} - set(by) - set(given):
        raise ValueError(f"no stage makes {', '.join(sorted(missing))}")
    sorter = TopologicalSorter({s.name: [x for x in s.reads if x in by] for s in stages})
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"stages read each other: {' -> '.join(e.args[1])}") from e
    rank, out, ready = {s.name: i for i, s in enumerate(stages)}, [], []
    while sorter.is_active():
        ready += sorter.get_ready()
        ready.sort(key=rank.__getitem__)
        name = ready.pop(0)
        out.append(by[name])
        sorter.done(name)
    return out


def _trained(tier: Tier, tables: dict[str, DataFrame]) -> Scoring:
    """The tier's scoring, with the probabilities that training gives: from the candidates, or from
    the table `source_labels` (pairs with is_match)."""
    p, comparisons = tier.scoring, tier.scoring.comparisons
    if tier.training == "none":
        return p
    if tier.training == "em":
        got = estimation.estimate_em(tables[f"candidates_{tier.name}"], tables["featured"], comparisons, tier.training_iterations, sample_size=tier.training_sample)
    else:
        rows = estimation.estimate_from_labels(tables["source_labels"], tables["featured"], comparisons).collect()  # one row a level
        half = lambda v: 0.5 if v is None else v
        key = {(r.comparison, r.level): r for r in rows}
        got = estimation.Parameters({k: half(r.m) for k, r in key.items()}, {k: half(r.u) for k, r in key.items()}, half(rows[0].match_rate))
    return replace(p, comparisons=estimation.with_parameters(comparisons, got), log_prior_odds=got.log_prior_odds)


def staging_of(s: Source, tables: dict[str, DataFrame]) -> Staging:
    """How a source is staged; tables holds what it joins, as lookup_<table>."""
    joins = tuple(SourceJoin(tables[f"lookup_{j.table}"], j.on, j.alias, j.how, j.columns) for j in s.joins)
    return Staging(s.name, s.unique_key, s.updated_at, tuple(s.columns), s.passthrough_columns, joins, s.filter, grace_period_hours=s.grace_period_hours, partition_column=s.partition_column,
                   batch_size=s.batch_size, partition_cursors=s.partition_cursors, cursor_mode=s.cursor_mode, hash_cursor=s.hash_cursor, cursors=s.cursors)


def featurized(c: Config, frames: list[DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """Staged sources with all features and keys."""
    if c.split_compounds:
        frames = [compound.split_compounds(f, c.split_compounds) for f in frames]
    lookups = [features.Enrichment(tables[f"lookup_{e.table}"], features.Feature("_key", e.function, e.inputs), e.lookup_key, e.columns, e.prefix, e.flag or "") for e in c.enrichment]
    df = features.engineer(frames, c.features, lookups, c.blocking_keys)
    return vectors.with_lsh(df, c.lsh.columns, c.lsh.dimensions, c.lsh.tables, c.lsh.functions, c.lsh.seed) if c.lsh else df


def frequency_columns(c: Config) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.tf.column for t in c.tiers for x in t.scoring.comparisons if x.tf))


def _model_stages(c: Config) -> list[Stage]:
    """Of each model: the matrix of its tier's candidates with their labels, predictions for all
    candidates, and metrics of the labels that training didn't see."""
    out: list[Stage] = []
    for m in c.models:
        tests = next(t for t in c.tiers if t.name == m.tier).scoring.comparisons
        names = [x.label for x in tests]
        seen = F.pmod(F.xxhash64(LEFT, RIGHT), F.lit(1000)) >= round(1000 * m.held_out)
        matrix, model = f"matrix_{m.tier}", {}

        def trained(t: dict[str, DataFrame], m=m, names=names, seen=seen, matrix=matrix, model=model):
            if not model:
                model["it"] = learning.train(t[matrix].where(seen), names, m.kind)
            return model["it"]

        def metrics(t: dict[str, DataFrame], seen=seen, matrix=matrix, trained=trained) -> DataFrame:
            rows = [(k, float(v)) for k, v in learning.evaluate(trained(t), t[matrix].where(~seen)).items()]
            return t[matrix].sparkSession.createDataFrame(rows, "metric string, value double")

        candidates = f"candidates_{m.tier}"
        out.append(Stage(matrix, (candidates, "featured", "source_labels"), lambda t, x=tests, k=candidates: learning.feature_matrix(t[k], t["featured"], x, t["source_labels"]), shared=True))
        out.append(Stage(f"predictions_{m.tier}", (candidates, "featured", matrix), lambda t, x=tests, k=candidates, m=m, trained=trained: learning.predict(trained(t), learning.feature_matrix(t[k], t["featured"], x), threshold=m.threshold)))
        out.append(Stage(f"evaluation_{m.tier}", (matrix,), metrics))
    return out


def stages_of(c: Config) -> list[Stage]:
    out: list[Stage] = []
    for s in c.sources:
        out.append(Stage(f"staged_{s.name}", (f"source_{s.name}", *(f"lookup_{j.table}" for j in s.joins)), lambda t, s=s: stage(t[f"source_{s.name}"], staging_of(s, t))))
    staged = tuple(f"staged_{s.name}" for s in c.sources)
    out.append(Stage("featured", (*staged, *dict.fromkeys(f"lookup_{e.table}" for e in c.enrichment)), lambda t: featurized(c, [t[x] for x in staged], t), shared=True))
    tf = frequency_columns(c)
    if tf:
        out.append(Stage("term_frequencies", ("featured",), lambda t: features.term_frequencies(t["featured"], tf), shared=True))
    before: str | None = None
    for tier in c.tiers:
        reads = ("featured", *((before,) if before else ()))
        out.append(Stage(f"candidates_{tier.name}", reads, lambda t, tier=tier, b=before: block(t["featured"], tier.blocking, excluded=t[b] if b else None), lambda d, n=tier.name: monitoring.blocking_gate(d, n), True))
        need = ("featured", f"candidates_{tier.name}", *(("term_frequencies",) if tf else ()))
        out.append(Stage(f"matches_{tier.name}", need, lambda t, tier=tier: score_pairs(t[f"candidates_{tier.name}"], t["featured"], _trained(tier, t), t.get("term_frequencies")), lambda d, n=tier.name: monitoring.matching_gate(d, n), True))
        now = f"all_matches_{tier.name}"
        out.append(Stage(now, (f"matches_{tier.name}", *((before,) if before else ())), lambda t, n=tier.name, b=before: accumulate(t[b] if b else None, t[f"matches_{n}"]), shared=True))
        if tier.review_size:
            out.append(Stage(f"review_{tier.name}", (f"matches_{tier.name}",), lambda t, tier=tier: review.review_queue(t[f"matches_{tier.name}"], tier.review_size, tier.review_window, tier.scoring.method == "fellegi_sunter", tier.scoring.min_score)))
        before = now
    last = before or "featured"
    gate = (lambda d: monitoring.cluster_gate(d, c.max_cluster_size)) if c.max_cluster_size else None
    out.append(Stage("entity_clusters", (last, "featured"), lambda t: clustering.cluster(c.clustering, t[last], t["featured"], c.min_cluster_confidence), gate, True))
    final = last
    if c.shape_confidence:
        out.append(Stage("shaped_matches", (last, "entity_clusters"), lambda t: clustering.shape_confidence(t[last], t["entity_clusters"])))
        final = "shaped_matches"
    out.append(Stage("resolved_entities", ("featured", "entity_clusters", final), lambda t: golden.resolve(t["featured"], t["entity_clusters"], t[final], c.golden)))
    out.append(Stage("cluster_quality", ("entity_clusters", final, "featured"), lambda t: clustering.cluster_quality(t["entity_clusters"], t[final], t["featured"])))
    out.append(Stage("blocking_effectiveness", ("featured", *(f"candidates_{t.name}" for t in c.tiers)), lambda t: blocking_effectiveness([(x.name, t["featured"], t[f"candidates_{x.name}"]) for x in c.tiers])))
    if c.placeholder_columns:
        out.append(Stage("placeholder_log", ("featured",), lambda t: profiling.placeholder_scan(t["featured"], c.placeholder_columns, t.get("run_id", "run"), c.name)))
    return out + _model_stages(c)


class Pipeline:
    def __init__(self, config: Config, stages: list[Stage] | None = None) -> None:
        self.config = config
        self.given = {f"source_{s.name}" for s in config.sources} | {f"lookup_{j.table}" for s in config.sources for j in s.joins} | {f"lookup_{e.table}" for e in config.enrichment}
        if config.models or any(t.training == "labeled" for t in config.tiers):
            self.given.add("source_labels")
        self.stages = order(stages or stages_of(config), self.given)

    @classmethod
    def from_stages(cls, config: Config, stages: list[Stage]) -> Pipeline:
        return cls(config, stages)

    @classmethod
    def from_table(cls, spark: SparkSession, table: str, unique_key: str, updated_at: str, name: str = "quick") -> Pipeline:
        """A pipeline for a catalog table, from its column names."""
        types = {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}
        columns = {c: t for c, t in types.items() if c not in (unique_key, updated_at)}
        return cls(quick_config(name, Source(name, table, unique_key, updated_at, columns, {c: r for c in columns if (r := R.detect_role(c))})))

    def validate(self) -> list[str]:
        return validate(self.config)

    def plan(self, sources: dict[str, DataFrame], lookups: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All tables as lazy frames; nothing but clustering runs."""
        tables = _tables(sources, lookups)
        for s in self.stages:
            tables[s.name] = s.make(tables)
        return tables

    def explain(self, sources: dict[str, DataFrame], name: str) -> str:
        return self.plan(sources)[name]._jdf.queryExecution().explainString(_formatted(sources))

    def estimate(self, sources: dict[str, DataFrame]) -> dict[str, int]:
        """Bytes that the optimizer expects of each source."""
        return {k: int(v._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for k, v in sources.items()}

    def drain(self, sources: dict[str, DataFrame], state: str, lookups: dict[str, DataFrame] | None = None, run_id: str | None = None, most: int | None = None) -> dict[str, int]:
        """What the sources have beyond their watermarks, batch by batch into the canonical index, for
        all tiers; batches by source. Index, watermarks and lock are kept in the folder state; a run
        that dies repeats its batch. `index(spark, state)` reads the result."""
        if bad := self.validate():
            raise ValueError("; ".join(bad))
        spark, c = next(iter(sources.values())).sparkSession, self.config
        tables, lock = _tables(sources, lookups), Lock(spark, state, c.name)
        tf = frequency_columns(c)
        lock.acquire()
        try:
            got = {}
            for s in c.sources:
                cursors = list(s.cursors or (s.updated_at,))
                extra = [x for x in cursors if x not in (*s.columns, *s.passthrough_columns)]
                got[s.name] = drain(
                    sources[s.name], staging_of(s, tables), cursors, lambda df, x=extra: featurized(c, [df.drop(*x)], tables), [t.blocking for t in c.tiers], [t.scoring for t in c.tiers],
                    VersionedTable(spark, f"{state}/index"), Watermarks(spark, state), run_id or uuid.uuid4().hex, lock, most, (lambda df: features.term_frequencies(df, tf)) if tf else None)
            return got
        finally:
            lock.release()

    @staticmethod
    def index(spark: SparkSession, state: str) -> DataFrame | None:
        """The canonical index: all records with their features and cluster_id."""
        return VersionedTable(spark, f"{state}/index").read()

    def run(self, sources: dict[str, DataFrame], run_id: str | None = None, state: str | None = None, strict: bool = False, lock: bool = False, lookups: dict[str, DataFrame] | None = None) -> Result:
        """Every table; shared ones are written. state: a folder in which completed stages and the
        lock are kept. strict: warnings of gates stop the run too. lookups: joined tables by name."""
        if bad := self.validate():
            raise ValueError("; ".join(bad))
        spark = next(iter(sources.values())).sparkSession
        result = Result(_tables(sources, lookups), run_id=run_id or uuid.uuid4().hex)
        result.log = monitoring.JobLog(result.run_id)
        held = Lock(spark, state, self.config.name) if lock and state else None
        if held:
            held.acquire()
        checkpoints = Checkpoints(spark, state) if state else None
        done = checkpoints.done(result.run_id) if checkpoints else set()
        for s in self.stages:
            path = f"{state}/{result.run_id}/{s.name}" if state else None
            if s.name in done and s.shared:
                table = spark.read.parquet(path)
            else:
                table = s.make(result.tables | {"run_id": result.run_id})
                if s.shared and path:

                    def write(d: DataFrame, p: str = path) -> int:
                        d.write.mode("overwrite").parquet(p)
                        return spark.read.parquet(p).count()  # from the files' footers

                    result.log.timed(s.name, table, write)
                    table = spark.read.parquet(path)
                    checkpoints.add(result.run_id, s.name, held)
                elif s.shared:
                    table = materialize(table)
            result.tables[s.name] = table
            for f in s.gate(table) if s.gate else []:
                result.findings.append(f)
                if f.severity == "error" or strict:
                    raise GateError(f.what)
        if checkpoints:
            checkpoints.finish(result.run_id, held)
        if held:
            held.release()
        return result


def _tables(sources: dict[str, DataFrame], lookups: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    return {f"source_{k}": v for k, v in sources.items()} | {f"lookup_{k}": v for k, v in (lookups or {}).items()}


def _formatted(sources: dict[str, DataFrame]):
    spark = next(iter(sources.values())).sparkSession
    return spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


def clusters_of(result: Result, key: str = "id") -> DataFrame:
    """cluster_id and the sorted keys of its records."""
    rows = result["featured"].select("entity_uid", key).join(result["entity_clusters"], "entity_uid")
    return rows.groupBy(CLUSTER_ID).agg(F.sort_array(F.collect_list(key)).alias("members"))


