"""Configurations: from YAML, or made from column names.

A configuration says what to read, which features to make, how to block, score and cluster, and
what to put out. `load` takes includes, deep merges and `${NAME:-default}` from the environment.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..functions.comparisons import USES_PYTHON
from ..functions.registry import COMPARISONS, FEATURES
from ..operators.blocking import Blocking, BlockingPath, check_paths
from ..operators.features import Feature, levels
from ..operators.golden import FieldStrategy, Golden
from ..operators.scoring import Band, Comparison, Level, Scoring, Signal, TermFrequency, Test
from ..operators.staging import HashCursor, PartitionCursor
from ..sources.tables import column_type
from . import roles as R

#: Words that SQL in a configuration must not hold.
FORBIDDEN = re.compile(r";|--|/\*|\b(drop|delete|insert|update|merge|alter|create|truncate|grant|revoke|call|execute)\b", re.I)


@dataclass(frozen=True)
class Source:
    name: str
    table: str
    unique_key: str
    updated_at: str
    columns: dict[str, str] = field(default_factory=dict)  # type by name
    roles: dict[str, str] = field(default_factory=dict)
    passthrough_columns: tuple[str, ...] = ()
    filter: str | None = None
    entity_type: str | None = None
    batch_size: int | None = None
    cursors: tuple[str, ...] = ()
    cursor_mode: str = "ordered"
    grace_period_hours: int = 0
    partition_column: str | None = None
    partition_cursors: tuple[PartitionCursor, ...] = ()
    hash_cursor: HashCursor | None = None
    joins: tuple[Join, ...] = ()


@dataclass(frozen=True)
class Join:
    """A table that staging joins; on: SQL over the aliases `src` and this one."""

    table: str
    on: str
    alias: str
    how: str = "left"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lookup:
    """A table that features are enriched from, by a key that a feature function makes."""

    table: str
    function: str
    inputs: tuple[str, ...]
    lookup_key: str
    columns: tuple[str, ...]
    prefix: str = ""
    flag: str | None = None


@dataclass(frozen=True)
class Tier:
    name: str
    blocking: Blocking
    scoring: Scoring
    review_size: int = 0
    review_window: float = 0.15
    training: str = "none"
    training_iterations: int = 10
    training_sample: int = 100_000


@dataclass(frozen=True)
class Lsh:
    """Buckets of the columns' text vectors, lsh_bucket_0 and so on, to block on."""

    columns: tuple[str, ...]
    dimensions: int = 64
    tables: int = 8
    functions: int = 4
    seed: int = 42


@dataclass(frozen=True)
class Model:
    """A classifier of a tier's candidates, learnt from the table `source_labels`; a part of the labels,
    by a hash of the pair, is held out to evaluate it."""

    tier: str
    kind: str = "LOGISTIC_REG"
    threshold: float = 0.5
    held_out: float = 0.2


@dataclass(frozen=True)
class Config:
    name: str
    sources: tuple[Source, ...]
    features: tuple[Feature, ...]
    blocking_keys: tuple[Feature, ...]
    tiers: tuple[Tier, ...]
    golden: Golden
    clustering: str = "connected_components"
    min_cluster_confidence: float = 0.0
    max_cluster_size: int = 0
    allow_udfs: bool = True
    placeholder_columns: dict[str, str] = field(default_factory=dict)
    shape_confidence: bool = False
    split_compounds: str | None = None
    lsh: Lsh | None = None
    enrichment: tuple[Lookup, ...] = ()
    models: tuple[Model, ...] = ()


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ValueError(f"{m[1]} isn't set and has no default")
        return m[2]

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text)


def merge(base: dict, over: dict) -> dict:
    """over on top of base; mappings are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_yaml(path: str, overrides: dict | None = None, env: dict[str, str] | None = None, seen: tuple[str, ...] = ()) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    here = str(Path(path).resolve())
    if here in seen:
        raise ValueError(f"{path} includes itself")
    own = yaml.safe_load(interpolate(Path(path).read_text(), env)) or {}
    out: dict = {}
    for other in own.pop("include", []):
        out = merge(out, read_yaml(str(Path(path).parent / other), env=env, seen=(*seen, here)))
    return merge(merge(out, own), overrides or {})


def _test(d: dict) -> Test:
    return Test(d.get("left", ""), d.get("right") or d.get("left", ""), d.get("method", "exact"), d.get("params", {}), d.get("sql") or d.get("sql_expr"))


def _comparison(d: dict, pool: dict[str, dict]) -> Comparison:
    if "ref" in d:
        d = pool[d["ref"]] | {k: v for k, v in d.items() if k != "ref"} | {"name": d.get("name", d["ref"])}
    test, tf = _test(d), d.get("tf_adjustment") or {}
    lv = tuple(
        Level(x["label"], Test(test.left, test.right, x["method"], x.get("params", {})) if x.get("method") else Test(sql=x["sql_expr"]) if x.get("sql_expr") else None, x.get("m") or 0.9, x.get("u") or 0.1, x.get("log_weight") or 0.0, x.get("tf_adjusted", False))
        for x in d.get("levels") or ()
    )
    return Comparison(test, float(d.get("weight", 1.0)), d.get("name", ""), lv, TermFrequency(tf.get("tf_adjustment_column") or test.left, tf.get("tf_minimum_u_value", 0.001)) if tf.get("enabled") else None)


def _signals(d: dict) -> list[Signal]:
    out = []
    for x in d.get("hard_negatives", ()):
        kind = "penalize" if x.get("severity") == "hn4_contextual" else x.get("action", "disqualify")
        out.append(Signal(_test(x), kind, float(x.get("penalty", 0.0)), entity_type=x.get("entity_type_condition"), strict=x.get("strict_nulls", False), requires_overrides=int(x.get("requires_overrides", 0))))
    out += [Signal(_test(x), x.get("action", "boost"), float(x.get("boost", 5.0)), x.get("target_band", "HIGH"), x.get("entity_type_condition")) for x in d.get("hard_positives", ())]
    return out + [Signal(_test(x), "bonus", float(x.get("bonus", 1.0)), entity_type=x.get("entity_type_condition")) for x in d.get("soft_signals", ())]


def _tier(d: dict, index: int, pool: dict[str, dict], shared: list[Signal]) -> Tier:
    b, t = d.get("blocking", {}), d.get("threshold", {})
    paths = tuple(BlockingPath(tuple(p.get("keys", ())), tuple(p.get("lsh_keys", ())), p.get("candidate_limit", 200), p.get("bucket_size_limit", 10_000)) for p in b.get("paths", ()))
    bands = tuple(Band(x["name"], x["min_score"], x.get("max_score", 999_999.0), x.get("action", "accept")) for x in d.get("score_banding", {}).get("bands", ())) if d.get("score_banding", {}).get("enabled") else ()
    scoring = Scoring(
        d["name"], tuple(_comparison(x, pool) for x in d.get("comparisons", ())), {"weighted_sum": "sum"}.get(t.get("method", "sum"), t.get("method", "sum")), index, float(t.get("min_score", 0.0)), t.get("match_threshold"),
        int(t.get("min_matching_comparisons", 0)), float(t.get("log_prior_odds", 0.0)), tuple(shared + _signals(d)), bands, d.get("confidence"), d.get("confidence_method", "ratio"), d.get("audit_trail", False))
    review, training = d.get("active_learning", {}), d.get("training", {})
    return Tier(d["name"], Blocking(paths, d.get("link_type", "link_and_dedupe"), b.get("lsh_min_bands", 0)), scoring, review.get("queue_size", 200) if review.get("enabled") else 0, review.get("uncertainty_window", 0.15),
                training.get("method", "none"), training.get("em_max_iterations", 10), training.get("em_sample_size", 100_000))


def _feature(d: dict) -> Feature:
    inputs = d.get("inputs") or ([d["input"]] if "input" in d else [])
    return Feature(d["name"], d.get("function"), tuple(inputs), d.get("params", {}), d.get("sql"))


def _lsh(d: dict) -> Lsh | None:
    if not d.get("enabled"):
        return None
    h = d.get("lsh", {})
    return Lsh(tuple(d["source_columns"]), d.get("dimensions", 64), h.get("num_hash_tables", 8), h.get("num_hash_functions_per_table", 4), h.get("projection_seed", 42))


#: The keys that each part of a configuration may hold.
KEYS = {
    "": "project include sources global_signals comparison_pool matching_tiers reconciliation feature_engineering embeddings placeholder_columns allow_udfs models",
    "sources": "name table unique_key updated_at columns passthrough_columns filter entity_type batch_size cursors cursor_mode grace_period_hours partition_column partition_cursors hash_cursor joins",
    "matching_tiers": "name enabled description blocking comparisons threshold score_banding confidence confidence_method audit_trail active_learning training hard_negatives hard_positives soft_signals link_type",
    "feature_engineering": "name_features address_features contact_features custom_features features blocking_keys composite_keys enrichment_joins split_compounds",
    "reconciliation": "strategy canonical_selection clustering scoring_columns include_match_metadata entity_id_prefix confidence_shaping",
}


def unknown_keys(d: dict) -> list[str]:
    """What a configuration holds that nothing reads, most often a misspelt key."""
    bad = []
    for part, names in KEYS.items():
        held = d if not part else d.get(part) or []
        for x in held if isinstance(held, list) else [held]:
            where = part and f"{part} {x.get('name', '')}".strip() or "the configuration"
            bad += [f"{where} has an unknown key {k!r}" for k in x if k not in names.split()]
    return bad


def _source(s: dict) -> Source:
    h = s.get("hash_cursor")
    return Source(
        s["name"], s["table"], s["unique_key"], s["updated_at"], {c["name"]: c.get("type", "STRING") for c in s.get("columns", ())}, {c["name"]: c["role"] for c in s.get("columns", ()) if c.get("role")},
        tuple(s.get("passthrough_columns", ())), s.get("filter"), s.get("entity_type"), s.get("batch_size"), tuple(s.get("cursors", ())), s.get("cursor_mode", "ordered"), int(s.get("grace_period_hours", 0)), s.get("partition_column"),
        tuple(PartitionCursor(c["column"], c["value"], c.get("strategy", "range")) for c in s.get("partition_cursors", ())), HashCursor(h["column"], h.get("modulus", 1000), h.get("alias", "_hash_partition")) if h else None,
        tuple(Join(j["table"], j["on"], j.get("alias", j["table"]), j.get("type", "left").lower(), tuple(j.get("columns", ()))) for j in s.get("joins", ())))


def from_dict(d: dict) -> Config:
    if bad := unknown_keys(d):
        raise ValueError("; ".join(bad))
    sources = tuple(_source(s) for s in d.get("sources", ()))
    shared = _signals(d.get("global_signals", {}))
    tiers = tuple(_tier(t, i, d.get("comparison_pool", {}), shared) for i, t in enumerate(d.get("matching_tiers", ())) if t.get("enabled", True))
    rec = d.get("reconciliation", {})
    canonical, cluster = rec.get("canonical_selection", {}), rec.get("clustering", {})
    fields = tuple(FieldStrategy(f["column"], f.get("strategy", "most_complete"), tuple(f.get("source_priority", ())), f.get("decay_rate", 0.01)) for f in canonical.get("field_strategies", ()))
    columns = tuple(dict.fromkeys(c for s in sources for c in s.columns))
    golden = Golden(columns, canonical.get("method", "completeness"), tuple(rec.get("scoring_columns", ())), tuple(dict.fromkeys(c for s in sources for c in s.passthrough_columns)),
                    tuple(canonical.get("source_priority", ())), fields, canonical.get("default_field_strategy", "most_complete"), rec.get("include_match_metadata", True), rec.get("entity_id_prefix", ""), rec.get("strategy", "tier_priority"))
    eng = d.get("feature_engineering", {})
    every = [_feature(f) for g in ("name_features", "address_features", "contact_features", "custom_features", "features") for f in eng.get(g, ())]
    keys = [_feature(f) for f in eng.get("blocking_keys", ())] + [_feature({"function": "farm_fingerprint_concat"} | f) for f in eng.get("composite_keys", ())]
    lookups = tuple(Lookup(e["table"], e.get("function", "identity"), tuple(e.get("inputs") or [e["input"]]), e["lookup_key"], tuple(e.get("columns", ())), e.get("prefix", ""), e.get("flag")) for e in eng.get("enrichment_joins", ()))
    models = tuple(Model(m["tier"], m.get("kind", "LOGISTIC_REG"), float(m.get("threshold", 0.5)), float(m.get("held_out", 0.2))) for m in d.get("models", ()))
    return Config(d.get("project", {}).get("name", "pipeline"), sources, tuple(every), tuple(keys), tiers, golden, cluster.get("method", "connected_components"),
                  cluster.get("min_cluster_confidence", 0.0), cluster.get("max_cluster_size", 0), d.get("allow_udfs", True), d.get("placeholder_columns", {}), bool(rec.get("confidence_shaping")), eng.get("split_compounds"), _lsh(d.get("embeddings", {})), lookups, models)


def load(path: str, overrides: dict | None = None, env: dict[str, str] | None = None) -> Config:
    c = from_dict(read_yaml(path, overrides, env))
    if bad := validate(c):
        raise ValueError("; ".join(bad))
    return c


def _sqls(c: Config) -> Iterable[str]:
    yield from (f.sql for f in (*c.features, *c.blocking_keys) if f.sql)
    yield from (s.filter for s in c.sources if s.filter)
    yield from (j.on for s in c.sources for j in s.joins)
    for t in c.tiers:
        tests = [*(x.test for x in t.scoring.comparisons), *(lv.test for x in t.scoring.comparisons for lv in x.levels if lv.test), *(s.test for s in t.scoring.signals)]
        yield from (x.sql for x in tests if x.sql)


def _staging_faults(c: Config) -> list[str]:
    bad: list[str] = []
    for s in c.sources:
        bad += [f"source {s.name!r} has a column of an unknown type {t!r}" for t in s.columns.values() if not _is_type(t)]
        if s.cursor_mode not in ("ordered", "independent"):
            bad.append(f"source {s.name!r} has an unknown cursor mode {s.cursor_mode!r}")
        if s.batch_size is not None and s.batch_size < 1:
            bad.append(f"source {s.name!r} has a batch size below 1")
        if s.grace_period_hours < 0:
            bad.append(f"source {s.name!r} has a negative grace period")
        if s.hash_cursor and s.hash_cursor.modulus < 2:
            bad.append(f"source {s.name!r} has a hash cursor of fewer than 2 parts")
        bad += [f"source {s.name!r} has a partition cursor of an unknown kind {p.strategy!r}" for p in s.partition_cursors if p.strategy not in ("range", "equality", "in")]
        bad += [f"source {s.name!r} has an unknown join {j.how!r}" for j in s.joins if j.how not in ("left", "inner", "right", "cross")]
        bad += [f"source {s.name!r} has a role for {k!r}, which it has no column of" for k in s.roles if k not in s.columns]
        aliases = ["src", *(j.alias for j in s.joins)]
        bad += [f"source {s.name!r} has the alias {a!r} twice" for a in sorted({a for a in aliases if aliases.count(a) > 1})]
    return bad


def _is_type(name: str) -> bool:
    try:
        column_type(name)
    except ValueError:
        return False
    return True


def _scoring_faults(c: Config) -> list[str]:
    bad: list[str] = []
    for t in c.tiers:
        p = t.scoring
        if p.method not in ("sum", "min_all", "fellegi_sunter"):
            bad.append(f"tier {t.name!r} has an unknown method {p.method!r}")
        labels = [x.label for x in p.comparisons]
        bad += [f"tier {t.name!r} has the comparison {n!r} twice" for n in sorted({n for n in labels if labels.count(n) > 1})]
        for x in p.comparisons:
            if x.weight < 0:
                bad.append(f"tier {t.name!r}: {x.label!r} has a negative weight")
            if x.levels and p.method != "fellegi_sunter":
                bad.append(f"tier {t.name!r}: {x.label!r} has levels, which only fellegi_sunter reads")
            if x.levels and all(lv.test for lv in x.levels):
                bad.append(f"tier {t.name!r}: the levels of {x.label!r} have no last one without a test")
            bad += [f"tier {t.name!r}: level {lv.label!r} of {x.label!r} needs m and u between 0 and 1" for lv in x.levels if not (0 < lv.m <= 1 and 0 < lv.u <= 1)]
            bad += [f"tier {t.name!r}: level {lv.label!r} of {x.label!r} is adjusted by term frequencies that aren't switched on" for lv in x.levels if lv.tf_adjusted and not x.tf]
            if x.tf and not 0 < x.tf.minimum_u <= 1:
                bad.append(f"tier {t.name!r}: {x.label!r} needs a least u between 0 and 1")
        bands = sorted(p.bands, key=lambda b: b.min_score)
        bad += [f"tier {t.name!r}: band {b.name!r} ends before it begins" for b in bands if b.max_score <= b.min_score]
        bad += [f"tier {t.name!r}: bands {a.name!r} and {b.name!r} overlap" for a, b in zip(bands, bands[1:], strict=False) if a.max_score > b.min_score and a.max_score != 999_999.0]
        if bands and p.method != "fellegi_sunter" and max(b.max_score for b in bands) <= p.min_score:
            bad.append(f"tier {t.name!r}: no band reaches the least score {p.min_score:g}")
        if p.min_matching_comparisons > len(p.comparisons):
            bad.append(f"tier {t.name!r} asks for more agreeing comparisons than it has")
        if p.confidence is not None and not 0 <= p.confidence <= 1:
            bad.append(f"tier {t.name!r} has a confidence outside 0 to 1")
        bad += [f"tier {t.name!r} names an unknown band {s.band!r}" for s in p.signals if s.kind == "elevate_band" and p.bands and s.band not in {b.name for b in p.bands}]
        bad += [f"tier {t.name!r} has a signal of an unknown kind {s.kind!r}" for s in p.signals if s.kind not in ("disqualify", "penalize", "bonus", "boost", "auto_match", "elevate_band")]
    columns = {x for s in c.sources for x in (*s.columns, *s.passthrough_columns)} | {f.name for f in c.features}
    bad += [f"golden records take {f.column!r}, which no source has" for f in c.golden.field_strategies if f.column not in columns]
    bad += [f"unknown clustering method {c.clustering!r}"] * (c.clustering not in ("connected_components", "star", "best_match"))
    bad += [f"model of an unknown tier {m.tier!r}" for m in c.models if m.tier not in {t.name for t in c.tiers}]
    return bad + [f"the model of {m.tier!r} holds out {m.held_out:g} of its labels" for m in c.models if not 0 < m.held_out < 1]


def validate(c: Config) -> list[str]:
    """What is wrong with a configuration; empty if nothing is."""
    bad: list[str] = []
    if not c.sources:
        bad.append("there is no source")
    if len({frozenset(s.columns) for s in c.sources}) > 1:
        bad.append("sources declare different columns")
    for names, what in (([s.name for s in c.sources], "source"), ([t.name for t in c.tiers], "tier"), ([f.name for f in (*c.features, *c.blocking_keys)], "feature")):
        bad += [f"{what} {n!r} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
    columns = {x for s in c.sources for x in (*s.columns, *s.passthrough_columns, *(y for j in s.joins for y in j.columns))} | {"source_name", "entity_uid", "entity_type"}
    columns |= {f"{e.prefix}{x}" for e in c.enrichment for x in e.columns} | {e.flag for e in c.enrichment if e.flag}
    bad += _staging_faults(c) + _scoring_faults(c)
    for f in (*c.features, *c.blocking_keys):
        if f.function and f.function not in FEATURES.names():
            bad.append(f"feature {f.name!r} uses an unknown function {f.function!r}")
    try:
        levels([*c.features, *c.blocking_keys], columns)
    except ValueError as e:
        bad.append(str(e))
    known = columns | {f.name for f in (*c.features, *c.blocking_keys)} | {f"lsh_bucket_{i}" for i in range(c.lsh.tables if c.lsh else 0)}
    bad += [f"feature {f.name!r} needs an unknown column {x!r}" for f in (*c.features, *c.blocking_keys) for x in f.inputs if x not in known]
    if not c.tiers:
        bad.append("there is no tier")
    for t in c.tiers:
        if not t.blocking.paths:
            bad.append(f"tier {t.name!r} has no blocking path")
        bad += [f"tier {t.name!r}: {x}" for x in check_paths(t.blocking)]
        bad += [f"tier {t.name!r} blocks on an unknown column {k!r}" for p in t.blocking.paths for k in (*p.keys, *p.lsh_keys) if k not in known]
        if t.training not in ("none", "em", "labeled"):
            bad.append(f"tier {t.name!r} has an unknown training method {t.training!r}")
        if not t.scoring.comparisons:
            bad.append(f"tier {t.name!r} compares nothing")
        for x in t.scoring.comparisons:
            for test in (x.test, *(lv.test for lv in x.levels if lv.test)):
                if test.sql is None and test.method not in COMPARISONS.names():
                    bad.append(f"tier {t.name!r} uses an unknown comparison {test.method!r}")
                if test.sql is None and test.method in USES_PYTHON and not c.allow_udfs:
                    bad.append(f"tier {t.name!r}: {test.method!r} needs a UDF, and allow_udfs is off")
                bad += [f"tier {t.name!r} compares an unknown column {k!r}" for k in test.columns() if k and k not in known]
        if t.scoring.method == "sum":
            most = sum(x.weight for x in t.scoring.comparisons)
            if most and t.scoring.min_score > most + sum(max(s.value, 0) for s in t.scoring.signals):
                bad.append(f"tier {t.name!r}: no pair can reach {t.scoring.min_score:g}")
    bad += [f"SQL {s!r} holds what isn't allowed" for s in _sqls(c) if FORBIDDEN.search(s)]
    return bad


def quick_config(name: str, source: Source | Sequence[Source], roles: dict[str, str] | None = None, link_type: str = "link_and_dedupe", identifiers: Sequence[str] = ()) -> Config:
    """A configuration from column names: roles are found, and give features, keys and comparisons;
    an exact tier asks for seven tenths of all weight, a fuzzy one for four, and the blocking keys
    are shared out between them. identifiers: roles that name a record by themselves; where there are
    columns of them, a tier before the others takes pairs that agree in one."""
    sources = (source,) if isinstance(source, Source) else tuple(source)
    columns = sources[0].columns
    found = roles or sources[0].roles or {c: r for c in columns if (r := R.detect_role(c))}
    if not found:
        raise ValueError("no column has a known role; name the roles")
    features = [f for c, r in found.items() for f in R.features_for(c, r)]
    keys = [k for c, r in found.items() if (k := R.blocking_key_for(c, r))]
    every = [x for c, r in found.items() for x in R.comparisons_for(c, r)]
    strict = [x for x in every if x.test.method in ("exact", "numeric_within", "numeric_percent_diff")]
    half = max(1, (len(keys) + 1) // 2)
    split = [keys[:half] or keys, keys[half:] or keys]
    wanted = [("exact", strict, 0.7 * sum(x.weight for x in strict), split[0]), ("fuzzy", every, 0.4 * sum(x.weight for x in every), split[1])]
    named = [(k, x) for c, r in found.items() if r in identifiers and (k := R.blocking_key_for(c, r)) for x in R.comparisons_for(c, r) if x.test.method == "exact"]
    if named:
        wanted.insert(0, ("identifier", [x for _, x in named], min(x.weight for _, x in named), list(dict.fromkeys(k for k, _ in named))))
    tiers = tuple(Tier(tier, Blocking(tuple(BlockingPath((k,), (), 200, 10_000) for k in paths), link_type), Scoring(tier, tuple(comps), "sum", i, round(least, 4))) for i, (tier, comps, least, paths) in enumerate(wanted))
    return Config(name, tuple(replace(s, roles=found) for s in sources), tuple(features), (), tiers, Golden(tuple(columns)))


@dataclass(frozen=True)
class Preset:
    """What a field of use looks at: roles, those of them that name a record by themselves, and whether
    pairs within a source, across sources or both are looked for."""

    roles: tuple[str, ...]
    identifiers: tuple[str, ...] = ()
    link_type: str = "link_and_dedupe"
    least_sources: int = 1

    def __call__(self, name: str, source: Source | Sequence[Source]) -> Config:
        sources = (source,) if isinstance(source, Source) else tuple(source)
        if len(sources) < self.least_sources:
            raise ValueError(f"{name}: linkage needs {self.least_sources} sources at least")
        every = (*self.roles, *self.identifiers)
        found = {c: r for c in sources[0].columns if (r := sources[0].roles.get(c) or R.detect_role(c)) and r in every}
        return quick_config(name, sources, found, self.link_type, self.identifiers)


_PERSON = ("first_name", "last_name", "full_name", "date_of_birth", "email", "phone")
_PLACE = ("address_line_1", "city", "state", "zip_code")
_FIRM = ("company_name", "dba_name", "phone", "email", "website")

#: Configurations for a field of use.
PRESETS: dict[str, Preset] = {
    "person_dedup": Preset((*_PERSON, *_PLACE), ("ssn",), "dedupe_only"),
    "person_linkage": Preset((*_PERSON, *_PLACE), ("ssn",), "link_only", 2),
    "business_dedup": Preset((*_FIRM, *_PLACE), ("ein", "duns"), "dedupe_only"),
    "insurance_dedup": Preset((*_PERSON, *_PLACE, "date_of_loss"), ("policy_number", "claim_number", "ssn"), "dedupe_only"),
    "financial_transaction": Preset((*_PERSON, "routing_number", "amount", "transaction_date", "currency"), ("account_number",)),
    "healthcare_patient": Preset((*_PERSON, *_PLACE, "gender"), ("mrn", "npi", "ssn"), "dedupe_only"),
    "healthcare_provider": Preset((*_PERSON, *_PLACE), ("npi", "dea_number", "license_number"), "dedupe_only"),
    "banking_customer": Preset((*_PERSON, *_PLACE, "routing_number"), ("account_number", "iban", "ssn"), "dedupe_only"),
    "securities": Preset(("company_name",), ("ticker", "cusip", "isin")),
    "ecommerce_product": Preset(("product_name", "brand", "category", "price", "seller_name", "description"), ("sku", "upc")),
    "vehicle_registry": Preset(("make", "model", "year", "color"), ("vin", "license_plate"), "dedupe_only"),
    "real_estate": Preset((*_PLACE, "latitude", "longitude", "property_type"), ("parcel_number",), "dedupe_only"),
    "real_estate_property": Preset((*_PLACE, "full_name", "company_name"), ("parcel_number", "mls_id", "deed_reference"), "dedupe_only"),
    "education_student": Preset((*_PERSON, *_PLACE, "institution_code"), ("student_id", "enrollment_id"), "dedupe_only"),
    "hr_employee": Preset((*_PERSON, "job_title"), ("employee_id",), "dedupe_only"),
    "address_dedup": Preset(("full_name", "address_line_2", *_PLACE), (), "dedupe_only"),
    "telecom_subscriber": Preset((*_PERSON, *_PLACE), ("subscriber_id", "imsi", "imei", "msisdn", "service_point_id", "meter_id")),
    "logistics_carrier": Preset((*_FIRM, *_PLACE), ("duns", "mc_dot_number", "carrier_scac", "ein")),
    "retail_customer": Preset((*_PERSON, *_PLACE, "device_fingerprint_id", "payment_token_id"), ("loyalty_id", "customer_id")),
    "public_sector": Preset((*_PERSON, *_PLACE, "case_number"), ("passport", "national_id", "voter_registration", "license_number", "ssn"), "dedupe_only"),
    "travel_guest": Preset((*_PERSON, *_PLACE), ("guest_id", "booking_reference", "loyalty_id", "passport")),
    "vendor_master": Preset((*_FIRM, *_PLACE), ("vendor_id", "duns", "cage_code", "sam_uei", "ein")),
    "identity_fraud": Preset((*_PERSON, *_PLACE, "device_fingerprint_id", "payment_token_id"), ("ssn", "passport", "national_id", "account_number")),
}


def describe(c: Config) -> str:
    lines = [f"{c.name}: {len(c.sources)} sources, {len(c.features)} features, {len(c.tiers)} tiers, clusters by {c.clustering}"]
    for t in c.tiers:
        lines.append(f"  {t.name}: {t.scoring.method} from {t.scoring.match_threshold if t.scoring.match_threshold is not None else t.scoring.min_score:g}; " + "; ".join(f"block {', '.join((*p.keys, *p.lsh_keys))}" for p in t.blocking.paths))
        lines += [f"    {x.label} x {x.weight:g}" for x in t.scoring.comparisons]
    return "\n".join(lines)


def column_list(sources: Sequence[Source]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for s in sources for c in (*s.columns, *s.passthrough_columns)))
