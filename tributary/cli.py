"""Commands: python -m tributary.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from pathlib import Path

from .plans import config as C

STARTER = """project:
  name: customers
sources:
  - name: customers
    table: ${CUSTOMERS:-customers}
    unique_key: id
    updated_at: updated_at
    columns:
      - {name: first_name}
      - {name: last_name}
      - {name: email}
feature_engineering:
  features:
    - {name: first_clean, function: name_clean, input: first_name}
    - {name: last_clean, function: name_clean, input: last_name}
    - {name: email_clean, function: lower_trim, input: email}
matching_tiers:
  - name: exact
    blocking: {paths: [{keys: [email_clean]}]}
    comparisons:
      - {left: first_clean, method: exact, weight: 2}
      - {left: last_clean, method: exact, weight: 2}
    threshold: {min_score: 2}
"""


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tributary").getOrCreate()


def _table(spark, name: str):
    if name.endswith(".csv"):
        return spark.read.option("header", True).option("nullValue", "").csv(name)
    return spark.read.parquet(name) if "/" in name or name.endswith(".parquet") else spark.table(name)


def _sources(spark, c: C.Config) -> dict:
    return {s.name: _table(spark, s.table) for s in c.sources}


def cmd_run(a) -> None:
    from .plans.pipeline import Pipeline

    spark, c = _session(), C.load(a.config)
    lookups = {n: _table(spark, n) for n in dict.fromkeys([*(j.table for s in c.sources for j in s.joins), *(e.table for e in c.enrichment)])}
    if a.drain:
        if not a.state:
            sys.exit("--drain needs --state, the folder that keeps the index and the watermarks")
        batches = Pipeline(c).drain(_sources(spark, c), a.state, lookups, a.run_id)
        Pipeline.index(spark, a.state).write.mode("overwrite").parquet(a.output)
        print(json.dumps({"batches": batches}))
        return
    result = Pipeline(c).run(_sources(spark, c), run_id=a.run_id, state=a.state, lock=bool(a.state), lookups=lookups)
    result["resolved_entities"].write.mode("overwrite").parquet(a.output)
    print(json.dumps({"run_id": result.run_id, "findings": [f.what for f in result.findings]}))


def cmd_validate(a) -> None:
    bad = C.validate(C.from_dict(C.read_yaml(a.config)))
    print("\n".join(bad) or "valid")
    sys.exit(bool(bad))


def cmd_preview_plan(a) -> None:
    from .plans.pipeline import Pipeline

    spark, c = _session(), C.load(a.config)
    print(Pipeline(c).explain(_sources(spark, c), a.stage))


def _featured(a):
    from .plans.pipeline import Pipeline

    spark, c = _session(), C.load(a.config)
    return c, Pipeline(c).plan(_sources(spark, c))


def cmd_estimate_params(a) -> None:
    from .operators.estimation import estimate_em

    c, tables = _featured(a)
    for t in c.tiers:
        p = estimate_em(tables[f"candidates_{t.name}"], tables["featured"], t.scoring.comparisons, sample_size=a.sample)
        print(f"{t.name}: match rate {p.match_rate:.4f}, log prior odds {p.log_prior_odds:.3f}\n{p.frame().to_string(index=False)}")


def cmd_review_queue(a) -> None:
    from .operators.review import review_queue

    c, tables = _featured(a)
    for t in c.tiers:
        review_queue(tables[f"matches_{t.name}"], a.size, fellegi_sunter=t.scoring.method == "fellegi_sunter", min_score=t.scoring.min_score).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output}/{t.name}")


def cmd_ingest_labels(a) -> None:
    from .operators.review import ingest_labels

    spark = _session()
    reviewed = spark.read.option("header", True).option("inferSchema", True).csv(a.reviewed)
    ingest_labels(None, reviewed, a.tier).write.mode("append").parquet(a.labels)


def cmd_profile(a) -> None:
    from .operators.profiling import column_profile, suggest

    rows = column_profile(_table(_session(), a.table), a.columns).collect()
    print("\n".join(json.dumps(r.asDict() | {"suggestion": suggest(r.asDict())}, default=str) for r in rows))


def cmd_profile_cursors(a) -> None:
    from .operators.profiling import cursor_profile

    print("\n".join(json.dumps(r.asDict()) for r in cursor_profile(_table(_session(), a.table), a.columns).collect()))


def cmd_profile_placeholders(a) -> None:
    from .operators.profiling import suspected_placeholders

    print("\n".join(json.dumps(r.asDict()) for r in suspected_placeholders(_table(_session(), a.table), a.columns).toLocalIterator()))


def cmd_analyze(a) -> None:
    from .operators.profiling import threshold_sweep, weight_contribution

    c, tables = _featured(a)
    for t in c.tiers:
        m, names = tables[f"matches_{t.name}"], [x.label for x in t.scoring.comparisons]
        prefix = "match_log_weight_" if t.scoring.method == "fellegi_sunter" else "match_score_"
        weight_contribution(m, names, prefix).show(truncate=False)
        threshold_sweep(m, t.scoring.min_score).show(truncate=False)


def cmd_init(a) -> None:
    with Path(a.config).open("x") as f:
        f.write(STARTER)


def cmd_check_env(a) -> None:
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "yaml"):
        print(f"{name}: {'found' if importlib.util.find_spec(name) else 'missing'}")


def cmd_describe(a) -> None:
    print(C.describe(C.load(a.config)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *args):
        q = sub.add_parser(name)
        q.set_defaults(run=f)
        for flags, options in args:
            q.add_argument(*flags, **options)

    config = (("config",), {})
    table, columns = (("table",), {}), (("columns",), {"nargs": "+"})
    add("run", cmd_run, config, (("--output",), {"required": True}), (("--run-id",), {}), (("--state",), {}), (("--drain",), {"action": "store_true"}))
    add("validate", cmd_validate, config)
    add("preview-plan", cmd_preview_plan, config, (("--stage",), {"default": "resolved_entities"}))
    add("estimate-params", cmd_estimate_params, config, (("--sample",), {"type": int}))
    add("review-queue", cmd_review_queue, config, (("--output",), {"required": True}), (("--size",), {"type": int, "default": 100}))
    add("ingest-labels", cmd_ingest_labels, (("reviewed",), {}), (("labels",), {}), (("--tier",), {"required": True}))
    add("profile", cmd_profile, table, columns)
    add("profile-cursors", cmd_profile_cursors, table, columns)
    add("profile-placeholders", cmd_profile_placeholders, table, columns)
    add("analyze", cmd_analyze, config)
    add("init", cmd_init, config)
    add("check-env", cmd_check_env)
    add("describe", cmd_describe, config)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main()
