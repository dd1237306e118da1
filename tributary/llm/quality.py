"""Quality rules: adaptive thresholds from mergeable quantile sketches, then a joined filter.

Every document gets a few counts. Documents that fail two fixed base rules are out. From the
others, a quantile sketch is built for each (language, source) and metric: counts of integer bins
that are one unit wide below 2^(precision + 1) and beyond it 2^k wide in the k-th octave, so that
the edges of the bin that holds a quantile are off by one part in 2^precision at most, whatever
the values; nothing is clipped, and a sketch has at most 64 * 2^precision bins. Two sketches merge
by adding counts, so partial aggregation builds them before any shuffle, and groups too small for
an own threshold use the merged sketch of their language, or of all documents.

A fence lies beyond the high quantile by `reach` times the distance between the two quantiles of
the metric, and by `floor` at least. Metrics that spread in every group use the quartiles, which
junk doesn't move as long as it is under a quarter of the group; metrics that are 0 for most
documents use the 98th of 100 parts, and so follow the group's tail. The fences are joined back to
the documents by (language, source), nulls being equal.

Defined results: null or empty text has no words, fails the base rules and is not kept; a very
long text is counted whole; a value on a fence is inside; null language or source is a group of its
own; repeated rows are each judged; an empty table gives no rows; other columns are ignored, or
carried along unchanged by `filter_documents`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stash, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_marks")
SPACE, SYMBOLS, WINDOW = b" \t\n\x0b\x0c\r", b"#*$%&|<>", 8
#: ASCII digits and punctuation.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalpha())


@dataclass(frozen=True)
class Metric:
    """A ratio in integer units, and the quantiles (in hundredths) that its fences are taken from;
    what is over the upper one is rejected, and, if `low`, what is under the lower one."""

    name: str
    sql: str
    quantiles: tuple[int, int]
    reach: int
    floor: int
    low: bool = False


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    precision: int = 5
    min_group: int = 50
    metrics: tuple[Metric, ...] = (
        Metric("marks", "1000 * n_marks div word_chars", (25, 75), 8, 50),
        Metric("repeats", "1000 * n_repeat_words div n_words", (50, 98), 2, 100),
        Metric("dup_lines", "1000 * n_dup_lines div n_word_lines", (50, 98), 2, 200),
        Metric("word_len", "100 * word_chars div n_words", (25, 75), 5, 60, True),
    )


def count_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(raw) - len(raw.translate(None, MARKS))


_MIX = np.random.default_rng(11).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes += mixed[k : n + k] * _MIX[k]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    keys = [ids[i : i + WINDOW].tobytes() for i in at.tolist()]
    often = Counter(keys)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(at.tolist(), keys, strict=True):
        if often[k] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [count_text(t) for t in batch.column("text").to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], [*batch.schema.names, *COUNTS]
        )


def measure(docs: DataFrame) -> DataFrame:
    """docs with the counts; its columns must have distinct names."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_counted, f"{names}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(rules: QualityRules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def bin_sql(value: str, rules: QualityRules) -> str:
    """The bin of a value: the value in its octave's unit 2^k, after k times 2^precision others."""
    k = f"greatest(length(bin({value})) - {rules.precision + 1}, 0)"
    return f"shiftleft({k}, {rules.precision}) + shiftright({value}, {k})"


def bin_edge(bin: Column, rules: QualityRules) -> tuple[Column, Column]:
    """The least value of a bin, and its width."""
    k = F.greatest(F.floor(bin / 2**rules.precision).cast("int") - 1, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return (bin - 2**rules.precision * k) * width, width


def sketches(counted: DataFrame, rules: QualityRules) -> DataFrame:
    """lang, source, metric, bin, n: the sketch of each group."""
    good = counted.where(~base_failed(rules))
    bins = F.array(*(F.struct(F.lit(m.name).alias("metric"), F.expr(bin_sql(m.sql, rules)).alias("bin")) for m in rules.metrics))
    return good.select("lang", "source", F.explode(bins).alias("b")).groupBy("lang", "source", "b.metric", "b.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *group: str) -> DataFrame:
    return sketch.groupBy(*group, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, rules: QualityRules, *group: str) -> DataFrame:
    """Of each group and metric: documents, and the bins that hold its two quantiles."""
    by = Window.partitionBy(*group, "metric")
    running = sketch.withColumns({"below": F.sum("n").over(by.orderBy("bin")), "docs": F.sum("n").over(by)})
    level = lambda i: F.expr("CASE metric " + " ".join(f"WHEN '{m.name}' THEN {m.quantiles[i]}" for m in rules.metrics) + " END")
    at = lambda i: F.min(F.when(F.col("below") * 100 >= F.col("docs") * level(i), F.col("bin")))
    return running.groupBy(*group, "metric").agg(F.max("docs").alias("docs"), at(0).alias("q1"), at(1).alias("q2"))


def thresholds(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """lang, source and, for each metric, lo_<metric> and hi_<metric> in the metric's units."""
    own = quantiles(sketch, rules, "lang", "source")
    lang = quantiles(merged(sketch, "lang"), rules, "lang").select(F.col("lang").alias("lang2"), F.col("metric").alias("metric2"), *(F.col(c).alias(f"{c}_lang") for c in ("docs", "q1", "q2")))
    every = quantiles(merged(sketch), rules).select(F.col("metric").alias("metric3"), *(F.col(c).alias(f"{c}_all") for c in ("q1", "q2")))
    joined = own.join(lang, own.lang.eqNullSafe(lang.lang2) & (own.metric == lang.metric2), "left").join(every, own.metric == every.metric3, "left")
    level = lambda c: F.when(F.col("docs") >= rules.min_group, F.col(c)).when(F.col("docs_lang") >= rules.min_group, F.col(f"{c}_lang")).otherwise(F.col(f"{c}_all"))
    (q1, _), (q2, last) = (bin_edge(level(q), rules) for q in ("q1", "q2"))
    at = joined.select("lang", "source", "metric", q1.alias("q1"), q2.alias("q2"), last.alias("last"))
    fences = []
    for m in rules.metrics:
        width = F.greatest(F.lit(m.floor), m.reach * (F.col("q2") - F.col("q1")))
        mine = F.col("metric") == m.name
        fences += [F.max(F.when(mine, F.col("q2") + F.col("last") + width)).alias(f"hi_{m.name}"), F.max(F.when(mine, F.col("q1") - width)).alias(f"lo_{m.name}")]
    return at.groupBy("lang", "source").agg(*fences)


def judge(counted: DataFrame, limits: DataFrame, rules: QualityRules) -> DataFrame:
    """counted with base_failed and kept."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counted.join(limits, counted["lang"].eqNullSafe(limits["_lang"]) & counted["source"].eqNullSafe(limits["_source"]), "left")
    good = ~F.col("base_failed")
    for m in rules.metrics:
        value = F.expr(m.sql)
        good &= F.when(F.col("base_failed"), False).otherwise(value <= F.col(f"hi_{m.name}"))
        if m.low:
            good &= F.when(F.col("base_failed"), False).otherwise(value >= F.col(f"lo_{m.name}"))
    return joined.withColumn("base_failed", base_failed(rules)).withColumn("kept", F.coalesce(good, F.lit(False))).drop(*limits.columns)


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the counts, base_failed, kept of every row of docs (doc_id, text, lang, source)."""
    counted = stash(measure(pick(docs, "doc_id", "text", "lang", "source")).drop("text"))
    return judge(counted, thresholds(sketches(counted, rules), rules), rules)


def filter_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that are kept, with all their columns. The counts are taken twice, as
    keeping texts for the second use would write the whole corpus."""
    limits = stash(thresholds(sketches(measure(pick(docs, "text", "lang", "source")).drop("text"), rules), rules))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    whole = plain.withColumns({n: plain[f"c{at[n]}"] for n in ("text", "lang", "source")})
    kept = judge(measure(whole), limits, rules).where("kept")
    return kept.select(*plain.columns).toDF(*docs.columns)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def _fences_sql(r: QualityRules) -> str:
    return ", ".join(
        f"max(CASE WHEN metric = '{m.name}' THEN q2 + last + greatest({m.floor}, {m.reach} * (q2 - q1)) END) AS hi_{m.name}, "
        f"max(CASE WHEN metric = '{m.name}' THEN q1 - greatest({m.floor}, {m.reach} * (q2 - q1)) END) AS lo_{m.name}"
        for m in r.metrics
    )


def ctes(docs: str = "documents", r: QualityRules = QualityRules()) -> str:
    """DuckDB CTEs up to `verdict`: the columns of docs, the counts, base_failed and kept. A bin goes by
    its least value and its width here."""
    duck = lambda m: m.sql.replace(" div ", " // ")
    level = lambda i: "CASE metric " + " ".join(f"WHEN '{m.name}' THEN {m.quantiles[i]}" for m in r.metrics) + " END"
    quant = lambda group: (
        f"SELECT {group} metric, max(docs) AS docs, min(low) FILTER (WHERE below * 100 >= docs * {level(0)}) AS q1, min(low) FILTER (WHERE below * 100 >= docs * {level(1)}) AS q2 FROM ("
        f"SELECT {group} metric, low, sum(n) OVER (PARTITION BY {group} metric ORDER BY low) AS below, sum(n) OVER (PARTITION BY {group} metric) AS docs FROM ("
        f"SELECT {group} metric, low, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"
    )
    width = lambda v: f"(1::BIGINT << greatest(length(bin({v})) - {r.precision + 1}, 0))"
    tests = " AND ".join(f"{duck(m)} <= hi_{m.name}" + (f" AND {duck(m)} >= lo_{m.name}" if m.low else "") for m in r.metrics)
    pick = lambda q: f"CASE WHEN o.docs >= {r.min_group} THEN o.{q} WHEN l.docs >= {r.min_group} THEN l.{q} ELSE e.{q} END AS {q}"
    return rf"""
src AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
words AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM src),
wins AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
reps AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(8) t(j) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_word_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM src) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (SELECT src.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[!-@\[-`{{-~]', '', 'g')) AS n_marks,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words, coalesce(n_word_lines, 0) AS n_word_lines
  FROM src JOIN words USING (rid) LEFT JOIN reps USING (rid) LEFT JOIN lines USING (rid)),
based AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM counted),
sketch AS (SELECT lang, source, metric, v // {width("v")} * {width("v")} AS low, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT lang, source, '{m.name}' AS metric, {duck(m)} AS v FROM based WHERE NOT base_failed" for m in r.metrics)}) GROUP BY ALL),
own AS ({quant("lang, source,")}), bylang AS ({quant("lang,")}), every AS ({quant("")}),
levels AS (SELECT *, {width("q2")} AS last FROM (SELECT o.lang, o.source, o.metric, {pick("q1")}, {pick("q2")}
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN every e ON o.metric = e.metric)),
fences AS (SELECT lang, source, {_fences_sql(r)} FROM levels GROUP BY lang, source),
verdict AS (SELECT b.*, coalesce(CASE WHEN base_failed THEN false ELSE {tests} END, false) AS kept FROM based b LEFT JOIN fences f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source)"""


OP1_SQL = f"WITH {ctes()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"
