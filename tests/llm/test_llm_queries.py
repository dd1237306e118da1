"""The queries against their SQL, and the pipeline against a plain version of it."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from helpers import check_query
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_counts, brute_lines, brute_repeats

from tributary.llm import decontamination, quality, sentencepiece, token_files
from tributary.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in SQL:
        check_query(spark, sf_dir, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def test_op5_is_brute_force(spark, sf_dir, texts):
    want = sorted((d, n, removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")) for d, n, removed, runs, kept in brute_repeats(texts))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in QUERIES["op5_suffix_array"](spark, sf_dir).collect())
    assert got == want and any(r[2] for r in got)


def test_op8_is_the_tokenizer(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for d, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_files"](spark, sf_dir).collect()) == want


def test_op2_and_op6_are_brute_force(spark, sf_dir, texts):
    """Word by word, as no piece holds a space mark after another character."""
    vocabulary = sentencepiece.load_pieces(sentencepiece.default_model())
    score = {p: (s, i) for i, (p, s, k) in enumerate(vocabulary) if k == sentencepiece.NORMAL}
    raw = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(vocabulary) if k == sentencepiece.BYTE}
    longest, low = max(map(len, score)), min(s for s, _ in score.values()) - 10
    known: dict[str, tuple[float, list[int]]] = {}

    def solve(word):
        if word not in known:
            best = [(0.0, [])]
            for end in range(1, len(word) + 1):
                options = [(best[a][0] + score[word[a:end]][0], -a, best[a][1] + [score[word[a:end]][1]]) for a in range(max(0, end - longest), end) if word[a:end] in score]
                if word[end - 1] not in score:
                    options.append((best[end - 1][0] + low, 1 - end, best[end - 1][1] + [raw[b] for b in word[end - 1].encode()]))
                best.append(max(options, key=lambda o: o[:2])[::2])
            known[word] = best[-1]
        return known[word]

    want = {d: [i for w in re.findall("▁+[^▁]*|[^▁]+", "▁" + text.replace(" ", "▁")) for i in solve(w)[1]] if text else [] for d, text in texts}
    got = {r.doc_id: list(r.ids) for r in QUERIES["op2_sentencepiece"](spark, sf_dir).collect()}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, sf_dir).collect()} == {d: len(x) for d, x in want.items()}


def plain_pipeline(rows, items, kept):
    """doc_id, text and ids of what is left, stage by stage."""
    rows = [r for r in rows if r[0] in kept]
    rows = [(d, t) for d, _, n, t in brute_lines(rows) if not n or t.strip(" \t\n\x0b\x0c\r")]
    groups = [eval(x) for x in brute_components(rows)]  # noqa: S307  (doc_id, size, component_id)
    first = {d for d, _, c in groups if d == c}
    rows = [r for r in rows if r[0] in first]
    left = []
    for d, t in rows:
        w = decontamination.words_of(t)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        sets = [{tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in map(decontamination.words_of, items)]
        if not any(4 * len(s & own) >= 3 * len(s) for s in sets):
            left.append((d, t))
    p = sentencepiece.pieces(sentencepiece.default_model())
    return sorted((d, t, p.encode(t)) for d, t in left)


def plain_quality(rows):
    """The ids that are kept: quantiles from sorted values, of which a sketch knows the bin only."""
    rules, values, kept = quality.QualityRules(), {}, []
    for d, lang, source, text in rows:
        n, chars, _, dup, rep, lines, marks = brute_counts(text)
        if n >= rules.min_words and 100 * rep <= rules.max_repeat_percent * n:
            values[d] = (lang, source, {"marks": 1000 * marks // chars, "repeats": 1000 * rep // n, "dup_lines": 1000 * dup // lines, "word_len": 100 * chars // n})
    width = lambda v: 1 << max(v.bit_length() - rules.precision - 1, 0)
    for d, (lang, source, own) in values.items():
        groups = ([v for _, _, v in values.values()], [v for a, _, v in values.values() if a == lang], [v for a, b, v in values.values() if (a, b) == (lang, source)])
        group = next((g for g in groups[:0:-1] if len(g) >= rules.min_group), groups[0])
        good = True
        for m in rules.metrics:
            ordered = sorted(v[m.name] for v in group)
            low, high = (ordered[-(-len(ordered) * q // 100) - 1] for q in m.quantiles)
            low, high, last = low // width(low) * width(low), high // width(high) * width(high), width(high)
            reach = max(m.floor, m.reach * (high - low))
            good &= own[m.name] <= high + last + reach and (not m.low or own[m.name] >= low - reach)
        if good:
            kept.append(d)
    return set(kept)


def test_pipeline_is_the_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = plain_quality([(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:5] == docs.columns
    assert sorted((r.doc_id, r.text, list(r.ids)) for r in out.collect()) == plain_pipeline(rows, items, kept)


def test_stages_take_odd_rows(spark, sf_dir):
    long = " ".join(f"w{random.Random(i).randrange(99)}" for i in range(3000))
    rows = [(1, None, None, None, None), (None, long, "en", "s", 1), (2, long, None, "s", None), (2, long, "en", "s", 1), (3, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumn("more", F.lit(1)).toDF(*docs.columns, "TEXT")
    for frame in (docs, docs.limit(0), clash):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.columns[: len(frame.columns)] == frame.columns and out.count() <= frame.count(), name


def test_pipeline_takes_clashing_names(spark, sf_dir, monkeypatch):
    table = corpus_pipeline.table
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: table(s, d, name).withColumn("more", F.lit(1)).toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT") if name == "documents" else table(s, d, name))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[5] == "TEXT" and out.count() > 0
