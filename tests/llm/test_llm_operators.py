"""Each operator against a brute-force version, on hand-made tables with nulls, empty and very long
texts, ties, repeated rows and clashing columns, and on empty tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import chat, components, decontamination, html, jaccard, lines, quality, sentencepiece, substrings, suffix_array, token_files
from tributary.llm.common import pick, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that operators must take: nulls anywhere, empty and long texts, copies, one id twice,
    and columns whose names clash."""
    base = " ".join(words(60, 1))
    near = base.split()
    near[50] = "changed"
    long = "\n".join(" ".join(words(30, k)) for k in range(400))
    rows = [(1, base, "en", "s"), (2, base, "en", "s"), (3, " ".join(near), None, None), (4, None, "en", "s"), (5, "", "en", None), (6, long, "en", "s"), (7, "\n \n\t\n", "de", "s"), (8, "one two", "de", "s"), (9, "one two", "de", "s"),
            (None, base, "en", "s"), (10, long + "\ntail", "en", "s"), (2, base, "en", "s"), (11, base.upper() + " \n" + base, "en", "s"), (12, "日本語 テキスト 🙂 ok", "ja", "s"), (13, "x" * 30_000, "en", "s")]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "a", "b") for r in rows], DOCS + ", extra string, more string")
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "TEXT"), rows


def clash(df, name):
    """df with another column, whose name differs from one of df's in case only."""
    return df.withColumn("_more", F.lit("clash")).toDF(*df.columns, name)


def empty(spark, ddl=DOCS):
    return spark.createDataFrame([], ddl)


# quality


def brute_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered), len(ls), len(re.findall(r"[!-@\[-`{-~]", text))


def test_quality_counts(odd):
    rng = random.Random(5)
    texts = [r[1] for r in odd[1]] + ["".join(rng.choice("ab \n\t#$|é") for _ in range(rng.randrange(400))) for _ in range(200)]
    for t in texts:
        assert quality.count_text(t) == brute_counts(t)


def test_quality_takes_odd_rows(spark, odd):
    out = quality.quality(odd[0])
    got = {(r.doc_id, r.base_failed) for r in out.collect()}
    assert out.count() == len(odd[1]) and (4, True) in got and (5, True) in got and (1, False) in got
    kept = quality.filter_documents(odd[0])
    assert kept.columns == odd[0].columns and kept.count() == sum(r.kept for r in out.collect())
    assert quality.quality(empty(spark)).count() == 0 and quality.filter_documents(empty(spark)).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    rows = [(i, " ".join(words(50, i)), "en", "plain", 0) for i in range(80)] + [(100 + i, " ".join(w + " ##" for w in words(50, i)), "en", "marked", 0) for i in range(80)]
    rows.append((300, " ".join(w + " ##" for w in words(50, 7)), "en", "plain", 0))
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] and got[0] and not got[300]


def test_quality_clips_nothing(spark):
    text = lambda i, n: " ".join(w + "#" * n for w in words(50, i))
    rows = [(i, text(i, i % 2), "en", "mixed", 0) for i in range(80)] + [(200, text(200, 900), "en", "mixed", 0), (201, text(201, 1), "en", "mixed", 0)]
    rules = quality.QualityRules(metrics=(quality.Metric("symbols", "1000 * n_symbols div n_words", (25, 75), 8, 50),))
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, DOCS), rules).collect()}
    assert not got.pop(200) and all(got.values())


def test_quality_bins_have_bounded_relative_width(spark):
    rules = quality.QualityRules()
    values = [*range(8100), *(k * 2**j + d for j in range(8, 40) for k in (4, 7, 1000) for d in (-1, 0, 1))]
    low, width = quality.bin_edge(F.expr(quality.bin_sql("v", rules)), rules)
    got = spark.createDataFrame([(v,) for v in sorted(values)], "v long").select("v", low.alias("low"), width.alias("width"), F.expr(quality.bin_sql("v", rules)).alias("bin")).orderBy("v").collect()
    for r in got:
        assert r.low <= r.v < r.low + r.width and (r.width == 1 or 32 * r.width <= r.v)
    assert all(a.bin <= b.bin for a, b in zip(got, got[1:], strict=False))


def test_quality_sketches_merge(spark, odd):
    rules = quality.QualityRules()
    counted = quality.measure(pick(odd[0], "doc_id", "text", "lang", "source"))
    whole = quality.merged(quality.sketches(counted, rules), "lang")
    halves = quality.sketches(counted.where("doc_id % 2 = 0"), rules).union(quality.sketches(counted.where("NOT coalesce(doc_id % 2 = 0, false)"), rules))
    assert sorted(map(str, whole.collect())) == sorted(map(str, quality.merged(halves, "lang").collect()))


# SentencePiece


def brute_path(vocabulary, word):
    score = {p: (s, i) for i, (p, s, k) in enumerate(vocabulary) if k == sentencepiece.NORMAL}
    low = min(s for s, _ in score.values()) - 10
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            p = word[start:end]
            if p in score:
                options.append((best[start][0] + score[p][0], -start, best[start][1] + [score[p][1]]))
        if word[end - 1] not in score:
            raw = [i for b in word[end - 1].encode() for i, x in enumerate(vocabulary) if x[2] == sentencepiece.BYTE and int(x[0][3:5], 16) == b] or [next(i for i, x in enumerate(vocabulary) if x[2] == sentencepiece.UNKNOWN)]
            options.append((best[end - 1][0] + low, -(end - 1), best[end - 1][1] + raw))
        top = max(options, key=lambda o: o[:2])
        best.append((top[0], top[2]))
    return best[-1]


TOY = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((c, -10.0 - k, 1) for k, c in enumerate("▁abc")), ("ab", -5.0, 1), ("bc", -5.0, 1), ("▁a", -6.0, 1), ("abc", -16.0, 1), ("▁ab", -11.0, 1), ("▁▁", -3.0, 1), ("ca", -7.0, 1), ("cab", -19.0, 1)]


def test_viterbi_is_brute_force():
    p, rng = sentencepiece.Pieces(TOY), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abc  zé\n") for _ in range(rng.randrange(14)))
        score, ids = brute_path(TOY, p.normal(text)) if text else (0.0, [])
        assert p.encode(text) == ids and p.count(text) == (len(ids), pytest.approx(score)) and p.decode(ids) == text


def test_real_vocabulary_is_brute_force():
    p = sentencepiece.pieces(sentencepiece.default_model())
    score = {x: (s, i) for i, (x, s, k) in enumerate(p.vocabulary) if k == 1}
    for w in ["▁the", "▁thereupon", "▁internationalization", "▁été", "▁Zürich", "▁aaaaaaaa"]:
        best = [(0.0, [])]
        for end in range(1, len(w) + 1):
            best.append(max(((best[a][0] + score[w[a:end]][0], -a, best[a][1] + [score[w[a:end]][1]]) for a in range(end) if w[a:end] in score), key=lambda o: o[:2])[::2])
        assert p.encode(w[1:]) == best[-1][1] and p.count(w[1:])[0] == len(best[-1][1])


def library_encoder(vocabulary):
    """The SentencePiece library's own unigram encoder over these pieces; nothing is trained."""
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as model

    m = model.ModelProto()
    for piece, score, kind in vocabulary:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = model.TrainerSpec.UNIGRAM, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    return library.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_ties_go_as_the_library_decides_them():
    """Small whole scores, so that the library's 32-bit sums are exact and many paths are equal."""
    rng = random.Random(11)
    for _ in range(40):
        found = set("▁abc")
        while len(found) < 25:
            found.add(("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))))
        vocabulary = [*TOY[:258], *((x, -float(rng.randrange(1, 5)), 1) for x in sorted(found))]
        p, library = sentencepiece.Pieces(vocabulary), library_encoder(vocabulary)
        for _ in range(150):
            text = "".join(rng.choice("abc ") for _ in range(rng.randrange(20))) + rng.choice(["", "z", "é\n"])
            ids = library.encode(text)
            assert p.encode(text) == ids and p.count(text)[0] == len(ids) and p.decode(ids) == library.decode(ids)


def test_tokens_take_odd_rows(spark, odd):
    out = sentencepiece.with_tokens(pick(odd[0], "doc_id", "text")).collect()
    assert len(out) == len(odd[1]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    counts = sentencepiece.with_counts(pick(odd[0], "doc_id", "text")).collect()
    assert [r.n_tokens for r in counts] == [r.n_tokens for r in out] and sentencepiece.with_tokens(empty(spark)).count() == 0


# chat


def test_chats_round_trip(spark):
    rng = random.Random(8)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "\\", "\\c", "\\s", "<", "|", "assistant", "a", "<|im_end|>\n<|im_start|>assistant\n", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "as\\n"]), rng.choice([None, "", *["".join(rng.choice(bits) for _ in range(6)) for _ in range(8)]])) for c in range(60) for t in range(rng.randrange(1, 5))]
    rows += [(None, None, None, None), (61, 1, "user", "x"), (61, 1, "user", "x")]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "TURN")
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    chats = chat.format_chats(df)
    got, spans = chats.collect(), collections.defaultdict(list)
    for r in chat.loss_spans(chats).orderBy("turn").collect():
        spans[r.conv_id].append((r.start, r.length))
    assert len(got) == len(want)
    for r in got:
        turns = [(a, b) for _, a, b in sorted(want[r.conv_id])]
        assert r.identical and [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(b for a, b in turns if a == "assistant")
        cut = [r.formatted[a : a + n] for a, n in spans[r.conv_id]]
        assert "".join(x.replace("\\c", "<|").replace("\\s", "\\") for x in cut) == r.loss and len(cut) == sum(a == "assistant" for a, _ in turns)
        inner = r.formatted.replace("<|im_start|>", "").replace("<|im_end|>\n", "")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(turns) and "<|" not in inner
    assert chat.format_chats(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_take_time_in_proportion(spark):
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('say ', id) AS text")
    r = chat.format_chats(rows).first()
    assert r.identical and len(r.turns) == 20_000 and r.loss == "".join(f"say {i}" for i in range(1, 20_000, 2))


# line dedup


def brute_lines(rows):
    import re

    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    ident = lambda d: 2**63 - 1 if d is None else d
    held = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(ident(d))
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 10 and len(held[key(x)]) >= 2 and ident(d) != min(held[key(x)]))]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_is_brute_force(spark, odd):
    out = lines.LineIndex.build(odd[0]).dedup(odd[0])
    got = [(r[0], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(odd[1])))
    texts = lines.dedup_text(odd[0])
    assert texts.columns == odd[0].columns and lines.dedup_text(empty(spark)).count() == 0


def test_line_index_is_reversible(spark, odd):
    docs = pick(odd[0], "doc_id", "text")
    a, b = docs.where("doc_id % 3 = 0"), docs.where("NOT coalesce(doc_id % 3 = 0, false)")
    state = lambda i: sorted(map(tuple, i.refs.select("k1", "k2", "n_docs", "first_doc").collect()))
    full = lines.LineIndex.build(docs)
    first = lines.LineIndex.build(a)
    grown = first.insert(b)
    assert state(grown) == state(full)
    back = grown.delete(b)
    assert state(back) == state(first)
    keys = back.refs.toPandas()
    for f in back.filters.collect():
        held = lines.CuckooFilter.load(f["filter"])
        own = keys[keys.shard == f.shard].k2.to_numpy().view(np.uint64)
        assert held.contains(own).all() and int((held.slots != 0).sum()) + len(held.over) == len(own)


def test_cuckoo_filter_never_loses_a_key():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    f = lines.CuckooFilter(1000)  # far too small: what has no place goes to the list
    f.insert(h)
    f.insert(h[:100])
    assert f.contains(h).all()
    f.delete(h[:100])
    assert f.contains(h).all() and int((f.slots != 0).sum()) + len(f.over) == 5000


# suffix arrays


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randrange(70))] + [0]
        want = sorted(range(len(x)), key=lambda i: x[i:])
        s = np.array(x, np.int32)
        assert suffix_array.suffix_array(s, 5).tolist() == want == suffix_array.suffix_array(s, 2000).tolist()
        before, lcp = suffix_array.permuted_lcp(s, np.array(want), 100)
        for i, j in zip(want[1:], want, strict=False):
            n = next(k for k in range(len(x)) if x[i + k] != x[j + k])
            assert before[i] == j and lcp[i] == n


def test_spans_give_each_window_once():
    rng = random.Random(6)
    for n in (399, 400, 401, 900, 5000):
        raw = bytes(rng.choice(b"ab") for _ in range(n))
        got = [(s, k) for _, s, k, _ in substrings.spans(raw)]
        assert [w for s, k in got for w in range(s, s + k)] == list(range(max(0, n - 399)))


def brute_repeats(rows, width=400):
    count = collections.Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("small", [256, 1])
def test_repeats_are_brute_force(spark, odd, small, monkeypatch):
    monkeypatch.setattr(substrings, "SMALL", small)  # 1: every group is divided
    rng = random.Random(9)
    passage = " ".join(words(90, 77))
    rows = [(r[0], r[1][:6000] if r[1] else r[1]) for r in odd[1]]
    rows += [(100 + i, " ".join(words(rng.randrange(20, 60), 200 + i)) + " " + passage[rng.randrange(60) :] + " ".join(words(20, 300 + i))) for i in range(12)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "Text")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repeats(rows)))


def test_a_passage_that_is_everywhere_stays_spread(spark):
    """No task gets all spans of one class, even where Spark doesn't split the join."""
    key = F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id"))
    null = F.lit(None).cast("long")
    rows = spark.range(0, 8000, 1, 8).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.lit(1).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), F.lit(0).cast("long").alias("start"), F.lit(1).alias("n"), F.lit(0).alias("lead"), F.lit(0).alias("lo"), key.alias("k1"), key.alias("k2"), null.alias("l"), null.alias("r"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        whole, _ = substrings._classes(rows)
        counts = [r["count"] for r in whole.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sum(counts) == 6000 and max(counts) < 1000


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0


# Jaccard join


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return sorted(repr((r[0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None))) for i, r in enumerate(rows))


def test_jaccard_join_is_brute_force(spark, odd, monkeypatch):
    rng, rows = random.Random(12), list(odd[1])
    for g in range(12):
        base = words(rng.randrange(8, 90), 900 + g)
        for i in range(12):
            w = base[:]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            rows.append((1000 + 20 * g + i, " ".join(w[: len(w) - rng.randrange(3)])))
    df = clash(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), "Doc_Id")
    # Small numbers: many meetings and partitions, shingles dealt by class, and crowded ones.
    for kept in ({}, {"BLOCK": 3, "COMMON": 2, "FEW": 5, "NEXT": 1, "MANY": 2, "SPOT": 2, "PART": 500}, {"BLOCK": 2, "FEW": 5, "NEXT": 1, "MANY": 1, "TURNS": 1, "PIECE": 1}):
        for name, value in kept.items():
            monkeypatch.setattr(jaccard, name, value)
        got = sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.join_components(df).collect())
        assert got == brute_components(rows)
    one = jaccard.one_of_each(df)
    ids = [r[0] for r in one.collect()]
    assert one.columns == df.columns and len(ids) == len(set(ids))
    assert jaccard.join_components(empty(spark)).count() == 0 and jaccard.one_of_each(empty(spark)).count() == 0


def test_one_of_each_keeps_texts_that_link_with_nothing(spark):
    a, b, c, d, e = (" ".join(words(60, 700 + k)) for k in range(5))
    near = b.split()
    near[50] = "changed"
    rows = [(None, a), (None, b), (None, " ".join(near)), (None, b), (7, c), (7, d), (7, d), (8, c), (9, e), (None, e), (None, None), (None, ""), (7, " ")]
    got = collections.Counter(jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    either = got.pop((None, b), 0) + got.pop((None, " ".join(near)), 0)
    assert either == 1 and got == collections.Counter([(None, a), (7, c), (7, d), (9, e), (None, None), (None, ""), (7, " ")])


def test_tree_finds_all_partners():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40)))) for _ in range(80)] + [np.arange(20)] * 3
    tree = jaccard.Tree(sets)
    for s in sets:
        mask = np.zeros(60, bool)
        mask[s] = True
        want = sorted(i for i, t in enumerate(sets) if 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t)))
        assert sorted(tree.partners(s, mask)) == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.v: r.label for r in components.components(links).collect()}
    assert set(got[i] for i in range(61)) == {0} and got[101] == 100
    pairs = spark.createDataFrame([((1, 5), (2, 4)), ((2, 4), (2, 9)), ((7, 0), (7, 1)), ((7, 0), None)], "a struct<d:long,c:long>, b struct<d:long,c:long>")
    got = {tuple(r.v): tuple(r.label) for r in components.components(pairs).collect()}
    assert got == {(1, 5): (1, 5), (2, 4): (1, 5), (2, 9): (1, 5), (7, 0): (7, 0), (7, 1): (7, 0)} and not components.components(pairs.limit(0)).count()


# token files


def test_byte_codes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack(ranks)
        assert (token_files.unpack(control, data, n) == ranks).all()


def test_token_files_hold_what_the_tokenizer_gives(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    e, rng = token_files.Encoder(token_files.default_tokenizer()), random.Random(3)
    bits = ["a", "b", "é", "×", "ł", "²", "1", " ", " ", "\n", "\t", " ", "'s", "don't", ".", "<|endoftext|>", "日", "́", "_", "!"]
    for text in ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)]:
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    path = scratch(spark)
    token_files.write_files(odd[0], path)
    got = token_files.read_files(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "crc").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in odd[1]), key=lambda d: 2**63 if d is None else d)
    want = collections.Counter()
    for d, text, *_ in odd[1]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.crc) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    token_files.write_files(empty(spark), path := scratch(spark))
    assert token_files.read_files(spark, path, len, "n").count() == 0


# decontamination


def test_contaminated_pairs_are_brute_force(spark, odd, monkeypatch):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng.randrange(1, 40), 500 + i))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (None, "one two"), (93, "ONE, two!")]
    rows = [(r[0], r[1]) for r in odd[1]]
    for i in range(60):
        item = items[rng.randrange(40)][1].split()
        if rng.random() < 0.5 and len(item) > 12:
            item[rng.randrange(len(item))] = "odd"
        rows.append((1000 + i, " ".join(words(50, i)) + " " + ", ".join(item).upper() + " " + " ".join(words(50, 99 + i))))
    want = []
    for d, t in rows:
        w = decontamination.words_of(t)
        for i, x in items:
            v = decontamination.words_of(x)
            m = min(5, len(v))
            s = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
            shared = len(s & {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}) if s else 0
            if s and 4 * shared >= 3 * len(s):
                want.append(repr((d, i, len(s), shared)))
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "DOC_ID")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 20, 0):  # 0: items are joined, not broadcast
        monkeypatch.setattr(decontamination, "BROADCAST_CHARS", chars)
        assert sorted(map(repr, map(tuple, decontamination.contaminated(df, bench).collect()))) == sorted(want)
        clean = decontamination.clean_documents(df, bench)
        assert clean.columns == df.columns and clean.count() == len(rows) - len([r for r in rows if any(w.startswith(f"({r[0]},") for w in want)])
    assert decontamination.contaminated(empty(spark), bench).count() == 0 and decontamination.contaminated(df, empty(spark, "item_id long, text string")).count() == 0


# HTML


PAGES = [
    ("<article><h1>T&eacute;st</h1><p>a  b<br>c<p>d &amp; e</article><footer>x</footer>", "Tést\n\na b c\n\nd & e"),
    ("<html><head><title>t</title></head><body><nav><ul><li><a href=x>m</a></ul></nav><main><div class='ad-box'>buy, now.</div><section><h2>H</h2><p>Some text, with commas, and more.</p></section><section id=comments><p>Nice, I like it, a lot.</p></section></main></body>", "H\n\nSome text, with commas, and more."),
    ("<body><div class=menu>a, b</div><div class=post><p>A long, long text, with words.</p><p>short</p><ul><li>x<li>y</ul></div><div class='sidebar'><p>Other, text.</p></div><form><p>name</p></form><div role=dialog>cookies, ok.</div><p style='display: none'>hidden, text.</p></body>", "A long, long text, with words.\n\nshort\n\nx\n\ny"),
    ("<article><header><h1>Head</h1></header><p>Body, text.</p><footer>by me</footer><script>var a='</p>';</script><style>p{}</style><!-- c --></article><header><p>Site, name.</p></header>", "Head\n\nBody, text."),
    ("<p>a<script>x", "a"), ("just &lt;text&gt;", "just <text>"), ("", ""), (None, ""), ("<div><nav>x</nav></div>", ""), ("<article><p>a < b<p title='x>y'>c", "a < b\n\nc"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html.extract(page) == want


LONG = "<p>A long text, with words, and more of it, in a row.</p>"
MARKED = [
    (f"<div class='flex overflow-hidden'><article>{LONG}</article></div>", 1, []), (f"<div class='layout has-sidebar'>{LONG * 3}</div>", 3, []),
    (f"<div class='no-sidebar'><article>{LONG}</article></div><div class=sidebar>{LONG}</div>", 1, []), (f"<main><div class=sidebar><article>{LONG}</article></div></main>", 1, []),
    (f"<article>{LONG * 2}<section id='discussion'><h2>D</h2>{LONG}</section><section id='related-work'>{LONG}</section></article>", 4, ["D"]),
    (f"<article><h1 class='article-header'>T</h1>{LONG}<h2 id='discussion'>D</h2>{LONG}</article>", 2, ["T", "D"]), (f"<article><div class='banner'>{LONG}</div></article>", 1, []),
    (f"<article>{LONG}<div class=comments>{LONG * 5}</div><div class=related-box><ul><li><a href=x>link text</a></ul></div></article>", 1, []),
]


@pytest.mark.parametrize("page, n, rest", MARKED)
def test_words_of_a_class_cut_no_article(page, n, rest):
    got = html.extract(page).split("\n\n")
    assert sum(x.startswith("A long") for x in got) == n and [x for x in got if not x.startswith("A long")] == rest


CHOSEN = [
    (f"<main><article>{LONG * 8}</article><article>{LONG * 2}</article></main>", 10, []), (f"<article>{LONG * 8}</article><div><h2>H</h2>{LONG * 2}</div><div>x y</div>", 10, ["H"]),
    (f"<main><div>{LONG * 3}</div><article>{LONG * 3}</article><p>short</p></main>", 6, ["short"]), (f"<article>{LONG * 4}<p>short</p></article><article class=card><h3>Card</h3></article>", 4, ["short"]),
]


@pytest.mark.parametrize("page, n, rest", CHOSEN)
def test_content_paths_choose_the_elements(page, n, rest):
    got = html.extract(page).split("\n\n")
    assert sum(x.startswith("A long") for x in got) == n and [x for x in got if not x.startswith("A long")] == rest


def test_path_values_are_the_formula():
    """Each path's mean of the smoothed ratios, fused, less what counts as boilerplate."""
    import math
    import re

    rng, paths = random.Random(4), {}
    nodes = [html.Node(t, None, t, False) for t in "abcd"]
    for n in nodes:
        n.path = paths.setdefault(n.tag, len(paths))
    for _ in range(200):
        blocks = [(n := rng.choice(nodes), x := "".join(rng.choice("ab ,.") for _ in range(rng.randrange(1, 30))), rng.randrange(len(x) + 1)) for _ in range(rng.randrange(1, 12))]
        named = set(rng.sample(nodes, rng.randrange(3)))
        mine = lambda p: [b for b in blocks if b[0].path == p]  # noqa: E731, B023
        text = [sum(len(b[1]) - b[2] for b in mine(n.path)) / len(mine(n.path)) for n, _, _ in blocks]
        marks = [sum(len(re.findall("[,.]", b[1])) for b in mine(n.path)) / len(mine(n.path)) for n, _, _ in blocks]
        want = {}
        for p in {n.path for n, _, _ in blocks}:
            at = [i for i, b in enumerate(blocks) if b[0].path == p]
            near = lambda v: sum((v[max(i - 1, 0)] + 2 * v[i] + v[min(i + 1, len(v) - 1)]) / 4 for i in at) / len(at)  # noqa: E731, B023
            share = sum(len(b[1]) * (html.NAMED if b[0] in named else 1) for b in mine(p)) / sum(len(b[1]) for b in mine(p))
            want[p] = near(text) * (1 + math.log1p(near(marks))) * share
        assert html.path_values(blocks, lambda n: n in named) == pytest.approx(want)  # noqa: B023


PLAIN = "<div class=a><a href=1>Home</a><a href=2>News</a></div><div class=b><h2>Head</h2>%s</div><div class=c><p>c 2020</p></div>"
BARE = [
    (PLAIN % (LONG * 5), 5), ("<body>" + PLAIN % (LONG * 3 + "<p>Short.</p>"), 3), (f"<article>{LONG * 3}</article><section id=comments>{LONG * 9}</section>", 3), (f"<div class=post>{LONG * 4}</div><div class='comments'>{LONG * 3}</div>", 4),
    (f"<form id=aspnet><div class=post>{LONG * 4}</div></form><nav>{LONG}</nav>", 4), (f"<article><object data=x>{LONG}<p>y</p></article>", 1),
]


@pytest.mark.parametrize("page, n", BARE)
def test_pages_without_helpful_names(page, n):
    got = html.extract(page)
    assert got.count("A long") == n and "c 2020" not in got and "News" not in got


def test_path_values_decide(spark, sf_dir, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    before = [html.extract(p) for p in pages]
    values = html.path_values
    monkeypatch.setattr(html, "path_values", lambda blocks, named: dict.fromkeys(values(blocks, named), 1.0))
    assert all(html.extract(p) != x for p, x in zip(pages, before, strict=True))


def test_pages_of_the_table_give_their_article(spark, sf_dir):
    import html as entities
    import re

    for page, text in [(r.html, html.extract(r.html)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert text == "\n\n".join(b for b in blocks if b)


def test_pages_take_odd_rows(spark):
    df = clash(spark.createDataFrame([(1, "u", None), (None, None, "<p>x"), (2, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string"), "HTML")
    assert sorted(r.text for r in html.with_main_text(df).collect()) == ["", "deep", "x"]
    assert html.with_main_text(empty(spark, "page_id long, url string, html string")).count() == 0


def test_digest_columns(spark, sf_dir):
    r = chat.op3_chat(spark, sf_dir).where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and r.loss_chars == len(said)
