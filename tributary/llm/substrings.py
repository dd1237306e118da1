"""Suffix-array dedup: bytes covered by a repeated string of `width` bytes are removed.

A suffix array of the corpus would have to be sorted in one place, so the places where strings of
`width` bytes start (windows) are first dealt into shards that hold whole groups of equal windows:

1. Every window has an anchor, the smallest hash (leftmost on ties) of the 48-byte strings in it,
   a choice that depends on the window alone: equal windows have anchors of one hash at one
   distance. Consecutive windows of one anchor make a span; about one span starts for each
   177 bytes, and each window lies in just one.
2. Spans whose anchor hash is nowhere else hold no repeated window. Equal spans are one class;
   a class of two spans or more is repeated as a whole. A window reaches 176 bytes beyond its anchor
   to the left or to the right; classes that share neither half with another of their anchor hash
   hold no repeated window.
3. Anchor hashes with several classes are dealt into shards of bounded size. A shard's suffix array
   is built by induced sorting, and the permuted common prefixes with the neighbours in it tell
   which windows are repeated. No window is in two spans, so nothing matches itself.
4. An anchor hash with very many classes (a passage that a third of the documents share) is
   divided before: its spans are halved at fixed distances from the anchor, and regrouped by the
   bytes that all windows of the half contain, until the groups are small or hold one window each.

So all windows are judged, on the whole input and exactly but for collisions of 128-bit hashes,
and no shard grows with a group's size.

Defined results: null and empty texts have no bytes; null ids stay null, and count as one id;
rows of one id and text are each a document and remove each other's bytes; a very long text is cut
into spans piece by piece; an empty table gives no rows; extra columns are ignored. Removing bytes can cut a character, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_id, pick, real_id, small, stash, table
from .suffix_array import repeated_windows

WIDTH = 400
ANCHOR = 48
#: Bytes beyond its anchor that a window has on one side at least.
HALF = (WIDTH - ANCHOR) // 2
#: Windows of a text that are looked at together.
CHUNK = 1 << 19
#: Classes of an anchor hash that go into one shard undivided.
SMALL = 256
SHARD_BYTES = 1_000_000
#: Rows of a key beyond which it is broadcast; there are at most a thousandth as many such keys as rows.
MANY = 1000

_RANDOM = np.random.default_rng(3)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 2 * WIDTH), _powers(_BASE_INVERSE, CHUNK + 2 * WIDTH)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Of every string of ANCHOR bytes."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP[:n], out=sums[1:])
    out = (sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: n - ANCHOR + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def spans(raw: bytes, width: int = WIDTH) -> Iterator[tuple[int, int, int, int]]:
    """anchor hash, start, number of windows, and anchor less start, of every span, in order."""
    reach = width - ANCHOR + 1
    for cut in range(0, len(raw) - width + 1, CHUNK):
        part = np.frombuffer(raw, np.uint8, min(CHUNK + width - 1, len(raw) - cut), cut)
        hashes = _hashes(part)
        n = len(hashes) - reach + 1
        # The place in the low bits makes the leftmost of equal hashes the smallest.
        keys = (hashes & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(hashes), dtype=np.uint64)
        whole = np.full(-(-len(keys) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
        whole[: len(keys)] = keys
        rows = whole.reshape(-1, reach)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
        at = (least & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sizes = np.diff(np.r_[starts, n])
        anchors = at[starts]
        yield from zip(hashes[anchors].view(np.int64).tolist(), (starts + cut).tolist(), sizes.tolist(), (anchors - starts).tolist(), strict=True)


def _two(raw: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8").tolist()
    return a, b


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tie, text: rows that are equal in the first two are equal."""
    return pick(docs, "doc_id", "text").select(long_id().alias("doc_id"), F.xxhash64("text").alias("tie"), "text")


def _anchored(docs: DataFrame) -> DataFrame:
    """The spans of all documents; k1, k2: their bytes; l, r: their anchor with HALF bytes to the left and
    to the right, where a window of theirs reaches so far."""
    names = ["doc_id", "tie", "h", "start", "n", "lead", "k1", "k2", "l", "r"]
    half = lambda raw, a, b: np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw[a:b])).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for h, start, n, lead in spans(raw):
                    at = start + lead
                    left = half(raw, at - HALF, at + ANCHOR) if lead >= HALF else None
                    right = half(raw, at, at + ANCHOR + HALF) if lead - n + 1 <= WIDTH - ANCHOR - HALF else None
                    for col, x in zip(cols, (doc, tie, h, start, n, lead, *_two(raw[start : start + n - 1 + WIDTH]), left, right), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc_id long, tie long, h long, start long, n int, lead int, k1 long, k2 long, l long, r long")


KEY = ["g1", "g2"]


def _repeated(rows: DataFrame, counts: DataFrame, by: list[str], count: str) -> DataFrame:
    """The rows whose key (`by`) has more than one. counts, a stored table, has each key once and how
    many rows it has. Keys of very many rows stay where they are, so that no task is dealt all of one."""
    hot = small(counts.where(f"{count} > {MANY}").select(*by))
    cold = counts.where(f"{count} > 1 AND {count} <= {MANY}").select(*by)
    return rows.join(hot, by).unionByName(rows.join(hot, by, "left_anti").join(cold, by))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of spans (g1, g2: group; k1, k2: their bytes; doc_id, tie, start, n, ...): those that are
    repeated as a whole, and one of each class, with `sole` and `size` (classes of its group), of
    groups that still have something to judge."""
    classes = stash(rows.groupBy(*KEY, "k1", "k2").agg(F.count("*").alias("spans"), F.min(F.struct("doc_id", "tie", "start", "n", "lead", "lo", "l", "r")).alias("one")))
    mixed = lambda df: df.groupBy(*KEY).agg(F.count("*").alias("size"), F.count_if("sole").alias("soles")).where("size > 1 AND soles > 0").drop("soles")
    whole = _repeated(rows, classes, [*KEY, "k1", "k2"], "spans").select("doc_id", "tie", "start", "n")
    sole = classes.select(*KEY, "k1", "k2", (F.col("spans") == 1).alias("sole"), "one.*")
    open_ = stash(sole.join(mixed(sole).drop("size"), KEY))
    halves = open_.select(*KEY, "k1", "k2", F.explode(F.array("l", "r")).alias("half")).where("half IS NOT NULL")
    often = halves.groupBy(*KEY, "half").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    near = open_.join(halves.join(often, [*KEY, "half"]).select(*KEY, "k1", "k2"), [*KEY, "k1", "k2"], "left_semi")
    return whole, near.join(mixed(near), KEY).select(*KEY, "size", "sole", "doc_id", "tie", "start", "n", "lead", "lo")


def _with_bytes(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """The open spans with their bytes."""
    names = [c for c in open_.columns if c not in ("doc_id", "tie")]
    wanted = open_.groupBy("doc_id", "tie").agg(F.collect_list(F.struct(*names)).alias("spans"))
    # Rows that are equal in text would each give the bytes; one does.
    joined = docs.join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "text", "spans")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema.fields if f.name in names)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [arrow[dict(open_.dtypes)[c]] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = row["text"].encode("utf-8", "surrogatepass")
                got = row["spans"]
                own = [raw[s["start"] : s["start"] + s["n"] - 1 + WIDTH] for s in got]
                cols = [pa.array([s[c] for s in got], t) for c, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * len(got), pa.int64()), pa.array([row["tie"]] * len(got), pa.int64()), *cols, pa.array(own, pa.binary())], ["doc_id", "tie", *names, "raw"])

    return joined.mapInArrow(run, f"doc_id long, tie long, {kinds}, raw binary")


def _halved(rows: DataFrame) -> DataFrame:
    """Spans of groups that are too large, cut at the middle of their group's distances from the
    anchor, and regrouped by what all windows of the half contain.

    A span's windows start `lead` - i before the anchor for i = 0 .. n - 1; its group holds
    distances lo .. lo + room - 1, where room is a power of two."""
    names = ["doc_id", "tie", "g1", "g2", "start", "n", "lead", "lo", "room", "sole", "k1", "k2", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                half = r["room"] // 2
                for lo in (r["lo"], r["lo"] + half):
                    # Distances lead - n + 1 .. lead of the span that lie in lo .. lo + half - 1.
                    far, near = min(r["lead"], lo + half - 1), max(r["lead"] - r["n"] + 1, lo)
                    if far < near:
                        continue
                    skip = r["lead"] - far
                    n = far - near + 1
                    raw = r["raw"][skip : skip + n - 1 + WIDTH]
                    # The bytes from `lo` before the anchor on, as far as the furthest window reaches.
                    at = r["lead"] - lo
                    core = r["raw"][at : at + WIDTH - half + 1] if at >= 0 else b""
                    group = _two(b"%d %d %d %d " % (r["g1"], r["g2"], lo, half) + core)
                    out.append((r["doc_id"], r["tie"], *group, r["start"] + skip, n, far, lo, half, r["sole"], *_two(raw), raw))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, tie long, g1 long, g2 long, start long, n int, lead int, lo int, room int, sole boolean, k1 long, k2 long, raw binary")


def _divided(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of large groups' spans: windows found repeated, and spans of small groups."""
    found, small = [], []
    rows = rows.withColumn("room", F.lit(512))
    while not rows.isEmpty():
        rows = stash(_halved(rows))
        cols = [c for c in rows.columns if c not in (*KEY, "k1", "k2")]
        # A span that already is known to be repeated stands for its class; others count.
        classes = rows.groupBy(*KEY, "k1", "k2").agg(F.count("*").alias("spans"), F.min("sole").alias("all_sole"), F.min(F.struct(*(c for c in cols if c != "sole"))).alias("one"))
        classes = stash(classes.withColumn("sole", (F.col("spans") == 1) & F.col("all_sole")))
        found.append(stash(_repeated(rows, classes, [*KEY, "k1", "k2"], "spans").where("sole").select("doc_id", "tie", "start", "n")))
        groups = classes.groupBy(*KEY).agg(F.count("*").alias("size"), F.count_if("sole").alias("soles")).where("size > 1 AND soles > 0")
        open_ = classes.join(groups, KEY).select("one.*", *KEY, "sole", "size")
        small.append(stash(open_.where(f"size <= {SMALL}").drop("size", "room")))
        rows = stash(open_.where(f"size > {SMALL} AND room > 1").drop("size"))
    return found, small


def _judged(rows: DataFrame) -> DataFrame:
    """doc_id, tie, start, n: the runs of repeated windows among the sole spans of small groups,
    by suffix arrays of shards."""
    total = rows.agg(F.sum(F.length("raw"))).first()[0] or 0
    shards = 1 + total // SHARD_BYTES

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        twice = repeated_windows(frame["raw"].tolist(), WIDTH)
        out = []
        for doc, tie, start, sole, own in zip(frame["doc_id"], frame["tie"], frame["start"], frame["sole"], twice, strict=True):
            if sole and own.any():
                edges = np.flatnonzero(np.diff(np.r_[False, own, False]))
                out += [(doc, tie, start + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["doc_id", "tie", "start", "n"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*KEY), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, tie long, start long, n int")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, tie, start, n: n windows from start on are repeated. docs as of _keyed."""
    anchored = stash(_anchored(docs))
    often = stash(anchored.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    live = _repeated(anchored, often, ["h"], "c").select("doc_id", "tie", F.col("h").alias("g1"), F.lit(0).cast("long").alias("g2"), "start", "n", "lead", F.lit(0).alias("lo"), "k1", "k2", "l", "r")
    live = stash(live)
    whole, open_ = _classes(live)
    full = stash(_with_bytes(open_, docs).dropDuplicates([*KEY, "doc_id", "tie", "start"]))
    found, small = _divided(full.where(f"size > {SMALL}").select("doc_id", "tie", *KEY, "start", "n", "lead", "lo", "sole", "raw"))
    spans_ = full.where(f"size <= {SMALL}").select("doc_id", "tie", "start", "sole", *KEY, "raw")
    for s in small:
        spans_ = spans_.unionByName(s.select("doc_id", "tie", "start", "sole", *KEY, "raw"))
    runs = whole.unionByName(_judged(spans_))
    for f in found:
        runs = runs.unionByName(f)
    return runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), removed (start and end of the runs)."""
    docs = _keyed(docs)
    runs = repeated_runs(docs).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone: list[list[int]] = []
                for s, e in sorted((r["start"], r["start"] + r["n"] - 1 + WIDTH) for r in runs or ()):
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
                kept, at = [], 0
                for s, e in gone:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                kept_raw = b"".join(kept)
                for col, x in zip(cols, (len(raw), len(raw) - len(kept_raw), len(gone), kept_raw, [{"start": s, "end": e} for s, e in gone]), strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    joined = docs.join(runs, ["doc_id", "tie"], "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:long,end:long>>")
    return out.withColumn("doc_id", real_id("doc_id"))


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a removed run may begin within a character
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "removed", text.alias("text"))
