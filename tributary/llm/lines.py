r"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without surrounding ASCII white space, with A-Z in lower case; keys of
at least `min_chars` code points count, by their 128-bit xxh3 hash. The index holds

* `refs`: the exact reference-count table, one row for each key with the number of documents
  that hold it and the smallest of their ids;
* `holders`: key and document, once each, from which smallest ids can be taken again;
* `filters`: for each shard of the keys a cuckoo filter of the keys in `refs`.

Documents are inserted, into an empty index as into a full one, by counting the keys of each batch
of rows (so that a frequent line is one row a batch, not one a document) and streaming these counts
by shard: the shard's filter is asked first; a key that it doesn't hold is new and goes into the filter
and the table unseen, and only a key that it may hold is looked up in the table. Deleting
documents takes their rows out of `holders`, lowers the counts of keys that the filters may hold,
gives the smallest id to the next holder, and takes keys without holders out of `refs` and the
filters, so that an index from which documents are deleted is the index of the others. Tables are
written anew as versions in a shared folder; nothing is changed in place, and a lost executor costs
a recomputation.

`dedup` drops the lines of keys with two holders or more, but in the smallest document.

Defined results: null and empty texts are one empty line; null ids count as one document that
sorts last; rows of one id are one document, repeated or not; an empty table gives no rows; a
text whose lines are all dropped is empty; a very long text is cut into lines like others; extra
columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, long_id, pick, stash, table

SHARD_KEYS = 100_000
KEY = ["shard", "k1", "k2"]


class CuckooFilter:
    """Four 16-bit fingerprints a bucket. Fingerprints that find no place after many moves are kept
    in a list with their bucket, so that an insertion never fails and a deletion always finds its entry."""

    def __init__(self, capacity: int) -> None:
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / 4 / 0.8))))
        self.slots = np.zeros((self.buckets, 4), np.uint16)
        self.over: list[int] = []

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = hashes.astype(np.uint64)
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(hashes)
        found = ((self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])).any(1)
        if self.over:
            over, high = np.array(self.over, np.uint64), (prints.astype(np.uint64) - np.uint64(1)) << np.uint64(48)
            found |= np.isin(high | first.astype(np.uint64), over) | np.isin(high | second.astype(np.uint64), over)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        """Each hash once more. All that fit are placed at once; the rest move others round by round."""
        hashes = hashes.astype(np.uint64)
        prints, at, _ = self._places(hashes)
        for turn in range(64):
            if not len(prints):
                return
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = np.argsort(self.slots[at] != 0, axis=1, kind="stable")
            fits = nth < (self.slots[at] == 0).sum(1)
            self.slots[at[fits], free[fits, nth[fits] % 4]] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if turn % 2 and len(prints):
                # One entry of each full bucket makes way and goes to its other bucket.
                lead = np.r_[True, at[1:] != at[:-1]]
                slot = (at[lead] + turn // 2) % 4
                out = self.slots[at[lead], slot].copy()
                self.slots[at[lead], slot] = prints[lead]
                prints[lead] = out
            at = self._other(at, prints)
        self.over += [((int(p) - 1) << 48) | int(a) for p, a in zip(prints, at, strict=True)]

    def delete(self, hashes: np.ndarray) -> None:
        prints, first, second = self._places(hashes)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for at in (a, b):
                if len(hit := np.flatnonzero(self.slots[at] == p)):
                    self.slots[at, hit[0]] = 0
                    break
            else:
                left = [x for x in self.over if (x >> 48, x & (self.buckets - 1)) in ((p - 1, a), (p - 1, b))]
                if left:
                    self.over.remove(left[0])

    def dump(self) -> bytes:
        return np.array([self.buckets, *self.over], "<u8").tobytes()[:8] + self.slots.astype("<u2").tobytes() + np.array(self.over, "<u8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        out = cls(1)
        out.buckets = int(np.frombuffer(raw, "<u8", 1)[0])
        end = 8 + 8 * out.buckets
        out.slots = np.frombuffer(raw[8:end], "<u2").reshape(-1, 4).copy()
        out.over = np.frombuffer(raw[end:], "<u8").tolist()
        return out


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None for lines that are too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(keys: list[bytes]) -> list[np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return [both[:, 0].copy(), both[:, 1].copy()]


def holders_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, k1, k2: every key of every document, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {line_key(x, min_chars) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")} - {None}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, _halves(keys))], ["doc_id", "k1", "k2"])

    return pick(docs, "doc_id", "text").select(long_id().alias("doc_id"), "text").mapInArrow(run, "doc_id long, k1 long, k2 long")


#: What streams through a shard: its filter, then its table, then counts to add, each by kind.
STREAM = "shard int, kind int, k1 long, k2 long, n_docs long, first_doc long, filter binary"
FILTER, KNOWN, NEW = 0, 1, 2
NAMES = [c.split()[0] for c in STREAM.split(", ")]


def _summed(k1: np.ndarray, k2: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts and smallest ids by key."""
    order = np.lexsort((k2, k1))
    k1, k2, n, first = k1[order], k2[order], n[order], first[order]
    at = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][: len(k1)])
    return (k1[at], k2[at], np.add.reduceat(n, at), np.minimum.reduceat(first, at)) if len(at) else (k1, k2, n, first)


class Shard:
    """A shard's filter and table while counts are added."""

    def __init__(self) -> None:
        self.filter = CuckooFilter(SHARD_KEYS)
        self.table: dict[tuple[int, int], list[int]] = {}

    def add(self, k1: np.ndarray, k2: np.ndarray, n: np.ndarray, first: np.ndarray) -> None:
        k1, k2, n, first = _summed(k1, k2, n, first)
        hashes = k2.view(np.uint64)
        new = ~self.filter.contains(hashes)
        for key, count, doc in zip(zip(k1[~new].tolist(), k2[~new].tolist(), strict=True), n[~new].tolist(), first[~new].tolist(), strict=True):
            if row := self.table.get(key):
                row[0] += count
                row[1] = min(row[1], doc)
            else:  # a false positive
                self.table[key] = [count, doc]
                self.filter.insert(np.array([key[1]], np.int64).view(np.uint64))
        self.filter.insert(hashes[new])
        self.table.update(zip(zip(k1[new].tolist(), k2[new].tolist(), strict=True), map(list, zip(n[new].tolist(), first[new].tolist(), strict=True)), strict=True))

    def rows(self, shard: int) -> pa.RecordBatch:
        keys, rows, m = list(self.table), list(self.table.values()), len(self.table)
        cols = [[shard] * (m + 1), [KNOWN] * m + [FILTER], [*(k[0] for k in keys), None], [*(k[1] for k in keys), None], [*(r[0] for r in rows), None], [*(r[1] for r in rows), None], [None] * m + [self.filter.dump()]]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter and the table of every shard after what streams in, in order of shard and kind."""
    here, own = None, Shard()
    for batch in batches:
        shards, kinds = (batch.column(c).to_numpy() for c in ("shard", "kind"))
        starts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])][: len(shards)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shards)], strict=True):
            if shards[a] != here:
                if here is not None:
                    yield own.rows(int(here))
                here, own = shards[a], Shard()
            part = batch.slice(a, b - a)
            if kinds[a] == FILTER:
                own.filter = CuckooFilter.load(part.column("filter")[0].as_py())
                continue
            k1, k2, n, first = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in NAMES[2:6])
            if kinds[a] == KNOWN:
                own.table.update(zip(zip(k1.tolist(), k2.tolist(), strict=True), map(list, zip(n.tolist(), first.tolist(), strict=True)), strict=True))
            else:
                own.add(k1, k2, n, first)
    if here is not None:
        yield own.rows(int(here))


@dataclass(frozen=True)
class LineIndex:
    """A version of the index. shards: of the keys; set when the first documents are inserted."""

    refs: DataFrame
    holders: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 10

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, min_chars: int = 10) -> LineIndex:
        make = lambda ddl: spark.createDataFrame([], ddl)
        return cls(make("shard int, k1 long, k2 long, n_docs long, first_doc long"), make("doc_id long, k1 long, k2 long"), make("shard int, filter binary"), shards, min_chars)

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 10) -> LineIndex:
        """The index of docs alone, with as many shards as its keys ask for."""
        holders = stash(holders_of(docs, min_chars))
        if pick(docs, "doc_id").groupBy("doc_id").count().where("count > 1").limit(1).count():
            holders = stash(holders.dropDuplicates(["doc_id", "k1", "k2"]))
        return cls.empty(docs.sparkSession, 1 + holders.count() // SHARD_KEYS, min_chars)._add(holders)

    def insert(self, docs: DataFrame) -> LineIndex:
        """This index with docs added; ids that it already holds become one document with the new row."""
        new = holders_of(docs, self.min_chars).join(self.holders, ["doc_id", "k1", "k2"], "left_anti").dropDuplicates(["doc_id", "k1", "k2"])
        return self._add(stash(new))

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))

    def _new(self, holders: DataFrame) -> DataFrame:
        """The stream's rows of kind NEW: counts by key within each batch of holders."""
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, k1, k2 = (batch.column(c).to_numpy() for c in ("doc_id", "k1", "k2"))
                k1, k2, n, first = _summed(k1, k2, np.ones(len(k1), np.int64), doc)
                m = len(k1)
                yield pa.RecordBatch.from_arrays([pa.array((k1 % shards).astype(np.int32)), pa.array(np.full(m, NEW, np.int32)), *map(pa.array, (k1, k2, n, first)), pa.nulls(m, pa.binary())], NAMES)

        return holders.select("doc_id", "k1", "k2").mapInArrow(run, STREAM)

    def _add(self, holders: DataFrame) -> LineIndex:
        """This index with holders, stored and not held yet, added."""
        none = lambda *kept: [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in STREAM.split(", ")) if c not in kept]
        held = self.filters.select("shard", F.lit(FILTER).alias("kind"), "filter", *none("shard", "kind", "filter"))
        known = self.refs.select("*", F.lit(KNOWN).alias("kind"), *none("shard", "kind", "k1", "k2", "n_docs", "first_doc"))
        stream = self._new(holders).unionByName(held).unionByName(known)
        out = stash(stream.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_added, STREAM))
        refs = out.where(f"kind = {KNOWN}").select(*KEY, "n_docs", "first_doc")
        return LineIndex(refs, stash(self.holders.unionByName(holders)) if not self.holders.isEmpty() else holders, out.where(f"kind = {FILTER}").select("shard", "filter"), self.shards, self.min_chars)

    def delete(self, docs: DataFrame) -> LineIndex:
        """This index without the documents of these doc_ids."""
        gone = pick(docs, "doc_id").select(long_id().alias("doc_id")).dropDuplicates()
        lost = stash(self._shard(self.holders.join(gone, "doc_id", "left_semi")))
        holders = stash(self.holders.join(gone, "doc_id", "left_anti"))
        touched = stash(self._ask(lost.groupBy(*KEY).agg(F.count("*").alias("lost")))).where("maybe").drop("maybe")
        left = self._shard(holders).join(touched.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        left = stash(left)
        dead = stash(touched.select(*KEY).join(left, KEY, "left_anti"))
        refs = stash(self.refs.join(touched.select(*KEY), KEY, "left_anti").unionByName(left))
        return LineIndex(refs, holders, stash(self._without(dead)), self.shards, self.min_chars)

    def _ask(self, counts: DataFrame) -> DataFrame:
        """counts with `maybe`: whether the shard's filter may hold the key."""

        def run(_: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            held = [CuckooFilter.load(f) for f in filters["filter"]]
            maybe = np.zeros(len(keys), bool)
            for f in held:
                maybe |= f.contains(keys["k2"].to_numpy().view(np.uint64))
            return keys.assign(maybe=maybe)

        schema = T.StructType([*counts.schema.fields, T.StructField("maybe", T.BooleanType())])
        return counts.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(run, schema)

    def _without(self, dead: DataFrame) -> DataFrame:
        """The filters without these keys."""

        def run(group: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.load(filters["filter"].iloc[0])
            f.delete(rows["k2"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": [int(group[0])], "filter": [f.dump()]})

        return dead.select("shard", "k2").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(run, "shard int, filter binary")

    def drops(self) -> DataFrame:
        """doc_id, keys: of each document, the keys whose lines it loses."""
        shared = self.refs.where("n_docs >= 2").select("k1", "k2", "first_doc")
        lost = self.holders.join(shared, ["k1", "k2"]).where("doc_id != first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs, whose documents the index holds, with n_lines, n_dropped and kept (the text that stays)."""
        min_chars, drops = self.min_chars, self.drops().withColumnRenamed("doc_id", "_drop_id")
        flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
        at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
        joined = flat.join(drops, F.coalesce(flat[f"c{at['doc_id']}"].cast("long"), F.lit(NULL_ID)) == drops["_drop_id"], "left").select(*flat.columns, F.col("keys.k1").alias("_k1"), F.col("keys.k2").alias("_k2"))
        text, names = f"c{at['text']}", flat.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_lines, n_dropped, kept = [], [], []
                for t, k1, k2 in zip(batch.column(text).to_pylist(), batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    n_lines.append(len(lines))
                    if k1:
                        gone = {np.array(k, "<i8").tobytes() for k in zip(k1, k2, strict=True)}
                        lines = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass"), min_chars) not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append("\n".join(lines))
                cols = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept"])

        new = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
        out = joined.mapInArrow(run, T.StructType([*flat.schema.fields, *new]))
        return out.toDF(*docs.columns, "n_lines", "n_dropped", "kept")


def dedup_text(docs: DataFrame, min_chars: int = 10, keep_emptied: bool = True) -> DataFrame:
    """docs with deduplicated text and its n_chars, in its own columns. keep_emptied: whether a document
    stays of which no word is left."""
    out = LineIndex.build(docs, min_chars).dedup(docs)
    flat = out.toDF(*(f"c{i}" for i in range(len(out.columns))))
    dropped, kept = flat.columns[-2:]
    if not keep_emptied:
        flat = flat.where((F.col(dropped) == 0) | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    value = {"text": F.col(kept), "n_chars": F.length(kept).cast("long")}
    seen: set[str] = set()
    cols = []
    for i, c in enumerate(docs.columns):
        cols.append(value[c].alias(f"c{i}") if c in value and c not in seen else F.col(f"c{i}"))
        seen.add(c)
    return flat.select(*cols).toDF(*docs.columns)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = LineIndex.build(docs).dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def sql(docs: str = "documents") -> str:
    """DuckDB CTEs up to `deduped`: the columns of docs, n_lines, n_dropped, kept."""
    return rf"""
ln AS (SELECT rid, doc_id, i, l[i] AS line FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}))),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ln),
shared AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT rid, doc_id, i, line, first_doc IS NOT NULL AND doc_id != first_doc AS lost FROM keyed LEFT JOIN shared USING (k)),
joined AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '') AS kept FROM marked GROUP BY rid),
deduped AS (SELECT d.*, n_lines, n_dropped, kept FROM (SELECT row_number() OVER () AS rid, * FROM {docs}) d JOIN joined USING (rid))"""


OP4_SQL = f"WITH {sql()} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
