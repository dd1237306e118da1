"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Words are runs of letters and digits in lower case; an item's set are its distinct shingles of
five words, or, with fewer words, the whole sequence as one shingle of that many words. A
document is contaminated by an item if it holds at least three quarters of the item's shingles,
wherever they stand in it.

Items are short and documents long, so that the Jaccard similarity of the two sets says little
and a sketch of the document would miss the item. The search is therefore asymmetric, and runs over
partitions of the items by the size of their sets, each twice as wide as the one before. The sizes
of a partition, lo to hi shingles, bound what its search needs: every item keeps the k = hi -
ceil(3hi/4) + 1 smallest values of a MinHash permutation of its shingles, and only documents of
3lo/4 shingles or more are looked up. A document that holds three quarters of an item misses at
most k - 1 of its shingles and so meets at least one of the k: the candidates are complete, not just
likely. They are then verified on the words themselves.

Items of bounded text together are broadcast, and the search is one pass over the documents that
shuffles nothing. More items stay a table: documents are filtered by a bitmap of the sketches'
values, whose size is fixed, and joined with the sketches by value; memory doesn't grow with the
benchmark either way.

Defined results: null, empty and wordless documents and items match nothing; null ids stay null;
a very long text is searched whole; repeated items and repeated documents each give their own
pairs; an empty table on either side gives no pairs; extra columns are ignored, or carried along
by `clean_documents`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, small, stash, table

WORD = re.compile(r"[^\W_]+")
SIZE = 5
#: Containment as a fraction.
SHARE = (3, 4)
#: Characters of items that are broadcast.
BROADCAST_CHARS = 4 << 20
#: Words remembered in a worker.
MEMO = 500_000
BITS = 22

_MIX = np.random.default_rng(5).integers(1, 2**63, SIZE, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hashes(dict):
    """The hash of a word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """The permuted value of every run of `size` words."""
    n = len(hashed) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out += hashed[k : k + n] * _MIX[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def sketch_size(n: int) -> int:
    """Values of the sketch of n shingles, one of which any document with enough of them holds."""
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def shingles_of(words: list[str]) -> tuple[int, frozenset]:
    """Words in a shingle, and the distinct shingles, of an item."""
    size = min(SIZE, len(words))
    return size, frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def sketch_of(words: list[str], size: int, hashes: Hashes) -> tuple[int, list[int]]:
    """An item's partition p, of 2^p to 2^(p+1) - 1 shingles, and its sketch."""
    hashed = np.unique(shingle_hashes(np.array([hashes[w] for w in words], np.uint64), size))
    part = len(hashed).bit_length() - 1
    return part, hashed[: sketch_size(2 ** (part + 1) - 1)].tolist()


def least(part: int) -> int:
    """The shingles that a document needs to hold enough of any item of a partition."""
    return -(-SHARE[0] * 2**part // SHARE[1])


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - BITS)).astype(np.int64)


class Sketches:
    """The sketches of items, by words in a shingle and partition."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        hashes = Hashes()
        self.items: list[tuple[int | None, int, frozenset]] = []  # id, words in a shingle, shingles
        self.values: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))  # partition and item of each value
        self.parts: dict[int, list[int]] = defaultdict(list)
        for item, text in items:
            if not (words := words_of(text)):
                continue
            size, shingles = shingles_of(words)
            part, sketch = sketch_of(words, size, hashes)
            for v in sketch:
                self.values[size][v].append((part, len(self.items)))
            if part not in self.parts[size]:
                self.parts[size].append(part)
            self.items.append((item, size, shingles))
        self.values, self.parts, self.maps = {k: dict(v) for k, v in self.values.items()}, dict(self.parts), {}
        for size, v in self.values.items():
            # A bit for each partition that has a value here.
            self.maps[size] = np.zeros(1 << BITS, np.uint32)
            for value, where in v.items():
                for part, _ in where:
                    self.maps[size][value >> (64 - BITS)] |= np.uint32(1 << part)

    def hits(self, words: list[str], hashes: Hashes) -> list[tuple[int | None, int, int]]:
        """item, its shingles and those that are here, of every contained item."""
        found: set[int] = set()
        hashed = None
        for size, parts in self.parts.items():
            n = len(words) - size + 1
            searched = sum(1 << p for p in parts if n >= least(p))
            if not searched:
                continue
            if hashed is None:
                hashed = np.array([hashes[w] for w in words], np.uint64)
            own = shingle_hashes(hashed, size)
            for v in own[(self.maps[size][_slot(own)] & np.uint32(searched)) > 0].tolist():
                found.update(i for part, i in self.values[size].get(v, ()) if searched >> part & 1)
        out, own_sets = [], {}
        for i in sorted(found):
            item, size, shingles = self.items[i]
            if size not in own_sets:
                own_sets[size] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
            shared = len(shingles & own_sets[size])
            if SHARE[1] * shared >= SHARE[0] * len(shingles):
                out.append((item, len(shingles), shared))
        return out


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))
ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())]))


def _searched(flat: DataFrame, text: str, items: list[tuple[int | None, str | None]]) -> DataFrame:
    """flat with hits, by broadcast sketches."""
    shared, names = flat.sparkSession.sparkContext.broadcast(Sketches(items)), flat.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            got = [[dict(zip(("item_id", "n_shingles", "n_shared"), h, strict=True)) for h in shared.value.hits(words_of(t), hashes)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got, ARROW_HITS)], [*names, "hits"])

    return flat.mapInArrow(run, T.StructType([*flat.schema.fields, T.StructField("hits", HITS)]))


def _item_sketches(items: DataFrame) -> DataFrame:
    """item, size, part and value of every value of every item's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if words := words_of(text):
                    size = min(SIZE, len(words))
                    part, sketch = sketch_of(words, size, hashes)
                    rows += [(item, size, part, np.uint64(v).astype(np.int64)) for v in sketch]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["item", "size", "part", "value"])

    return items.mapInArrow(run, "item long, size int, part int, value long")


def _joined(flat: DataFrame, text: str, items: DataFrame) -> DataFrame:
    """t1, t2 (hashes of a text) and hits of the texts that items contaminate, by a join with the sketches."""
    items = stash(pick(items, "item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    sketches = stash(_item_sketches(items))
    slots = sketches.select("size", F.shiftrightunsigned("value", 64 - BITS).alias("slot"))
    bits = slots.groupBy("size", F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()  # 2^BITS bits for each of five sizes
    maps: dict[int, np.ndarray] = {}
    for r in bits:
        own = maps.setdefault(r["size"], np.zeros((1 << BITS) + (1 << 15), bool))
        raw = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        at = (r.b - 1) * len(raw) + 1  # bucket b holds positions (b - 1) * 32768 + 1 and on
        first = max(0, -at)
        own[at + first : at + len(raw)] |= raw[first:].astype(bool)
    shared = flat.sparkSession.sparkContext.broadcast({k: v[: 1 << BITS] for k, v in maps.items()})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, maps = Hashes(), shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for t1, t2, text in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text")), strict=True):
                words = words_of(text)
                hashed = np.array([hashes[w] for w in words], np.uint64)
                for size, there in maps.items():
                    own = np.unique(shingle_hashes(hashed, size))
                    for v in own[there[_slot(own)]].view(np.int64).tolist():
                        for col, x in zip(cols, (t1, t2, size, len(words) - size + 1, v), strict=True):
                            col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["t1", "t2", "size", "n", "value"])

    keyed = flat.select(F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), F.col(text).alias("text"))
    values = keyed.mapInArrow(met, "t1 long, t2 int, size int, n long, value long")
    enough = F.col("n") >= F.ceil(F.lit(SHARE[0]) * F.pow(F.lit(2.0), F.col("part")) / SHARE[1])
    pairs = stash(values.join(sketches, ["size", "value"]).where(enough).select("t1", "t2", "item").dropDuplicates())
    texts = keyed.join(small(stash(pairs.select("t1", "t2").dropDuplicates())), ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    both = pairs.join(texts, ["t1", "t2"]).join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for text, item in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                size, shingles = shingles_of(words_of(item))
                words = words_of(text)
                counts.append((len(shingles), len(shingles.intersection(tuple(words[k : k + size]) for k in range(len(words) - size + 1)))))
            cols = [batch.column(c) for c in ("t1", "t2", "item_id")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([a for a, _ in counts], pa.int64()), pa.array([b for _, b in counts], pa.int64())], ["t1", "t2", "item_id", "n_shingles", "n_shared"])

    found = both.select("t1", "t2", "item_id", "text", "item_text").mapInArrow(verified, "t1 long, t2 int, item_id long, n_shingles long, n_shared long")
    held = found.where(f"{SHARE[1]} * n_shared >= {SHARE[0]} * n_shingles")
    return stash(held.groupBy("t1", "t2").agg(F.collect_list(F.struct("item_id", "n_shingles", "n_shared")).alias("hits")))


def with_hits(docs: DataFrame, items: DataFrame, column: str = "hits") -> DataFrame:
    """docs with the contaminating items of every document; an empty array where there are none."""
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    chars = pick(items, "text").agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= BROADCAST_CHARS and items.count() <= BROADCAST_CHARS:
        out = _searched(flat, text, [(r.item_id, r.text) for r in pick(items, "item_id", "text").collect()])
    else:
        found = _joined(flat, text, items)
        same = (F.xxhash64(flat[text]) == found["t1"]) & (F.hash(flat[text]) == found["t2"])
        out = flat.join(small(found), same, "left").select(*flat.columns, F.coalesce("hits", F.array().cast(HITS)).alias("hits"))
    return out.toDF(*docs.columns, column)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared of every contaminated pair."""
    found = with_hits(pick(docs, "doc_id", "text"), items)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.n_shingles", "h.n_shared")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    found = with_hits(docs, items, "hits")
    flat = found.toDF(*(f"c{i}" for i in range(len(found.columns))))
    return flat.where(F.size(flat.columns[-1]) == 0).select(*flat.columns[:-1]).toDF(*docs.columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql(docs: str = "documents") -> str:
    """DuckDB CTEs up to `leaks`: doc rid, doc_id, item_id, n_shingles, n_shared."""
    return rf"""
dw AS (SELECT row_number() OVER () AS drid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM {docs}),
iw AS (SELECT row_number() OVER () AS irid, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
ish AS (SELECT DISTINCT irid, item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT irid, item_id, w, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
isz AS (SELECT irid, count(*) AS n_shingles FROM ish GROUP BY irid),
dsh AS (SELECT DISTINCT drid, doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT drid, doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM ish) WHERE len(w) >= m)),
leaks AS (SELECT drid, doc_id, item_id, n_shingles, count(*) AS n_shared FROM dsh JOIN ish USING (m, s) JOIN isz USING (irid) GROUP BY drid, doc_id, irid, item_id, n_shingles HAVING 4 * count(*) >= 3 * n_shingles)"""


OP9_SQL = f"WITH {sql()} SELECT doc_id, item_id, n_shingles, n_shared FROM leaks"
