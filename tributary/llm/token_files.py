"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Documents are tokenized, ids are counted over the corpus, and each id is replaced by its rank by
falling count (ties: the smaller id), so that frequent tokens have small numbers. A rank takes
one to four bytes; two control bits for each hold its byte count less one, four to a control
byte, apart from the data bytes. Numpy decodes a block by looking up, for each control byte, its
four lengths, and adding up the data bytes of each length at once.

A file set is a Parquet table of blocks in ascending document order (part, block, skip: ids
before it in its part, doc_ids, counts, control, data), beside a table of ranks (rank, id): at most one row for each entry of the
vocabulary, and so of bounded size. Documents are range-partitioned by id, so no task and not the
driver holds more than a block and one number for each partition.

Defined results: null and empty texts hold the end id alone; null doc_ids come last; rows of
equal doc_id are ordered by a hash of the text; an empty table gives files without blocks; extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, long_id, pick, real_id, scratch, stash, table

#: Characters of texts that are encoded together, stretches in a row, and stretches looked up at once.
TOGETHER = 24 << 20
IN_A_ROW = 1000
AT_ONCE = 1 << 18
#: Ids in a block, but for a document that is longer, and in a part of the files.
BLOCK, PART = 1 << 18, 1 << 22

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        out[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_ALPHA = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Second bytes of the Latin letters from U+00C0 to U+00FF, which all have the first byte LATIN.
_SECOND = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
LATIN = 0xC3
#: First bytes of characters that surely are no white space.
_VISIBLE = np.isin(np.arange(256), [*range(0x21, 0x7F), LATIN])


def stretches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of texts, which begin at starts: at texts, at an ASCII character
    that is no letter after a Latin letter, and at a space before a visible character. A byte-level
    pre-tokenizer splits at all of these places."""
    alpha = _ALPHA[data]
    letter = alpha.copy()
    letter[1:] |= (data[:-1] == LATIN) & _SECOND[data[1:]]
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = letter[:-1] & (data[1:] < 0x80) & ~alpha[1:]
    space = (data[:-1] == 32) & _VISIBLE[data[1:]]
    space[starts[starts > 0] - 1] = False  # what follows is another text
    first[:-2] |= space
    first[starts] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """Whole texts to ids. The stretches of many texts between places where a byte-level pre-tokenizer
    always splits are numbered, and each different one is encoded once: those that begin with a
    space in long rows, which the token lengths cut again. Texts with a special token's string, and
    all texts of tokenizers of another kind, are encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # a character for each byte

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.byte_level or any(x in text for x in self.special):
                out[i] = self._whole([text])[0]
                continue
            held.append(i)
            size += len(text)
            if size >= TOGETHER:
                self._together(texts, held, out)
                held, size = [], 0
        if held:
            self._together(texts, held, out)
        return out

    def _together(self, texts: list[str | None], held: list[int], out: list[np.ndarray]) -> None:
        raw = [texts[i].encode() for i in held]
        starts = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        cuts = stretches(data, starts[:-1])
        edges = np.append(cuts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        flat, sizes = self._each(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        first = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[which])
        ids, at = np.empty(ends[-1], np.uint32), 0
        for k in range(0, len(which), AT_ONCE):
            some = which[k : k + AT_ONCE]
            own = sizes[some]
            gone = np.cumsum(own)
            ids[at : at + gone[-1]] = flat[np.repeat(first[some] - gone + own, own) + np.arange(gone[-1])]
            at += gone[-1]
        bounds = np.append(0, ends)[np.searchsorted(cuts, starts)]
        for i, a, b in zip(held, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[a:b]

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and their numbers."""
        spaced = [i for i, p in enumerate(pieces) if p[0] == 32 and len(p) > 1 and _VISIBLE[p[1]]]
        ids, sizes = [], np.zeros(len(pieces), np.int64)
        rows = [spaced[k : k + IN_A_ROW] for k in range(0, len(spaced), IN_A_ROW)]
        for row, got in zip(rows, self._whole([b"".join([pieces[i] for i in row]).decode() for row in rows]), strict=True):
            # A piece ends where so many bytes of tokens have gone by.
            last = np.searchsorted(np.cumsum(self.lengths[got]), np.cumsum([len(pieces[i]) for i in row])) + 1
            sizes[row] = np.diff(last, prepend=0)
            ids.append(got)
        other = np.setdiff1d(np.arange(len(pieces)), spaced, assume_unique=True).tolist()
        for i, got in zip(other, self._whole([pieces[i].decode() for i in other]), strict=True):
            sizes[i] = len(got)
            ids.append(got)
        order = np.array([*spaced, *other], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        # From the order in which they were encoded to that of the pieces.
        own = sizes[order]
        at = np.empty(len(pieces), np.int64)
        at[order] = np.cumsum(own) - own
        ends = np.cumsum(sizes)
        return flat[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, tie, ids (little-endian unsigned 16-bit where they fit, else 32), wide of every
    document; and in rows of their own, id and n: how often a task has met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, total = encoder(tokenizer), np.zeros(0, np.int64)
        names = ["doc_id", "tie", "ids", "wide", "id", "n"]
        for batch in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in e.encode_all(batch.column("text").to_pylist())]
            wide = [bool(len(x) and x.max() > 0xFFFF) for x in ids]
            raw = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
            if ids:
                part = np.bincount(np.concatenate(ids))
                total = np.pad(total, (0, max(0, len(part) - len(total))))
                total[: len(part)] += part
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(raw, pa.binary()), pa.array(wide, pa.bool_()), none, none], names)
        at = np.flatnonzero(total)
        empty = [pa.nulls(len(at), k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(at, pa.int64()), pa.array(total[at])], names)

    docs = pick(docs, "doc_id", "text").select(long_id().alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return docs.mapInArrow(run, "doc_id long, tie long, ids binary, wide boolean, id long, n long")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def rank_table(tokens: DataFrame) -> DataFrame:
    """rank, id: ids by falling count."""
    counts = tokens.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    ordered = [r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]  # one row for each vocabulary entry at most
    return tokens.sparkSession.createDataFrame(pd.DataFrame({"rank": range(len(ordered)), "id": ordered}), "rank long, id long")


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """The file set of docs (doc_id, text), written to path."""
    spark = docs.sparkSession
    tokens = stash(tokenize(docs, tokenizer or default_tokenizer(), end_id), "zstd")
    ranks = rank_table(tokens)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    ids = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # 4 bytes for each vocabulary entry

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, skip, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            control, data = pack(np.concatenate(held))
            row = {"part": [part], "block": [block], "skip": [skip], "doc_ids": [names], "counts": [[len(x) for x in held]], "control": [control], "data": [data]}
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema({"part": pa.int32(), "block": pa.int32(), "skip": pa.int64(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "control": pa.binary(), "data": pa.binary()})
        for batch in batches:
            for doc, raw, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "wide")), strict=True):
                ranks = shared.value[_ids(raw, wide)]
                if held and size + len(ranks) > BLOCK:
                    yield flush()
                    block, skip, held, names, size = block + 1, skip + size, [], [], 0
                held.append(ranks)
                names.append(doc)
                size += len(ranks)
        if held:
            yield flush()

    parts = 1 + (tokens.agg(F.sum("n")).first()[0] or 0) // PART
    # By the text's hash as well, so that many rows of one id, or of none, are not one part.
    ordered = tokens.where("id IS NULL").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", "wide")
    ordered.mapInArrow(blocks, "part int, block int, skip long, doc_ids array<long>, counts array<long>, control binary, data binary").write.parquet(f"{path}/blocks")
    discard(tokens)


def read_files(spark: SparkSession, path: str, reduce: Callable[[np.ndarray], int], name: str) -> DataFrame:
    """doc_id, start, n_tokens and `name` = reduce(ids) of each document, decoded from the files."""
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    shared = spark.sparkContext.broadcast(np.array(ranks, np.uint32))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # Ids before each part: one number for each partition of the writer.
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in totals:
        before[r.part] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = shared.value[unpack(row["control"], row["data"], int(counts.sum()))]
                starts = np.cumsum(counts) - counts
                got = [reduce(ids[s : s + n]) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + (before[row["part"]] + row["skip"])), pa.array(counts), pa.array(got, pa.int64())],
                    ["doc_id", "start", "n_tokens", name])

    out = blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} long")
    return out.withColumn("doc_id", real_id("doc_id"))


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_files(table(spark, sf_dir, "documents"), path)
    return read_files(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32")
