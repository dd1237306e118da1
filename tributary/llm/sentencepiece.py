"""SentencePiece encoding, decoding and token counts over a piece vocabulary.

The pieces and scores come from a SentencePiece model file. An Aho-Corasick automaton over the
pieces enumerates, at each position, every piece that ends there; a single left-to-right Viterbi
pass relaxes the best score of that position. Ties go to the piece that starts first, as the
library's unigram encoder decides them, and a character that no piece covers costs the lowest
score less 10 and becomes its UTF-8 bytes. Scores are added exactly, whatever the text's length
(the library adds in 32-bit floats, whose rounding starts near 16 million).

No piece holds the space mark after another character, so that best paths split before every
run of space marks: each such word is solved once and remembered, in a table of bounded size.
A text without spaces is one word, solved as a whole.

Defined results: null and empty texts have no tokens; a very long text is split into words like
others; of paths of equal score the tie rule above decides; null ids and repeated rows need no
care, as each row stands alone; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pick, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words remembered in a generation of a worker's memory.
MEMO = 150_000
NEVER = float("-inf")
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """piece, score and type of every id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else UNUSED if sp.is_unused(i) else NORMAL
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Memory:
    """What was computed for words, in two generations, so that frequent words stay."""

    def __init__(self, compute: Callable[[str], object]) -> None:
        self.compute, self.young, self.old = compute, {}, {}

    def all(self, words: list[str]) -> list:
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for w in words:
            if w not in young:
                young[w] = old[w] if w in old else self.compute(w)
        out = [young[w] for w in words]
        for w in {w for w in words if len(w) > 64}:
            del young[w]
        return out


class Pieces:
    """A vocabulary with its automaton."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]) -> None:
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.byte_ids: dict[int, int] = {}
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind == NORMAL:
                self.automaton.add_word(piece, (len(piece), score, i))
            elif kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.automaton.make_automaton()
        normal = [x for x in vocabulary if x[2] == NORMAL]
        self.letters = {p for p, _, _ in normal if len(p) == 1}
        self.unknown = next((i for i, x in enumerate(vocabulary) if x[2] == UNKNOWN), 0)
        self.unknown_score = min((x[1] for x in normal), default=0.0) - 10
        self.inner_mark = any(MARK in p.lstrip(MARK) for p, _, _ in normal)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else p.encode() for p, _, k in vocabulary]
        self.solved = Memory(self.solve)
        self.counted = Memory(self.count_word)

    def normal(self, text: str) -> str:
        """What is encoded: a space mark before the text and for every space."""
        return MARK + text.replace(" ", MARK) if text else ""

    def words(self, marked: str) -> list[str]:
        return [marked] * bool(marked) if self.inner_mark else WORDS.findall(marked)

    def edges(self, word: str) -> Iterator[tuple[int, tuple[int, float, int]]]:
        """end - 1 and (length, score, id) of every edge, by end; following the output links gives
        the longest piece that ends there first. An unknown character is an edge of id -1."""
        if self.letters.issuperset(word):
            return self.automaton.iter(word)
        found = [*self.automaton.iter(word), *((i, (1, self.unknown_score, -1)) for i, c in enumerate(word) if c not in self.letters)]
        return iter(sorted(found, key=lambda e: (e[0], -e[1][0])))

    def solve(self, word: str) -> bytes:
        """The ids of the best path, as 32-bit integers."""
        n = len(word)
        best, back = [0.0] + [NEVER] * n, [(0, 0)] * (n + 1)
        for end, (size, score, i) in self.edges(word):
            end += 1
            total = best[end - size] + score
            if total > best[end]:
                best[end] = total
                back[end] = (size, i)
        ids: list[int] = []
        while n:
            size, i = back[n]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.byte_ids[b] for b in reversed(word[n - 1].encode())] if self.byte_ids else [self.unknown]
            n -= size
        return array("i", reversed(ids)).tobytes()

    def count_word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path, without the path."""
        best, pieces = [0.0] + [NEVER] * len(word), [0] * (len(word) + 1)
        for end, (size, score, i) in self.edges(word):
            end += 1
            total = best[end - size] + score
            if total > best[end]:
                best[end] = total
                pieces[end] = pieces[end - size] + (1 if i >= 0 or not self.byte_ids else len(word[end - 1].encode()))
        return pieces[-1], best[-1]

    def encode_array(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.solved.all(self.words(self.normal(text or "")))), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def count(self, text: str | None) -> tuple[int, float]:
        got = self.counted.all(self.words(self.normal(text or "")))
        return sum(n for n, _ in got), sum(s for _, s in got) if got else 0.0

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode(errors="replace").replace(MARK, " ")[1:]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(load_pieces(path))


def _extended(docs: DataFrame, new: dict[str, T.DataType], values: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """docs with new columns, in place of those of exactly these names; columns go by position, so that
    other names may clash. A thousand rows go at a time, as ids take several times the room of the text."""
    kept = [c for c in docs.columns if c not in new]
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    flat = flat.select(*(f"c{i}" for i, c in enumerate(docs.columns) if c not in new)).toDF(*(f"c{i}" for i in range(len(kept))))
    text = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([*batch.columns, *values(batch.column(text).to_pylist())], [*batch.schema.names, *new])

    return flat.mapInArrow(run, T.StructType([*flat.schema.fields, *(T.StructField(n, t) for n, t in new.items())])).toDF(*kept, *new)


def with_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with ids (array<int>), n_tokens (long) and round_trip (boolean: decoding the ids
    gives the text, in which space marks count as spaces). Existing columns of these names are replaced."""
    model = model or default_model()

    def values(texts: list[str | None]) -> list[pa.Array]:
        p = pieces(model)
        ids = [p.encode_array(t) for t in texts]
        back = [p.decode(x.tolist()) == (t or "").replace(MARK, " ") for t, x in zip(texts, ids, strict=True)]
        sizes = np.array([len(x) for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        return [lists, pa.array(sizes), pa.array(back, pa.bool_())]

    return _extended(docs, {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "round_trip": T.BooleanType()}, values)


def with_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with n_tokens (long) and score (double) of the best path, which is not kept."""
    model = model or default_model()

    def values(texts: list[str | None]) -> list[pa.Array]:
        got = [pieces(model).count(t) for t in texts]
        return [pa.array((n for n, _ in got), pa.int64()), pa.array((s for _, s in got), pa.float64())]

    return _extended(docs, {"n_tokens": T.LongType(), "score": T.DoubleType()}, values)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return with_tokens(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return with_counts(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "n_tokens", "score")
