r"""N-gram Jaccard join of documents by a prefix tree.

A document's set are its distinct shingles of five words (words: runs of characters other than
ASCII white space, A-Z in lower case; fewer words make one shingle), as 64-bit hashes. Two
documents link when their sets' Jaccard similarity is at least 3/4.

* Equal sets are one class, named by a 64-bit hash of the set; only classes are joined.
* Shingles have one global order, by the count of the bucket that a shingle falls into (of
  4,194,304, counted over all documents) and then by hash. Two sets that link share one of their
  n - ceil(3n/4) + 1 rarest shingles (the prefix): shingles in the prefixes of two classes or more
  name all candidates, whatever their number.
* Candidates are joined in prefix trees, never pair by pair. A tree holds the globally ordered
  sets of one meeting, commonest shingle first, each node a run of shingles that the sets below it
  share. A set is looked up by walking the tree: the overlap with a node's run is taken once for
  all sets below, and a subtree is left when the lengths that remain can't reach the overlap that a
  link needs, or when its sets are in one component with the one looked up already.
* First, each class meets those that it shares most prefix shingles with, as far as uncrowded
  shingles tell; what these meetings link are components from then on. Then, for a few turns,
  components that still meet at a crowded shingle try a few pairs each. Last, all pairs of components
  are counted that share prefix shingles; those that share enough of them for a link to be
  possible meet with all their classes, so that no link between components is lost.

A group of near copies thus costs about one comparison a member, not one a pair, and no task
gets an unbounded group: shingles of common buckets are dealt by shingle and class, and meetings
have a bounded number of members. What stays quadratic is the last count, in classes that share a
prefix shingle, are near enough in size and don't link.

Defined results: null, empty and blank texts have empty sets and are alone; null ids stay null
and count as the largest; rows of one id are joined like others; a very long text is one set, in
meetings like others; of ties, the smallest id and then the smallest class decide; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, discard, long_id, pick, real_id, small, stash, table
from .components import components

SIZE = 5
#: Buckets of shingles, and those in a segment, the unit in which their counts are added up.
BUCKETS = 1 << 22
SEGMENT = 1 << 12
#: Classes in a meeting.
BLOCK = 256
#: Classes that a shingle is not crowded with; neighbours in size that a crowded one still pairs.
FEW, NEXT = 16, 4
#: Turns in which components try one pair each at crowded shingles, and the pairs that make a shingle crowded.
TURNS = 6
MANY = 100
#: Components that meet at one place of a crowded shingle; pairs that each tries in a turn.
SPOT, TRIES = 8, 8
#: Postings in a partition.
PART = 400_000
#: Shingles of a node that are compared together.
PIECE = 64
#: A bucket is common if its count is over this, and over four times the mean.
COMMON = 500
_MIX = np.random.default_rng(7).integers(1, 2**63, SIZE, dtype=np.uint64) | np.uint64(1)


_BYTE = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of a text that are hashed together, but for a word that is longer.
CHUNK = 1 << 20


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n - 1."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of every word: the sum of a random number for each byte times the base to the
    power of its place in the word, all words at once from running sums."""
    if len(raw) > CHUNK:
        out, at = [], 0
        while at < len(raw):
            end = at + CHUNK
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            out.append(_word_hashes(raw[at:end]))
            at = end
        return np.concatenate(out)
    return _word_hashes(raw)


def _word_hashes(raw: bytes) -> np.ndarray:
    n = len(raw)
    up, down = _powers(max(CHUNK, 1 << (n - 1).bit_length()) + 1)
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted distinct hashes."""
    hashed = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else ()
    if not len(hashed):
        return np.zeros(0, np.uint64)
    hashed ^= hashed >> np.uint64(32)
    size = min(SIZE, len(hashed))
    n = len(hashed) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += hashed[k : k + n] * _MIX[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def class_of(own: np.ndarray) -> int | None:
    return int(np.frombuffer(xxhash.xxh3_64_digest(own.tobytes()), "<i8")[0]) if len(own) else None


def needed(n: int, m: int) -> int:
    """The overlap that sets of these sizes need: 4 * o >= 3 * (n + m - o)."""
    return -(-3 * (n + m) // 7)


class Tree:
    """Sets of shingle numbers, as sorted runs on the nodes of a prefix tree."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        # run, depth below, children, sets that end here, sets below, least and largest size
        self.nodes: list[tuple[np.ndarray, int, list[int], list[int], np.ndarray, int, int]] = []
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.roots = self._grow(order, 0)

    def _grow(self, order: list[int], depth: int) -> list[int]:
        """Nodes over the sets in `order` (sorted), which agree up to depth."""
        made, stack = [], [(order, depth, None)]
        while stack:
            group, at, parent = stack.pop()
            i = 0
            while i < len(group):
                first = self.sets[group[i]]
                j = i + 1
                if len(first) > at:
                    while j < len(group) and len(self.sets[group[j]]) > at and self.sets[group[j]][at] == first[at]:
                        j += 1
                    last = self.sets[group[j - 1]]
                    m = min(len(first), len(last))
                    differ = np.flatnonzero(first[at:m] != last[at:m])
                    end = at + int(differ[0]) if len(differ) else m
                else:
                    end = at
                below = group[i:j]
                sizes = [len(self.sets[x]) for x in below]
                ends = [x for x in below if len(self.sets[x]) == end]
                node = len(self.nodes)
                self.nodes.append((first[at:end], end, [], ends, np.array(below), min(sizes), max(sizes)))
                (made if parent is None else self.nodes[parent][2]).append(node)
                if rest := [x for x in below if len(self.sets[x]) > end]:
                    stack.append((rest, end, node))
                i = j
        return made

    def partners(self, own: np.ndarray, mask: np.ndarray, skip: Callable[[np.ndarray], bool] = lambda below: False) -> Iterator[int]:
        """Sets that link with the set own, which mask marks, but for subtrees whose sets skip() names."""
        n, stack = len(own), [(r, 0) for r in self.roots]
        while stack:
            node, overlap = stack.pop()
            run, depth, children, ends, below, least, largest = self.nodes[node]
            if 4 * largest < 3 * n or 3 * least > 4 * n or skip(below):
                continue
            need, at, possible = needed(n, max(least, -(-3 * n // 4))), depth - len(run), True
            for k in range(0, len(run), PIECE):
                piece = run[k : k + PIECE]
                overlap += int(np.count_nonzero(mask[piece]))
                at += len(piece)
                # What is left of the set looked up lies beyond the last shingle of the piece.
                if overlap + min(n - int(np.searchsorted(own, piece[-1], "right")), largest - at) < need:
                    possible = False
                    break
            if possible:
                for x in ends:
                    if overlap >= needed(n, depth):
                        yield x
                stack += [(c, overlap) for c in children]


def forest(sets: list[np.ndarray], counts: np.ndarray, comps: list | None = None, hubs: list[int] | None = None) -> list[tuple]:
    """What the links of these sets (or of those numbered hubs with the others) connect beyond the
    components given: pairs of a component and the smallest one that it comes to."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -_weight(values, counts)))] = np.arange(len(values))
    numbers, cut = [], 0
    for s in sets:
        numbers.append(np.sort(rank[at[cut : cut + len(s)]]))
        cut += len(s)
    comps = comps or list(range(len(sets)))
    names = sorted(set(comps))
    number = {c: i for i, c in enumerate(names)}
    comp, became = np.array([number[c] for c in comps]), np.arange(len(names))
    tree, mask = Tree(numbers), np.zeros(len(values), bool)
    for i in range(len(sets)) if hubs is None else hubs:
        if (comp == comp[0]).all():
            break
        own = numbers[i]
        mask[own] = True
        # Sets that were looked up before have found this one.
        for j in tree.partners(own, mask, lambda below: bool((comp[below] == comp[i]).all()) or hubs is None and below.max() <= i):
            if (a := comp[i]) != (b := comp[j]):
                comp[comp == max(a, b)] = min(a, b)
                became[became == max(a, b)] = min(a, b)
        mask[own] = False
    return [(names[i], names[b]) for i, b in enumerate(became.tolist()) if i != b]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and class; and in rows of their own, a task's bucket counts by segment."""
    total = np.zeros(BUCKETS, np.uint32)
    names = ["doc_id", "tie", "n_shingles", "class", "segment", "counts"]
    for batch in batches:
        sizes, classes, met = [], [], [np.zeros(0, np.uint64)]
        for text in batch.column("text").to_pylist():
            own = shingles(text)
            met.append(own)
            sizes.append(len(own))
            classes.append(class_of(own))
        total += np.bincount((np.concatenate(met) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
        none = [pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *none], names)
    rows = total.reshape(-1, SEGMENT)
    at = np.flatnonzero(rows.any(1))
    none = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at, pa.int32()), pa.array([_narrow(rows[i]) for i in at], pa.binary())], names)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts of a segment in as many bytes each as the largest needs."""
    most = int(counts.max())
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // SEGMENT}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of all tasks, added up by segment as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if i not in total:
                total[i] = np.zeros(SEGMENT, np.uint64)
            total[i] += _wide(raw)
    values = [_narrow(np.minimum(v, np.iinfo(np.uint32).max)) for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(values, pa.binary())], ["segment", "counts"])


def _weight(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)


def _order(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the global order sorts by, rare buckets first."""
    return (_weight(own, counts).astype(np.uint64) << np.uint64(32)) | (own >> np.uint64(32))


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


SALTED = 1 << 31


def _postings(docs: DataFrame, shared: Broadcast, limit: float, parts: int) -> DataFrame:
    """part, raw: the shingles in prefixes, packed by part: 8 bytes for the class, 4 for its size, 6
    of the shingle. A class comes once for each batch. Parts are dealt by shingle, those of buckets
    with a count over limit by shingle and class."""

    def packed(tokens: np.ndarray, classes: np.ndarray, sizes: np.ndarray, salts: np.ndarray) -> pa.RecordBatch:
        to = ((tokens ^ (tokens >> np.uint64(23))) + salts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        to, tokens, classes = to[order], tokens[order], classes[order]
        sizes = (sizes | np.where(salts > 0, SALTED, 0))[order].astype("<u4")
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        short = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        raw = [classes[a:b].astype("<i8").tobytes() + sizes[a:b].tobytes() + short[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=True)] if len(to) else []
        return pa.RecordBatch.from_arrays([pa.array(to[starts].astype(np.int64), pa.int64()), pa.array(raw, pa.binary())], ["part", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            seen, held = set(), []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                name = class_of(own)
                if name is None or name in seen:
                    continue
                seen.add(name)
                n = len(own)
                order = _order(own, counts)
                p = prefix_size(n)
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                salt = np.where((order[first] >> np.uint64(32)).astype(np.int64) > limit, 1 + name % 1023, 0)
                held.append((own[first], np.full(p, name), np.full(p, n), salt))
            if held:
                yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.select("text").mapInArrow(run, "part long, raw binary")


def _runs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    return starts, np.diff(np.r_[starts, len(token)])


def _neighbours(token: np.ndarray, name: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes near enough in size, with the number of shingles that they share: all pairs of
    shingles with a few classes, those next to each other in size of others. In order of token and size."""
    _, lengths = _runs(token)
    few = np.repeat(lengths, lengths) <= FEW
    ones, others = [], []
    for d in range(1, FEW):
        ok = (token[d:] == token[:-d]) & (4 * size[:-d] >= 3 * size[d:])
        if d > NEXT:
            ok &= few[d:]
        at = np.flatnonzero(ok)
        if not len(at) and d > NEXT:
            break
        ones.append(name[at])
        others.append(name[at + d])
    one, other = np.concatenate(ones), np.concatenate(others)
    a, b = np.minimum(one, other), np.maximum(one, other)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return a[first], b[first], np.diff(np.r_[first, len(a)])


def _shared(postings: DataFrame, parts: int) -> DataFrame:
    """token, class, size of postings whose token another class has that is near enough in size for a
    link, each once; those of common buckets, which are dealt by class, all stay. In rows of their
    own, class, other and k: pairs of _neighbours, added up within a partition."""
    names = ["token", "class", "size", "other", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, sizes = [], [], []
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                n = len(raw) // 18
                classes.append(np.frombuffer(raw, "<i8", n))
                sizes.append(np.frombuffer(raw, "<u4", n, 8 * n))
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 12 * n).reshape(n, 6)
                tokens.append(wide.view("<i8").ravel())
        if not tokens:
            return
        token, name, size = np.concatenate(tokens), np.concatenate(classes), np.concatenate(sizes).astype(np.int64)
        del tokens, classes, sizes
        order = np.argsort(token, kind="stable")
        token, name, size = token[order], name[order], size[order]
        edge = np.r_[False, token[1:] == token[:-1], False]
        some = edge[1:] | edge[:-1] | (size >= SALTED)
        token, name, size = token[some], name[some], size[some]
        order = np.lexsort((name, size, token))
        token, name, size = token[order], name[order], size[order]
        first = np.r_[True, (token[1:] != token[:-1]) | (name[1:] != name[:-1])][: len(token)]
        token, name, size = token[first], name[first], size[first]
        salted, size = size >= SALTED, size % SALTED
        # In order of size, a partner near enough is next to a set if there is one.
        near = (token[1:] == token[:-1]) & (4 * size[:-1] >= 3 * size[1:])
        stays = np.r_[False, near][: len(token)] | np.r_[near, False][: len(token)] | salted
        token, name, size, salted = token[stays], name[stays], size[stays], salted[stays]
        none = pa.nulls(len(token), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(name), pa.array(size), none, none], names)
        if len(token):
            a, b, k = _neighbours(token[~salted], name[~salted], size[~salted])
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(a), none, pa.array(b), pa.array(k)], names)

    return postings.repartition(parts, "part").mapInArrow(run, "token long, class long, size long, other long, k long")


def _homes(pairs: DataFrame) -> DataFrame:
    """class, home: every class of pairs (class, other, k) goes to the one that it shares most with, and
    on from there; the two that share most with each other, where this ends, name the home."""
    one = pairs.groupBy("class", "other").agg(F.sum("k").alias("k"))
    # Ties by the pair itself, so that going on ends at such two.
    weight = F.struct("k", "class", "other")
    both = one.select(F.col("class").alias("v"), F.col("other").alias("w"), weight.alias("e")).union(one.select("other", "class", weight))
    best = stash(both.groupBy("v").agg(F.max_by("w", "e").alias("w")))
    twice = lambda p: p.alias("p").join(p.alias("q"), F.col("p.w") == F.col("q.v")).select("p.v", "q.w")
    four = stash(twice(twice(best)))
    ends = four.alias("p").join(best.alias("q"), F.col("p.w") == F.col("q.v"))
    return ends.select(F.col("p.v").alias("class"), F.least("p.w", "q.w").alias("home"))


def _dealt(members: DataFrame) -> DataFrame:
    """members (home, class, ...) that share a home, with part: parts have about BLOCK members at most."""
    sizes = members.groupBy("home").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    return members.join(sizes, "home").select(*members.columns, F.pmod(F.xxhash64("class"), parts).alias("part"))


def _meetings(members: DataFrame, shared: Broadcast) -> DataFrame:
    """The components (a) that meetings of members (home, part, class, comp, rank, hub, text) connect with
    others (b), which are first by rank and name. Where a meeting has a hub, only its links are looked for."""
    cols = ["home", "part", "class", "comp", "rank", "hub", "text"]

    def joined(rows: dict[int, tuple]) -> list[tuple]:
        if len({r[0] for r in rows.values()}) < 2:
            return []
        own = [rows[c] for c in sorted(rows)]
        hubs = [i for i, r in enumerate(own) if r[1]]
        return forest([shingles(r[2]) for r in own], shared.value, [r[0] for r in own], hubs or None)

    def batch_of(links: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i][1] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, links = None, {}, []
        for batch in batches:
            for home, part, name, comp, rank, hub, text in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if (home, part) != here:
                    links += joined(rows)
                    here, rows = (home, part), {}
                rows[name] = ((rank, comp), hub, text)
            yield batch_of(links)
            links = []
        yield batch_of(joined(rows))

    dealt = members.select(cols).repartition("home", "part").sortWithinPartitions("home", "part")
    return dealt.mapInArrow(run, "a long, b long")


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """comp, new, doc: components that links connect, the one of smallest document and class that each
    comes to, and that document. A component has the name of a class of its smallest document."""
    doc = classes.select(F.col("class").alias("v"), "doc")
    named = small(links).join(doc.withColumnsRenamed({"v": "a", "doc": "a_doc"}), "a").join(doc.withColumnsRenamed({"v": "b", "doc": "b_doc"}), "b")
    found = components(named.select(F.struct(F.col("a_doc").alias("doc"), F.col("a").alias("class")).alias("a"), F.struct(F.col("b_doc").alias("doc"), F.col("b").alias("class")).alias("b")))
    return found.where("v != label").select(F.col("v.class").alias("comp"), F.col("label.class").alias("new"), F.col("label.doc").alias("doc"))


def _relabelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """frame, whose column comp goes to its new one."""
    new = small(labels.select(F.col("comp").alias("v"), "new"))
    return frame.join(new, frame["comp"] == new["v"], "left").withColumn("comp", F.coalesce("new", "comp")).select(*frame.columns)


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows whose token has several components."""
    tokens = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return rows.join(tokens, "token")


def _groups(comps: DataFrame) -> DataFrame:
    """comp, n, lo, hi, last: classes and sizes of every component; last, where it has one class, is the
    order of its last prefix shingle."""
    return stash(comps.groupBy("comp").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.when(F.count("*") == 1, F.max("last")).alias("last")))


NEAR = "comp_a < comp_b AND 4 * hi_a >= 3 * lo_b AND 4 * hi_b >= 3 * lo_a"


def _tried(crowded: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """comp_a, n_a, comp_b, n_b, k: components that meet at k places of shingles, whose components are
    dealt to places; of each component's pairs, dealt to TRIES lots, the one of each lot that meets most."""
    held = crowded.select("token", "comp").distinct()
    n = held.groupBy("token").agg(F.count("*").alias("m"))
    spot = F.pmod(F.xxhash64("comp", F.lit(turn)), F.ceil(F.col("m") / SPOT).cast("long"))
    met = stash(held.join(n, "token").join(small(groups), "comp").select("token", spot.alias("spot"), "comp", "n", "lo", "hi"))
    a, b = (met.select("token", "spot", *(F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", "lo", "hi"))) for x in "ab")
    pairs = a.join(b, ["token", "spot"]).where(NEAR).groupBy("comp_a", "comp_b").agg(F.count("*").alias("k"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return _likeliest(pairs, F.pmod(F.xxhash64("comp_a", "comp_b", F.lit(turn)), F.lit(TRIES)))


def _likeliest(pairs: DataFrame, lot: Column | None = None) -> DataFrame:
    """Of each component's pairs (in each lot), the one that shares most."""
    pair = F.struct("k", "comp_a", "comp_b", "n_a", "n_b").alias("pair")
    of = pairs.select(F.explode(F.array("comp_a", "comp_b")).alias("of"), (F.lit(0) if lot is None else lot).alias("lot"), pair)
    return of.groupBy("of", "lot").agg(F.max("pair").alias("pair")).select("pair.comp_a", "pair.n_a", "pair.comp_b", "pair.n_b", "pair.k").dropDuplicates()


def _possible(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """comp_a, n_a, comp_b, n_b, k: the components that share k prefix shingles and may link. Up to the end
    of the prefix that ends first, all shingles that two sets share are in both prefixes and so
    among the k; at most what that set has beyond may be shared too, three quarters of it. (One more,
    as the order's key is shorter than a shingle.) Of components with several classes, whose
    sizes lie from lo to hi, the best case counts."""
    # Shingles that mostly have the same components are one family, in which two components meet once.
    by = F.struct(F.xxhash64("comp").alias("h"), "comp")
    families = rows.groupBy("token").agg(F.min(by).alias("one"), F.max(by).alias("other")).where("one.comp != other.comp").select("token", F.col("one.comp").alias("family"))
    met = stash(rows.join(families, "token").groupBy("family", "comp").agg(F.collect_set("token").alias("tokens")))
    groups = groups.join(met.groupBy("comp").agg(F.sum(F.size("tokens")).alias("m")), "comp")
    held = met.join(small(stash(groups)), "comp")
    a, b = (held.select("family", *(F.col(c).alias(f"{c}_{x}") for c in ("comp", "tokens", "n", "lo", "hi", "last", "m"))) for x in "ab")
    # last: the order of the last prefix shingle, where a component has one class.
    needs = lambda n, m, ends: f"3 * ({n} + {m}) / 7D - ceil(0.75D * {ends})"
    first, second = ([needs(f"{x}_a", f"{y}_b", f"{x}_a" if end == "a" else f"{y}_b") for x in ("lo", "hi") for y in ("lo", "hi")] for end in "ab")
    low = lambda c: f"least({', '.join(c)})"
    need = F.expr(f"CASE WHEN last_a < last_b THEN {low(first)} WHEN last_a > last_b THEN {low(second)} ELSE {low(first + second)} END")
    here = F.size(F.array_intersect("tokens_a", "tokens_b"))
    # What two share elsewhere is at most what each has elsewhere.
    most = here + F.least(F.col("m_a") - F.size("tokens_a"), F.col("m_b") - F.size("tokens_b"))
    near = a.join(b, "family").where(NEAR).where("arrays_overlap(tokens_a, tokens_b)").where(most + 1 >= need).withColumn("k", here)
    pairs = near.groupBy("comp_a", "comp_b").agg(F.sum("k").alias("k"), *(F.first(f"{c}_{x}").alias(f"{c}_{x}") for c in ("n", "lo", "hi", "last") for x in "ab"))
    return pairs.where(F.col("k") + 1 >= need).select("comp_a", "n_a", "comp_b", "n_b", "k")


def _faced(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """home, part, class, hub: meetings in which each class of the smaller component of a pair (comp_a,
    n_a, comp_b, n_b) is looked up among those of the larger one, the home; a home's classes and its
    hubs are dealt to parts of about BLOCK each."""
    larger = F.col("n_a") >= F.col("n_b")
    ends = pairs.select(F.when(larger, F.col("comp_a")).otherwise(F.col("comp_b")).alias("home"), F.greatest("n_a", "n_b").alias("n"), F.when(larger, F.col("comp_b")).otherwise(F.col("comp_a")).alias("guest"))
    guests = stash(ends.join(comps.select("class", F.col("comp").alias("guest")), "guest").select("home", "n", "class"))
    homes = guests.groupBy("home").agg(F.ceil(F.first("n") / BLOCK).cast("long").alias("parts"), F.ceil(F.count("*") / BLOCK).cast("long").alias("lots"))
    lot = lambda c: F.pmod(F.xxhash64("class"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("each")
    hubs = guests.join(homes, "home").select("home", "class", "lots", lot("lots").alias("lot"), each("parts")).select("home", (F.col("each") * F.col("lots") + F.col("lot")).alias("part"), "class", F.lit(True).alias("hub"))
    hosts = homes.join(comps.select("class", F.col("comp").alias("home")), "home").select("home", "class", "lots", lot("parts").alias("own"), each("lots")).select("home", (F.col("own") * F.col("lots") + F.col("each")).alias("part"), "class", F.lit(False).alias("hub"))
    return stash(hubs.union(hosts))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, class of every row of docs (doc_id, text); class, doc_id (its smallest),
    comp and comp_doc (the smallest document and class of its component) of every class. Null ids are NULL_ID."""
    docs = pick(docs, "doc_id", "text").select(long_id().alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    read = stash(docs.mapInArrow(_classes, "doc_id long, tie long, n_shingles long, class long, segment int, counts binary"))
    rows = read.where("segment IS NULL").select("doc_id", "tie", "n_shingles", "class")
    counts = np.zeros((BUCKETS // SEGMENT, SEGMENT), np.uint32)
    added = read.where("segment IS NOT NULL").select("segment", "counts").repartition("segment").mapInArrow(_added, "segment int, counts binary")
    for r in added.collect():  # BUCKETS numbers at most
        counts[r.segment] = _wide(r.counts)
    counts = counts.ravel()
    parts = 1 + int(counts.sum(dtype=np.int64)) // (4 * PART)
    shared_counts = docs.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers, once for all that follows
    met = stash(_shared(_postings(docs, shared_counts, max(COMMON, 4 * float(counts.mean())), parts), parts))
    shared = met.where("token IS NOT NULL").select("token", "class", "size")
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "tie")).alias("one")).select("class", "one.*")
    homes = stash(_homes(met.where("other IS NOT NULL").select("class", "other", "k")))
    wanted = shared.select("class").distinct().join(_dealt(homes), "class", "left").join(first, "class").withColumnRenamed("class", "wanted")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "wanted", "home", "part", "text"]
        for batch in batches:
            own = [shingles(t) for t in batch.column("text").to_pylist()]
            last = [int(np.partition(o, p - 1)[p - 1]) if p < len(o) else int(o.max()) for s in own for o, p in [(_order(s, shared_counts.value), prefix_size(len(s)))]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(s) for s in own], pa.int64()), pa.array(last, pa.int64())], ["doc", "class", "home", "part", "text", "size", "last"])

    found = docs.join(small(stash(wanted)), ["doc_id", "tie"]).select("doc_id", "wanted", "home", "part", "text")
    texts = stash(found.mapInArrow(texts_of, "doc long, class long, home long, part long, text string, size long, last long"))
    classes = texts.select("class", "doc", "size", "last").dropDuplicates(["class"])
    links = _meetings(texts.where("part IS NOT NULL").select("home", "part", "class", F.col("class").alias("comp"), F.col("doc").alias("rank"), F.lit(False).alias("hub"), "text"), shared_counts)
    # A class is in one such meeting, and so its component is known without further rounds.
    linked = stash(links.withColumnsRenamed({"a": "class", "b": "comp"}))
    comps = stash(classes.join(small(linked), "class", "left").select("class", "doc", "size", "last", F.coalesce("comp", "class").alias("comp")))
    open_ = stash(_mixed(shared.join(small(comps.select("class", "comp")), "class")))
    # Crowded tokens: many pairs of classes in different components, most of which are in one soon.
    per = open_.groupBy("token", "comp").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    crowded = stash(open_.join(per.where((F.col("n") * F.col("n") - F.col("own")) / 2 > MANY).select("token"), "token"))

    def met_by(pairs: DataFrame, then: DataFrame, comps: DataFrame) -> tuple[DataFrame, int]:
        """comps after pairs of components, of the classes that `then` gives them, have met; links found."""
        members = _faced(pairs, then)
        found = texts.select("class", "text").join(small(members), "class").join(small(comps.select("class", "comp")), "class")
        links = stash(_meetings(found.select("home", "part", "class", "comp", F.lit(0).alias("rank"), "hub", "text"), shared_counts))
        got = links.count()
        return stash(_relabelled(comps, _labels(links, comps))) if got else comps, got

    for turn in range(1, TURNS + 1):
        pairs = stash(_tried(crowded, _groups(comps), turn))
        if not (n := pairs.count()):
            break
        comps, got = met_by(pairs, comps, comps)
        if 50 * got < n:
            break
        before = crowded
        crowded = stash(_mixed(crowded.drop("comp").join(small(comps.select("class", "comp")), "class")))
        discard(before)
    # What is left: components of that moment meet whole, the likeliest first, as most others are one then.
    then = comps
    pairs = stash(_possible(open_.drop("comp").join(small(comps.select("class", "comp")), "class"), _groups(comps)))
    first_ones = stash(_likeliest(pairs))
    for some in (first_ones, pairs.join(first_ones, ["comp_a", "comp_b"], "left_anti")):
        now = small(stash(then.where("class = comp").select("class").join(comps.select("class", F.col("comp").alias("now")), "class")))
        a, b = (now.select(F.col("class").alias(f"comp_{x}"), F.col("now").alias(f"now_{x}")) for x in "ab")
        some = stash(some.join(a, "comp_a").join(b, "comp_b").where("now_a != now_b").select(*pairs.columns))
        if not some.isEmpty():
            comps, _ = met_by(some, then, comps)
    # A component has the name of a class, and its smallest document is that class's.
    roots = stash(comps.where("class = comp").select(F.col("class").alias("comp"), F.col("doc").alias("comp_doc")))
    final = first.join(stash(comps.join(small(roots), "comp").select("class", "comp", "comp_doc")), "class", "left")
    discard(met, homes, texts, open_, crowded)
    shared_counts.unpersist()
    return rows, final.select("class", "doc_id", F.coalesce("comp", "class").alias("comp"), F.coalesce("comp_doc", "doc_id").alias("comp_doc"))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows, final = _joined(docs)
    joined = rows.join(final.select("class", F.col("comp_doc").alias("component_id")), "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumns({"doc_id": real_id("doc_id"), "component_id": real_id("component_id")})


def _with_class(docs: DataFrame, text: str) -> DataFrame:
    """docs, whose names are distinct, with the class of the column text as _class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([class_of(shingles(t)) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "_class"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{names}, _class long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with all columns, one of each component: one with the smallest id, and of
    its classes with that id the smallest. A row goes only if its own text is in the component of
    one that stays, whatever its id: rows that share or lack an id stay if their texts don't link,
    and so do all rows with empty sets."""
    rows, classes = _joined(docs)
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = F.coalesce(flat[f"c{docs.columns.index('doc_id')}"].cast("long"), F.lit(NULL_ID))
    if not pick(docs, "doc_id").select(long_id()).toDF("id").groupBy("id").count().where("count > 1").limit(1).count():
        gone = stash(rows.join(classes.select("class", "comp_doc"), "class").where("doc_id != comp_doc").select(F.col("doc_id").alias("_id")))
        return flat.join(small(gone), own == gone["_id"], "left_anti").toDF(*docs.columns)
    # Ids don't name rows here: their classes do.
    first = classes.where("comp = class").select(F.col("doc_id").alias("_id"), F.col("class").alias("_own"))
    named = _with_class(flat.withColumn("_doc", own), f"c{docs.columns.index('text')}")
    kept = named.where("_class IS NOT NULL").join(first, (F.col("_doc") == F.col("_id")) & (F.col("_class") == F.col("_own")), "left_semi")
    return kept.dropDuplicates(["_doc", "_class"]).union(named.where("_class IS NULL")).select(*flat.columns).toDF(*docs.columns)


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' ' || len(w) ELSE '' END) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id != b.doc_id JOIN sz p ON p.doc_id = a.doc_id JOIN sz q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach(doc_id, other) AS (SELECT x, y FROM pairs UNION SELECT r.doc_id, p.y FROM reach r JOIN pairs p ON r.other = p.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)"""
