"""Suffix arrays by induced sorting, and permuted longest-common-prefix values, of one shard.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S
suffixes (LMS) are sorted by inducing, named, and, where two have one name, sorted by recursion on
the string of names; the order of all suffixes is then induced from theirs in linear time. On
bytes, a bucket of suffixes is induced at once with numpy; in the recursion, whose alphabet is as
long as its string, one by one.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; the last one, the sentinel, is."""
    n = len(s)
    if n == 1:
        return np.ones(1, bool)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.r_[np.where(at < n - 1, step[np.minimum(at, n - 2)] > 0, False), True]


def _lms(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _induce_bytes(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes from the order of the LMS suffixes, bucket by bucket."""
    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, np.int64)
    chars = s[lms]
    order = np.argsort(chars, kind="stable")
    held = np.bincount(chars, minlength=sigma)
    sa[np.repeat(tails - held, held) + np.arange(len(lms)) - np.repeat(np.cumsum(held) - held, held)] = lms[order]
    filled = heads.copy()

    def place(batch: np.ndarray, larger: bool) -> None:
        j = batch - 1
        j = j[j >= 0]
        j = j[is_s[j] != larger]
        if not len(j):
            return
        c = s[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        first = np.r_[True, c[1:] != c[:-1]]
        starts = np.flatnonzero(first)
        nth = np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
        own, size = c[starts], np.diff(np.r_[starts, len(c)])
        if larger:
            sa[filled[c] + nth] = j
            filled[own] += size
        else:
            sa[filled[c] - 1 - nth] = j
            filled[own] -= size

    used = np.flatnonzero(counts)
    for c in used:
        done = heads[c]
        while done < filled[c]:
            end = filled[c]
            place(sa[done:end].copy(), True)
            done = end
        place(sa[tails[c] - held[c] : tails[c]].copy(), True)
    larger_end = filled
    filled = tails.copy()
    filled[0] = tails[0] - held[0]  # the sentinel stays
    for c in used[::-1]:
        if not c:
            continue
        done = tails[c]
        while done > filled[c]:
            end = filled[c]
            place(sa[end:done][::-1].copy(), False)
            done = end
        place(sa[heads[c] : larger_end[c]][::-1].copy(), False)
    return sa


def _induce_names(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same, one suffix at a time. The lists are read while they are filled; 0 stands for an
    empty place as well as for the first suffix, as neither has a suffix before it to be placed."""
    tails = np.cumsum(np.bincount(s, minlength=sigma))
    heads = np.r_[0, tails[:-1]].tolist()
    chars = s[lms]
    held = np.bincount(chars, minlength=sigma)
    start = np.zeros(len(s), np.int64)
    start[np.repeat(tails - held, held) + np.arange(len(lms)) - np.repeat(np.cumsum(held) - held, held)] = lms[np.argsort(chars, kind="stable")]
    sa = start.tolist()
    larger = np.where(is_s, -1, s).tolist()
    smaller = np.where(is_s, s, -1).tolist()
    smaller[-1] = -1
    for i in sa:
        c = larger[i - 1]
        if c >= 0:
            at = heads[c]
            sa[at] = i - 1
            heads[c] = at + 1
    ends = (tails - 1).tolist()
    for i in reversed(sa):
        c = smaller[i - 1]
        if c >= 0:
            at = ends[c]
            sa[at] = i - 1
            ends[c] = at - 1
    return np.array(sa, np.int64)


def _named(s: np.ndarray, is_s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, which are given in order, by position in the string; how many."""
    position = np.sort(order)
    length = np.zeros(len(s), np.int64)
    length[position] = np.diff(np.r_[position, len(s) - 1]) + 1
    size = length[order]
    same = np.zeros(len(order), bool)
    equal = np.flatnonzero(size[1:] == size[:-1]) + 1
    kinds = s.astype(np.int64) * 2 + is_s
    for m in np.unique(size[equal]):
        pairs = equal[size[equal] == m]
        for block in np.array_split(pairs, 1 + len(pairs) * int(m) // 4_000_000):
            a, b = order[block - 1], order[block]
            ok = np.ones(len(block), bool)
            for k in range(int(m)):
                live = np.flatnonzero(ok)
                if not len(live):
                    break
                ok[live] = kinds[a[live] + k] == kinds[b[live] + k]
            same[block] = ok
    names = np.zeros(len(s), np.int64)
    names[order] = np.cumsum(~same) - 1
    return names[position], int((~same).sum())


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """s: integers below sigma, the last of them 0 and no other."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = sigma <= 1024
    is_s = _types(s)
    lms = _lms(is_s)

    def induce(order: np.ndarray) -> np.ndarray:
        if small:
            return _induce_bytes(s, is_s, order, sigma)
        return _induce_names(s, is_s, order, sigma)

    rough = induce(lms)
    marks = np.zeros(len(s), bool)
    marks[lms] = True
    order = rough[marks[rough]]
    names, n_names = _named(s, is_s, order)
    if n_names < len(lms):
        order = lms[suffix_array(names, n_names)]
    return induce(order)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, most: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For every position the suffix before it in sa (-1: none) and the length of their common
    prefix, up to `most` at least. Every step-th position is compared from the start; the others
    from the length that the one before them leaves, as a permuted value is at least the last less
    one. Eight places are compared at once, so that s must be below 256."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    padded = np.r_[s, np.zeros(8, s.dtype)].astype(np.uint8)
    words = np.ndarray((n,), "<u8", padded.data, strides=(1,))

    def leap(at: np.ndarray, limit: int) -> None:
        at = at[before[at] >= 0]
        while len(at):
            at = at[lcp[at] < limit]
            i, j = at + lcp[at], before[at] + lcp[at]
            ok = np.maximum(i, j) < n
            at, i, j = at[ok], i[ok], j[ok]
            differ = words[i] ^ words[j]
            same = differ == 0
            lcp[at[same]] += 8
            lowest = differ[~same]
            lcp[at[~same]] += np.log2((lowest & (~lowest + np.uint64(1))).astype(float)).astype(np.int64) >> 3
            at = at[same]

    leap(np.arange(0, n, step), most + step)
    for k in range(1, step):
        at = np.arange(k, n, step)
        lcp[at] = np.maximum(lcp[at - 1] - 1, 0)
        at = at[before[at] >= 0]
        leap(at, most + step - k)
    lcp[before < 0] = 0
    return before, lcp


def repeated_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text, whether the `width` bytes that start at each of its places also start at
    another place of these texts."""
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int32) + 2  # UTF-8 has no byte over 0xF4
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 1
    joined = np.r_[joined, np.int32(0)]
    sa = suffix_array(joined, 258)
    before, lcp = permuted_lcp(joined, sa, width)
    twice = lcp >= width
    twice[before[twice]] = True
    return [twice[e - n : e - width + 1] if n >= width else np.zeros(0, bool) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
